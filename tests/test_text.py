import random
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from voxloom.functions import editdistance as E
from voxloom.functions import text as X


def one(spark, text, *columns):
    df = spark.createDataFrame([(text,)], "t string")
    return list(df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_words_keep_apostrophes_inside(spark):
    n = X.words(X.normalise(F.col("t")))
    assert one(spark, "Old Mara Teller's boat, painted.", n)[0] == ["old", "mara", "teller's", "boat", "painted"]
    assert one(spark, "'so' d’abord", n)[0] == ["so", "d'abord"]
    assert one(spark, "half-open door", n)[0] == ["half", "open", "door"]


def test_numbers_lose_separators(spark):
    for text in ("25,000", "25.000", "25 000", "25 000"):
        assert one(spark, text, X.normalise(F.col("t")))[0] == "25000"
    assert one(spark, "of 1931 1932", X.normalise(F.col("t")))[0] == "of 1931 1932"


def test_case_folding_and_characters(spark):
    assert one(spark, "Große ÎLE ΣΟΦΟΣ", X.normalise(F.col("t")))[0] == "grosse île σοφοσ"
    assert one(spark, "１０％", X.characters(X.normalise(F.col("t"))))[0] == "10"
    assert one(spark, "ශ්‍රී ලංකාව", F.length(X.characters(X.normalise(F.col("t")))), F.size(X.words(X.normalise(F.col("t"))))) == [9, 3]


def test_glosses(spark):
    bare = X.without_glosses(F.col("t"))
    assert one(spark, "米娜（Mina Peel）来了", bare)[0] == "米娜 来了"
    assert one(spark, "她（河边）来了", bare)[0] == "她（河边）来了"


def test_clean_and_key(spark):
    assert one(spark, " ‍ක‍  ශ්‍රී é ‍", X.clean(F.col("t")))[0] == "ක ශ්‍රී é"
    assert one(spark, "“Hello,  World!” ₤5", X.sentence_key(F.col("t")))[0] == "hello world ₤5"


def test_latin(spark):
    rows = spark.createDataFrame([(w,) for w in ("harbour", "île", "d'abord", "k9k", "එකට", "2018", "aක")], "t string")
    assert [r[0] for r in rows.select(X.is_latin(F.col("t"))).collect()] == [True, True, True, True, False, False, False]


def test_record_parts(spark):
    assert one(spark, "language Sinhala<asr_text>මම<asr_text>", X.language_of(F.col("t")), X.transcript_of(F.col("t"))) == ["Sinhala", "මම<asr_text>"]
    assert one(spark, "plain", X.language_of(F.col("t")), X.transcript_of(F.col("t"))) == [None, "plain"]
    assert one(spark, None, X.language_of(F.col("t")), X.transcript_of(F.col("t")), X.clean(F.col("t")), X.normalise(F.col("t"))) == [None] * 4


def test_flat_line(spark):
    assert one(spark, " a\tb c\n", X.flat_line(F.col("t")))[0] == "a b c"


def test_rounding_follows_c(spark):
    df = spark.createDataFrame([(0.0625,), (0.0005,), (None,)], "x double")
    assert [r[0] for r in df.select(X.fixed3(F.col("x"))).collect()] == ["0.062", "0.001", None]


def test_word_distance(spark):
    rows = [(list("kitten"), list("sitting"), 3), ([], ["a"], 1), (["a", "b"], [], 2), (["x"] * 3, ["x"] * 3, 0)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, d int")
    for r in df.select(E.word_distance(F.col("a"), F.col("b")).alias("got"), "d").collect():
        assert r.got == r.d


def test_shared_count(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "a", "a", "c"])], "a array<string>, b array<string>")
    assert df.select(E.shared_count(F.col("a"), F.col("b"))).first()[0] == 2


def test_forms_equal_the_standard_library():
    rng = random.Random(3)
    chars = [chr(c) for c in (*range(0x3000), *range(0xAC00, 0xAC40), *range(0x1100, 0x1200), *range(0xFF00, 0xFFF0))]
    texts = ["".join(rng.choices(chars, k=rng.randint(0, 6))) for _ in range(30_000)] + ["\u0dd9\u0dca", "\u0dd9\u0dcf\u0dca", "\u0dca\u0301", None]
    given = pa.array(texts, pa.string())
    for form in ("NFC", "NFKC"):
        assert X.normal(given, form).to_pylist() == [None if t is None else unicodedata.normalize(form, t) for t in texts]
    assert X.casefolded(given).to_pylist() == [None if t is None else t.casefold() for t in texts]


def test_distance_of_pairs_with_very_many_words(spark):
    words = [f"w{i}" for i in range(36_000)]
    df = spark.createDataFrame([(words[35_990:], words[35_991:])], "a array<string>, b array<string>")
    named = df.select(E.let(F.array(*map(F.lit, ("x", "y"))), lambda n: F.size(n)), E.word_distance(F.col("a"), F.col("b")).alias("d")).first()
    assert named.d == 1
    wide = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(36_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("a"))
    got = wide.select(E.word_distance(F.slice("a", 1, 40), F.slice("a", 3, 40)), F.length(E.coded(F.col("a"), F.slice("a", 35_300, 200)))).first()
    assert list(got) == [4, 200]


def test_language_is_added_as_the_list_is_written(spark):
    given = ['{"support_languages": ["A",\n  "B"], "other": 1}', '{ "x": [2], "support_languages":["A"] }', '{"support_languages":["Sinhala"],"z":0}', '{"support_languages":[]}', '{"z":1}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, c string")
    got = [r[0] for r in df.orderBy("i").select(X.with_language(F.col("c"), "Sinhala")).collect()]
    assert got == ['{"support_languages": ["A",\n  "B",\n  "Sinhala"], "other": 1}', '{ "x": [2], "support_languages":["A", "Sinhala"] }', given[2], None, None, None]
