import pytest
from pyspark.sql import functions as F

from voxloom.llm import forms, lookalikes

SAME = [
    ("ɡood", "good"), ("ρarty", "party"), ("νice", "vice"), ("օk", "ok"), ("ⅼist", "list"), ("ӏ", "l"), ("𝐡𝐞𝐥𝐥𝐨", "hello"), ("𝛂", "a"), ("\u0d94\u0dca", "\u0d95"), ("\u0d94\u200b\u0dca", "\u0d95"),
    ("Ａ１", "A1"), ("е", "e"), ("é", "\xe9"), ("ё", "\xeb"), ("a\xa0b", "a b"), ("a　b", "a b"), ("a​b", "ab"), ("a\xadb﻿", "ab"), ("l’h", "l'h"), ("lʼh", "l'h"),
    ("ො", "ො"), ("ේ", "ේ"), ("ෝ", "ෝ"), ("අා", "ආ"),
    ("ක‍ය", "කය"), ("ක්‌ය", "ක්ය"), ("ක්​‍ය", "ක්‍ය"),
]
OTHER = [("a b", "a  b"), ("A", "a"), ("a.", "a"), ("10\xb2", "102"), ("ක්‍ය", "ක්ය"), ("“a”", '"a"'), ("\xdf", "ss")]


@pytest.mark.parametrize("a, b", SAME)
def test_look_the_same(a, b):
    assert forms.visual_form(a) == forms.visual_form(b) == b
    assert lookalikes.Trie([b, b + "x", "x"]).spelling(a) == b
    assert lookalikes.base_hash(a) == lookalikes.base_hash(b)


@pytest.mark.parametrize("a, b", OTHER)
def test_look_different(a, b):
    assert forms.visual_form(a) != forms.visual_form(b)
    assert lookalikes.Trie([forms.visual_form(b)]).spelling(a) is None


def test_column_settles_everything(spark):
    texts = [x for pair in SAME + OTHER for x in pair] + [None, "", " "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", forms.visual_form_column(F.col("text")).alias("f")).collect()
    for r in got:
        assert r.f == (None if r.text is None else forms.visual_form(r.text))


def test_pairs(spark):
    rows = [("t", "k1", "a b"), ("t", "k2", "a\xa0b"), ("t", "k2", "a\xa0b"), ("t", "k3", "a b"), ("u", "k4", "a b"), ("t", "k5", None), ("t", "k6", ""), ("t", "k7", "е"), ("t", "k8", "e"), ("t", "k0", "​")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "tbl string, key string, text string, form int")
    marked = lookalikes.unsettled_rows(df)
    formed = lookalikes.unsettled_forms(marked, lambda x: x)
    got = sorted(tuple(r) for r in lookalikes.same_looking_pairs(marked, formed).collect())
    assert got == [("t", "k1", "k2"), ("t", "k2", "k3"), ("t", "k7", "k8")]
    none = lookalikes.unsettled_rows(df.limit(0))
    assert lookalikes.same_looking_pairs(none, lookalikes.unsettled_forms(none, lambda x: x)).count() == 0


def test_hash_tells_words_of_other_scripts_apart():
    for words in (["ไทย", "ภาษา", "คำ"], ["كتاب", "بيت", "قلم"], ["한국", "나라", "말"], ["घर", "पानी", "काम"], ["дом", "лес", "мир", "год"], ["λόγος", "ψυχή"]):
        assert len({lookalikes.base_hash(w) for w in words}) == len(words)


def test_classes(spark):
    rows = [("t", "k1", "a b"), ("t", "k2", "a\xa0b"), ("t", "k3", "a b"), ("t", "k4", "x"), ("u", "k5", "a b")] + [("t", f"n{i}", "a b") for i in range(50)]
    marked = lookalikes.unsettled_rows(spark.createDataFrame(rows, "tbl string, key string, text string"))
    formed = lookalikes.unsettled_forms(marked, lambda x: x)
    got = {r.key: (r["class"], r.links) for r in lookalikes.same_looking_classes(marked, formed).collect()}
    assert len(got) == 53 and len({c for c, _ in got.values()}) == 1 and got["k2"][1] == 52 and got["k1"][1] == 1
    assert sum(n for _, n in got.values()) == 2 * lookalikes.same_looking_pairs(marked, formed).count()
