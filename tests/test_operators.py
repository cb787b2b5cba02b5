import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import batching as B
from voxloom.operators import checks, leakage, manifest, ranking, scoring, speakers, tensors
from voxloom.operators import vocabulary as V


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_vocabulary_ranks_ties_by_first_appearance(spark):
    said = spark.createDataFrame([(0, "ක ග ග"), (1, "ජ ක ත"), (2, None), (3, "")], "pos long, text string")
    got = rows(V.vocabulary(V.count_words(said), 1, 2).orderBy("rank").select("word", "count", "rank", "chunk"))
    assert got == [("ක", 2, 1, 0), ("ග", 2, 2, 0), ("ජ", 1, 3, 1), ("ත", 1, 4, 1)]
    assert rows(V.coverage(V.count_words(said), 2)) == [(6, 4, 2, pytest.approx(100 * 4 / 6))]
    assert rows(V.coverage(V.count_words(said.limit(0)))) == [(0, 0, 0, 0.0)]


def test_ranks_across_buckets(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("major"), F.col("id").alias("minor"))
    got = rows(ranking.ranked(df, "major", "minor", 7).orderBy("rank").select("major", "minor", "rank"))
    assert [r[:2] for r in got] == sorted([(i % 3, i) for i in range(50)], key=lambda r: (-r[0], r[1])) and [r[2] for r in got] == list(range(1, 51))


def test_merge_first_wins_and_problems(spark):
    counts = spark.createDataFrame([("ක", 5, 0), ("ග", 7, 1)], "word string, count long, first_pos long")
    lines = [("a", 1, "ක\tE\tcar\tය"), ("a", 2, "ග\tN\tgoal"), ("b", 1, "ක\tP\tother\t"), ("b", 2, "ජ\tE\tx\t"), ("b", 3, "ග\tX\tx\t"), ("b", 4, "ග\tE\t\t"), ("b", 5, "ග\tE"), ("b", 6, " \t ")]
    judged = V.judged_lines(spark.createDataFrame(lines, "path string, line_no long, line string"), counts)
    merged = sorted(rows(V.merge(judged).select("word", "category", "english", "suffix", "frequency")))
    assert merged == [("ක", "E", "car", "ය", 5), ("ග", "N", "goal", "", 7)]
    found = {r.line_no: r.problem for r in judged.where("path = 'b' AND problem IS NOT NULL").collect()}
    assert found == {2: "not in the vocabulary", 3: "unknown category", 4: "no English spelling", 5: "expected 4 columns, got 2"}


def test_rewrite(spark):
    loans = spark.createDataFrame([("ආමි", "army", "එක"), ("බස්", "bus", ""), ("කාර්", "car", "යක්")], "word string, english string, suffix string")
    said = spark.createDataFrame([(1, "ආමි  බස් කාර් මම")], "pos long, text string")
    assert rows(V.rewritten(said, loans)) == [(1, "ආමි බස් කාර් මම", "army එක bus කාර් මම")]


def test_splits(spark):
    by = spark.createDataFrame([(f"s{i:02d}", i) for i in range(20)], "speaker string, utterances long")
    for split in (speakers.hash_split(by, 52, 4, 2), speakers.shuffled_split(by, 52, 4, 2)):
        assert {r[0]: r[1] for r in split.groupBy("split").count().collect()} == {"train": 14, "dev": 2, "test": 4}
    with pytest.raises(ValueError):
        speakers.hash_split(by, 52, 15, 5)
    with pytest.raises(ValueError):
        speakers.seeded_sample([1, 2], 3, 52)


def test_epoch_order_pinned():
    # fixed values: the first of the orders that the public generator gives
    a, b = (speakers.epoch_order(500, 7, e) for e in (0, 1))
    assert sorted(a) == list(range(500)) and a[:5] == [238, 384, 250, 140, 481] and b[:5] == [215, 262, 87, 138, 340]
    assert a != speakers.epoch_order(500, 8, 0)


def test_hold_out(spark):
    df = spark.createDataFrame([("train", "A b."), ("train", "c"), ("test", "a B"), ("dev", "d")], "split string, text string")
    keyed = leakage.keyed(df)
    assert sorted(r.text for r in leakage.hold_out(keyed).collect()) == ["a B", "c", "d"]
    assert rows(leakage.new_sentences(keyed).select("split", "text")) == [("dev_new", "d")]


def test_label_errors(spark):
    pairs = [("en_us", "A grey hen lays by the gate", "a grey hen lays by gate"), ("cmn_hans_cn", "米娜（Mina）唱歌", "米娜唱歌"), ("en_us", "", "x"), ("en_us", None, "x"), ("other", "a", "a")]
    got = scoring.label_errors(spark.createDataFrame(pairs, "source string, reference string, hypothesis string"))
    assert {(r.source, r.reference): r.error for r in got.collect()} == {("en_us", "A grey hen lays by the gate"): pytest.approx(1 / 7), ("cmn_hans_cn", "米娜（Mina）唱歌"): 0.0, ("en_us", ""): None}


def test_tally(spark):
    got = scoring.tally(spark.createDataFrame([("r", "ඔයා laptop එකේ බලන්න", "ඔයා ලැප්ටොප් එකේ බලන්න"), ("r", "ඒක update කළා නේද", "ඒ")], "run string, reference string, hypothesis string"), "run").first()
    assert (got.words, got.word_errors, got.truncated, got.latin_in_references, got.latin_in_hypotheses, got.latin_matched, got.utterances) == (8, 5, 1, 2, 0, 0, 2)


def test_summary_and_cut(spark):
    df = spark.createDataFrame([("en_us", 3600.0, 0.3004), ("en_us", 3600.0, 0.1), ("fr_fr", 1800.0, 0.4)], "source string, seconds double, error double")
    got = {r.source: (r.utterances, r.kept, r.hours) for r in scoring.summary(df).collect()}
    assert got == {"en_us": (2, 1, 2.0), "fr_fr": (1, 0, 0.5), "total": (3, 1, 2.5)}
    odd = df.union(spark.createDataFrame([("x", 1.0, float("nan")), ("x", 1.0, -0.1), ("x", 1.0, float("inf")), ("x", 1.0, None)], df.schema))
    assert scoring.cut(odd).count() == 2  # 0.3004 is written 0.300
    with pytest.raises(ValueError):
        scoring.cut(df, -1)


def test_upper_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    assert df.agg(scoring.upper_median("x")).first()[0] == 3.0
    assert df.limit(0).agg(scoring.upper_median("x")).first()[0] == 0.0


def test_sources():
    assert scoring.parse_sources(" fr_fr, ,en_us") == ["fr_fr", "en_us"]
    for bad in ("", "xx"):
        with pytest.raises(ValueError):
            scoring.parse_sources(bad)


@pytest.mark.parametrize("lengths, budget, expected", [([7, 33, 14, 29, 21, 3], 70, [[1, 3], [4, 2, 0], [5]]), ([90, 6, 6], 40, [[0], [1, 2]])])
def test_packing(spark, lengths, budget, expected):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(lengths)], "step long, at long, length long")
    got = {}
    for r in B.micro_batches(df, budget).collect():
        got.setdefault(r.batch, []).append(r["at"])
    assert [set(got[k]) for k in sorted(got)] == [set(x) for x in expected]


def test_audio_tokens(spark):
    # fixed values: frames of clips and the tokens that the public model makes of them
    df = spark.createDataFrame([(100, 13), (101, 14), (200, 26), (541, 76), (591, 88), (671, 96), (1000, 130), (1303, 170)], "f int, t int")
    assert all(r[0] == r[1] for r in df.select(B.audio_tokens(F.col("f")), "t").collect())


def test_chunks_and_windows(spark):
    clips = spark.createDataFrame([(0, 0, 1303), (0, 1, 541)], "batch int, clip int, frames int")
    chunks = B.clip_chunks(clips)
    assert rows(chunks.groupBy("clip").agg(F.sum("rows")).orderBy("clip")) == [(0, 170), (1, 76)]
    assert [(r.first_row, r.rows) for r in B.windows(chunks).orderBy("clip", "window").collect()] == [(0, 104), (104, 66), (170, 76)]


def test_schedule(spark):
    rates = [r[0] for r in spark.range(1579).select(B.learning_rate(F.col("id"), 1.0, 1578, 0.02)).collect()]
    assert rates[0] == 0 and rates[16] == 0.5 and rates[32] == 1.0 and rates[1578] == 0


def test_targets_and_gather(spark):
    df = spark.createDataFrame([([6, 40, 40, 7, 8, 5, 2], 4)], "ids array<int>, p int")
    assert [tuple(x) for x in df.select(B.targets(F.col("ids"), F.col("p"))).first()[0]] == [(3, 8), (4, 5), (5, 2)]
    got = spark.createDataFrame([([1, 50, 50, 2], [False, True, False, False], [0, 1, 0, 0], [7, 8])], "t array<int>, a array<boolean>, i array<int>, v array<int>")
    assert got.select(B.gathered(F.col("t"), F.col("a"), F.col("i"), F.col("v"))).first()[0] == [1, 8, 50, 2]


def test_tensors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [3.0, 2.0])], "k int, a array<float>, b array<float>")
    assert df.select(tensors.blend(F.col("a"), F.col("b"), 0.25)).first()[0] == [2.5, 2.0]
    with pytest.raises(ValueError):
        tensors.blend(F.col("a"), F.col("b"), 2)
    half = spark.createDataFrame([(1.001,), (-1.001,), (None,)], "x float")
    assert rows(half.select(tensors.rounded("bfloat16", True)(F.col("x")), tensors.rounded("bfloat16", False)(F.col("x")))) == [(1.0078125, 1.0), (-1.0, -1.0078125), (None, None)]
    seq = spark.createDataFrame([(["a", "b"], ["a", "c", "d"]), (["a"], ["a"])], "a array<string>, b array<string>")
    assert rows(seq.select(tensors.first_mismatch(F.col("a"), F.col("b")), tensors.match_share(F.col("a"), F.col("b")))) == [(1, pytest.approx(1 / 3)), (None, 1.0)]


def test_checks(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "name string, val string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("w", "4"), ("z", None)], "name string, val string")
    assert sorted(rows(checks.setting_differences(a, b, ("w",)))) == [("y", "2", "3")]
    with pytest.raises(ValueError):
        checks.enforce(checks.repeated(a.union(a), "name"))
    checks.enforce(checks.repeated(a, "name"))


def test_quantised_values_come_back(spark):
    import random

    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(20)] + [(20, [0.0] * 64)]
    df = spark.createDataFrame(rows, "k int, v array<float>")
    got = tensors.quantised(df, "k", "v", 32, 8).withColumn("back", tensors.dequantised(F.col("levels"), F.col("scale"), F.col("bias"))).collect()
    own = dict(rows)
    for r in got:
        assert max(abs(a - b) for a, b in zip(r.back, own[r.k][r.part * 32 : r.part * 32 + 32], strict=True)) <= abs(r.scale) * 0.5001 + 1e-6
        assert [(w >> (8 * i)) & 255 for w in r.packed for i in range(4)] == list(r.levels)


def test_right_padding(spark):
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0, 3.0],)], "x array<float>")
    assert rows(df.select(B.right_padded(F.col("x"), 2))) == [([1.0, 0.0],), ([1.0, 2.0, 3.0],)]


def test_git_id(spark):
    df = spark.createDataFrame([(bytearray(b"hello\n"),)], "c binary")
    assert df.select(manifest.git_id(F.col("c"))).first()[0] == "ce013625030ba8dba906f756967f9e9ca394464a"


def test_safe_members(spark):
    names = [("top/a.wav", False), ("../evil.wav", False), ("top/../b", False), ("/top/c", False), ("top/l", True), ("other/d", False)]
    assert [r.name for r in manifest.safe_members(spark.createDataFrame(names, "name string, is_link boolean"), "top").collect()] == ["top/a.wav"]


def test_choices_pass_over_incomplete_runs(monkeypatch):
    drawn = [1 << 63, 5, (1 << 64) - 1, 7, 9]
    monkeypatch.setattr(speakers, "draws", lambda state, n: np.array(drawn[state // speakers.GAMMA :][:n], np.uint64))
    assert speakers.choices(0, np.array([10, 6, 3])).tolist() == [(1 << 63) % 10, 5, 1]  # the third draw is left out
    assert speakers.draws(speakers.GAMMA, 1).tolist() == [5]
    with pytest.raises(ValueError):
        speakers.epoch_order(speakers.MOST + 1, 1, 0)


@pytest.mark.parametrize("dtype, kind", [("bfloat16", None), ("float16", np.float16)])
def test_outward_rounding_is_tight(dtype, kind):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal(5000) * 10.0 ** rng.integers(-9, 5, 5000), [0.0, 1.0, -1.0, 65504.0, 65505.0, -70000.0, 2.0**-24, 2.0**-26]]).astype(np.float32)
    up, down = tensors.outward(x, dtype, True), tensors.outward(x, dtype, False)
    assert (down <= x).all() and (x <= up).all()
    if kind is not None:
        same = x.astype(kind).astype(np.float32) == x
        assert (up[same] == x[same]).all() and (down[same] == x[same]).all()
        inner = ~same & np.isfinite(up) & np.isfinite(down)
        assert (np.nextafter(down[inner].astype(kind), kind(np.inf)) == up[inner].astype(kind)).all()
    else:
        bits = lambda v: v.view(np.uint32)
        assert not (bits(up[np.isfinite(up)]) & 0xFFFF).any() and not (bits(down) & 0xFFFF).any()
    assert tensors.outward(x, "float32", True).tolist() == x.tolist()


def test_grid_of_a_stored_type_spans_its_group(spark):
    rng = np.random.default_rng(5)
    rows_ = [(i, rng.normal(rng.normal(), 1, 32).astype(float).tolist()) for i in range(30)]
    own = dict(rows_)
    for dtype in ("bfloat16", "float16"):
        got = tensors.quantised(spark.createDataFrame(rows_, "k int, v array<float>"), "k", "v", 32, 8, dtype).withColumn("back", tensors.dequantised(F.col("levels"), F.col("scale"), F.col("bias"))).collect()
        for r in got:
            assert tensors.outward(np.array([r.scale, r.bias]), dtype, True).tolist() == [r.scale, r.bias]
            assert max(abs(a - b) for a, b in zip(r.back, own[r.k], strict=True)) <= abs(r.scale) * 0.5001 + 1e-6


def test_blend_shares(spark):
    df = spark.createDataFrame([(0.25, [4.0], [0.0]), (1.0, [4.0], [0.0])], "s double, a array<float>, b array<float>")
    assert rows(df.select(tensors.blend(F.col("a"), F.col("b"), F.col("s")))) == [([1.0],), ([4.0],)]
    with pytest.raises(Exception, match="a blend of"):
        df.select(tensors.blend(F.col("a"), F.col("b"), F.col("s") + 1)).collect()


def test_preparing_stops_without_a_split(spark):
    said = spark.createDataFrame([(0, "a", "ගෙදර", "/0"), (1, "b", "ගෙදර!", "/1"), (2, "a", "බස්", "/2"), (3, "a", "", "/3")], "pos long, speaker string, text string, audio string")
    split = spark.createDataFrame([("a", "train")], "speaker string, split string")
    loans = spark.createDataFrame([("බස්", "bus", "")], "word string, english string, suffix string")
    with pytest.raises(ValueError):
        leakage.prepared(said, split, loans)
    both = split.union(spark.createDataFrame([("b", "test")], split.schema))
    got = leakage.prepared(said, both, loans, spark.createDataFrame([("/0",), ("/1",), ("/2",)], "audio string"))
    assert sorted((r.pos, r.record) for r in got.collect()) == [(0, "language Sinhala<asr_text>ගෙදර"), (1, "language Sinhala<asr_text>ගෙදර!"), (2, "language Sinhala<asr_text>bus")]
    assert sorted(tuple(r) for r in leakage.training_files(got, True).select("file", "pos").collect()) == [("test", 1), ("test_new", 1), ("train", 2)]
    assert sorted(tuple(r) for r in leakage.training_files(got, False).select("file", "pos").collect()) == [("test", 1), ("train", 0), ("train", 2)]


def test_layout(spark):
    drawn = spark.createDataFrame([("a", 0), ("b", 1), ("stray", None)], "file string, shard int")
    there = spark.createDataFrame([("a", "/r/a")], "file string, target string")
    assert sorted(tuple(r) for r in manifest.layout(drawn, there, "/o", 2).select("file", "path", "problem").collect()) == [("a", "/o/1/a", None), ("b", "/o/2/b", "no recording"), ("stray", None, "not drawn")]
    assert manifest.layout(drawn, there, "/o", 1).where("file = 'b'").first().path == "/o/b"


def test_digests_of_groups(spark):
    df = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("y", 1, ""), (None, 1, "n")], "k string, o int, l string")
    got = {r[0]: (r.digest, r.records) for r in manifest.ordered_digest(df, "k", "o", F.col("l")).collect()}
    assert got == {k: (hashlib.sha256(t).hexdigest(), n) for k, t, n in (("x", b"ab", 2), ("y", b"", 1), (None, b"n", 1))}
    assert manifest.ordered_digest(df.limit(0), "k", "o", F.col("l")).count() == 0
