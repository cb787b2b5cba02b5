import json

import pandas as pd
from pyspark.sql import functions as F

from voxloom.operators import rejects as R
from voxloom.sources import readers, sinks
from voxloom.streaming import labelling


def test_utterances_keep_later_tabs(spark, tmp_path):
    (tmp_path / "u.tsv").write_text("a\ts\tx\ty\n\n \t\nb\ts\tz\n", encoding="utf-8")
    got = readers.utterances(readers.lines(spark, str(tmp_path / "u.tsv"))).orderBy("pos").select("utterance", "text").collect()
    assert [tuple(r) for r in got] == [("a", "x\ty"), ("b", "z")]


def test_label_file_problems(spark, tmp_path):
    head = "file\tseconds\tms\ttext\n"
    (tmp_path / "1.tsv").write_text(head + "a.wav\t1.5\t4\tx\nb.wav\tn\t4\tx\nc.wav\t1\t4\n", encoding="utf-8")
    (tmp_path / "2.tsv").write_text(head + "a.wav\t1.5\t4\tx\nd.wav\t1\t4\tcut", encoding="utf-8")
    (tmp_path / "3.tsv").write_text("file\tms\n", encoding="utf-8")
    got = {(r.path[-5:], r.pos): r.problem for r in readers.label_file(spark, str(tmp_path)).collect()}
    assert got == {("1.tsv", 1): "labelled twice", ("1.tsv", 2): "not a number", ("1.tsv", 3): "expected 4 columns", ("2.tsv", 1): "labelled twice", ("2.tsv", 2): "cut off", ("3.tsv", 0): "header"}


def test_replay_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("en_us", "b.wav", 0.0625, "x", 0), ("en_us", "a.wav", 0.3004, "", 0)], "source string, file string, error double, label string, ord int")
    sinks.replay(df.coalesce(1), str(tmp_path / "r"))
    got = readers.replay(readers.lines(spark, str(tmp_path / "r")))
    assert [(r.file, r.error, r.problem) for r in got.orderBy("file").collect()] == [("a.wav", 0.3, None), ("b.wav", 0.062, None)]
    bad = spark.createDataFrame([("p", i, x) for i, x in enumerate(("xx\ta\t0.1\tl", "en_us\ta\tnan\tl", "en_us\ta\t-0.1\tl", "en_us\ta\tlow\tl", "en_us\ta\t0.1"))], "path string, pos long, line string")
    assert [r.problem for r in readers.replay(bad).orderBy("pos").collect()] == ["unknown source", "not an error", "not an error", "not an error", "expected 4 columns"]


def test_records(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join([json.dumps({"audio": "/a", "text": "language X<asr_text>é"}), "{bad", json.dumps({"audio": "", "text": "<asr_text>"}), json.dumps({"audio": "/b", "text": "x"})]), encoding="utf-8")
    got = readers.records(spark, str(path), str(path))
    assert got.count() == 8 and sorted(str(r.problem) for r in got.collect())[::2] == ["None", "malformed", "no audio", "no marker"]


def test_json_sink_keeps_characters(spark, tmp_path):
    df = spark.createDataFrame([("train", "/a", "ශ්‍රී")], "split string, audio string, text string")
    sinks.json_records(df, str(tmp_path / "j"))
    files = list((tmp_path / "j" / "split=train").glob("*.json"))
    assert json.loads(files[0].read_text(encoding="utf-8"))["text"] == "ශ්‍රී" and "\\u" not in files[0].read_text(encoding="utf-8")


LINES = [
    ("file\tseconds\tms\ttext", "skip", 1), ("", "skip", 2), (" \t ", "skip", 3), (None, "skip", 4), ("a.wav\t1.5\t40\thello", None, 5), ("A.FLAC\t0.5\t0\t", None, 6),
    ('a.wav\t1\t2\t"tab\tin ""q"""', None, 7), ('a.wav\t1\t2\tmid"quote', None, 8), ('a.wav\t1\t2\t"open', "quotes", 9), ("next.wav\t1\t2\tx", None, 10), ('a.wav\t1\t2\t"x"y', "quotes", 11),
    ("a.wav\t1\t2", "columns", 12), ("a.wav\t1\t2\tx\t", "columns", 13), ('"a.wav\t1', "quotes", 14), ("a.mp3\t1\t2\tx", "value", 15), ("a.wav\t0.0\t2\tx", "value", 16), ("a.wav\t１\t2\tx", "value", 17),
    ("a.wav\t1\t-2\tx", "value", 18), ("a.wav\t1\t2\tx\x07", "value", 19), ("a.wav\t1\t2\t�", "value", 20), ("a.wav\t1\t2\tx\r", "value", 21), ("a.wav\t1\t2\t" + "ක" * 50_000, None, 22),
    ("file\tseconds\tms\ttext", "value", 23), ('a.wav\t1\t2\t"a"b"c', "quotes", 24), ("a.wav\t1e3\t2\tx", "value", 25), ("a.wav\t1\t2\t\\N", None, 26), ("a.wav\t1\t2\tx\x00y", "value", 27),
]


def test_rejects(spark):
    df = spark.createDataFrame([("p", n, line, "clash") for line, _, n in LINES] * 2, "path string, line_no long, line string, reason string").coalesce(1)
    loaded = R.load(df, R.LABELS)
    got = {r.line_no: r.reason for r in loaded.collect()}
    assert got == {n: why for _, why, n in LINES if why != "skip"}
    good = {r.line_no: (r.seconds, r.text) for r in R.accepted(loaded, R.LABELS).collect()}
    assert good[7] == (1.0, 'tab\tin "q"') and good[6] == (0.5, "") and len(good[22][1]) == 50_000
    assert R.rejected(loaded).count() == sum(why not in (None, "skip") for _, why, _ in LINES)
    assert R.load(df.limit(0), R.LABELS).count() == 0


def test_rejects_agree_with_the_exact_check(spark, data):
    for name, form in (("label_lines", R.LABELS), ("loanword_lines", R.LOANWORDS)):
        rows = spark.read.parquet(f"{data}/{name}.parquet")
        got = {(r.path, r.line_no): r.reason for r in R.load(rows, form).collect()}
        lines = [r for r in rows.collect() if r.line and r.line.strip() and not (r.line_no == 1 and r.line == form.header)]
        assert got == {(r.path, r.line_no): R.reason(r.line, form) for r in lines} and got


def test_incremental_labelling(spark, tmp_path):
    inbox, labels, checkpoint = (str(tmp_path / x) for x in ("in", "labels", "cp"))
    seen = spark.sparkContext.accumulator(0)

    def transcribe(batches):
        for b in batches:
            seen.add(len(b))
            yield pd.DataFrame({"file": b["file"], "seconds": 1.0, "ms": 2.0, "text": "x"})

    for files in (["a", "b"], ["b", "c"]):
        spark.createDataFrame([(f,) for f in files], "file string").write.mode("append").json(inbox)
        labelling.label_new(spark, inbox, "file string", labels, checkpoint, transcribe)
    labelling.label_new(spark, inbox, "file string", labels, checkpoint, transcribe)
    assert sorted(r.file for r in spark.read.parquet(labels).collect()) == ["a", "b", "c"] and seen.value == 3


def test_resumed_labels_and_states(spark):
    texts = spark.createDataFrame([("p", "file\tseconds\tms\ttext\na.wav\t1\t2\tx\nb.wav\t1")], "path string, value string")
    assert [r.file for r in labelling.resumed(texts).collect()] == ["a.wav"]
    files = spark.createDataFrame([("1", "state.json"), ("1", "w"), ("2", "w")], "folder string, name string")
    assert [r.folder for r in labelling.complete_states(files).collect()] == ["1"]
    assert labelling.unlabelled(files.select(F.col("name").alias("file")), texts.select(F.lit("w").alias("file"))).count() == 1


def test_other_readers(spark):
    given = lambda *lines: spark.createDataFrame([("p", i, t) for i, t in enumerate(lines)], "path string, pos long, line string")
    assert [tuple(r) for r in readers.vocabulary(given("ක\t3", "", "ග\tx")).select("word", "count").collect()] == [("ක", 3), ("ග", None)]
    got = readers.split_transcripts(given("1\ta.wav\tHi there\thi there\th i\t9\tF", "2\tb.wav"))
    assert [tuple(r)[2:] for r in got.collect()] == [("a.wav", "Hi there", None), ("b.wav", None, "expected 7 columns")]
    assert [(r.file, r.transcript) for r in readers.spaced_transcripts(given("7-2 TWO WORDS", "7-1 ONE")).collect()] == [("7-1.flac", "ONE"), ("7-2.flac", "TWO WORDS")]
    configs = spark.createDataFrame([('{"quantization":{"group_size":64,"bits":4}}',), ('{"quantization":{"group_size":64,"bits":4,"mode":"mx"}}',), ("{}",)], "value string")
    assert [tuple(r) for r in readers.quantisation(configs).collect()] == [(64, 4, "affine", None), (64, 4, "mx", "unknown mode"), (None, None, "affine", None)]


def test_shards_of_labels(spark, tmp_path):
    (tmp_path / "one.tsv").write_text("", encoding="utf-8")
    (tmp_path / "many").mkdir()
    assert readers.shards(spark, str(tmp_path), "one") == [f"{tmp_path}/one.tsv"] and readers.shards(spark, str(tmp_path), "many") == [f"{tmp_path}/many/*.tsv"]


def test_other_sinks(spark, tmp_path):
    read = lambda name: sorted(line for p in (tmp_path / name).rglob("part*") for line in p.read_text(encoding="utf-8").splitlines())
    words = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "c", 3)], "chunk long, word string, rank long")
    sinks.chunked(words, str(tmp_path / "c"))
    assert {p.name: sorted(x.read_text() for x in p.glob("part*")) for p in (tmp_path / "c").glob("chunk*")} == {"chunk=0": ["a\nb\n"], "chunk=1": ["c\n"]}
    sinks.transcripts(spark.createDataFrame([("/a", "x\ty", None, None, 1.005, 40.4)], "audio string, reference string, hypothesis string, language string, seconds double, milliseconds double"), str(tmp_path / "t"))
    assert read("t") == ["/a\tx y\t\t\t1.01\t40", "audio\treference\thypothesis\tlanguage\tseconds\tms"] or read("t")[0].startswith("/a\tx y\t\t\t1.0")
    for step in (1, 2):
        sinks.metrics(spark.createDataFrame([(step, 0.5)], "step long, loss double"), str(tmp_path / "m"))
    assert [json.loads(x)["step"] for x in read("m")] == [1, 2]
    for n in (1, 2):
        sinks.report(spark.createDataFrame([(n,)], "utterances long"), str(tmp_path / "r"))
    assert [json.loads(x) for x in read("r")] == [{"utterances": 2}]


def test_no_silent_local_folder(monkeypatch):
    from types import SimpleNamespace

    from voxloom import session

    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    try:
        session.shared_folder(away)
    except ValueError as error:
        assert "spark.checkpoint.dir" in str(error)
    else:
        raise AssertionError("a cluster got a folder of one machine")
