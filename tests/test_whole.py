"""Whole jobs of the core's queries, held against plain Python written after the reference."""

import unicodedata
from collections import Counter

import duckdb
import pytest

from voxloom.functions import text as X
from voxloom.plans import queries

JOINERS = X.ZWJ + X.ZWNJ
UTTERANCES = [
    ("u0", "a", "ශ්‍රී කෝ ගෙදර, යමු"), ("u1", "b", f"{X.ZWJ}ශ්‍රී  කෝ{X.ZWNJ} ගෙදර යමු"),
    ("u2", "a", "අපි බස් එකේ යමු"), ("u3", "b", "අපි bus එකේ යමු"), ("u4", "c", "අපි bus එකේ! යමු"),
    ("u5", "a", "කො ගම"), ("u6", "b", unicodedata.normalize("NFC", "කො ගම")),
    ("u7", "a", f" {X.ZWJ} "), ("u8", "b", f"{X.ZWNJ}"), ("u9", "a", None), ("u10", "b", "වෙන වැකියක්"), ("u11", "x", "බස් එකේ"), ("u12", "a", "ලා ආමිඑක බස්"), ("u13", "a", "තනි"),
]
LOANS = ["බස්\tE\tbus\t", "ආමිඑක\tN\tarmy\tඑක", "ආමිඑක\tE\tarmy\tඑක", "ගෙදර\tP\thome\t", "යමුයි\tE\tgo\tයි"]


@pytest.fixture
def crafted(tmp_path):
    """A folder with tables of few rows, some of whose sentences are the same only as written."""
    db = duckdb.connect()
    values = {
        "utt_spk_text": [(i, u, p, t, "asr") for i, (u, p, t) in enumerate(UTTERANCES)],
        "speaker_split": [("a", "dev"), ("a", "train"), ("b", "test"), ("c", "test"), ("c", "dev")],
        "loanword_lines": [("table-0.tsv", i + 1, line) for i, line in enumerate(LOANS)],
        "train": [(i, "asr", f"/corpora/asr/data/{u[:2]}/{u}.flac", "x") for i, u in enumerate(("u0", "u2", "u3"))],
    }
    kinds = {"utt_spk_text": "pos BIGINT, utterance VARCHAR, speaker VARCHAR, text VARCHAR, source VARCHAR", "speaker_split": "speaker VARCHAR, split VARCHAR", "loanword_lines": "path VARCHAR, line_no BIGINT, line VARCHAR", "train": "pos BIGINT, source VARCHAR, audio VARCHAR, text VARCHAR"}
    for name, rows in values.items():
        db.execute(f"CREATE TABLE {name} ({kinds[name]})")
        db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        db.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    return str(tmp_path)


def clean(text):
    return [w for w in (w.strip(JOINERS) for w in unicodedata.normalize("NFC", text).split()) if w]


def key(text):
    return " ".join("".join(" " if unicodedata.category(c).startswith("P") else c for c in text.casefold()).split())


def expected(folder):
    """(pos, utterance, split or None, words, written words) of utterances with text, and the rows whose split is known, held out or new."""
    read = lambda sql: duckdb.execute(sql.replace("{", f"read_parquet('{folder}/").replace("}", ".parquet')")).fetchall()
    marks = dict(read("SELECT speaker, split FROM {speaker_split}"))  # the last row holds
    loans = {}
    for (line,) in read("SELECT line FROM {loanword_lines} WHERE line IS NOT NULL ORDER BY path, line_no"):
        fields = line.split("\t")
        if len(fields) == 4 and fields[1] == "E":
            loans[" ".join(clean(fields[0]))] = fields[2], fields[3].strip(JOINERS)

    def new(word):
        english, suffix = loans.get(word, (word, None))
        return word if suffix is None or suffix and suffix not in X.PARTICLES else f"{english} {suffix}" if suffix else english

    rows = [(pos, u, marks.get(p), clean(t)) for pos, u, p, t in read("SELECT pos, utterance, speaker, text FROM {utt_spk_text} WHERE text IS NOT NULL")]
    return [(pos, u, split, words, [new(w) for w in words]) for pos, u, split, words in rows if words]


def held(rows):
    keyed = [(u, split, key(" ".join(after))) for _, u, split, _, after in rows if split]
    evaluated, trained = ({k for _, s, k in keyed if (s == "train") is t} for t in (False, True))
    kept = [(u, s) for u, s, k in keyed if s != "train" or k not in evaluated]
    return keyed, kept, [(u, f"{s}_new") for u, s, k in keyed if s != "train" and k not in trained]


def answer(spark, folder, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in queries.queries()[name](spark, folder).collect())


@pytest.fixture(params=["crafted", "data"])
def folder(request):
    return request.getfixturevalue(request.param)


def test_sentences_are_compared_as_written(spark, folder):
    rows = expected(folder)
    _, kept, new = held(rows)
    assert answer(spark, folder, "sentence_keys", "pos", "key") == sorted((pos, key(" ".join(after))) for pos, _, _, _, after in rows)
    assert answer(spark, folder, "hold_out", "utterance", "split") == sorted(kept)
    assert answer(spark, folder, "new_sentences", "utterance", "split") == sorted(new)
    assert answer(spark, folder, "new_after_hold_out", "split", "rows") == sorted(Counter(f"{s}_new" for _, s in kept if s != "train").items())


def test_crafted_train_rows_left(spark, crafted):
    assert [u for u, s in answer(spark, crafted, "hold_out", "utterance", "split") if s == "train"] == ["u12", "u13"]


def test_every_utterance_is_rewritten(spark, folder):
    rows = expected(folder)
    changed = [(pos, " ".join(before), " ".join(after)) for pos, _, _, before, after in rows]
    assert answer(spark, folder, "word_rewrite", "pos", "rewritten") == sorted((pos, after) for pos, before, after in changed if before != after)
    times = Counter((b, a) for *_, before, after in rows for b, a in zip(before, after, strict=True) if b != a)
    assert answer(spark, folder, "rewrite_counts", "before", "after", "times") == sorted((*k, n) for k, n in times.items())


def test_split_counters(spark, folder):
    rows = expected(folder)
    keyed, kept, _ = held(rows)
    got = {r.split: r for r in queries.queries()["split_counters"](spark, folder).collect()}
    of = lambda found: Counter(s or "none" for s in found)
    written, rewritten = of(s for _, _, s, _, _ in rows), of(s for _, _, s, before, after in rows if before != after)
    assert all((r.written, r.rewritten) == (written[s], rewritten[s]) and r.rows == r.empty + r.written for s, r in got.items())
    assert {s: r.held_out for s, r in got.items() if r.held_out} == {s: n for s, n in (of(s for _, s, _ in keyed) - of(s for _, s in kept)).items() if n}
    audios = {a for (a,) in duckdb.execute(f"SELECT audio FROM read_parquet('{folder}/train.parquet')").fetchall()}
    own = duckdb.execute(f"SELECT speaker, '/corpora/' || source || '/data/' || substring(utterance, 1, 2) || '/' || utterance || '.flac' FROM read_parquet('{folder}/utt_spk_text.parquet')").fetchall()
    marks = dict(duckdb.execute(f"SELECT speaker, split FROM read_parquet('{folder}/speaker_split.parquet')").fetchall())
    assert {s: r.missing_audio for s, r in got.items()} == {s: of(marks.get(p) for p, a in own if a not in audios)[s] for s in got}


def test_unlabelled_of_every_run(spark, data):
    labels = set(duckdb.execute(f"SELECT run, audio FROM read_parquet('{data}/transcript.parquet')").fetchall())
    runs, audios = ({x[i] for x in labels} for i in (0, 1))
    has = {a: sorted(r for r in runs if (r, a) in labels) for a in audios}
    assert answer(spark, data, "incremental_unlabelled", "file", "labelled", "missing") == sorted((a, ",".join(x), len(runs) - len(x)) for a, x in has.items() if len(x) < len(runs))


def test_every_document_is_wanted(spark, tmp_path):
    duckdb.execute(f"COPY (SELECT i::BIGINT AS doc_id, CASE WHEN i <> 4 THEN repeat('x', i::INT * 500) END AS text FROM range(8) t(i)) TO '{tmp_path}/documents.parquet'")
    got = answer(spark, str(tmp_path), "manifest_wanted", "path", "kind", "size")
    assert got == [(str(i), None if i == 4 else "sha256" if i > 4 else "git", None if i == 4 else 500 * i) for i in range(8)]


@pytest.fixture
def texts(tmp_path):
    found = {0: "ab", 1: "ශ්‍රී 😀" * 1000, 2: "\x00", 17: "x" * 5000}
    db = duckdb.connect()
    db.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, n_chars BIGINT)")
    db.executemany("INSERT INTO d VALUES (?, ?, ?)", [(i, t, len(t)) for i, t in found.items()] + [(3, None, None), (4, "", 0)])
    db.execute(f"COPY d TO '{tmp_path}/documents.parquet'")
    return str(tmp_path), found


def test_rows_are_as_long_as_their_texts(spark, texts):
    folder, found = texts
    longest = {i: max(len(t) for k, t in found.items() if k // 16 == i // 16) for i in found}
    rows = sorted((i, longest[i], ",".join(map(str, [ord(c) + 64 for c in t] + [0] * (longest[i] - len(t))))) for i, t in found.items())
    assert answer(spark, folder, "pad_layout", "doc_id", "length", "inputs") == rows


def test_targets_are_the_whole_text(spark, texts):
    folder, found = texts
    halved = lambda n: (n - 1) // 2 + 1
    clip = {i: halved(halved(halved(len(t) % 100))) + len(t) // 100 * 13 + int(len(t) % 100 * 0.13) for i, t in found.items()}
    expected = [(i, clip[i] + 3 + k, x) for i, t in found.items() for k, x in enumerate([*(ord(c) + 64 for c in t), 9])]
    assert answer(spark, folder, "prompt_targets", "doc_id", "place", "id") == sorted(expected)
