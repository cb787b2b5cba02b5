import collections
import random

import numpy as np

from voxloom.llm import cutoffs, terms


def test_trie_accumulates():
    rng = random.Random(2)
    for capacity in (1, 10, 512):
        trie, truth = terms.Trie(capacity), {}
        for _ in range(30):
            words = sorted({"".join(rng.choices("ab\U0010ffffක", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 200))})
            o, n = ([rng.randint(1, 9) for _ in words] for _ in range(2))
            trie.add(words, np.array(o, np.int64), np.array(n, np.int64))
            for w, x, y in zip(words, o, n, strict=True):
                a, b = truth.get(w, (0, 0))
                truth[w] = a + x, b + y
        got = {}
        for prefix, words, o, n in trie.subtrees():
            assert all(w.startswith(prefix) for w in words) and words == sorted(words) and len(words) <= capacity
            assert terms.front_decode(*terms.front_code(words)) == words
            for w, x, y in zip(words, o, n, strict=True):
                assert w not in got
                got[w] = x, y
        assert got == truth and trie.size == len(truth)


def test_texts_of_one_key_are_one_record(spark):
    df = spark.createDataFrame([("u1", "a b"), ("u1", "a c a"), ("u1", "a b"), ("u2", "a"), (None, "a"), (None, "a"), (None, "b")], "k string, t string")
    found, n = terms.count_terms(df, "k", "t", lambda x: x)
    assert n == 4 and {r.term: (r.occurrences, r.records) for r in found.collect()} == {"a": (5, 3), "b": (2, 2), "c": (1, 1)}


def test_counts(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{i % 50}x{i}" for i in range(400)] + ["hot"] * 300 + [" ", "", "a b"], k=9)) for _ in range(500)] + [None, "", "  ", "hot"]
    rows = [(f"u{i}", t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:100] + [(None, "solo", "x")], "utterance string, text string, term string")
    occurrences, records = collections.Counter(), collections.Counter()
    for t in [*texts, "solo"]:
        own = [w for w in (t or "").split(" ") if w]
        occurrences.update(own)
        records.update(set(own))
    for cap, route, held, enter in ((512, 50_000, 1_000_000, 200_000), (4, 20, 50, 30)):
        monkeypatch.setattr(terms, "CAPACITY", cap)
        monkeypatch.setattr(terms, "ROUTE", route)
        monkeypatch.setattr(terms, "HELD", held)
        monkeypatch.setattr(terms, "ENTER", enter)
        found, n = terms.count_terms(df, "utterance", "text", lambda x: x)
        got = {r.term: (r.occurrences, r.records) for r in found.collect()}
        assert n == len(texts) + 1 and got == {w: (occurrences[w], records[w]) for w in occurrences}
    marks = {r.term: r.mark for r in terms.mark_terms(found, n).collect()}
    assert marks["hot"] == "common" and marks["solo"] == "rare"
    empty, n = terms.count_terms(df.limit(0), "utterance", "text", lambda x: x)
    assert empty.count() == 0 and n == 0


def brute(errors, percent):
    xs = sorted(errors)
    return next(x for x in xs if sum(y <= x for y in xs) * 100 >= percent * len(xs))


def test_cutoffs(spark, monkeypatch):
    rng = random.Random(4)
    rows = [("hot", f"h{i}", rng.choice([0.0, 0.1, rng.random()])) for i in range(3000)] + [("one", "o", 0.5), ("none", "n", None), ("none", "m", float("nan")), ("hot", "x", float("inf")), ("hot", "y", -0.1), (None, "z", 0.1), ("other", "w", 0.2)]
    df = spark.createDataFrame([(*r, 1) for r in rows + rows[:500]], "source string, file string, error double, cutoff int")
    targets = spark.createDataFrame([("hot", 60), ("one", 100), ("none", 50), ("absent", 10)], "source string, keep_percent int")
    for counted, slack in ((1_000_000, 0.004), (10, 0.05), (1_000_000, 0.0)):
        monkeypatch.setattr(cutoffs, "COUNTED", counted)
        monkeypatch.setattr(cutoffs, "SLACK", slack)
        kept, found = cutoffs.cutoffs_stored(df, targets, "source", "file", "error", lambda x: x)
        got = {r.source: (r.records, r.cutoff, r.kept) for r in found.collect()}
        hot = [e for s, _, e in rows if s == "hot" and 0 <= e < 9]
        limit = brute(hot, 60)
        assert got == {"hot": (3000, limit, sum(e <= limit for e in hot)), "one": (1, 0.5, 1), "none": (0, None, 0), "absent": (0, None, 0)}
        assert cutoffs.above(kept, found).count() == sum(e > limit for e in hot)
    kept, found = cutoffs.cutoffs_stored(df.limit(0), targets, "source", "file", "error", lambda x: x)
    assert cutoffs.above(kept, found).count() == 0 and found.count() == 4
