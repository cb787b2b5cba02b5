import collections
import random

import numpy as np

from voxloom.llm import overlaps, splits, truncation


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words) + 1)
        kind = rng.random()
        if kind < 0.4 and words:
            words.pop(min(i, len(words) - 1))
        elif kind < 0.7:
            words.insert(i, rng.randrange(40))
        elif words:
            words[min(i, len(words) - 1)] = rng.randrange(40)
    return words


def test_every_near_pair_is_found():
    rng = random.Random(5)
    for vocabulary in (3, 40):
        texts = list({tuple(rng.randrange(vocabulary) for _ in range(rng.randint(1, 30))) for _ in range(150)})
        queries = [tuple(changed(rng, rng.choice(texts), rng.randint(0, 6))) for _ in range(150)]
        queries = [q for q in queries if q] + [tuple(range(1000, 1010))]
        flat = lambda xs: (np.array([w for x in xs for w in x], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in xs])]))
        words, starts = flat(texts)
        index = overlaps.Index.load(overlaps.Index.build(words, starts, np.arange(len(texts))).dump())
        found = overlaps.near_texts(index, *flat(queries))
        got = {(int(t), int(e)): int(d) for t, e, d in zip(found["text"], found["other"], found["edits"], strict=True)}
        truth = {(i, j): distance(q, t) for i, q in enumerate(queries) for j, t in enumerate(texts)}
        assert got == {k: d for k, d in truth.items() if d <= max(len(queries[k[0]]), len(texts[k[1]])) // 5}
        assert all(s <= len(queries[t]) for s, t in zip(found["shared"], found["text"], strict=True))


def test_tables(spark):
    said = "one two three four five six"
    utterances = [("u1", "AB ", said.upper() + "!"), ("u2", "ab", "x"), ("u3", "cd", said), ("u4", None, said), ("u5", "ab", None), ("u6", "ab", " ."), ("u1", "AB ", said.upper() + "!")]
    split = [("ａｂ", "test"), ("ab", "train"), ("cd", "train"), (None, "dev")]
    train = [("a1", f"language X<asr_text>{said}"), ("a2", "one two three four six"), ("a3", "one two three"), ("a4", None), ("a5", "X"), ("a1", f"language X<asr_text>{said}"), ("a6", "")]
    u = spark.createDataFrame([(*r, 1) for r in utterances], "utterance string, speaker string, text string, edits int")
    s = spark.createDataFrame(split, "speaker string, split string")
    t = spark.createDataFrame(train, "audio string, text string")
    from voxloom.session import stored

    got = overlaps.overlaps(overlaps.evaluation_rows(u, s), t, stored).collect()
    assert sorted((r.utterance, r.audio, r.edits) for r in got) == [("u1", "a1", 0), ("u1", "a2", 1), ("u2", "a5", 0)]
    assert {(r.audio, r.edits): (r.shared, r.spans) for r in got} == {("a1", 0): (6, 1), ("a2", 1): (4, 1), ("a5", 0): (1, 1)}
    again = u.union(spark.createDataFrame([("u9", "ab", said, 1)], u.schema))
    pairs, members = overlaps.overlap_classes(overlaps.evaluation_rows(again, s), t.union(spark.createDataFrame([("a9", said)], t.schema)), stored)
    assert sorted((r.edits, r.utterances, r.records) for r in pairs.collect()) == [(0, 1, 1), (0, 2, 2), (1, 2, 1)] and members.distinct().count() == 3
    assert overlaps.overlaps(overlaps.evaluation_rows(u.limit(0), s), t, stored).count() == 0
    assert overlaps.overlaps(overlaps.evaluation_rows(u, s), t.limit(0), stored).count() == 0


def test_rounds_of_indexes(spark, monkeypatch):
    from voxloom.session import stored

    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randint(3, 9))) for _ in range(200)]
    e = spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts[:100])], "utterance string, text string")
    t = spark.createDataFrame([(f"a{i}", x) for i, x in enumerate(texts[50:])], "audio string, text string")
    whole = {tuple(r) for r in overlaps.overlaps(e, t, stored).collect()}
    for name, value in (("SHARD_WORDS", 100), ("HELD_WORDS", 50), ("TEXTS_AT_ONCE", 7)):
        monkeypatch.setattr(overlaps, name, value)
    few = t.coalesce(1).mapInArrow(lambda b: b, t.schema)
    assert {tuple(r) for r in overlaps.overlaps(e, few, stored).collect()} == whole and len(whole) >= 50


def test_forest(spark):
    rng = random.Random(6)
    pairs = [(f"n{rng.randrange(80)}", f"n{rng.randrange(80)}") for _ in range(60)] + [("hub", f"n{i}") for i in range(20)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    from voxloom.session import stored

    roots, forest = splits.spanning_forest(spark.createDataFrame(pairs, "a string, b string"), stored)
    got = {r.node: r.root for r in roots.collect()}
    groups = collections.defaultdict(set)
    for x in parent:
        groups[find(x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(n for n in got if got[n] == r) for r in set(got.values()))
    assert forest.count() == len(parent) - len(groups)


def test_assignment(spark):
    from voxloom.session import stored

    rng = random.Random(7)
    rows = [(f"u{i}", rng.choice(["big", "BIG ", f"s{min(int(rng.expovariate(0.02)), 300)}", None])) for i in range(4000)]
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:50]], "utterance string, speaker string, root string")
    targets = spark.createDataFrame([("train", 90), ("dev", 4), ("test", 6)], "split string, share_percent int")
    roots, _ = splits.spanning_forest(splits.spelling_edges(df).union(splits.shared_edges(df)), stored)
    got = splits.assign(df, targets, roots, stored).collect()
    assert len(got) == 4000
    by = collections.defaultdict(set)
    for r in got:
        if r.speaker:
            by[r.speaker.strip().lower()].add(r.split)
    assert all(len(x) == 1 for x in by.values())
    shares = collections.Counter(r.split for r in got)
    assert abs(shares["train"] - 3600) < 80 and abs(shares["dev"] - 160) < 60 and abs(shares["test"] - 240) < 60
    assert splits.assign(df.limit(0), targets, roots, stored).count() == 0


def test_torn(spark):
    from voxloom.session import stored

    split = spark.createDataFrame([("0a1b2", "train"), (" 0A1B2", "dev"), ("11111", "test"), ("１１１１１", "test"), (None, "train"), ("22222", None), ("22222", "dev")], "speaker string, split string")
    roots, _ = splits.spanning_forest(splits.spelling_edges(split), stored)
    assert [r.speaker for r in splits.torn_speakers(split, roots).collect()] == ["0a1b2"]


def test_truncation(spark):
    from voxloom.session import stored

    rng = random.Random(8)
    nouns = [f"noun{i}" for i in range(60)]
    full = [f"the {rng.choice(nouns)} saw the {rng.choice(nouns)} while a {rng.choice(nouns)} left the {rng.choice(nouns)} at home." for _ in range(300)]
    rows = [("r", f"a{i}", "s", t, t) for i, t in enumerate(full)]
    rows += [("r", "cut1", "s", full[0], full[0][:40]), ("r", "cut2", "s", full[1], full[1][:45] + "…"), ("r", "mark", "s", full[2], full[2].rstrip(".")), ("r", "misheard", "s", full[3], full[3].replace("home", "hame"))]
    rows += [("r", "silence", "s", full[4], "the"), ("r", "null", "s", full[5], None), ("r", "empty", "s", full[5], ""), ("r", "blank", "s", None, " "), ("r", "alone", "s", None, full[6][: full[6].index(" at home")].rsplit(" ", 1)[0]), ("r", "whole", "s", None, full[7])]
    df = spark.createDataFrame([(*r, 1) for r in rows + rows[-12:]], "run string, audio string, source string, reference string, hypothesis string, cut int")
    found = truncation.truncated(df, stored)
    assert sorted(r.audio for r in found.collect()) == ["alone", "cut1", "cut2"]
    assert truncation.truncation_rates(df, found).first().cut == 3
    assert truncation.truncated(df.limit(0), stored).count() == 0


def test_entity_edges(spark):
    from voxloom.session import stored

    rows = spark.createDataFrame([("u1", "a", "x"), ("u2", "b", "x"), ("u3", "c", "y"), ("u4", None, "x"), ("u5", "d", None)], "utterance string, speaker string, source string")
    roots, forest = splits.spanning_forest(splits.spelling_edges(rows).union(splits.entity_edges(rows, "source")), stored)
    top = {r.node: r.root for r in roots.collect()}
    assert top["written a"] == top["written b"] != top["written c"] and len(set(top.values())) == 3 and forest.count() == len(top) - 3
