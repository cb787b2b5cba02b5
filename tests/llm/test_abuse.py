import random

import numpy as np
import pyarrow as pa

from voxloom.llm import abuse
from voxloom.session import stored


def corpus(rng, n):
    nouns = ["river", "castle", "teacher", "garden", "miller", "station", "window", "baker", "bridge", "harbour"]
    bad = ["you are such a filthy moron", "shut up you idiot", "get lost you stupid loser"]
    fine = ["the word moron is on page nine", "the clinic treats losers of weight", "an idiot plot needs no villain"]
    texts, flags = [], []
    for _ in range(n):
        parts = [f"The {rng.choice(nouns)} near the {rng.choice(nouns)} reached the {rng.choice(nouns)}." for _ in range(rng.randint(1, 6))]
        flag = int(rng.random() < 0.3)
        extra = rng.choice(bad) if flag else rng.choice(fine) if rng.random() < 0.3 else None
        if extra:
            if flag and rng.random() < 0.3:
                extra = extra.replace("moron", "m.o.r.o.n").replace("idiot", "id*ot").replace("loser", "l o s e r")
            parts.insert(rng.randrange(len(parts) + 1), extra + "!")
        texts.append(" ".join(parts))
        flags.append(flag if rng.random() > 0.03 else 1 - flag)
    return texts, flags


def given(texts, flags):
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "flagged": pa.array(flags, pa.int64()), "text": pa.array(texts, pa.string())})
    return abuse.Here().give(table)


def scores(model, texts):
    codes = abuse.stream(pa.array(texts, pa.string()))
    doc, lo, hi = abuse.passages(codes)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, doc, model.score(codes, lo, hi))
    return best


def test_held_out_accuracy():
    rng = random.Random(9)
    model = abuse.fit(given(*corpus(rng, 500)), ["moron", "idiot"])
    texts, flags = corpus(rng, 300)
    found, flags = scores(model, texts) > 0, np.array(flags)
    assert (found == flags).mean() > 0.9


def test_folded_weights_equal_the_kernel(monkeypatch):
    rng = random.Random(10)
    codes = abuse.stream(pa.array(["abcdefgh", "abxcdefgh", "zzzz", None, ""]))
    monkeypatch.setattr(abuse, "TABLE", 1 << 16)
    doc, lo, hi = abuse.passages(codes)
    assert doc.tolist() == [0, 1, 2]
    own, sub, val = abuse.features(codes, lo, hi)
    phi = np.zeros((3, abuse.TABLE), np.float32)
    np.add.at(phi, (own, sub), val)
    norm = abuse.norms(lo, hi)
    beta = np.array([rng.random() for _ in range(3)])
    kernel = (phi @ phi.T) / norm[:, None] / norm[None, :]
    model = abuse.Model((beta / norm) @ phi, 0.5)
    assert np.allclose(model.score(codes, lo, hi), kernel @ beta + 0.5, atol=1e-5)
    assert np.allclose(abuse.kernel(codes, lo, hi, [codes[a:b].tobytes() for a, b in zip(lo, hi, strict=True)]), kernel, atol=1e-5)


def test_tasks_fit_the_same_model(spark):
    texts, flags = corpus(random.Random(12), 300)
    here = abuse.fit(given(texts, flags), ["moron"])
    rows = spark.createDataFrame(list(zip(range(300), flags, texts, strict=True)), "doc_id long, flagged long, text string")
    there = abuse.fit(rows, ["moron"], abuse.Cluster(spark))
    assert np.allclose(scores(here, texts), scores(there, texts), atol=1e-2)


def test_every_document_gets_a_row(spark):
    texts, flags = corpus(random.Random(11), 200)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1000, None, "x"), (1001, "", "x"), (1002, " 123 !!", "x"), (1003, "word " * 50_000 + "shut up you idiot", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, f) for i, f in enumerate(flags)] + [(5, None)], "doc_id long, flagged int")
    terms = spark.createDataFrame([("idiot",), (None,)], "term string")
    model = abuse.train(docs, labels, terms, stored)
    got = {r.doc_id: r.score for r in abuse.score_documents(docs, model).collect()}
    assert len(got) == len(rows) and got[1000] is got[1001] is got[1002] is None and got[1003] > 0
    none = abuse.train(docs, labels.limit(0), terms, stored)
    assert all(r.score is None or r.score < 0 for r in abuse.score_documents(docs, none).collect())
    assert abuse.score_documents(docs.limit(0), model).count() == 0


def test_a_long_text_does_not_end_the_sample(spark, monkeypatch):
    monkeypatch.setattr(abuse, "MAX_LETTERS", 100)
    monkeypatch.setattr(abuse, "fit", lambda sample, terms, where: (sorted(r.text for r in sample.collect()), terms))
    documents = spark.createDataFrame([(i, "x" * 101 if i == 1 else "y" * 20) for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, flagged int")
    terms = spark.range(10_001).selectExpr("CAST(id AS STRING) AS term")
    texts, listed = abuse.train(documents, labels, terms, stored)
    assert texts == ["y" * 20] * 3 and len(listed) == 10_001
