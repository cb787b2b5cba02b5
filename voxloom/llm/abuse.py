"""Scores of documents for abusive, hateful or sexual content: a string-kernel support vector machine with Nyström landmarks.

The kernel counts gapped subsequences: SUB letters in order within a span of SPAN, each weighted DECAY for every letter of the
span. Only letters and marks, in one visual form and lower case, are seen, so inserted blanks, points and signs change nothing
and a replaced or added letter costs a gap. Texts are scored in passages: sentences, long ones in overlapping windows.

A machine over kernel values with landmarks is linear in them, and they are linear in the subsequences; so after training the
landmarks fold into one table of weights by hashed subsequence, and all passages of all documents are scored in one scan.

The sums over passages run as Spark tasks: counts of subsequences, first scores, and kernel values with the landmarks, round by
round; the driver holds the sample's passages and kernel values (bounded by MAX_LETTERS, MAX_PASSAGES and LANDMARKS), no texts.

Labels are of documents, so passages are labelled in rounds: a flagged document's passages that score highest are taken as its
flagged ones, the others as unknown; all passages of the other documents are clean. Listed terms seed the first round.
Training takes a bounded sample of labelled documents (MAX_DOCUMENTS, MAX_LETTERS) and of their passages (MAX_PASSAGES of either
label); landmarks are chosen among at most POOL flagged passages. Scoring covers every document whole.

Null and empty texts, and those without a passage of SUB letters (a Han character counts for two), score null and aren't flagged. Null labels take no part. Without labels of both kinds no
document is flagged. Repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.forms import visual_forms

SUB, SPAN, DECAY = 4, 5, 0.6
#: Size of the table of hashed subsequences.
TABLE = 1 << 21
#: Letters in a window of a long sentence, and from one to the next.
WINDOW, STRIDE = 60, 30
LANDMARKS = 800
#: Flagged passages that landmarks are chosen among.
POOL = 2000
MAX_DOCUMENTS, MAX_LETTERS, MAX_PASSAGES = 5000, 4_000_000, 5000
ROUNDS = 4
#: Landmarks that kernel values are computed with at a time.
LANDMARKS_AT_ONCE = 100
#: Standard deviations above its share of documents at which a subsequence speaks for a flag; weight of a flagged passage.
SIGNIFICANT, HEAVIER = 2.0, 1.5
#: Share of the clean passages that a flagged one must score above.
ABOVE = 0.985
_COUNTS = "sub long, n long, dirty long"
Work = Callable[[pa.RecordBatch], pa.RecordBatch]
_END, _DOC = "\x1e", "\x1f"
_HAN_END = r"[.!?…]+([\x{4E00}-\x{9FFF}])"
_SENTENCE = r"[.!?…]+(\s|$)|[。！？；]+|[\r\n]+"


def offsets() -> list[tuple[tuple[int, ...], float]]:
    """Places of a subsequence's letters after its first, and its weight."""
    from itertools import combinations

    return [(c, DECAY ** (c[-1] + 1 - SUB)) for c in combinations(range(1, SPAN), SUB - 1)]


def stream(texts: pa.Array) -> np.ndarray:
    """The letters of all texts as code points, sentences and texts ended by marks."""
    formed = pc.utf8_lower(visual_forms(pc.fill_null(texts, "")))
    marked = pc.replace_substring_regex(formed, _HAN_END, _END + r"\1")
    marked = pc.replace_substring_regex(marked, _SENTENCE, _END)
    marked = pc.replace_substring_regex(marked, r"([\x{4E00}-\x{9FFF}])", r"\1\1")  # a Han character says as much as two letters
    letters = pc.replace_substring_regex(marked, r"[^\pL\pM\x1e]+", "")
    joined = _DOC.join(letters.to_pylist()) + _DOC
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32)


def passages(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of all passages with at least SUB letters."""
    ends = np.flatnonzero((codes == 0x1E) | (codes == 0x1F))
    starts = np.concatenate([[0], ends[:-1] + 1])
    doc = np.cumsum(codes == 0x1F)[ends] - (codes[ends] == 0x1F)
    size = ends - starts
    n = np.where(size > WINDOW, -(-(size - WINDOW) // STRIDE) + 1, 1) * (size >= SUB)
    own = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    lo = starts[own] + k * STRIDE
    hi = np.minimum(lo + WINDOW, ends[own])
    return doc[own], lo, hi


def subsequences(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, float]]:
    """For each shape: its reach, the hashed subsequences by place, and its weight."""
    mixed = codes.astype(np.uint32)
    mixed = (mixed ^ (mixed >> np.uint32(7))) * np.uint32(0x9E3779B1)
    factors = [np.uint32(x) for x in (1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]
    parts = [mixed * f for f in factors[:SUB]]
    n = len(codes)
    for places, weight in offsets():
        reach = places[-1]
        if n <= reach:
            continue
        h = parts[0][: n - reach].copy()
        for f, p in zip(parts[1:], places, strict=True):
            h += f[p : n - reach + p]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        yield reach, h >> np.uint32(33 - TABLE.bit_length()), weight


def norms(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Root of a passage's kernel with itself, as if no subsequence were repeated."""
    total = np.zeros(len(lo))
    for places, weight in offsets():
        total += np.maximum(0, hi - lo - places[-1]) * weight * weight
    return np.sqrt(np.maximum(total, 1e-9))


@dataclass
class Model:
    weights: np.ndarray  # by hashed subsequence
    bias: float

    def score(self, codes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        total = np.zeros(len(lo))
        for reach, h, weight in subsequences(codes):
            sums = np.concatenate([[0], np.cumsum(self.weights[h], dtype=np.float64)])
            last = np.maximum(lo, np.minimum(hi - reach, len(sums) - 1))
            total += weight * (sums[last] - sums[np.minimum(lo, len(sums) - 1)])
        return total / norms(lo, hi) + self.bias


def features(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, hashed subsequence and weight of all subsequences of the passages, ordered by passage."""
    own, sub, val = [], [], []
    for reach, h, weight in subsequences(codes):
        n = np.maximum(0, hi - lo - reach)
        which = np.repeat(np.arange(len(lo)), n)
        at = np.repeat(lo, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        own.append(which)
        sub.append(h[at])
        val.append(np.full(len(at), weight, np.float32))
    own, sub, val = map(np.concatenate, (own, sub, val))
    order = np.argsort(own.astype(np.int32), kind="stable")
    return own[order], sub[order], val[order]


class Here:
    """Runs the work on passages in this process, batch by batch."""

    def give(self, table: pa.Table) -> list[pa.RecordBatch]:
        return table.to_batches(max_chunksize=512)

    def run(self, data: list[pa.RecordBatch], work: Work, schema: str) -> pa.Table:
        return pa.Table.from_batches([work(batch) for batch in data])

    def above(self, data: list[pa.RecordBatch], least: float) -> tuple[np.ndarray, np.ndarray] | None:
        found = self.run(data, _occurrences, _COUNTS).group_by("sub").aggregate([("n", "sum"), ("dirty", "sum")])
        return _significant(*(found.column(c).to_numpy() for c in ("sub", "n_sum", "dirty_sum")), least)


class Cluster:
    """Runs it as Spark tasks over Arrow batches; what comes back is bounded by the sample."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def give(self, table: pa.Table) -> DataFrame:
        return self.spark.createDataFrame(table).repartition(2 * self.spark.sparkContext.defaultParallelism)

    def run(self, data: DataFrame, work: Work, schema: str) -> pa.Table:
        return data.mapInArrow(lambda batches: (work(batch) for batch in batches), schema).toArrow()

    def above(self, data: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray] | None:
        counted = data.mapInArrow(lambda batches: map(_occurrences, batches), _COUNTS).groupBy("sub").agg(F.sum("n").alias("n"), F.sum("dirty").alias("dirty"))
        whole = data.agg(F.count("*"), F.sum("flagged")).first()
        share = (whole[1] or 0) / max(whole[0], 1)
        # what can't be significant stays on the cluster
        high = (F.col("dirty") - share * F.col("n")) > least * F.sqrt(F.greatest(F.lit(1), "n") * share * (1 - share))
        found = counted.where(high | (F.col("sub") < 0)).toArrow()
        return _significant(*(found.column(c).to_numpy() for c in ("sub", "n", "dirty")), least)


def fit(sample, terms: list[str], where: Here | Cluster | None = None, seed: int = 0) -> Model:
    """A model from a sample of documents (flagged 0 or 1, text), as where.give has it. terms: listed words, which seed the choice of passages."""
    where = where or Here()
    none = Model(np.zeros(TABLE, np.float32), -1.0)
    seeds = where.above(sample, SIGNIFICANT - 0.3)
    if seeds is None:
        return none
    rng = np.random.default_rng(seed)
    # first scores: subsequences that flagged documents have significantly more often than their share, documents counted once
    first = Model(np.full(TABLE, -0.3, np.float32), 0.0)
    first.weights[seeds[0]] = np.clip(seeds[1] - SIGNIFICANT, -0.3, 4)
    found = where.run(sample, _first_scores(first, terms), "doc long, flagged long, score double, letters binary")
    found = found.sort_by([("doc", "ascending"), ("letters", "ascending")])
    doc, label, score = (found.column(c).to_numpy() for c in ("doc", "flagged", "score"))
    if len(set(label.tolist())) < 2:
        return none
    # of either kind the passages that score highest, and of clean ones as many by chance, are trained on
    ranked = np.argsort(-score, kind="stable")
    dirty, clean = ranked[label[ranked] == 1][:MAX_PASSAGES], ranked[label[ranked] == 0]
    clean = np.concatenate([clean[: MAX_PASSAGES // 2], rng.permutation(clean[MAX_PASSAGES // 2 :])[: MAX_PASSAGES // 2]])
    rows = np.sort(np.concatenate([dirty, clean]))
    y, score, doc = label[rows], score[rows], doc[rows]
    letters = found.column("letters").take(pa.array(rows)).to_pylist()
    del found, ranked, clean, dirty
    for turn in range(ROUNDS):
        top = _chosen(score, doc, y)
        if not len(top):
            return none
        used = np.concatenate([top, np.flatnonzero(y == 0)])
        target = np.where(y[used] == 1, 1.0, -1.0)
        n = LANDMARKS if turn == ROUNDS - 1 else LANDMARKS // 2
        pool = rng.permutation(top)[:POOL]
        spread = pool[_diverse(_values(where, [letters[i] for i in pool], [letters[i] for i in pool]), n * 3 // 5)]
        hard = np.flatnonzero(y == 0)[np.argsort(-score[y == 0], kind="stable")]
        marks = np.unique(np.concatenate([spread, hard[: n // 5], rng.permutation(hard[n // 5 :])[: n // 5]]))
        values = _values(where, letters, [letters[i] for i in marks])
        among = values[marks].astype(np.float64)
        value, vector = np.linalg.eigh((among + among.T) / 2)
        good = value > 1e-4 * value[-1]
        root = vector[:, good] / np.sqrt(value[good])
        w, b = _machine(values[used] @ root.astype(np.float32), target)
        beta = root @ w
        score = values @ beta + b
    codes, lo, hi = joined([letters[i] for i in marks])
    own, sub, val = features(codes, lo, hi)
    table = np.zeros(TABLE, np.float32)
    np.add.at(table, sub, (val * (beta / norms(lo, hi))[own]).astype(np.float32))
    return Model(table, float(b))


def joined(letters: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages' letters in a row, and where each starts and ends."""
    sizes = np.array([len(x) // 4 for x in letters], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(letters), np.uint32), ends - sizes, ends


def _occurrences(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The hashed subsequences of a batch of documents, with the documents and the flagged ones that have each; -1 for all documents."""
    flags = batch.column("flagged").to_numpy(zero_copy_only=False)
    codes = stream(batch.column("text"))
    doc = np.cumsum(codes == 0x1F) - (codes == 0x1F)
    part = np.cumsum((codes == 0x1E) | (codes == 0x1F))
    ends = np.concatenate([[0], np.flatnonzero(codes == 0x1F) + 1])
    both = []
    for i in range(0, len(flags), 64):  # some documents at a time
        lo, hi = ends[i], ends[min(i + 64, len(flags))]
        seen = []
        for reach, h, _ in subsequences(codes[lo:hi]):
            n = len(h)
            seen.append(np.unique((doc[lo : lo + n] * np.int64(TABLE) + h)[part[lo : lo + n] == part[lo + reach : lo + reach + n]]))
        if seen:
            both.append(np.unique(np.concatenate(seen)))
    both = np.concatenate(both) if both else np.zeros(0, np.int64)
    among = np.bincount(both % TABLE, minlength=TABLE)
    dirty = np.bincount((both % TABLE)[flags[both // TABLE] == 1], minlength=TABLE)
    sub = np.flatnonzero(among)
    columns = ([-1], sub), ([len(flags)], among[sub]), ([flags.sum()], dirty[sub])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], ["sub", "n", "dirty"])


def _significant(sub: np.ndarray, n: np.ndarray, dirty: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed subsequences and by how many standard deviations flagged documents have them too often, where that is over least.

    -1 stands for the documents themselves; None without documents of both kinds.
    """
    whole = sub < 0
    documents, flagged = n[whole].sum(), dirty[whole].sum()
    if not 0 < flagged < documents:
        return None
    share = flagged / documents
    z = (dirty - share * n) / np.sqrt(np.maximum(1, n) * share * (1 - share))
    kept = ~whole & (z > least)
    return sub[kept], z[kept]


def _first_scores(model: Model, terms: list[str]) -> Work:
    words = [bytes(stream(pa.array([t], pa.string()))[:-1]).decode("utf-32-le").replace("\x1e", "") for t in terms]
    expression = "|".join(re.escape(w) for w in words if len(w) > 1) or r"(?!)"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = stream(batch.column("text"))
        own, lo, hi = passages(codes)
        hits = np.zeros(len(codes) + 1, np.int64)
        for m in re.finditer(expression, codes.astype("<u4").tobytes().decode("utf-32-le", "replace")):
            hits[m.start()] = 1
        upto = np.concatenate([[0], np.cumsum(hits)])
        score = model.score(codes, lo, hi) + (upto[hi] > upto[lo])
        letters = pa.array([codes[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
        doc, flagged = (batch.column(c).take(pa.array(own)).cast(pa.int64()) for c in ("doc_id", "flagged"))
        return pa.RecordBatch.from_arrays([doc, flagged, pa.array(score, pa.float64()), letters], ["doc", "flagged", "score", "letters"])

    return work


def _values(where: Here | Cluster, letters: list[bytes], marks: list[bytes]) -> np.ndarray:
    """Normalised kernel values of passages with landmarks, spread over where."""
    data = where.give(pa.table({"row": pa.array(np.arange(len(letters))), "letters": pa.array(letters, pa.binary())}))
    values = np.empty((len(letters), len(marks)), np.float32)
    for batch in where.run(data, _kernel_rows(marks), "row long, kernel binary").to_batches():
        for row, own in zip(batch.column("row").to_pylist(), batch.column("kernel"), strict=True):
            values[row] = np.frombuffer(own.as_buffer(), np.float32)
    return values


def _kernel_rows(marks: list[bytes]) -> Work:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = kernel(*joined(batch.column("letters").to_pylist()), marks)
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array([v.tobytes() for v in values], pa.binary())], ["row", "kernel"])

    return work


def _chosen(score: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Passages taken as flagged: those of flagged documents above nearly all clean ones, if best of their document or above 0."""
    bar = np.quantile(score[y == 0], ABOVE)
    rows = np.flatnonzero((y == 1) & (score > bar))
    order = rows[np.lexsort((-score[rows], doc[rows]))]
    best = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])] if len(order) else order
    return np.unique(np.concatenate([best, rows[score[rows] > max(bar, 0)]]))


def _diverse(kernel: np.ndarray, n: int) -> np.ndarray:
    """n members that span the others best, by pivoted Cholesky decomposition of their kernel: rare kinds get their landmarks."""
    left = kernel.diagonal().copy()
    n = min(n, len(left))
    columns, chosen = np.zeros((len(left), n)), []
    for k in range(n):
        i = int(np.argmax(left))
        if left[i] < 1e-6:
            break
        columns[:, k] = (kernel[:, i] - columns[:, :k] @ columns[i, :k]) / np.sqrt(left[i])
        left = np.maximum(0, left - columns[:, k] ** 2)
        left[i] = 0
        chosen.append(i)
    return np.array(chosen, np.int64)


def kernel(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """Normalised kernel values of passages with landmarks."""
    out = np.zeros((len(lo), len(marks)), np.float32)
    own, sub, val = features(codes, lo, hi)
    place = np.zeros(TABLE, np.int32)
    for first in range(0, len(marks), LANDMARKS_AT_ONCE):
        mark_codes, mark_lo, mark_hi = joined(marks[first : first + LANDMARKS_AT_ONCE])
        mark_own, mark_sub, mark_val = features(mark_codes, mark_lo, mark_hi)
        kept, compact = np.unique(mark_sub, return_inverse=True)
        dense = np.zeros((len(kept), len(mark_lo)), np.float32)
        np.add.at(dense, (compact, mark_own), mark_val / norms(mark_lo, mark_hi)[mark_own])
        place[kept] = np.arange(1, len(kept) + 1)
        col = place[sub]
        useful = np.flatnonzero(col)
        col, row, v = col[useful] - 1, own[useful], val[useful]
        place[kept] = 0
        part = out[:, first : first + len(mark_lo)]
        for i in range(0, len(col), 1 << 15):
            r = row[i : i + (1 << 15)]
            starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            part[r[starts]] += np.add.reduceat(dense[col[i : i + (1 << 15)]] * v[i : i + (1 << 15), None], starts, axis=0)
    return out / norms(lo, hi)[:, None].astype(np.float32)


def _machine(x: np.ndarray, y: np.ndarray, cost: float = 1.0) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, flagged passages weighing HEAVIER, by Newton steps on its support vectors."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    each = np.where(y > 0, cost * HEAVIER, cost).astype(x.dtype)
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        active = np.flatnonzero(y * (x1 @ w) < 1)
        left, right = ridge.copy(), np.zeros(len(w))
        for i in range(0, len(active), 1024):  # some rows at a time, in double precision
            part = active[i : i + 1024]
            a = x1[part].astype(np.float64)
            left += (a * each[part, None]).T @ a
            right += a.T @ (each[part] * y[part])
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def _score_documents(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = stream(batch.column(1))
            doc, lo, hi = passages(codes)
            best = np.full(batch.num_rows, -np.inf)
            np.maximum.at(best, doc, model.score(codes, lo, hi))
            none = np.isinf(best)
            scores = pa.array(np.where(none, 0, best), pa.float64(), mask=none)
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc_id", "score"])

    return run


def train(documents: DataFrame, labels: DataFrame, terms: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> Model:
    """A model from a bounded sample of labelled documents: of the first MAX_DOCUMENTS by hash, each that still fits in MAX_LETTERS letters.

    The sample's texts stay in the shared folder; ids and lengths, then passages, at most twice MAX_LETTERS letters, come to the driver.
    """
    marks = labels.where("flagged IN (0, 1)").groupBy("doc_id").agg(F.max("flagged").alias("flagged"))
    some = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_DOCUMENTS)  # ids only; at most so many are broadcast
    rows = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(some), "doc_id").distinct()
    sample = store(rows.select("doc_id", "flagged", "text"), "sample")
    lengths = sample.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n"), F.xxhash64("doc_id", F.lit(1)).alias("turn")).orderBy("turn", "doc_id", "h").collect()  # at most MAX_DOCUMENTS, but for ids with several texts
    letters, left_out = 0, []
    for r in lengths:
        if letters + r["n"] > MAX_LETTERS:
            left_out.append((r["doc_id"], r["h"]))
        else:
            letters += r["n"]
    spark = documents.sparkSession
    if left_out:
        sample = sample.withColumn("h", F.xxhash64("text")).join(F.broadcast(spark.createDataFrame(left_out, "doc_id long, h long")), ["doc_id", "h"], "left_anti").drop("h")
    listed = [r[0] for r in terms.select("term").where("term IS NOT NULL").distinct().orderBy("term").collect()]
    return fit(sample.repartition(2 * spark.sparkContext.defaultParallelism, "doc_id"), listed, Cluster(spark))


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every document: the highest of its passages. Flagged is a score above 0."""
    spark = documents.sparkSession
    return documents.select("doc_id", "text").mapInArrow(_score_documents(model), "doc_id long, score double")
