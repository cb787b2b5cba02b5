"""How often every distinct term occurs and in how many records, by burst tries.

Workers hold their rows' terms in a burst trie: an access trie over prefixes whose leaves are containers of sorted terms with
their counters of occurrences and records. The terms of some batches at a time, sorted, are led down the trie and merged into
the containers, counters added; a container over its capacity bursts into one for each next character. Subtrees travel
front-coded and are routed by prefixes that adapt to the data: a prefix with more than ROUTE terms is followed by a further
character, so no merge task gets more of them, whatever the vocabulary's size. Matching subtrees of all workers are merged as
sorted runs, counters added.

A record is all rows of one key, and counts once for a term however many of its texts hold it; equal texts of a key are one.
Each distinct text without a key is a record. Terms are the non-empty pieces between U+0020, exactly as stored; null and
empty texts are records without terms. An empty table gives no terms. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms in a container, above which it bursts.
CAPACITY = 512
#: Distinct terms that a worker's trie holds before it is handed on and another begun; terms of batches that enter it at a time.
HELD, ENTER = 1_000_000, 200_000
#: Terms under a prefix, above which it is routed by a further character.
ROUTE = 200_000

SUBTREE = "prefix string, n long, common array<int>, tails array<string>, occurrences array<long>, records array<long>"


class Trie:
    """A burst trie: containers (sorted terms, occurrences, records) by prefix, and the terms that end at a prefix that has burst."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.leaves: dict[str, tuple[list[str], np.ndarray, np.ndarray]] = {}
        self.burst: set[str] = set()
        self.ended: dict[str, tuple[int, int]] = {}
        self.size = 0

    def add(self, terms: list[str], occurrences: np.ndarray, records: np.ndarray) -> None:
        """Adds the counters of sorted, distinct terms."""
        todo = [("", 0, len(terms))]
        while todo:
            prefix, lo, hi = todo.pop()
            if prefix not in self.burst:
                self._merge(prefix, terms[lo:hi], occurrences[lo:hi], records[lo:hi])
                continue
            if lo < hi and len(terms[lo]) == len(prefix):
                self.size += prefix not in self.ended
                o, n = self.ended.get(prefix, (0, 0))
                self.ended[prefix] = o + int(occurrences[lo]), n + int(records[lo])
                lo += 1
            while lo < hi:
                head = terms[lo][: len(prefix) + 1]
                end = bisect_left(terms, head[:-1] + chr(ord(head[-1]) + 1), lo, hi) if head[-1] < "\U0010ffff" else hi
                todo.append((head, lo, end))
                lo = end

    def _merge(self, prefix: str, terms: list[str], occurrences: np.ndarray, records: np.ndarray) -> None:
        if prefix in self.leaves:
            own = self.leaves[prefix]
            self.size -= len(own[0])
            terms, occurrences, records = merged([own, (terms, occurrences, records)])
        self.size += len(terms)
        self.leaves[prefix] = terms, occurrences, records
        if len(terms) > self.capacity:
            self.burst.add(prefix)
            self.size -= len(terms)
            self.add_below(prefix, *self.leaves.pop(prefix))

    def add_below(self, prefix: str, terms: list[str], occurrences: np.ndarray, records: np.ndarray) -> None:
        """Adds terms that all begin with a prefix that has burst, one container for each next character."""
        lo = 0
        if len(terms[0]) == len(prefix):
            self.size += 1
            self.ended[prefix] = int(occurrences[0]), int(records[0])
            lo = 1
        while lo < len(terms):
            head = terms[lo][: len(prefix) + 1]
            end = bisect_left(terms, head[:-1] + chr(ord(head[-1]) + 1), lo) if head[-1] < "\U0010ffff" else len(terms)
            self._merge(head, terms[lo:end], occurrences[lo:end], records[lo:end])
            lo = end

    def subtrees(self) -> Iterator[tuple]:
        """prefix, terms, occurrences, records of all containers; a term that ends at a prefix that has burst is one of its own."""
        for prefix, (terms, occurrences, records) in self.leaves.items():
            if terms:
                yield prefix, terms, occurrences.tolist(), records.tolist()
        for term, (o, n) in self.ended.items():
            yield term, [term], [o], [n]


def merged(runs: list[tuple[list[str], np.ndarray, np.ndarray]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Sorted runs of terms as one; the counters of equal terms are added."""
    terms = [t for run, _, _ in runs for t in run]
    order = sorted(range(len(terms)), key=terms.__getitem__)  # merges runs
    ordered = [terms[i] for i in order]
    first = np.array([True] + [a != b for a, b in zip(ordered[1:], ordered, strict=False)])[: len(ordered)]
    starts = np.flatnonzero(first)
    at = np.array(order, np.int64)
    sums = [np.add.reduceat(np.concatenate([run[k] for run in runs])[at], starts) if len(starts) else np.zeros(0, np.int64) for k in (1, 2)]
    return [ordered[i] for i in starts.tolist()], *sums


def front_code(terms: list[str]) -> tuple[list[int], list[str]]:
    """For each of the sorted terms the length it shares with the one before, and the rest."""
    common, tails, last = [], [], ""
    for t in terms:
        k, most = 0, min(len(last), len(t))
        while k < most and last[k] == t[k]:
            k += 1
        common.append(k)
        tails.append(t[k:])
        last = t
    return common, tails


def front_decode(common: list[int], tails: list[str]) -> list[str]:
    terms, last = [], ""
    for k, tail in zip(common, tails, strict=True):
        last = last[:k] + tail
        terms.append(last)
    return terms


def _handed_on(trie: Trie) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for prefix, terms, occurrences, records in trie.subtrees():
        out.append((prefix, len(terms), *front_code(terms), occurrences, records))
        if len(out) == 200:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = ["prefix", "n", "common", "tails", "occurrences", "records"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def count_batch(texts: pa.Array) -> pa.Table:
    """term, o, r of a batch of records' texts; a record may have a list of texts."""
    record = None
    if pa.types.is_list(texts.type):
        record, texts = pc.list_parent_indices(texts).to_numpy(), texts.flatten()
    lists = pc.split_pattern(texts, " ")
    flat, owner = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.not_equal(flat, "")
    flat, owner = flat.filter(some), owner.filter(some).to_numpy()
    owner = owner if record is None else record[owner]
    coded = flat.dictionary_encode()
    code, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    once = np.unique(owner.astype(np.int64) * max(n, 1) + code) % max(n, 1)
    return pa.table({"term": coded.dictionary.cast(pa.string()), "o": np.bincount(code, minlength=n), "r": np.bincount(once, minlength=n)})


def _entered(trie: Trie, parts: list[pa.Table]) -> None:
    """Leads the terms of some batches down the trie."""
    whole = pa.concat_tables(parts).sort_by("term")
    terms = whole.column("term").to_pylist()
    starts = np.flatnonzero([True, *(a != b for a, b in zip(terms[1:], terms, strict=False))][: len(terms)])
    sums = [np.add.reduceat(whole.column(c).to_numpy(), starts) if len(starts) else np.zeros(0, np.int64) for c in ("o", "r")]
    trie.add([terms[i] for i in starts.tolist()], *sums)


def _count(held: int, enter: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        trie = Trie(capacity)
        waiting = rows = 0
        for batch in batches:
            rows += batch.num_rows
            parts.append(count_batch(batch.column(0)))
            waiting += parts[-1].num_rows
            if waiting > enter:
                _entered(trie, parts)
                parts, waiting = [], 0
                if trie.size > held:
                    yield from _handed_on(trie)
                    trie = Trie(capacity)
        if waiting:
            _entered(trie, parts)
        yield from _handed_on(trie)
        yield _batch([(None, rows, [], [], [], [])])  # how many records there were

    return run


def _route(heavy: frozenset[str], deepest: int):
    def route(term: str) -> str:
        for k in range(min(deepest, len(term)), -1, -1):
            if term[:k] in heavy:
                return term[: k + 1]
        return ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole: list[str] = []
            rows: list[int] = []
            split: list[tuple] = []
            names: list[str] = []
            for i, (prefix, n) in enumerate(zip(batch.column("prefix").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                if n == 1 or prefix not in heavy:  # heavy has the beginnings of its members too
                    rows.append(i)
                    whole.append(route(prefix if n > 1 else batch.column("tails")[i][0].as_py()))
                    continue
                row = batch.slice(i, 1).to_pylist()[0]
                parts: dict[str, list[tuple]] = {}
                for t, o, r in zip(front_decode(row["common"], row["tails"]), row["occurrences"], row["records"], strict=True):
                    parts.setdefault(route(t), []).append((t, o, r))
                for name, own in parts.items():
                    names.append(name)
                    split.append((name, len(own), *front_code([x[0] for x in own]), [x[1] for x in own], [x[2] for x in own]))
            for part, own in ((batch.take(pa.array(rows, pa.int64())), whole), (_batch(split), names)):
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), *part.columns], ["route", *part.schema.names])

    return run


def _merge(subtrees: pa.Table) -> pa.Table:
    runs = [(front_decode(row["common"], row["tails"]), np.array(row["occurrences"], np.int64), np.array(row["records"], np.int64)) for row in subtrees.select(["common", "tails", "occurrences", "records"]).to_pylist()]
    terms, occurrences, records = merged(runs)
    return pa.table({"term": pa.array(terms, pa.string()), "occurrences": occurrences, "records": records})


def count_terms(rows: DataFrame, key: str, text: str, store: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """term, occurrences, records of every distinct term; and the number of records. store writes the workers' tries to the shared folder."""
    given = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    records = given.groupBy("key", F.when(F.col("key").isNull(), F.col("text")).alias("own")).agg(F.collect_set("text").alias("texts"))
    tries = store(records.select("texts").mapInArrow(_count(HELD, ENTER, CAPACITY), SUBTREE))
    sums = tries.where("prefix IS NULL").agg(F.sum("n")).collect()
    n_records = sums[0][0] or 0
    trees = tries.where("prefix IS NOT NULL")
    starts = F.transform(F.sequence(F.lit(0), F.length("prefix")), lambda k: F.substring("prefix", F.lit(1), k))
    heavy = trees.select(F.explode(starts).alias("start"), "n").groupBy("start").agg(F.sum("n").alias("n")).where(F.col("n") > ROUTE)
    many = frozenset(r[0] for r in heavy.select("start").collect())  # one for each ROUTE terms at most, at each depth
    routed = trees.mapInArrow(_route(many, max(map(len, many), default=0)), "route string, " + SUBTREE)
    return routed.groupBy("route").applyInArrow(_merge, "term string, occurrences long, records long"), n_records


def mark_terms(counts: DataFrame, n_records: int, rare: int = 2, common_one_in: int = 20) -> DataFrame:
    """counts with mark: rare (in at most so many records), common (in more than one of common_one_in of all records and not rare), or null."""
    common = F.col("records") * common_one_in > n_records
    return counts.withColumn("mark", F.when(F.col("records") <= rare, "rare").when(common, "common"))
