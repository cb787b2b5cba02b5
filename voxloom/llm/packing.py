"""Filling containers of a fixed capacity with documents, as little room left as possible.

Conflict-constrained best fit: items go longest first, but the members of large clusters before all others, while there are
containers enough without one; open containers are kept ordered by the room left, each with a bitmap
of its sources and one of its duplicate clusters. The successor search starts at the tightest container with room and goes on,
without a limit, until one is compatible: it holds no duplicate of the item, and nothing of the item's source. Duplicates are
always kept apart. Sources are kept apart as long as any container with room allows it; else the tightest one without a
duplicate is taken, for a source of a third of all documents can't be kept apart in containers of four.

A cluster with more members than the fewest containers that could hold its block can't be kept apart without near-empty
containers; it is spread evenly instead, each container holding at most the number that some container must hold.

Items longer than the capacity are cut into full pieces and a rest; the rest is packed as an item.
Duplicates are texts with the same words, case, punctuation and spacing apart. Documents without tokens (null or empty text)
get container -1 and piece 0. Repeated rows count once. A null doc_id is kept; rows of one doc_id with other texts are items of
their own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm import tokens

#: Items in a block, which is packed on its own in one task. Each block leaves about one container partly empty.
BLOCK_ITEMS = 20_000
#: A cluster is large with more than one member for CROWD of the fewest containers that could hold the block.
CROWD = 10
#: Containers looked at in one step of the search.
STEP = 512


class _Bits:
    """Bitmaps of containers, a column of words of 64 bits for every 64 members."""

    def __init__(self, members: int, containers: int):
        self.words = np.zeros((members // 64 + 1, containers), np.uint64)

    def free(self, member: int, which: np.ndarray) -> np.ndarray:
        return (self.words[member >> 6, which] & np.uint64(1 << (member & 63))) == 0

    def add(self, member: int, which: int) -> None:
        self.words[member >> 6, which] |= np.uint64(1 << (member & 63))


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The container of each item, numbered from 0 in the order they are opened. Each size is 1 to capacity; sources and clusters are numbers from 0, cluster -1 is none."""
    n = len(sizes)
    size, cluster = np.array(sizes, np.int64), np.array(clusters, np.int64)
    fewest = -(-int(size.sum()) // capacity) if n else 0
    members = np.bincount(cluster[cluster >= 0]) if (cluster >= 0).any() else np.zeros(0, np.int64)
    crowd = np.zeros(n, np.int64)
    crowd[cluster >= 0] = members[cluster[cluster >= 0]]
    crowd[crowd * CROWD <= fewest] = 0
    order = np.lexsort((np.arange(n), cluster, -size, -crowd))
    most = -(-members // max(fewest, 1))
    has_source, has_cluster = _Bits(max(sources, default=0), n), _Bits(len(members), n)
    held = {int(c): np.zeros(n, np.int32) for c in np.flatnonzero(most > 1)}  # few: a cluster of more than the fewest containers
    room, box = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)  # open containers by the room left
    n_open = n_boxes = 0
    where = [-1] * n
    for i in order.tolist():
        own, s, c = int(size[i]), sources[i], clusters[i]
        start = int(np.searchsorted(room[:n_open], own))
        found = apart = -1
        for k in range(start, n_open, STEP):
            which = box[k : min(k + STEP, n_open)]
            fits = has_cluster.free(c, which) if c >= 0 and c not in held else held[c][which] < most[c] if c >= 0 else np.ones(len(which), bool)
            if apart < 0 and fits.any():
                apart = k + int(np.argmax(fits))
            both = fits & has_source.free(s, which)
            if both.any():
                found = k + int(np.argmax(both))
                break
        found = apart if found < 0 else found
        if found < 0:
            b, left = n_boxes, capacity
            n_boxes += 1
        else:
            b, left = int(box[found]), int(room[found])
            room[found : n_open - 1], box[found : n_open - 1] = room[found + 1 : n_open], box[found + 1 : n_open]
            n_open -= 1
        where[i] = b
        has_source.add(s, b)
        if c in held:
            held[c][b] += 1
        elif c >= 0:
            has_cluster.add(c, b)
        if left > own:
            at = int(np.searchsorted(room[:n_open], left - own, "right"))
            room[at + 1 : n_open + 1], box[at + 1 : n_open + 1] = room[at:n_open], box[at:n_open]
            room[at], box[at] = left - own, b
            n_open += 1
    return where


def _pack_block(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        rows["rest"] = rows["tokens"] % capacity
        items = rows[rows["rest"] > 0]
        sources = items["source"].fillna("").astype("category").cat.codes.astype(int).tolist()
        often = items["cluster"].value_counts()
        number = {c: k for k, c in enumerate(sorted(often.index[often > 1]))}
        codes = [number.get(c, -1) for c in items["cluster"]]
        found = best_fit(items["rest"].tolist(), sources, codes, capacity)
        own = dict(zip(items.index, found, strict=True))
        n = max(found, default=-1) + 1
        out = []
        for i, doc, size, rest in zip(rows.index, rows["doc_id"], rows["tokens"], rows["rest"], strict=True):
            full = size // capacity
            for piece in range(full):
                out.append((doc, piece, piece * capacity, capacity, n))
                n += 1
            if rest:
                out.append((doc, full, full * capacity, rest, own[i]))
        done = pd.DataFrame(out, columns=["doc_id", "piece", "start", "tokens", "container"])
        done["block"] = rows["block"].iloc[0]
        return done[["doc_id", "piece", "start", "tokens", "block", "container"]]

    return run


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece, start, tokens, block, container of the items (doc_id, tokens, source, cluster).

    A container is known by block and container. Blocks are by hash of doc_id, so copies and hot sources spread over all of
    them, and none grows with the data.
    """
    if capacity < 1:
        raise ValueError("capacity must be 1 or more")
    items = items.select("doc_id", "tokens", "source", "cluster")
    n = max(1, math.ceil(items.count() / BLOCK_ITEMS))
    rows = items.where("tokens > 0").withColumn("block", F.pmod(F.xxhash64("doc_id", "cluster", F.lit(9)), F.lit(n)))
    packed = rows.groupBy("block").applyInPandas(_pack_block(capacity), "doc_id long, piece long, start long, tokens long, block long, container long")
    none = items.where("tokens = 0").select("doc_id", *(F.lit(v).cast("long").alias(c) for c, v in (("piece", 0), ("start", 0), ("tokens", 0), ("block", -1), ("container", -1))))
    return packed.unionByName(none)


def pack_documents(documents: DataFrame, capacity: int, store=None, folder: str = tokens.FOLDER, name: str = tokens.NAME) -> DataFrame:
    """pack() of documents (doc_id, text, source), sized in tokens. store keeps the sizes between jobs."""
    items = tokens.encode_corpus(documents, folder, name, counts_only=True, carried="source").withColumnRenamed("words", "cluster")
    return pack(store(items) if store else items, capacity)
