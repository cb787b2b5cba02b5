"""Files: digests, verification against a manifest, selection, safe members, export totals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def git_id(content: Column) -> Column:
    """The object id that git gives a file's content."""
    head = F.concat(F.encode(F.concat(F.lit("blob "), F.length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")))
    return F.sha1(F.concat(head, content))


def digest(content: Column, kind: Column) -> Column:
    """Hex digest of binary content: sha256, md5 or git."""
    return F.when(kind == "sha256", F.sha2(content, 256)).when(kind == "md5", F.md5(content)).when(kind == "git", git_id(content))


def verified(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, state (missing, size, hash, good) of a manifest (path, size, kind, expected) against files (path, content)."""
    joined = manifest.join(files, "path", "left")
    state = F.when(F.col("content").isNull(), "missing").when(F.length("content") != F.col("size"), "size").when(digest(F.col("content"), F.col("kind")) != F.col("expected"), "hash").otherwise("good")
    return joined.select("path", state.alias("state"))


def wanted(listing: DataFrame, paths: DataFrame) -> DataFrame:
    """path, size, kind, expected of wanted paths in a listing (path, size, oid, lfs_oid): large files by sha256, others by git id; those not listed get null."""
    expected = F.coalesce("lfs_oid", "oid")
    return paths.join(listing, "path", "left").select("path", "size", F.when(expected.isNotNull(), F.when(F.col("lfs_oid").isNotNull(), "sha256").otherwise("git")).alias("kind"), expected.alias("expected"))


def safe_members(members: DataFrame, top: str) -> DataFrame:
    """Members (name, is_link) of an archive that lie under top, without links, absolute or climbing names."""
    parts = F.split("name", "/")
    safe = (F.get(parts, F.lit(0)) == top) & ~F.array_contains(parts, "..") & ~F.col("is_link") & ~F.col("name").startswith("/")
    return members.where(safe)


def ordered_digest(rows: DataFrame, by: str, order: str, line: Column, name: str = "digest") -> DataFrame:
    """by, digest, records: SHA-256 over each group's lines in order.

    A digest is one sequence by its nature, so a group's lines pass one task, sorted and batch by batch; none is held whole.
    """
    kept = rows.select(F.col(by).cast("string").alias(by), F.col(order).alias("_order"), line.alias("_line"))
    sorted_ = kept.repartition(by).sortWithinPartitions(by, "_order").select(by, "_line")
    return sorted_.mapInArrow(_digests, "k string, d string, n long").toDF(by, name, "records")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, state, n, seen = None, None, 0, False
    out = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.string()), pa.array([state.hexdigest()]), pa.array([n])], ["k", "d", "n"])
    for batch in batches:
        for key, line in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            if not seen or key != last:
                if seen:
                    yield out()
                last, state, n, seen = key, hashlib.sha256(), 0, True
            state.update((line or "").encode())
            n += 1
    if seen:
        yield out()


def export_totals(arrays: DataFrame, width: int) -> DataFrame:
    """bytes, parameters, arrays of arrays (key, v), stored with so many bytes for a number."""
    return arrays.agg((F.coalesce(F.sum(F.size("v")), F.lit(0)) * width).alias("bytes"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("parameters"), F.count("*").alias("arrays"))




def weight_files(arrays: DataFrame, width: int, file: str) -> DataFrame:
    """key, file, first_byte, bytes of arrays (key, v) stored one after the other in the order of their keys.

    Keys are few against numbers; their sizes, not the numbers, are ordered.
    """
    sizes = arrays.select("key", (F.size("v") * width).cast("long").alias("bytes"))
    upto = F.sum("bytes").over(Window.orderBy("key"))
    return sizes.select("key", F.lit(file).alias("file"), (upto - F.col("bytes")).alias("first_byte"), "bytes")


def selected_weights(arrays: DataFrame, prefix: str = "", without: tuple[str, ...] = ()) -> DataFrame:
    """Arrays whose key begins with prefix and ends in none of the endings of without."""
    kept = F.col("key").startswith(prefix)
    for ending in without:
        kept = kept & ~F.col("key").endswith(ending)
    return arrays.where(kept)


def needed(sources: DataFrame, chosen: list[str], given: list[str]) -> DataFrame:
    """corpus, sources: the corpora that chosen sources (source, corpus) need and that aren't given."""
    return sources.where(F.col("source").isin(chosen) & ~F.col("corpus").isin(given)).groupBy("corpus").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def layout(drawn: DataFrame, recordings: DataFrame, out: str, shards: int) -> DataFrame:
    """shard, file, path, target, problem of drawn files (file, shard): where each is to lie and the recording it stands for.

    recordings: file, target. One shard has no folder of its own. A file without a recording is a problem, and so are (file, path
    null) recordings already in a shard's folder (drawn rows with a null shard) that weren't drawn.
    """
    folder = F.lit(out) if shards == 1 else F.concat(F.lit(f"{out}/"), (F.col("shard") + 1).cast("string"))
    joined = drawn.join(recordings, "file", "left")
    problem = F.when(F.col("shard").isNull(), "not drawn").when(F.col("target").isNull(), "no recording")
    return joined.select("shard", "file", F.concat(folder, F.lit("/"), "file").alias("path"), "target", problem.alias("problem"))
