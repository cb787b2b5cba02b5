"""Encoding of a corpus with a public tokenizer: every distinct word is encoded once, ids go back by position.

Texts are cut before each space that something follows (and at single line breaks). The tokenizer's own pattern always
begins a new piece there, so the ids of a text are the ids of its words, one after the other. The cut is checked against
whole-text encoding in the tests.

Null and empty texts get an empty list. A null doc_id is kept. Extra columns are ignored. Repeated rows count once.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Bytes of text in a block of documents, which one task holds at a time with its words and ids.
BLOCK_BYTES = 2 << 20
BLOCKS_A_TASK = 2
#: Blocks, or groups of them, that share one row of each word at the level above.
GROUP = 1000

# White space as the tokenizer's pattern has it (Unicode's property).
_WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Texts for which a cut at single spaces and line breaks alone would not do.
_ODD = r"^[ \n]|[ \n]$|[ \n][ \n]|[\t\x0b\x0c\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CUT = re.compile(f"(?= [^{_WHITE}])")


def cut(text: str) -> list[str]:
    """The words of one text: joined they are the text, encoded apart they give its ids."""
    return [w for w in _CUT.split(text) if w]


def cut_batch(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a batch; each occurrence's index into them, in order; the number of words of each text."""
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, _ODD)
    usual = pc.if_else(pc.or_(odd, pc.equal(texts, "")), pa.scalar(None, pa.string()), texts)
    lists = pc.split_pattern(pc.replace_substring(usual, "\n", " \n"), " ")
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    first = np.zeros(len(flat), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    bare = first | pc.starts_with(flat, "\n").to_numpy(zero_copy_only=False)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + ~bare
    seen = np.zeros(2 * len(coded.dictionary), bool)
    seen[code] = True
    kept = np.flatnonzero(seen)
    at = np.zeros(len(seen), np.int64)
    at[kept] = np.arange(len(kept))
    words = coded.dictionary.take(pa.array(kept // 2))
    words = pc.binary_join_element_wise(pc.if_else(pa.array(kept % 2 == 1), " ", ""), words, "")
    index = at[code]
    odd_at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if len(odd_at):
        extra: dict[str, int] = {}
        more, owner = [], [np.repeat(np.arange(len(texts)), counts)]
        for i in odd_at:
            own = [extra.setdefault(w, len(extra)) for w in cut(texts[int(i)].as_py())]
            counts[i] = len(own)
            more.append(np.array(own, np.int64) + len(words))
            owner.append(np.full(len(own), i))
        order = np.argsort(np.concatenate(owner), kind="stable")
        index = np.concatenate([index, *more])[order]
        words = pa.concat_arrays([words.cast(pa.string()), pa.array(list(extra), pa.string())])
    return words.cast(pa.string()), index, counts


@cache
def encoder(folder: str, name: str):
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    # A fixed value: the public pattern of this family of byte-level tokenizers.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _distinct_by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks = batch.column(0).to_numpy(zero_copy_only=False)
        for block in np.unique(blocks):
            words, _, _ = cut_batch(batch.column(2).filter(pa.array(blocks == block)))
            for i in range(0, len(words), 10_000):
                part = words.slice(i, 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), part], ["block", "word"])


def _coded(words: pa.Array, own, counts_only: bool) -> pa.Array:
    """Ids of each word, four bytes each; or only how many."""
    found = own.encode_ordinary_batch(words.to_pylist(), num_threads=1)
    return pa.array([len(x) for x in found], pa.int32()) if counts_only else pa.array([np.array(x, "<i4").tobytes() for x in found], pa.binary())


def _encode_words(folder: str, name: str, counts_only: bool = False):
    """Ids of the words in the last column, whose rows come sorted by word: each word is encoded once, however many rows it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, name)
        last, last_ids = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.columns[-1].dictionary_encode()
            distinct = words.dictionary
            fresh = 1 if last is not None and distinct[0].as_py() == last else 0
            ids = _coded(distinct.slice(fresh), own, counts_only)
            if fresh:
                ids = pa.concat_arrays([last_ids, ids])
            yield pa.RecordBatch.from_arrays([*batch.columns, ids.take(words.indices)], [*batch.schema.names, "ids"])
            at = words.indices[-1].as_py()
            last, last_ids = distinct[at].as_py(), ids.slice(at, 1)

    return run


def words_hashes(texts: pa.Array) -> pa.Array:
    """A number for each text's words, case, punctuation and spacing apart; that of no words for texts without any."""
    import xxhash

    bare = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pM\pN]+", " ")
    return pa.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in pc.utf8_trim(bare, " ").to_pylist()], pa.int64())


def _join_back(counts_only: bool, carried: str | None):
    own_columns = ["doc_id", "text"] + ([carried] if carried else [])

    def run(documents: pa.Table, words: pa.Table) -> pa.Table:
        table_words = words.column("word").combine_chunks()
        pieces = words.column("ids").combine_chunks()
        if isinstance(pieces, pa.ChunkedArray):
            pieces = pa.concat_arrays(pieces.chunks)
        docs = documents.combine_chunks()
        if len(docs.column("doc_id").unique()) < docs.num_rows:  # repeated rows
            docs = docs.group_by(own_columns).aggregate([]).combine_chunks()
        texts = docs.column("text").combine_chunks() if docs.num_rows else pa.array([], pa.string())
        own, index, counts = cut_batch(texts)
        at = pc.index_in(own, value_set=table_words).to_numpy(zero_copy_only=False)
        if counts_only:
            sizes = pieces.to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int32)
            sizes = np.diff(offsets) // 4
        where = at[index].astype(np.int64) if len(index) else np.zeros(0, np.int64)
        length = sizes[where] if len(where) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(counts)])]
        if counts_only:
            found = {"doc_id": docs.column("doc_id"), "tokens": pa.array(np.diff(ends), pa.int64())}
            return pa.table(found | {carried: docs.column(carried), "words": words_hashes(texts)} if carried else found)
        if len(where):
            values = np.frombuffer(pieces.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<i4")
            starts = (offsets[:-1] - offsets[0]) // 4
            total = int(ends[-1])
            base = np.repeat(starts[where] - (np.cumsum(length) - length), length)
            ids = values[base + np.arange(total)]
        else:
            ids = np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
        return pa.table({"doc_id": docs.column("doc_id"), "ids": lists})

    return run


def _blocks(documents: DataFrame, carried: str | None = None) -> tuple[DataFrame, int]:
    """block, doc_id, text (and a column that is carried) of the rows, blocks together; and how many blocks."""
    n_bytes = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(n_bytes / BLOCK_BYTES))
    rows = documents.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("block"), "doc_id", "text", *([carried] if carried else []))
    # a task gets a few blocks, whatever the data's size; small data still spread over the cluster
    parts = max(n // BLOCKS_A_TASK, min(n, 2 * documents.sparkSession.sparkContext.defaultParallelism))
    return rows.repartition(parts, "block"), n


def encoded_words(pairs: DataFrame, blocks: int, folder: str = FOLDER, name: str = NAME, counts_only: bool = False) -> DataFrame:
    """block, word, ids of distinct pairs (block, word): each distinct word is encoded once. With counts_only ids are their numbers.

    A frequent word has a row for every block. Up to GROUP blocks its rows meet in one task, which encodes it once and hands it
    to them. More blocks are gathered in groups of GROUP; a word has one row for each group at the level above, whose ids are
    joined back, so no task gets more than GROUP rows of a word for each of its rows above. Partitions grow with the blocks.
    """
    kind = "int" if counts_only else "binary"
    parts = max(2 * pairs.sparkSession.sparkContext.defaultParallelism, blocks // 64)
    if blocks <= GROUP:
        return pairs.select("block", "word").repartition(parts, "word").sortWithinPartitions("word").mapInArrow(_encode_words(folder, name, counts_only), f"block long, word string, ids {kind}")
    keyed = pairs.select("block", F.floor(F.col("block") / GROUP).alias("group"), "word")
    above = keyed.select(F.col("group").alias("block"), "word").repartition(parts, "block", "word").distinct()
    coded = encoded_words(above, math.ceil(blocks / GROUP), folder, name, counts_only).withColumnRenamed("block", "group")
    return keyed.join(coded.hint("shuffle_hash"), ["group", "word"]).select("block", "word", "ids")


def encode_corpus(documents: DataFrame, folder: str = FOLDER, name: str = NAME, counts_only: bool = False, carried: str | None = None) -> DataFrame:
    """doc_id and ids of every document, or doc_id and its number of tokens, and then, with a column that is carried, it and a hash of the words.

    documents: doc_id, text. Blocks of documents meet their words' ids; no block holds more than about BLOCK_BYTES of text, or
    one document.
    """
    rows, n = _blocks(documents, carried)
    schema = ("doc_id long, tokens long" + (f", {carried} string, words long" if carried else "")) if counts_only else "doc_id long, ids array<int>"
    pairs = rows.select("block", "doc_id", "text").mapInArrow(_distinct_by_block, "block long, word string")
    words = encoded_words(pairs, n, folder, name, counts_only)
    return rows.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_join_back(counts_only, carried), schema)


def word_table(documents: DataFrame, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """word, ids: the distinct words of the corpus, each encoded once."""
    words = documents.select("text").mapInArrow(_words_only, "word string").distinct()
    coded = words.mapInArrow(_encode_words(folder, name), "word string, ids binary")  # distinct, so in any order
    return coded.select("word", _as_list("ids").alias("ids"))


def _words_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, _, _ = cut_batch(batch.column(0))
        yield pa.RecordBatch.from_arrays([words], ["word"])


def _as_list(ids: str):
    """Integers of four little-endian bytes each; ids of this vocabulary fit three."""
    byte = lambda i, k: F.conv(F.hex(F.substring(F.col(ids), i * 4 + k, F.lit(1))), 16, 10).cast("int")
    at = F.when(F.length(ids) > 0, F.sequence(F.lit(0), F.expr(f"CAST(length({ids}) DIV 4 - 1 AS INT)"))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: byte(i, 1) + byte(i, 2) * 256 + byte(i, 3) * 65536)


def pieces(spark, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """id, piece (binary): the tokenizer's fixed vocabulary."""
    lines = spark.read.text(f"file://{folder}/{name}.tiktoken").where("value <> ''")
    parts = F.split("value", " ")
    return lines.select(parts[1].cast("int").alias("id"), F.unbase64(parts[0]).alias("piece"))


def decode(coded: DataFrame, key: str, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """key and text of each list of ids, through a join of ids with the tokenizer's pieces.

    Only the vocabulary (a fixed size of the tokenizer's, 50,257 rows) is broadcast. An empty list gives an empty text.
    """
    ids = coded.select(key, F.posexplode_outer("ids").alias("at", "id"))
    joined = ids.join(F.broadcast(pieces(coded.sparkSession, folder, name)), "id", "left")
    hexed = F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", F.hex("piece").alias("h")))))
    return joined.groupBy(key).agg(F.decode(F.unhex(F.array_join(F.transform(hexed, lambda x: x["h"]), "")), "UTF-8").alias("text"))
