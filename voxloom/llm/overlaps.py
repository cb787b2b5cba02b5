"""Evaluation texts that are read again in training texts, the same or almost the same.

The distinct evaluation texts, as lists of word hashes, are held in full-text indexes, one for each shard of them: the
Burrows-Wheeler transform as occurrence lists of its symbols, with which one search step is a binary search, and the places in
text order. Training streams through backward search of every shard, many words for each index that is loaded. By the pigeonhole principle, of the d + 1 segments into
which a training text is cut at least one stands unchanged in any evaluation text within d edits; so all segments are searched
and all their occurrences taken, whatever their number. Occurrences that can still lie within d edits by place and length are
extended to maximal matches, spans and counts merged for each pair of texts, and the word edit distance computed exactly.

Texts are compared as lists of words ignoring case, punctuation and character form. Texts without words, nulls among them, have
no overlaps. Repeated rows count once. No step compares all pairs: work is in proportion to training words and to occurrences.
"""

from __future__ import annotations

import io
import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.forms import visual_forms
from voxloom.llm.splits import speaker_key

#: Words of evaluation texts in an index; bytes of indexes a worker keeps; and training words that it holds for a round of all indexes.
SHARD_WORDS, KEPT_BYTES, HELD_WORDS = 2_000_000, 256 << 20, 4_000_000
#: Edits for each word of the longer list: one in PART.
PART = 5
#: Occurrences handled at a time.
STEP = 1 << 20
#: Distinct training texts searched at a time.
TEXTS_AT_ONCE = 10_000
MARKER = "<asr_text>"


def most_edits(n: np.ndarray) -> np.ndarray:
    """The most edits between a list of n words and any list near it."""
    return (n * PART // (PART - 1)) // PART


def word_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, all in a row, and where each text's begin (one more than texts)."""
    import xxhash

    formed = visual_forms(pc.fill_null(texts, ""))
    flat = pc.replace_substring(pc.utf8_lower(formed), "ß", "ss")
    lists = pc.split_pattern(pc.replace_substring_regex(flat, r"[\pP\s]+", " "), " ")
    words, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    some = pc.not_equal(words, "")
    coded = words.filter(some).dictionary_encode()
    owner = owner[some.to_numpy(zero_copy_only=False)]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) >> 1 for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return hashes[coded.indices.to_numpy()] if len(owner) else np.zeros(0, np.int64), starts


def text_hashes(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    import xxhash

    raw, at = np.ascontiguousarray(words).view(np.uint8).data, starts * 8
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) >> 1 for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.int64, len(starts) - 1)


class Index:
    """A full-text index of lists of words."""

    NAMES = ("vocabulary", "first", "keys", "text", "place", "symbols", "starts", "hashes")

    def __init__(self, **parts: np.ndarray):
        self.__dict__ |= parts
        self.size = len(self.text)
        self.lengths = np.diff(self.starts)
        self.bytes = sum(parts[k].nbytes for k in self.NAMES)

    @classmethod
    def build(cls, words: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> Index:
        vocabulary, symbols = np.unique(words, return_inverse=True)
        m, n = len(starts) - 1, len(words) + len(starts) - 1
        lengths = np.diff(starts)
        ends = starts[1:] + np.arange(m)
        whole = np.empty(n, np.int64)  # each text followed by an end of its own, which sorts before all words
        inner = np.ones(n, bool)
        inner[ends] = False
        whole[inner] = symbols + m
        whole[ends] = np.arange(m)
        rank, width = whole.copy(), 1
        while True:  # prefix doubling; ends differ, so the longest text bounds the rounds
            nxt = np.full(n, -1, np.int64)
            nxt[: n - width] = rank[width:]
            key = rank * (max(n, m + len(vocabulary)) + 2) + nxt + 1
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                break
            width *= 2
        before = whole[order - 1]  # the transform; order 0 looks at the last end, which is no word
        at = np.flatnonzero(before >= m)
        keys = np.sort((before[at] - m) * n + at)
        first = np.searchsorted(np.sort(symbols), np.arange(len(vocabulary) + 1)) + m
        text = np.repeat(np.arange(m), lengths + 1)
        place = np.arange(n) - np.repeat(starts[:-1] + np.arange(m), lengths + 1)
        return cls(vocabulary=vocabulary, first=first, keys=keys, text=text[order].astype(np.int32), place=place[order].astype(np.int32), symbols=symbols.astype(np.int32), starts=starts.astype(np.int64), hashes=hashes)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **{k: getattr(self, k) for k in self.NAMES})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Index:
        parts = np.load(io.BytesIO(data))
        return cls(**{k: parts[k] for k in cls.NAMES})

    def code(self, words: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == words, at, -1) if len(self.vocabulary) else np.full(len(words), -1)

    def search(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with codes[start : start + length]: backward search of all patterns in step."""
        at = start + length - 1
        c = codes[at]
        known = c >= 0
        lo = np.where(known, self.first[c], 0)
        hi = np.where(known, self.first[np.minimum(c + 1, len(self.first) - 1)], 0)
        m, n = len(self.hashes), self.size
        for k in range(1, int(length.max(initial=1))):
            live = np.flatnonzero((lo < hi) & (length > k))
            if not len(live):
                break
            c = codes[at[live] - k]
            base = c.astype(np.int64) * n
            low, high = np.searchsorted(self.keys, base + lo[live]), np.searchsorted(self.keys, base + hi[live])
            lo[live], hi[live] = np.where(c >= 0, low + m, 0), np.where(c >= 0, high + m, 0)
        return lo, hi


def _ranges(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Owner and member of all ranges, STEP or so at a time."""
    size = hi - lo
    upto = np.cumsum(size)
    a = 0
    while a < len(lo):
        done = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + STEP, "right")))
        own = np.repeat(np.arange(a, b), size[a:b])
        if len(own):
            if b == a + 1 and len(own) > STEP:
                for i in range(0, len(own), STEP):
                    part = np.arange(i, min(i + STEP, len(own)))
                    yield own[part], lo[a] + part
            else:
                yield own, np.arange(len(own)) - np.repeat(upto[a:b] - size[a:b] - done, size[a:b]) + lo[own]
        a = b


def segments(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and length of the segments of texts of n words: one more each than the most edits, about equally long."""
    k = most_edits(n) + 1
    text = np.repeat(np.arange(len(n)), k)
    i = np.arange(len(text)) - np.repeat(np.cumsum(k) - k, k)
    start = i * n[text] // k[text]
    return text, start, (i + 1) * n[text] // k[text] - start


def distances(a: list[np.ndarray] | np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of the rows of a and b, each a matrix of lists of one length."""
    steps = np.arange(b.shape[1] + 1)
    row = np.broadcast_to(steps, (len(b), len(steps))).copy()
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != a[:, i : i + 1]))
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row[:, -1]


def near_texts(index: Index, words: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """text (of words), other (of the index), edits, shared (words in merged maximal matches) and spans (of these) of all near pairs."""
    codes = index.code(words)
    n = np.diff(starts)
    text, seg, size = segments(n)
    lo, hi = index.search(codes, starts[text] + seg, size)
    keep: list[np.ndarray] = []
    for own, suffix in _ranges(lo, hi):
        t, e, at = text[own], index.text[suffix].astype(np.int64), index.place[suffix]
        most = np.maximum(n[t], index.lengths[e]) // PART
        off = np.abs(seg[own] - at) + np.abs((n[t] - seg[own]) - (index.lengths[e] - at))
        near = off <= most
        keep.append(np.stack([t[near], e[near], seg[own][near], at[near], size[own][near]]))
    empty = {k: np.zeros(0, np.int64) for k in ("text", "other", "edits", "shared", "spans")}
    if not keep:
        return empty
    seeds = np.concatenate(keep, axis=1)
    if not seeds.shape[1]:
        return empty
    m = len(index.hashes)
    pair, which = np.unique(seeds[0] * m + seeds[1], return_inverse=True)
    t, e = pair // m, pair % m
    edits = np.full(len(pair), 1 << 30)
    shape = n[t] * (1 << 32) + index.lengths[e]
    order = np.argsort(shape, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(shape[order])) + 1):
        p, q = int(n[t[group[0]]]), int(index.lengths[e[group[0]]])
        step = max(1, STEP * 8 // (p + q))
        for i in range(0, len(group), step):
            g = group[i : i + step]
            a = codes[starts[t[g]][:, None] + np.arange(p)]
            b = index.symbols[index.starts[e[g]][:, None] + np.arange(q)]
            edits[g] = distances(a, b)
    good = edits <= np.maximum(n[t], index.lengths[e]) // PART
    number = np.cumsum(good) - 1
    seeds, which = seeds[:, good[which]], number[which[good[which]]]
    t, e, edits = t[good], e[good], edits[good]
    shared, spans = _shared(index, codes, starts, n, t, e, seeds, which)
    return {"text": t, "other": e, "edits": edits, "shared": shared, "spans": spans}


def _shared(index: Index, codes, starts, n, t, e, seeds, which) -> tuple[np.ndarray, np.ndarray]:
    """Words of each training text in the union of the maximal matches that the pair's seeds extend to, and the spans it consists of."""
    left, right = seeds[2].copy(), seeds[2] + seeds[4]
    shift = seeds[3] - seeds[2]
    own, other = starts[seeds[0]], index.starts[seeds[1]]
    ends = np.minimum(n[seeds[0]], index.lengths[seeds[1]] - shift)
    begins = np.maximum(0, -shift)
    live = np.arange(len(left))
    while len(live):
        live = live[left[live] > begins[live]]
        live = live[codes[own[live] + left[live] - 1] == index.symbols[other[live] + left[live] - 1 + shift[live]]]
        left[live] -= 1
    live = np.arange(len(left))
    while len(live):
        live = live[right[live] < ends[live]]
        live = live[codes[own[live] + right[live]] == index.symbols[other[live] + right[live] + shift[live]]]
        right[live] += 1
    base = np.concatenate([[0], np.cumsum(n[t] + 1)])
    marks = np.zeros(base[-1] + 1, np.int64)
    np.add.at(marks, base[which] + left, 1)
    np.add.at(marks, base[which] + right, -1)
    inside = np.cumsum(marks) > 0
    begun = inside & ~np.concatenate([[False], inside[:-1]])
    covered, opened = (np.concatenate([[0], np.cumsum(x)]) for x in (inside, begun))
    return covered[base[1:]] - covered[base[:-1]], opened[base[1:]] - opened[base[:-1]]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, starts = word_lists(batch.column(1))
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(words, pa.int64()))
        rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array(text_hashes(words, starts), pa.int64()), lists], ["utterance", "text", "words"])
        yield rows.filter(pa.array(np.diff(starts) > 0))


def _build(table: pa.Table) -> pa.Table:
    lists = table.column("words").combine_chunks()
    starts = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.to_numpy()[starts[0] : starts[-1]]
    index = Index.build(words, starts - starts[0], table.column("text").combine_chunks().to_numpy())
    return pa.table({"shard": table.column("shard").slice(0, 1), "data": pa.array([index.dump()], pa.binary())})


_KEPT: OrderedDict[tuple[str, int], Index] = OrderedDict()


def _index(file: str, shard: int) -> Index:
    """An index from the shared folder; a worker keeps those used last."""
    if (file, shard) in _KEPT:
        _KEPT.move_to_end((file, shard))
        return _KEPT[file, shard]
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(file)
    data = pq.read_table(path, filesystem=system, partitioning=None, filters=[("shard", "=", shard)]).column("data")[0].as_py()
    own = Index.load(data)
    while _KEPT and sum(x.bytes for x in _KEPT.values()) + own.bytes > KEPT_BYTES:
        _KEPT.popitem(last=False)
    _KEPT[file, shard] = own
    return own


def _stream(shards: list[tuple[int, str]], held_words: int, at_once: int):
    def search(audios: list[pa.Array], lists: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """All rows held, against one index after the other: each is loaded once for held_words words."""
        audio = pa.concat_arrays(audios)
        words = np.concatenate([w for w, _ in lists])
        sizes = np.concatenate([np.diff(starts) for _, starts in lists])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        hashes = text_hashes(words, starts)
        some = np.flatnonzero(sizes > 0)
        _, first, which = np.unique(hashes[some], return_index=True, return_inverse=True)  # copies are searched once
        rows = some[first]
        by = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[by], np.arange(len(rows) + 1))
        for shard, file in shards:
            index = _index(file, shard)
            for k in range(0, len(rows), at_once):
                part = rows[k : k + at_once]
                length = sizes[part]
                own_starts = np.concatenate([[0], np.cumsum(length)])
                own = words[np.repeat(starts[part] - own_starts[:-1], length) + np.arange(own_starts[-1])]
                found = near_texts(index, own, own_starts)
                for i in range(0, len(found["text"]), STEP // 8):
                    t = found["text"][i : i + STEP // 8] + k
                    copies = bounds[t + 1] - bounds[t]
                    pick = by[np.repeat(bounds[t] - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())]
                    given = (hashes[rows[t]], index.hashes[found["other"][i : i + STEP // 8]], *(found[c][i : i + STEP // 8] for c in ("edits", "shared", "spans")))
                    rest = [pa.array(np.repeat(x, copies), pa.int64()) for x in given]
                    yield pa.RecordBatch.from_arrays([audio.take(pa.array(some[pick])), *rest], ["audio", "said", "text", "edits", "shared", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audios: list[pa.Array] = []
        lists: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            words, starts = word_lists(batch.column(1))
            audios.append(batch.column(0))
            lists.append((words, starts))
            held += len(words)
            if held > held_words:
                yield from search(audios, lists)
                audios, lists, held = [], [], 0
        if held:
            yield from search(audios, lists)

    return run


def evaluation_rows(utterances: DataFrame, speaker_split: DataFrame, splits: tuple[str, ...] = ("dev", "test")) -> DataFrame:
    """utterance, text of the rows whose speaker, however written, has a row of an evaluation split."""
    wanted = speaker_split.where(F.col("split").isin(*splits)).select(speaker_key(F.col("speaker")).alias("who")).where("who IS NOT NULL").distinct()
    spelled = utterances.select("speaker").distinct().withColumn("who", speaker_key(F.col("speaker"))).join(wanted, "who", "left_semi")
    return utterances.join(spelled.select("speaker"), "speaker", "left_semi").select("utterance", "text").distinct()


def near_rows(evaluation: DataFrame, train: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """audio, said (a number for its text), text (one for the evaluation text), edits, shared, spans of training rows near an
    evaluation text; and utterance, text, words of the evaluation rows.

    Indexes live in the shared folder, where tasks read them; their number grows with the evaluation texts, their size doesn't.
    """
    listed = store(evaluation.select("utterance", "text").mapInArrow(_listed, "utterance string, text long, words array<long>"), "evaluation")
    texts = listed.select("text", "words").dropDuplicates(["text"])
    n_words = listed.agg(F.sum(F.size("words"))).first()[0] or 0
    n = max(1, math.ceil(n_words / SHARD_WORDS))
    sharded = texts.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(n)))
    built = store(sharded.groupBy("shard").applyInArrow(_build, "shard long, data binary"), "indexes")
    files = [(r[0], r[1]) for r in built.select("shard", F.col("_metadata.file_path")).orderBy("shard").collect()]  # a row for each index
    transcripts = train.select("audio", F.substring_index("text", MARKER, 1).alias("head"), "text")
    said = F.when(F.instr("text", MARKER) > 0, F.expr(f"substr(text, length(head) + {len(MARKER) + 1})")).otherwise(F.col("text"))
    rows = transcripts.where("audio IS NOT NULL AND text IS NOT NULL").select("audio", said.alias("said"))
    found = rows.mapInArrow(_stream(files, HELD_WORDS, TEXTS_AT_ONCE), "audio string, said long, text long, edits long, shared long, spans long").distinct()
    return found, listed


def overlaps(evaluation: DataFrame, train: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """utterance, audio, edits, shared, spans of every evaluation (utterance, text) and training (audio, text) pair of near texts.

    Equal utterances and equal records give all their pairs; overlap_classes gives a row for each pair of texts instead.
    """
    found, listed = near_rows(evaluation, train, store)
    pairs = found.join(listed.select("utterance", "text"), "text").groupBy("utterance", "audio")
    return pairs.agg(F.min("edits").alias("edits"), F.max("shared").alias("shared"), F.max("spans").alias("spans"))


def overlap_classes(evaluation: DataFrame, train: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """A row for each pair of near texts: text and said (numbers of the evaluation and the training text), edits, shared, spans,
    utterances and records (how many have these texts); and who has an evaluation text: utterance, text.
    """
    found, listed = near_rows(evaluation, train, store)
    sides = listed.groupBy("text").agg(F.count_distinct("utterance").alias("utterances"))
    pairs = found.groupBy("text", "said").agg(F.min("edits").alias("edits"), F.max("shared").alias("shared"), F.max("spans").alias("spans"), F.count("*").alias("records"))
    return pairs.join(sides, "text").select("text", "said", "edits", "shared", "spans", "utterances", "records"), listed.select("utterance", "text")
