"""All text in one visual form, by tries of the vocabulary and a weighted edit automaton.

Tokens between spaces of any kind are split in two: settled ones are in the one form as they stand and make up the vocabulary;
the others are traversed against tries of it. The automaton's edits cost nothing between look-alikes (including widths, and a
letter and its parts) and for ignorable characters, and one otherwise; only paths of cost zero are followed. The word at the
end of one is the canonical spelling. Tokens without one are normalised by table.

Tokens that can match have the same base letters, so tries are built for tokens that share a hash of these.
Null and empty texts have no form here; a text of spaces keeps their number; one of ignorables only becomes empty.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm import forms
from voxloom.llm.forms import VIRAMA, ZWJ, ZWNJ

#: Tokens a worker holds before it hands them on.
HELD = 500_000
#: Tokens in one trie at most, but for the tokens of one hash.
TRIE = 50_000
_SPACES = r"[ \x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
_CONSONANT = re.compile(f"[{forms.CONSONANTS}]")


class Trie:
    """Words by their decomposed characters."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in unicodedata.normalize("NFD", w):
                node = node.setdefault(c, {})
            node[""] = w

    def spelling(self, token: str) -> str | None:
        """The word at no cost from the token."""
        symbols = _symbols(token)
        states = [(self.root, 0)]
        found = None
        seen = set()
        while states:
            node, i = states.pop()
            if (id(node), i) in seen:
                continue
            seen.add((id(node), i))
            if i == len(symbols):
                if "" in node:
                    found = node[""]
                    break
                continue
            for c, step in _steps(symbols, i):
                at = node
                for x in c:
                    at = at.get(x)
                    if at is None:
                        break
                if at is not None:
                    states.append((at, i + step))
        return found


def _symbols(token: str) -> list[str]:
    """The decomposed characters of a token that show: edits of cost zero for the ignorable ones are taken at once."""
    table = forms.table()
    shown = [c for c in unicodedata.normalize("NFD", token) if table.get(ord(c), c) is not None and c != ZWNJ]
    out = []
    for i, c in enumerate(shown):
        if c == ZWJ:
            before, after = shown[i - 1] if i else "", "".join(shown[i + 1 : i + 3])
            if not (before == VIRAMA and _CONSONANT.match(after) or before != VIRAMA and after[:1] == VIRAMA and _CONSONANT.match(after[1:])):
                continue
        out.append(c)
    return out


def _steps(symbols: list[str], i: int) -> Iterator[tuple[str, int]]:
    """What the automaton may read in the trie at no cost, and how many symbols that uses up."""
    c = symbols[i]
    yield c, 1
    other = forms.table().get(ord(c))
    if other:
        yield unicodedata.normalize("NFD", other), 1
    if i + 1 < len(symbols):
        pair = forms.SINHALA_PAIRS.get(c + symbols[i + 1])
        if pair:
            yield unicodedata.normalize("NFD", pair), 2


@cache
def _kept(c: str) -> bool:
    """Whether free edits can't change this character: all but marks and invisible ones, and of Sinhala the consonants."""
    if "\u0d80" <= c <= "\u0dff":
        return bool(_CONSONANT.match(c))
    return unicodedata.category(c)[0] not in "MCZ"


def base_hash(token: str) -> int:
    """A hash of the token's base characters of any script, the same for all spellings that look the same."""
    table = forms.table()
    shown = "".join(table.get(ord(c), c) or "" for c in unicodedata.normalize("NFD", token))
    return zlib.crc32("".join(filter(_kept, unicodedata.normalize("NFD", shown))).encode())


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: set[str] = set()

    def out() -> Iterator[pa.RecordBatch]:
        words = list(held)
        held.clear()
        for i in range(0, len(words), 10_000):
            part = pa.array(words[i : i + 10_000], pa.string())
            keys = pa.array([base_hash(w) for w in words[i : i + 10_000]], pa.int64())
            yield pa.RecordBatch.from_arrays([keys, part, pc.match_substring_regex(part, forms.UNSETTLED_ARROW)], ["base", "token", "unsettled"])

    for batch in batches:
        flat = pc.split_pattern_regex(batch.column(0), _SPACES).flatten()
        held.update(flat.unique().to_pylist())
        if len(held) > HELD:
            yield from out()
    yield from out()


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens come sorted by base; those of one base are matched within one trie."""
    words: list[str] = []
    odd: list[str] = []
    last = None

    def out() -> pa.RecordBatch:
        trie = Trie(words)
        found = [trie.spelling(t) for t in odd]
        spelled = [t if f is None else f for t, f in zip(map(forms.visual_form, odd), found, strict=True)]
        batch = pa.RecordBatch.from_arrays([pa.array(odd, pa.string()), pa.array(spelled, pa.string()), pa.array([f is not None for f in found], pa.bool_())], ["token", "form", "matched"])
        words.clear()
        odd.clear()
        return batch

    for batch in batches:
        for base, token, unsettled in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if base != last and len(words) + len(odd) > TRIE:
                yield out()
            last = base
            (odd if unsettled else words).append(token)
    if words or odd:
        yield out()


def canonical_tokens(texts: DataFrame) -> DataFrame:
    """token, form, matched of every distinct token of texts (text) that isn't settled."""
    tokens = texts.where("text IS NOT NULL AND text <> ''").select("text").mapInArrow(_tokens, "base long, token string, unsettled boolean").distinct()
    odd = tokens.where("unsettled").select("base").distinct()
    rivals = tokens.join(odd, "base", "left_semi")  # only words that some unsettled token may match
    return rivals.repartition("base").sortWithinPartitions("base").mapInArrow(_match, "token string, form string, matched boolean")


def _split_settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pc.match_substring_regex(batch.column("text"), forms.UNSETTLED_ARROW)], [*batch.schema.names, "unsettled"])


def unsettled_rows(records: DataFrame) -> DataFrame:
    """tbl, key, text, unsettled of the distinct records with a non-empty text."""
    rows = records.where("text IS NOT NULL AND text <> ''").select("tbl", "key", "text")
    return rows.mapInArrow(_split_settled, "tbl string, key string, text string, unsettled boolean")


def unsettled_forms(rows: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """tbl, key, text, form of the rows (as of unsettled_rows) that aren't settled. The forms of tokens are stored."""
    spelled = store(canonical_tokens(rows)).select("token", F.col("form").alias("own"))
    odd = rows.where("unsettled").select("tbl", "key", "text", *_identity("text")).distinct()
    texts = odd.select("text", "h1", "h2").dropDuplicates(["h1", "h2"])
    # pieces carry the text's hashes, not the text
    pieces = texts.select("h1", "h2", F.posexplode(F.split("text", _SPACES, -1)).alias("at", "token"))
    placed = F.struct("at", F.coalesce("own", "token").alias("own"))
    formed = pieces.join(spelled, "token", "left").groupBy("h1", "h2").agg(F.array_sort(F.collect_list(placed)).alias("all"))
    form = F.array_join(F.transform("all", lambda x: x["own"]), " ")
    return odd.join(formed.select("h1", "h2", form.alias("form")), ["h1", "h2"]).select("tbl", "key", "text", "form")


def _identity(text: str, *names: str):
    """128 bits that stand for a text."""
    one, two = names or ("h1", "h2")
    return F.xxhash64(text).alias(one), F.xxhash64(F.lit(1), text).alias(two)


def _sharing(rows: DataFrame, formed: DataFrame) -> DataFrame:
    """tbl, key, t1, t2 (for the text), h1, h2 (for its form) of the distinct records whose form some unsettled record has."""
    other = formed.select("tbl", "key", *_identity("text", "t1", "t2"), *_identity("form"))
    wanted = other.select("tbl", "h1", "h2").distinct()
    settled = rows.where("NOT unsettled").select("tbl", "key", *_identity("text", "t1", "t2"), *_identity("text"))
    return settled.join(wanted, ["tbl", "h1", "h2"], "left_semi").unionByName(other).distinct()


def same_looking_pairs(rows: DataFrame, formed: DataFrame) -> DataFrame:
    """tbl, key_a, key_b of two records of a table that look the same but aren't the same string; key_a < key_b.

    Of two such strings one is unsettled, so only records with the form of an unsettled one are paired. rows: tbl, key, text,
    unsettled; formed: as of unsettled_forms. A class of many records gives many pairs; same_looking_classes gives a row for each
    record instead.
    """
    both = _sharing(rows, formed)
    a, b = (both.select("tbl", "h1", "h2", *(F.col(c).alias(f"{c}_{x}") for c in ("key", "t1", "t2"))) for x in "ab")
    pairs = a.join(b, ["tbl", "h1", "h2"]).where("key_a < key_b AND (t1_a <> t1_b OR t2_a <> t2_b)")
    return pairs.select("tbl", "key_a", "key_b").distinct()


def same_looking_classes(rows: DataFrame, formed: DataFrame) -> DataFrame:
    """tbl, key, class, links of every record that looks the same as another string: links counts the records of the class with
    other strings. Counts are aggregated before they are joined, so no class is paired out."""
    both = _sharing(rows, formed)
    keys = ["tbl", "h1", "h2"]
    strings = both.groupBy(*keys, "t1", "t2").agg(F.count("*").alias("own"))
    whole = strings.groupBy(*keys).agg(F.sum("own").alias("all"))
    links = strings.join(whole, keys).where("all > own").select(*keys, "t1", "t2", (F.col("all") - F.col("own")).alias("links"))
    named = F.concat(F.hex("h1"), F.hex("h2")).alias("class")
    return both.join(links, [*keys, "t1", "t2"]).select("tbl", "key", named, "links")
