"""Text functions as columns. Whatever Spark lacks (normal forms, full case folding, C's rounding) goes by Arrow batches.

Null in, null out, unless said otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZWJ, ZWNJ = "‍", "‌"
MARKER = "<asr_text>"
# Endings that stand as words of their own after a rewritten loanword.
PARTICLES = ("එක", "එකේ", "එකට", "එකෙන්", "එකක්", "එක්ක", "වල", "වලට", "වලින්", "ටික", "ටිකක්")
#: Words of one Sinhala script run, joiners included.
SCRIPT_WORD = r"[\x{0D80}-\x{0DFF}\x{200D}]+"
#: Letters, marks and numbers count in comparisons.
COUNTING = r"[\p{L}\p{M}\p{N}]"
# A fixed value: a separator within a number is a point or comma between digits, or one white space before exactly three digits.
NUMBER_SEPARATOR = r"(?U)(?<=\d)(?:[.,]|\s(?=\d{3}(?!\d)))(?=\d)"


def _where(texts: pa.Array, mask: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """texts with those of mask changed one by one; the others stay as they are."""
    mask = pc.fill_null(mask, False)
    if not pc.any(mask).as_py():
        return texts
    return pc.replace_with_mask(texts, mask, pa.array(list(map(change, texts.filter(mask).to_pylist())), pa.string()))


@cache
def _class(form: str) -> str:
    """An expression for texts that a normal form, or folding (fold), may treat otherwise than Arrow's simple functions do.

    For normal forms: characters that change, that move, or that compose with one before them; Sinhala's by their pairs.
    """
    if form == "fold":
        chars = [chr(c) for c in (*range(0x80, 0xD800), *range(0xE000, 0x20000))]
        odd = [ord(c) for c, low in zip(chars, pc.utf8_lower(pa.array(chars)).to_pylist(), strict=True) if c.casefold() != low]
    else:
        seconds = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # of Korean syllables
        others = [c for c in (*range(0x80, 0x0D80), *range(0x0E00, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20))]
        for c in others:
            parts = unicodedata.decomposition(chr(c)).split()
            if len(parts) == 2 and parts[0][0] != "<":
                seconds.add(int(parts[1], 16))
        odd = [c for c in others if c in seconds or unicodedata.combining(chr(c)) or not unicodedata.is_normalized(form, chr(c))]
    spans: list[list[int]] = []
    for c in odd:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    found = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"
    return found if form == "fold" else found + r"|\x{DD9}[\x{DCA}\x{DCF}\x{DDF}]|\x{DDC}\x{DCA}"


def normal(texts: pa.Array, form: str) -> pa.Array:
    """NFC or NFKC; only texts with a character that the form may change or move are looked at one by one."""
    return _where(texts, pc.match_substring_regex(texts, _class(form)), lambda t: unicodedata.normalize(form, t))


def casefolded(texts: pa.Array) -> pa.Array:
    """Full case folding; Arrow's lower case where that is the same."""
    odd = pc.match_substring_regex(texts, _class("fold"))
    return _where(pc.if_else(pc.fill_null(odd, False), texts, pc.utf8_lower(texts)), odd, str.casefold)


@F.arrow_udf(T.StringType())
def nfc(texts: pa.Array) -> pa.Array:
    return normal(texts.cast(pa.string()), "NFC")


@F.arrow_udf(T.StringType())
def folded(texts: pa.Array) -> pa.Array:
    """Compatibility form, fully case-folded."""
    return casefolded(normal(texts.cast(pa.string()), "NFKC"))


@F.arrow_udf(T.StringType())
def fixed3(numbers: pa.Array) -> pa.Array:
    """Three decimals, rounded as C does from the exact binary value."""
    return pa.array([None if x is None else f"{x:.3f}" for x in numbers.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def code_points(texts: pa.Array) -> pa.Array:
    """The code points of each text."""
    codes = [None if t is None else np.frombuffer(t.encode("utf-32-le"), np.int32) for t in texts.to_pylist()]
    return pa.array(codes, pa.list_(pa.int32()))


def clean(text: Column) -> Column:
    """Composed; words lose joiners at their edges, empty words go, one space between."""
    words = F.split(nfc(text), r"(?U)\s+")
    trimmed = F.transform(words, lambda w: F.btrim(w, F.lit(ZWJ + ZWNJ)))
    return F.array_join(F.filter(trimmed, lambda w: w != ""), " ")


def normalise(text: Column) -> Column:
    """Folded, apostrophes of one shape, numbers without separators."""
    return F.regexp_replace(F.translate(folded(text), "’‘ʼ", "'''"), NUMBER_SEPARATOR, "")


def words(normalised: Column) -> Column:
    """Words of a normalised text; apostrophes stay inside words only."""
    spaced = F.regexp_replace(normalised, r"[^\p{L}\p{M}\p{N}']+", " ")
    return F.filter(F.transform(F.split(spaced, " "), lambda w: F.btrim(w, F.lit("'"))), lambda w: w != "")


def characters(normalised: Column) -> Column:
    """Counting characters of a normalised text, as a string."""
    return F.regexp_replace(normalised, r"[^\p{L}\p{M}\p{N}]", "")


def without_glosses(text: Column) -> Column:
    """Without bracketed text that holds no unified ideograph; white space collapsed."""
    ideograph = r"\x{2E80}-\x{2EFF}\x{31C0}-\x{31EF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}"
    bare = F.regexp_replace(text, rf"[(\x{{FF08}}][^()\x{{FF08}}\x{{FF09}}{ideograph}]*[)\x{{FF09}}]", " ")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def sentence_key(text: Column) -> Column:
    """What makes two sentences the same: case, punctuation and spacing don't count; joiners and symbols do."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded_case(text), r"\p{P}", " "), r"(?U)\s+", " "))


@F.arrow_udf(T.StringType())
def folded_case(texts: pa.Array) -> pa.Array:
    return casefolded(texts.cast(pa.string()))


def is_latin(word: Column) -> Column:
    """At least one alphabetic character, and all of them Latin letters."""
    return word.rlike(r"\p{IsAlphabetic}") & ~word.rlike(r"[\p{IsAlphabetic}&&[^A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}]]")


def transcript_of(text: Column) -> Column:
    """What follows the first marker, or the whole text."""
    at = F.locate(MARKER, text)
    return F.when(at > 0, F.substring(text, at + len(MARKER), F.length(text))).otherwise(text)


def language_of(text: Column) -> Column:
    """The language named before the marker; null without prefix, marker or name."""
    return F.nullif(F.regexp_extract(text, f"^language (.*?){MARKER}", 1), F.lit(""))


def flat_line(text: Column) -> Column:
    """Line breaks of all kinds and tabs become spaces; trimmed."""
    return F.btrim(F.regexp_replace(text, r"[\t\n\x0B\f\r\x{85}\x{2028}\x{2029}]", " "))


def audio_path(folder: Column, utterance: Column) -> Column:
    """Where an utterance's recording lies; null without folder or utterance."""
    return F.concat(folder, F.lit("/data/"), F.substring(utterance, 1, 2), F.lit("/"), utterance, F.lit(".flac"))


def with_language(config: Column, language: str) -> Column:
    """A JSON configuration with the language at the end of its list of languages; the rest stays as written, byte by byte.

    The separator is the one between the list's last two items, or a comma and a space. A configuration that lists it already
    is unchanged; one without a list, or with an empty one, gives null.
    """
    listed = F.from_json(config, "support_languages array<string>")["support_languages"]
    opened = F.regexp_extract(config, r'"support_languages"\s*:\s*\[[^\]]*"', 0)
    between = F.when(F.size(listed) > 1, F.regexp_extract(opened, r'"([^"]*)"[^"]*"$', 1)).otherwise(", ")
    end = F.instr(config, opened) + F.length(opened)
    added = F.concat(F.substring(config, F.lit(1), end - 1), between, F.to_json(F.array(F.lit(language))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(language)))) - 2), F.substring(config, end, F.length(config)))
    return F.when(F.array_contains(listed, language), config).when((F.size(listed) > 0) & (opened != ""), added)
