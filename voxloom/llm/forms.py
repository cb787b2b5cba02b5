"""One visual form of text: strings come out equal exactly when they look the same.

No difference: invisible characters, kinds of space, widths, shapes of apostrophe, ways to compose a letter, look-alike
letters. Differences: case, punctuation, raised digits, the number of spaces, joiners that shape a conjunct.
Null stays null, the empty text stays empty.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unicode's default-ignorable code points but for the two joiners, which have rules of their own.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200B), (0x200E, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F),
    (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF),
)
# Letters of other scripts that look like a Latin letter, and the Latin letters; Cyrillic, Greek, Armenian, phonetic.
LOOK_ALIKE = {
    **dict(zip("АВЕЅІЈКМНОРСТУХҮаеѕіјорсухһԁԛԝӏӀѵү", "ABESIJKMHOPCTYXYaesijopcyxhdqwlIvy", strict=True)),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρυγι", "ABEZHIKMNOPTYXoavpuyi", strict=True)),
    **dict(zip("օոսհՕՍ", "onuhOU", strict=True)),
    **dict(zip("ɡɑ", "ga", strict=True)),
}
# Shapes of the apostrophe.
APOSTROPHES = "‘’‛ʻʼʽ"
# Sinhala sequences that look like one letter but have no canonical composition.
SINHALA_PAIRS = {
    "අා": "ආ", "අැ": "ඇ", "අෑ": "ඈ", "උෟ": "ඌ",
    "එ්": "ඒ", "එෙ": "ඓ", "ඔ්": "ඕ", "ඔෟ": "ඖ", "ෙෙ": "ෛ",
    "ෟෟ": "ෳ", "ෘෘ": "ෲ",
}
ZWNJ, ZWJ, VIRAMA = "‌", "‍", "්"
CONSONANTS = "ක-ෆ"
# A joiner shapes a conjunct between the vowel killer and a consonant, or before the killer in touching letters.
_STRAY = re.compile(f"{ZWNJ}|(?<!{VIRAMA}){ZWJ}(?!{VIRAMA}[{CONSONANTS}])|(?<={VIRAMA}){ZWJ}(?![{CONSONANTS}])")
_PAIRS = re.compile("|".join(SINHALA_PAIRS))

#: Texts of these characters only, in these orders, are in the one form already. Everything else takes the slow way.
_PLAIN = r" -~\x{00A1}-\x{00AC}\x{00AE}-\x{00B3}\x{00B5}-\x{017F}\x{0D82}-\x{0DF4}\x{201C}\x{201D}\x{3001}-\x{3029}\x{4E00}-\x{9FFF}"
UNSETTLED = (
    rf"[^{_PLAIN}\x{{200D}}]|(?<!\x{{0DCA}})\x{{200D}}|\x{{200D}}(?![\x{{0D9A}}-\x{{0DC6}}])|\x{{0DD9}}[\x{{0DCA}}\x{{0DCF}}\x{{0DD9}}\x{{0DDF}}]"
    r"|\x{0DDC}\x{0DCA}|\x{0D85}[\x{0DCF}\x{0DD0}\x{0DD1}]|[\x{0D8B}\x{0D94}\x{0DDF}]\x{0DDF}|\x{0D91}[\x{0DCA}\x{0DD9}]|\x{0D94}\x{0DCA}|\x{0DD8}\x{0DD8}"
)


@cache
def table() -> dict[int, str | None]:
    """What one character becomes: ignorable ones vanish, look-alikes become their class's letter.

    Widths, styles (bold, script and other letters of one shape) and numerals that are letters follow from Unicode's decompositions.
    """
    to: dict[int, str | None] = {}
    for c in (*range(0x80, 0x10000), *range(0x1D400, 0x1D800), *range(0x1EE00, 0x1EF00), *range(0x1FBF0, 0x1FBFA)):
        kind = unicodedata.decomposition(chr(c)).split(" ")
        if kind[0] in ("<wide>", "<narrow>", "<font>") and len(kind) == 2:
            to[c] = chr(int(kind[1], 16))
        elif kind[0] == "<compat>" and len(kind) == 2 and unicodedata.category(chr(c)) == "Nl":
            to[c] = chr(int(kind[1], 16))
        elif unicodedata.category(chr(c)) == "Zs":
            to[c] = " "
    for c in APOSTROPHES:
        to[ord(c)] = "'"
    for c, latin in LOOK_ALIKE.items():
        to[ord(c)] = latin
    for first, last in IGNORABLE:
        to |= dict.fromkeys(range(first, last + 1))
    to[0x3000] = " "
    for c, x in to.items():  # a style of a look-alike
        if x and x in LOOK_ALIKE:
            to[c] = LOOK_ALIKE[x]
    return to


def visual_form(text: str) -> str:
    """The one form of a text, by table."""
    text = unicodedata.normalize("NFD", text).translate(table())
    text = unicodedata.normalize("NFC", text)
    text = _STRAY.sub("", text)
    text = _PAIRS.sub(lambda m: SINHALA_PAIRS[m[0]], text)
    return unicodedata.normalize("NFC", text)


# UNSETTLED without look-behind and look-ahead, for Arrow's expressions.
UNSETTLED_ARROW = UNSETTLED.replace(r"(?<!\x{0DCA})\x{200D}", r"(^|[^\x{0DCA}])\x{200D}").replace(r"\x{200D}(?![\x{0D9A}-\x{0DC6}])", r"\x{200D}([^\x{0D9A}-\x{0DC6}]|$)")


def visual_forms(texts: pa.Array) -> pa.Array:
    """The one forms of a batch. Settled texts, found by one scan, stay as they are."""
    texts = texts.cast(pa.string())
    odd = pc.fill_null(pc.match_substring_regex(texts, UNSETTLED_ARROW), False)
    if not pc.any(odd).as_py():
        return texts
    return pc.replace_with_mask(texts, odd, pa.array([visual_form(t) for t in texts.filter(odd).to_pylist()], pa.string()))


@F.arrow_udf(T.StringType())
def _visual_form(texts: pa.Array) -> pa.Array:
    return visual_forms(texts)


def visual_form_column(text: Column) -> Column:
    """The one form as a column, by Arrow batches."""
    return _visual_form(text)

