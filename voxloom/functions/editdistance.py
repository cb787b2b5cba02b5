"""Unit-cost edit distances, error rates and multiset overlaps, inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that stand for the words of a pair with many: from FIRST to the surrogates, then from BEYOND. More than 1,083,904
#: distinct words in one pair have no code points left, and raise.
FIRST, BEYOND = 0x4E00, 0x10000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: a column that lambdas refer to is computed again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def coded(names: Column, words: Column) -> Column:
    """words as a string of one code point for each, by its place in names."""
    low = 0xD800 - FIRST
    point = lambda n: F.when(n <= low, n + F.lit(FIRST - 1)).otherwise(n + F.lit(BEYOND - 1 - low))
    wide = lambda n: F.decode(F.unhex(F.lpad(F.hex(point(n)), 8, "0")), "UTF-32")
    few = F.size(names) < 256
    return F.array_join(F.transform(words, lambda w: F.when(few, F.char(F.array_position(names, w))).otherwise(wide(F.array_position(names, w)))), "")


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words: each distinct word of the pair becomes one code point."""
    return let(F.array_distinct(F.concat(a, b)), lambda names: F.levenshtein(coded(names, a), coded(names, b)))


def error_rate(distance: Column, length: Column) -> Column:
    """distance / length; null where there is nothing to compare with. May exceed 1."""
    return F.when(length > 0, distance / length)


def shared_count(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(count(a, w), count(b, w)))
