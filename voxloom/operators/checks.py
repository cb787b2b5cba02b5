"""Checks of tables, settings and key sets. Each gives problems as rows; enforce() raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problems(rows: DataFrame, rules: list[tuple[str, Column]], *keep: str) -> DataFrame:
    """keep, reason: rows that break a rule, with the first they break. A rule is a reason and a condition that is true for bad rows; null is not bad."""
    reason = reduce(lambda w, r: w.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0]))
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select(*keep, "reason")


def enforce(found: DataFrame, most: int = 3) -> None:
    """Raises with the first few problems, if there are any."""
    first = found.limit(most).collect()
    if first:
        raise ValueError("; ".join(": ".join(map(str, r)) for r in first))


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """key, times of the keys that occur more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("times")).where("times > 1")


def missing(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Wanted keys that aren't there."""
    return wanted.select(key).distinct().join(there.select(key), key, "left_anti")


def setting_differences(old: DataFrame, new: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """name, old, new of settings (name, val) that differ or are in one only."""
    a, b = old.select("name", F.col("val").alias("old")), new.select("name", F.col("val").alias("new"))
    return a.join(b, "name", "full").where(~F.col("old").eqNullSafe(F.col("new")) & ~F.col("name").isin(*ignored))


def shape_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, problem of two sets of arrays (key, v): keys in one only, or other sizes."""
    x, y = a.select("key", F.size("v").alias("x")), b.select("key", F.size("v").alias("y"))
    problem = F.when(F.col("x").isNull(), "only in the second").when(F.col("y").isNull(), "only in the first").when(F.col("x") != F.col("y"), "another size")
    return x.join(y, "key", "full").select("key", problem.alias("problem")).where("problem IS NOT NULL")
