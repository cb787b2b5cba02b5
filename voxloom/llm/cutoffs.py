"""Score cutoffs that keep a target share of each source's records.

Mergeable KLL sketches (rank error bounded by their size) give each source's quantile to within a bracket. Another pass counts
what lies below and in the bracket, with ties, and finds the exact cutoff there. A bracket that still holds too many records
is sketched again; one that misses the quantile (the bound holds with high probability only) is opened wide and counted whole.

Records without a finite score of 0 or more, or of a source without a target, take no part. Repeated rows count once. A source
with a target but no records gets no cutoff (null) and 0 kept. Of several targets of a source the largest holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Size of the sketches; the rank error is about 0.1 % of the records, the bracket is four times that to either side.
SKETCH, SLACK = 4096, 0.004
#: Records in the brackets of a source, above which they are sketched again rather than counted by value.
COUNTED = 1_000_000
INF = float("inf")


def scored(records: DataFrame, source: str, key: str, score: str) -> DataFrame:
    """source, key, score of the records that take part, each once."""
    rows = records.select(F.col(source).alias("source"), F.col(key).alias("key"), F.col(score).cast("double").alias("score"))
    return rows.where("source IS NOT NULL AND score >= 0 AND NOT isnan(score) AND score < double('Infinity')").distinct()


def cutoffs(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """source, keep_percent, records, cutoff, kept, ties of each source of targets (source, keep_percent).

    rows: source, key, score, as scored() gives them; best stored, for they are read several times.
    The cutoff is the smallest score for which the records at or under it are at least keep_percent of the source's.
    ties are the records exactly at it.
    """
    spark = rows.sparkSession
    targets = targets.where("source IS NOT NULL AND keep_percent IS NOT NULL").groupBy("source").agg(F.max("keep_percent").cast("long").alias("keep_percent"))
    joined = rows.join(targets, "source").groupBy("source", "keep_percent")
    sketched = joined.agg(F.count("*").alias("records"), F.kll_sketch_agg_double("score", SKETCH).alias("sketch"))
    share = F.col("keep_percent") / 100
    # one row for each source that has a target: as few as targets has
    states = {r["source"]: r.asDict() | {"below": 0} for r in sketched.select("source", "keep_percent", "records", _quantile("sketch", share - SLACK).alias("lo"), _quantile("sketch", share + SLACK).alias("hi")).collect()}
    for s in states.values():
        s["need"] = max(1, -(-s["records"] * s["keep_percent"] // 100))
    unsettled = set(states)
    while unsettled:
        brackets = _brackets(spark, [states[k] for k in sorted(unsettled)])
        inside = F.when((F.col("score") >= F.col("lo")) & (F.col("score") <= F.col("hi")), F.col("score"))
        found = rows.join(F.broadcast(brackets), "source").groupBy("source").agg(F.count_if(F.col("score") < F.col("lo")).alias("below"), F.count(inside).alias("inside"), F.kll_sketch_agg_double(inside, SKETCH).alias("sketch"))
        need = F.broadcast(_needs(spark, [states[k] for k in unsettled]))
        part = (F.col("need") - F.col("below")) / F.col("inside")
        some = F.when(F.col("inside") > 0, F.col("sketch"))
        low, high = (_quantile(some, part + d) for d in (-SLACK, SLACK))
        for r in found.join(need, "source").select("source", "below", "inside", low.alias("low"), high.alias("high")).collect():
            s = states[r["source"]]
            if not r["below"] < s["need"] <= r["below"] + r["inside"]:
                s["lo"], s["hi"] = -INF, INF
            elif r["inside"] > COUNTED and (r["low"], r["high"]) != (s["lo"], s["hi"]) and s["hi"] < INF:
                s["lo"], s["hi"] = r["low"], r["high"]
            else:
                s["below"] = r["below"]
                unsettled.discard(r["source"])
    brackets = F.broadcast(_brackets(spark, list(states.values())))
    values = rows.join(brackets, "source").where("score BETWEEN lo AND hi").groupBy("source", "score", "below", "need").agg(F.count("*").alias("ties"))
    upto = F.sum("ties").over(Window.partitionBy("source").orderBy("score")) + F.col("below")
    reached = values.withColumn("kept", upto).where("kept >= need").groupBy("source").agg(F.min_by(F.struct("score", "kept", "ties"), "score").alias("cut"))
    sizes = spark.createDataFrame([(s["source"], s["records"]) for s in states.values()], "source string, records long")
    out = targets.join(F.broadcast(sizes), "source", "left").join(reached, "source", "left")
    zero = F.lit(0).cast("long")
    return out.select("source", "keep_percent", F.coalesce("records", zero).alias("records"), F.col("cut.score").alias("cutoff"), F.coalesce("cut.kept", zero).alias("kept"), F.coalesce("cut.ties", zero).alias("ties"))


def _quantile(sketch, rank: Column):
    """The sketch's value at the nearest of 1,001 ranks: the sketch functions take constant ranks only."""
    grid = F.array(*(F.lit(i / 1000) for i in range(1001)))
    at = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), rank)) * 1000).cast("int") + 1
    return F.element_at(F.kll_sketch_get_quantile_double(sketch, grid), at)


def above(rows: DataFrame, found: DataFrame) -> DataFrame:
    """source, key of the records above their source's cutoff. found has a row for each target, which bounds its size."""
    return rows.join(F.broadcast(found.select("source", "cutoff")), "source").where("score > cutoff").select("source", "key").distinct()


_STATE = T.StructType([T.StructField("source", T.StringType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()), T.StructField("below", T.LongType()), T.StructField("need", T.LongType())])


def _brackets(spark, states: list[dict]) -> DataFrame:
    return spark.createDataFrame([(s["source"], s["lo"], s["hi"], s["below"], s["need"]) for s in states], _STATE)


def _needs(spark, states: list[dict]) -> DataFrame:
    return spark.createDataFrame([(s["source"], s["need"]) for s in states], "source string, need long")


def cutoffs_stored(records: DataFrame, targets: DataFrame, source: str, key: str, score: str, store: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The records that take part, and the cutoffs."""
    rows = store(scored(records, source, key, score))
    return rows, cutoffs(rows, targets)
