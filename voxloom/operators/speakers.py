"""Counts per speaker, seeded splits and samples."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Speakers whose names the driver shuffles at most.
MOST_SPEAKERS = 5_000_000


def counts(utterances: DataFrame) -> DataFrame:
    """speaker, utterances."""
    return utterances.where("speaker IS NOT NULL").groupBy("speaker").agg(F.count("*").alias("utterances"))


def hash_split(by_speaker: DataFrame, seed: int, test: int, dev: int) -> DataFrame:
    """speaker, utterances, split: in the order of a seeded hash the first test, the next dev, the rest train. Only test + dev rows are ranked."""
    if test < 0 or dev < 0 or test + dev >= by_speaker.count():
        raise ValueError("test and dev take all speakers")
    keyed = by_speaker.withColumn("h", F.md5(F.concat(F.lit(f"{seed}\t"), "speaker")))
    first = keyed.orderBy("h", "speaker").limit(test + dev)
    turn = F.row_number().over(Window.orderBy("h", "speaker"))
    chosen = first.select("speaker", F.when(turn <= test, "test").otherwise("dev").alias("split"))
    return by_speaker.join(F.broadcast(chosen), "speaker", "left").select("speaker", "utterances", F.coalesce("split", F.lit("train")).alias("split"))


def shuffled_split(by_speaker: DataFrame, seed: int, test: int, dev: int) -> DataFrame:
    """As hash_split, by the standard library's seeded shuffle of the sorted speakers. The names pass the driver, at most MOST_SPEAKERS; more raise, and hash_split serves them."""
    names = sorted(r[0] for r in by_speaker.select("speaker").limit(MOST_SPEAKERS + 1).collect())
    if len(names) > MOST_SPEAKERS:
        raise ValueError(f"more than {MOST_SPEAKERS} speakers; their split is by hash")
    if test + dev >= len(names):
        raise ValueError("test and dev take all speakers")
    random.Random(seed).shuffle(names)
    rows = [(n, "test" if i < test else "dev" if i < test + dev else "train") for i, n in enumerate(names)]
    return by_speaker.join(by_speaker.sparkSession.createDataFrame(rows, "speaker string, split string"), "speaker")


def split_sizes(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("speakers"), F.sum("utterances").alias("utterances"))


def hash_sample(keys: DataFrame, key: str, count: int, seed: int, shards: int) -> DataFrame:
    """key, shard: count keys by a seeded hash, sorted again and dealt to shards in turn."""
    n = keys.count()
    if not 0 < count <= n:
        raise ValueError(f"{count} of {n}")
    drawn = keys.withColumn("h", F.md5(F.concat(F.lit(f"{seed}\t"), F.col(key).cast("string")))).orderBy("h", key).limit(count)
    return drawn.select(key, F.pmod(F.row_number().over(Window.orderBy(key)) - 1, F.lit(shards)).alias("shard"))


def seeded_sample(keys: list, count: int, seed: int) -> list:
    """The standard library's seeded sample of the sorted keys, sorted."""
    if not 0 < count <= len(keys):
        raise ValueError(f"{count} of {len(keys)}")
    return sorted(random.Random(seed).sample(sorted(keys), count))


# The public 64-bit generator's increment, multipliers and shifts.
GAMMA, MIX, SHIFTS = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (30, 27, 31)
#: Records whose order, a sequence by its definition, is made in one process; more raise, and hashed_order serves them.
MOST = 20_000_000


def draws(state: int, n: int) -> np.ndarray:
    """The n numbers that follow a state. Each is a mix of its own place in the sequence, so all are made at once."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(GAMMA) + np.uint64(state % (1 << 64))
    for shift, factor in zip(SHIFTS, (*MIX, 1), strict=True):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def choices(state: int, bounds: np.ndarray) -> np.ndarray:
    """A number under each bound in turn; draws in the generator's last, incomplete run of a bound are passed over."""
    bounds = bounds.astype(np.uint64)
    whole = np.uint64((1 << 64) - 1)
    drawn, used = draws(state, len(bounds)), len(bounds)
    while len(over := np.flatnonzero(drawn >= whole - whole % bounds)):
        drawn = np.concatenate([np.delete(drawn, over[0]), draws(state + used * GAMMA, 1)])
        used += 1
    return (drawn % bounds).astype(np.int64)


def epoch_order(n: int, seed: int, epoch: int) -> list[int]:
    """The order of n records in an epoch: a function of seed and epoch only, so a resumed run goes on as it would have."""
    if n > MOST:
        raise ValueError(f"{n} records; orders of more than {MOST} are by hash")
    order = list(range(n))
    last = np.arange(n - 1, 0, -1)
    for i, j in zip(last.tolist(), choices(seed + epoch * GAMMA, last + 1).tolist(), strict=True):
        order[i], order[j] = order[j], order[i]
    return order


def hashed_order(rows: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """rows with place, from 0: their order by a hash of seed, epoch and key, for any number of rows.

    Rows are ranked within 65,536 ranges of the hash; the ranges' counts, a table of that size, give the offsets.
    """
    hashed = rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}\t{epoch}\t"), F.col(key).cast("string"))))
    hashed = hashed.withColumn("_range", F.substring("_h", 1, 4))
    sizes = hashed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_h", key))
    return hashed.withColumn("_within", within).join(F.broadcast(before), "_range").withColumn("place", F.col("_before") + F.col("_within") - 1).drop("_h", "_range", "_within", "_before")
