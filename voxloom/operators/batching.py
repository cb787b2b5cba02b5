"""Plans of training steps: epochs, micro-batches within a token budget, layouts of rows, prompts, clips and windows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_FRAMES, WINDOW_CHUNKS = 100, 8


def step_position(step: Column, steps_per_epoch: int) -> Column:
    """epoch and step within it of a global step."""
    return F.struct(F.floor(step / steps_per_epoch).alias("epoch"), F.pmod(step, F.lit(steps_per_epoch)).alias("step"))


def micro_batches(lengths: DataFrame, budget: int) -> DataFrame:
    """step, at, length, batch: longest first, equal lengths in their order, a batch's rows times its longest within the budget; one longer stands alone.

    lengths: step, at, length. A step has a fixed number of records, so its array is small whatever the data's size.
    """
    struct = "struct<batch:bigint,n:bigint,longest:bigint,done:array<struct<at:bigint,length:bigint,batch:bigint>>>"
    item = F.struct((-F.col("length")).alias("k"), F.col("at").cast("long").alias("at"))
    sorted_ = lengths.groupBy("step").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.expr(f"CAST(named_struct('batch', 0, 'n', 0, 'longest', 0, 'done', array()) AS {struct})")

    def add(state: Column, x: Column) -> Column:
        full = (state["n"] > 0) & ((state["n"] + 1) * state["longest"] > budget)
        batch = state["batch"] + F.when(full, 1).otherwise(0)
        n = F.when(full, F.lit(1)).otherwise(state["n"] + 1)
        longest = F.when(full | (state["n"] == 0), -x["k"]).otherwise(state["longest"])
        one = F.struct(x["at"].alias("at"), (-x["k"]).cast("long").alias("length"), batch.cast("long").alias("batch"))
        done = F.array_append(state["done"], one)
        return F.struct(batch.cast("long").alias("batch"), n.cast("long").alias("n"), longest.cast("long").alias("longest"), done.alias("done")).cast(struct)

    return sorted_.select("step", F.explode(F.aggregate("items", start, add)["done"]).alias("b")).select("step", "b.at", "b.length", "b.batch")


def step_totals(batches: DataFrame) -> DataFrame:
    """step, micro_batches, padded_tokens (rows times longest, over the batches), tokens."""
    one = batches.groupBy("step", "batch").agg((F.count("*") * F.max("length")).alias("padded"), F.sum("length").alias("tokens"))
    return one.groupBy("step").agg(F.count("*").alias("micro_batches"), F.sum("padded").alias("padded_tokens"), F.sum("tokens").alias("tokens"))


def padded_rows(rows: DataFrame, by: str, padding: int) -> DataFrame:
    """rows (by, at, ids) with the inputs (all but the last id) padded to the group's longest."""
    longest = F.max(F.size("ids") - 1).over(Window.partitionBy(by))
    inputs = F.slice("ids", F.lit(1), F.size("ids") - 1)
    return rows.withColumn("length", longest).withColumn("inputs", F.concat(inputs, F.array_repeat(F.lit(padding), F.col("length") - F.size(inputs))))


def prompt(prefix: Column, placeholder: int, n: Column, suffix: Column, label: Column, end: int) -> Column:
    """prefix, n placeholders, suffix, the label and the end as one array."""
    return F.concat(prefix, F.array_repeat(F.lit(placeholder), n.cast("int")), suffix, label, F.array(F.lit(end)))


def tokeniser(encode: Callable[[list[str]], list[list[int]]]) -> Callable[[Column], Column]:
    """A column function of any tokeniser, given as a function of a list of texts; null stays null."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        some = [t is not None for t in texts.to_pylist()]
        coded = iter(encode(texts.drop_null().to_pylist()))
        return pa.array([next(coded) if s else None for s in some], pa.list_(pa.int32()))

    return run


def audio_places(ids: Column, placeholder: int) -> Column:
    """The places, from 0, of the placeholders in ids."""
    return F.filter(F.transform(ids, lambda x, i: F.when(x == placeholder, i)), lambda p: p.isNotNull())


def targets(ids: Column, prompt_length: Column) -> Column:
    """Places whose next token is a label's, with that token: from the last of the prompt to the last but one."""
    places = F.when(F.size(ids) > prompt_length, F.sequence(prompt_length - 1, F.size(ids) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda p: F.struct(p.alias("place"), F.get(ids, p + 1).alias("id")))


def running_offset(value: str, by: str, order: str) -> Column:
    """Sum of the values before this row in its group."""
    w = Window.partitionBy(by).orderBy(order)
    return F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def audio_tokens(frames: Column) -> Column:
    """Placeholders of a clip: whole steps of three halvings of the rest, plus 13 for each 100 frames, in single precision."""
    half = lambda n: F.floor((n - 1) / 2) + 1
    rest = half(half(half(F.pmod(frames, F.lit(100)))))
    share = ((frames.cast("float") / F.lit(100).cast("float")).cast("float") * F.lit(13).cast("float")).cast("float")
    return (rest.cast("float") + share).cast("float").cast("int")


def convolved(n: Column) -> Column:
    """Length after a convolution of stride 2."""
    return F.floor((n - 1) / 2) + 1


def clip_chunks(clips: DataFrame) -> DataFrame:
    """batch, clip, chunk, start, length, rows of clips (batch, clip, frames), cut into chunks of CHUNK_FRAMES."""
    longest = F.least(F.lit(CHUNK_FRAMES), F.max("frames").over(Window.partitionBy("batch")))
    most = convolved(convolved(convolved(longest)))
    cut = clips.where("frames > 0").withColumn("most", most).select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("frames") - 1) / CHUNK_FRAMES).cast("int"))).alias("chunk"))
    cut = cut.withColumn("start", F.col("chunk") * CHUNK_FRAMES).withColumn("length", F.least(F.lit(CHUNK_FRAMES), F.col("frames") - F.col("start")))
    return cut.withColumn("rows", F.least("most", audio_tokens(F.col("length")))).select("batch", "clip", "chunk", "start", "length", "rows")


def windows(chunks: DataFrame) -> DataFrame:
    """batch, clip, window, first_row, rows: WINDOW_CHUNKS chunks of a clip each, rows counted through the batch."""
    each = chunks.groupBy("batch", "clip", F.floor(F.col("chunk") / WINDOW_CHUNKS).alias("window")).agg(F.sum("rows").alias("rows"))
    w = Window.partitionBy("batch").orderBy("clip", "window").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("batch", "clip", "window", F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("first_row"), "rows")


def window_matrix(spans: DataFrame) -> DataFrame:
    """batch, window_no, place, row, masked: ragged windows as a padded matrix; places past a window's end are masked and hold row 0."""
    longest = F.max("rows").over(Window.partitionBy("batch"))
    number = F.row_number().over(Window.partitionBy("batch").orderBy("clip", "window")) - 1
    cells = spans.withColumn("longest", longest).withColumn("window_no", number).select("*", F.explode(F.sequence(F.lit(0), (F.col("longest") - 1).cast("int"))).alias("place"))
    inside = F.col("place") < F.col("rows")
    return cells.select("batch", "window_no", "place", F.when(inside, F.col("first_row") + F.col("place")).otherwise(F.lit(0)).alias("row"), (~inside).alias("masked"))


def gathered(tokens: Column, is_audio: Column, index: Column, audio: Column) -> Column:
    """Tokens, with audio values where is_audio says so, picked by index from 0."""
    return F.transform(tokens, lambda t, i: F.when(F.get(is_audio, i), F.get(audio, F.get(index, i))).otherwise(t))


def right_padded(samples: Column, least: int) -> Column:
    """Samples with zeros up to the least number."""
    return F.concat(samples, F.array_repeat(F.lit(0).cast("float"), F.greatest(F.lit(0), F.lit(least) - F.size(samples))))


def learning_rate(step: Column, peak: float, total: int, warmup_fraction: float) -> Column:
    """Linear warm-up over a share of the steps, rounded up, then linear decay to 0."""
    import math

    warm = math.ceil(total * warmup_fraction)
    decay = F.lit(peak) * F.greatest(F.lit(0.0), (total - step) / float(max(1, total - warm)))
    return F.when(step < warm, F.lit(peak) * step / float(max(1, warm))).otherwise(decay)


def evaluation_steps(spark, epochs: int, per_epoch: int, parts: int) -> DataFrame:
    """step: where a run of so many epochs evaluates, parts times in each."""
    e = spark.range(epochs).select(F.col("id").alias("epoch")).select("epoch", F.explode(F.sequence(F.lit(1), F.lit(parts))).alias("part"))
    return e.select((F.col("epoch") * per_epoch + F.floor(F.col("part") * per_epoch / parts)).cast("long").alias("step")).distinct()


def newest(states: DataFrame, keep: int, *by: str) -> DataFrame:
    """The states with the highest steps of each group."""
    return states.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("step").desc()))).where(F.col("turn") <= keep).drop("turn")
