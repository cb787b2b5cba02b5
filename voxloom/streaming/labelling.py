"""Incremental labelling: recordings that arrive are labelled once, across restarts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Transcriber = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
LABEL = "file string, seconds double, ms double, text string"


def label_new(spark: SparkSession, inbox: str, schema: str, labels: str, checkpoint: str, transcribe: Transcriber) -> None:
    """Labels what came to inbox (JSON lines with a file column) since the last call and appends to the table of labels.

    The checkpoint remembers the files read; a batch that is run again, or a recording that comes again, adds nothing, for
    labels there already are left out.
    """

    def add(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["file"])
        if _exists(spark, labels):
            new = new.join(spark.read.parquet(labels).select("file"), "file", "left_anti")
        new.mapInPandas(transcribe, LABEL).write.mode("append").parquet(labels)

    arriving = spark.readStream.schema(schema).json(inbox)
    query = arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def unlabelled(recordings: DataFrame, labels: DataFrame) -> DataFrame:
    """Recordings (file) without a label (file)."""
    return recordings.select("file").distinct().join(labels.select("file"), "file", "left_anti")


def unlabelled_by(labels: DataFrame, by: str) -> DataFrame:
    """file, labelled, missing of the recordings that some set of labels (named by the column by) lacks: the names of the sets that
    have it, sorted, and how many lack it."""
    known = labels.where(F.col("file").isNotNull() & F.col(by).isNotNull()).groupBy("file").agg(F.array_sort(F.collect_set(by)).alias("sets"))
    whole = labels.agg(F.count_distinct(by).alias("all"))
    counted = known.join(F.broadcast(whole)).withColumn("missing", F.col("all") - F.size("sets"))  # one row is broadcast
    return counted.where("missing > 0").select("file", F.array_join("sets", ",").alias("labelled"), "missing")


def resumed(contents: DataFrame) -> DataFrame:
    """path, file, line of labels files (path, value): complete lines; a last line without its break is dropped, to be done again."""
    whole = contents.withColumn("l", F.split("value", "\n"))
    kept = F.slice("l", F.lit(2), F.greatest(F.lit(0), F.size("l") - 2))  # without the header and what follows the last break
    return whole.select("path", F.explode(kept).alias("line")).where("line <> ''").select("path", F.split("line", "\t")[0].alias("file"), "line")


def complete_states(files: DataFrame) -> DataFrame:
    """folder of the checkpoints among files (folder, name) that were finished: those with their state file."""
    return files.groupBy("folder").agg(F.max(F.col("name") == "state.json").alias("done")).where("done").select("folder")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
