"""Writers of the corpus' files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import text as X


def json_records(rows: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines of audio and text, a folder for each split, no characters escaped."""
    rows.select(split, "audio", "text").write.partitionBy(split).option("ignoreNullFields", "false").json(path)


def lines(rows: DataFrame, path: str, *columns: str, order: tuple[str, ...] = ()) -> None:
    """Tab-separated lines without quoting; sorted over all files if an order is given."""
    kept = rows.orderBy(*order) if order else rows
    kept.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))).write.text(path)


def replay(rows: DataFrame, path: str) -> None:
    """source, file, error with three decimals, label; sources in their order, then files."""
    lines(rows.withColumn("error", X.fixed3(F.col("error"))), path, "source", "file", "error", "label", order=("ord", "file"))


def chunked(rows: DataFrame, path: str, chunk: str = "chunk", line: str = "word", order: str = "rank") -> None:
    """A folder of lines for each chunk."""
    rows.repartition(chunk).sortWithinPartitions(chunk, order).select(chunk, line).write.partitionBy(chunk).text(path)


def transcripts(rows: DataFrame, path: str) -> None:
    """Transcripts as lines with a header, breaks and tabs as spaces."""
    flat = rows.select("audio", *(X.flat_line(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("reference", "hypothesis")), F.coalesce("language", F.lit("")).alias("language"), F.format_string("%.2f", "seconds").alias("seconds"), F.format_string("%.0f", "milliseconds").alias("ms"))
    flat.write.option("sep", "\t").option("header", "true").option("quote", "").option("emptyValue", "").csv(path)


def metrics(rows: DataFrame, path: str) -> None:
    """Metrics appended as JSON lines."""
    rows.write.mode("append").json(path)


def report(rows: DataFrame, path: str) -> None:
    """Stored counters as JSON; rates are computed when read."""
    rows.write.mode("overwrite").json(path)
