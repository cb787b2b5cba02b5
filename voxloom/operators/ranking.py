"""Global ranks without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, major: str, minor: str, width: int = 1 << 20, then: tuple[str, ...] = ()) -> DataFrame:
    """rows with rank, from 1, by major descending, then minor (an integer) ascending, then the columns of then.

    Rows are ranked within buckets of one major value and width minor values. Offsets come in two steps: of the distinct major
    values (of counts there are at most about the root of twice their sum), then of the buckets within each.
    """
    bucketed = rows.withColumn("_bucket", F.floor(F.col(minor) / width))
    sizes = bucketed.groupBy(major, "_bucket").agg(F.count("*").alias("_n"))
    majors = sizes.groupBy(major).agg(F.sum("_n").alias("_m"))
    above = majors.select(major, (F.sum("_m").over(Window.orderBy(F.col(major).desc())) - F.col("_m")).alias("_above"))
    inner = F.sum("_n").over(Window.partitionBy(major).orderBy("_bucket")) - F.col("_n")
    before = sizes.withColumn("_inner", inner).join(above, major).select(major, "_bucket", (F.col("_above") + F.col("_inner")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(major, "_bucket").orderBy(minor, *then))
    return bucketed.withColumn("_within", within).join(before, [major, "_bucket"]).withColumn("rank", F.col("_before") + F.col("_within")).drop("_bucket", "_before", "_within")
