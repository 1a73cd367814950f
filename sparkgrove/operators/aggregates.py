"""Ordered aggregates that need no single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkgrove.session import materialise


def prefix_sum(rows: DataFrame, value: str, order: list[str], name: str = "before") -> DataFrame:
    """rows plus the sum of value over all rows before each in the given order (0 for the first).

    A range exchange gives every task a stretch of the order; running sums within stretches plus the sums of
    the stretches before, one row a task, make the whole.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = materialise(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "stretches")
    before = F.sum("total").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = placed.groupBy("_part").agg(F.sum(value).alias("total")).select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    inner = F.sum(value).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    summed = placed.withColumn(name, F.coalesce(inner, F.lit(0))).join(F.broadcast(offsets), "_part")  # one row a task
    return summed.withColumn(name, F.col(name) + F.col("_offset")).drop("_part", "_offset")
