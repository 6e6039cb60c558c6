"""Places of rows in a global order, without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with the place of each row, from 0, in the order of a unique key: range partitions are counted, and each adds to
    its own numbers what stands before it."""
    parts = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id())
    parts = store.cut(parts)
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    # as many rows as partitions
    starts = F.broadcast(counts.select("part", before.alias("before")))
    return parts.withColumn("inside", inside).join(starts, "part").withColumn(name, (F.col("inside") + F.col("before")).cast("long")).drop("part", "inside", "before")
