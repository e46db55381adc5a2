"""Gapless global positions of sorted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packing import stored


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df, written to the shared folder, with `name`: the position of each row in `order`, from 0.

    Rows are range-partitioned and sorted, so that no task holds more than a range; what is summed over all ranges is one
    row for each. Equal rows are numbered in any order, once: the written table is what later steps read. The result has
    `_stored`, the table to discard.
    """
    at = df.repartitionByRange(*order).sortWithinPartitions(*order)
    written = stored(at.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")))
    sizes = written.groupBy("_range").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    starts = sizes.select("_range", (before - F.col("_first")).alias("_shift"))
    out = written.join(F.broadcast(starts), "_range").withColumn(name, F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")
    out._stored = written._stored
    return out
