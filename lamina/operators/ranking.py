"""Row numbers over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.sources import scratch


def numbered(df: DataFrame, *order: Column | str, name: str = "n", start: int = 0) -> DataFrame:
    """``df`` with ``name``: the place of each row (long, from ``start``) in the given order; rows that tie in it take places in any order.

    Rows are written once in ranges of the order; the sizes of the ranges before it give each range its first place, and only the rows of one range are
    sorted together.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = scratch.cut(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = held.groupBy("_range").count().select("_range", (F.coalesce(before, F.lit(0)) + (start - 1)).alias("_first"))
    place = F.col("_first") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return held.join(F.broadcast(starts), "_range").withColumn(name, place.cast("long")).drop("_range", "_first")
