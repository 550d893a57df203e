"""Progressive chunk streams: coarse levels first, chunks of a level in raster order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def chunk_plan(spark: SparkSession, grids: list[tuple], region: tuple | None = None) -> DataFrame:
    """(seq, level, z, y, x, is_last) for pyramids with ``grids[level]`` chunks an axis.

    ``region`` is (z0, y0, x0, z1, y1, x1) in chunks of level 0, its end exclusive; coarser levels take its ceiling-halved bounds.
    """
    rows = []
    for level, shape in enumerate(grids):
        lo, hi = (region[:3], region[3:]) if region else ((0, 0, 0), grids[0])
        for _ in range(level):
            lo, hi = tuple(v // 2 for v in lo), tuple((v + 1) // 2 for v in hi)
        rows.append((level, *[int(v) for v in lo], *[min(int(h), n) for h, n in zip(hi, shape, strict=True)]))
    g = spark.createDataFrame(rows, "level int, z0 long, y0 long, x0 long, z1 long, y1 long, x1 long").where("z1 > z0 and y1 > y0 and x1 > x0")
    for c in "zyx":
        g = g.withColumn(c, F.explode(F.sequence(F.col(f"{c}0"), F.col(f"{c}1") - 1)))
    w = Window.orderBy(F.desc("level"), "z", "y", "x")
    after = F.lead("level").over(w)
    return g.select(F.row_number().over(w).alias("seq"), "level", "z", "y", "x", (after.isNull() | (after != F.col("level"))).alias("is_last"))


def stream_chunks(plan: DataFrame, chunks: DataFrame) -> DataFrame:
    """The plan with chunk data; a chunk that does not exist comes as an empty one."""
    return plan.join(chunks, ["level", "z", "y", "x"], "left").withColumn("data", F.coalesce("data", F.lit("").cast("binary")))


def chunk_plans(volumes: DataFrame, levels: int, key: str = "volume_id") -> DataFrame:
    """(key, seq, level, z, y, x, is_last) for every row of ``volumes`` (key, gz, gy, gx: chunks of level 0; z0 .. x1: region, end exclusive).

    Coarser grids have half the chunks, rounded up, and regions follow; a volume's plan is ordered for itself.
    """
    g = volumes.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    for c in "zyx":
        lo, hi, n = (F.col(k).cast("long") for k in (f"{c}0", f"{c}1", f"g{c}"))
        half = F.expr("shiftleft(1L, level)")
        up = lambda v, half=half: F.floor((v + half - 1) / half)
        g = g.withColumn(f"_{c}0", F.floor(lo / half)).withColumn(f"_{c}1", F.least(up(hi), up(n)))
    for c in "zyx":
        g = g.where(F.col(f"_{c}1") > F.col(f"_{c}0")).withColumn(c, F.explode(F.sequence(F.col(f"_{c}0"), F.col(f"_{c}1") - 1)))
    w = Window.partitionBy(key).orderBy(F.desc("level"), "z", "y", "x")
    after = F.lead("level").over(w)
    return g.select(key, F.row_number().over(w).alias("seq"), "level", "z", "y", "x", (after.isNull() | (after != F.col("level"))).alias("is_last"))
