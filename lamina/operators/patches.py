"""Patch and tile pipelines for model input and output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.ranking import numbered


def grid(spark, shape: tuple, patch: tuple, stride: tuple, part: tuple[int, int] | None = None) -> DataFrame:
    """Origins (z, y, x) of patches that fit, at least one an axis; ``part`` = (index, number) keeps every number-th z."""
    axes = [list(range(0, max(1, n - p + 1), s)) for n, p, s in zip(shape, patch, stride, strict=True)]
    if part:
        axes[0] = [z for z in axes[0] if (z // stride[0]) % part[1] == part[0]]
    seq = [F.array(*map(F.lit, a)) for a in axes]
    return spark.range(1).select(F.explode(seq[0]).alias("z"), F.lit(0).alias("_")).select("z", F.explode(seq[1]).alias("y")).select("z", "y", F.explode(seq[2]).alias("x")).select(*[F.col(c).cast("long").alias(c) for c in "zyx"])


def tile_positions(size: int, tile: int, stride: int) -> list[int]:
    """Starts that cover ``size``, the last one flush with the end."""
    if size <= tile:
        return [0]
    at = list(range(0, size - tile + 1, stride))
    return at if at[-1] == size - tile else [*at, size - tile]


def ramp(offset: Column, tile: int) -> Column:
    """1 at a tile's border, rising to its middle."""
    return F.least(offset + 1, F.lit(tile) - offset)


def _covers(axis: str, tile: int):
    return lambda p: (p <= F.col(axis)) & (F.col(axis) < p + tile)


def blend_tiles(volume: DataFrame, tile: int, stride: int, size: int, predict=lambda v: v) -> DataFrame:
    """Overlapping tiles of every plane, predicted per pixel and blended: sum(prediction * ramp) / max(sum(ramp), 1e-6)."""
    starts = F.array(*[F.lit(p) for p in tile_positions(size, tile, stride)])
    t = volume
    for c in ("y", "x"):
        t = t.withColumn(f"t{c}", F.explode(F.filter(starts, _covers(c, tile))))
    w = F.least(ramp(F.col("y") - F.col("ty"), tile), ramp(F.col("x") - F.col("tx"), tile))
    return t.groupBy("z", "y", "x").agg((F.sum(predict(F.col("v")) * w) / F.greatest(F.sum(w), F.lit(1e-6))).alias("v"))


def extract(volume: DataFrame, origins: DataFrame, patch: tuple) -> DataFrame:
    """Zero-padded crops: (pz, py, px, values in raster order, padding mask)."""
    o = origins.select(*[F.col(c).alias(f"p{c}") for c in "zyx"])
    for c, n in zip("zyx", patch, strict=True):
        o = o.withColumn(f"d{c}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cells = o.select("*", *[(F.col(f"p{c}") + F.col(f"d{c}")).alias(c) for c in "zyx"]).join(volume, ["z", "y", "x"], "left")
    pos = (F.col("dz") * patch[1] + F.col("dy")) * patch[2] + F.col("dx")
    g = cells.groupBy("pz", "py", "px").agg(F.array_sort(F.collect_list(F.struct(pos.alias("i"), F.coalesce("v", F.lit(0)).alias("v"), F.col("v").isNotNull().cast("int").alias("m")))).alias("c"))
    return g.select("pz", "py", "px", F.transform("c", lambda s: s["v"]).alias("image"), F.transform("c", lambda s: s["m"]).alias("mask"))


def batches(df: DataFrame, size: int, seed: int, key: str, drop_last: bool = False) -> DataFrame:
    """Seeded shuffle into batches (column ``batch``)."""
    out = numbered(df, F.xxhash64(F.lit(seed), F.col(key)), F.col(key), name="batch").withColumn("batch", F.floor(F.col("batch") / size))
    if drop_last:
        whole = out.groupBy("batch").count().where(F.col("count") == size).select("batch")
        out = out.join(whole, "batch")
    return out


# --- many volumes or images at once: positions from their sizes


def starts(size: Column, patch: int, stride: int) -> Column:
    """Starts of patches that fit into ``size``, at least one."""
    return F.sequence(F.lit(0).cast("long"), F.greatest(size.cast("long") - patch, F.lit(0).cast("long")), F.lit(stride).cast("long"))


def covering_starts(size: Column, tile: int, stride: int) -> Column:
    """Starts of tiles that cover ``size``, the last one flush with the end."""
    last = F.greatest(size.cast("long") - tile, F.lit(0).cast("long"))
    return F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long")), F.array(last)))


def origins(volumes: DataFrame, patch: tuple, stride: tuple, part: tuple[int, int] | None = None) -> DataFrame:
    """Patch origins (z, y, x) of every row of ``volumes`` (.., sz, sy, sx); ``part`` = (index, number) keeps every number-th step in z."""
    out = volumes
    for c, p, s in zip("zyx", patch, stride, strict=True):
        at = starts(F.col(f"s{c}"), p, s)
        if c == "z" and part:
            at = F.filter(at, lambda v: F.floor(v / stride[0]) % part[1] == part[0])
        out = out.withColumn(c, F.explode(at))
    return out.drop("sz", "sy", "sx")


def tiles(images: DataFrame, tile: int, stride: int) -> DataFrame:
    """Tile positions (ty, tx) that cover every row of ``images`` (.., height, width)."""
    t = images.withColumn("ty", F.explode(covering_starts(F.col("height"), tile, stride)))
    return t.withColumn("tx", F.explode(covering_starts(F.col("width"), tile, stride))).drop("height", "width")


def chunk_ranges(axes: DataFrame, chunk: int, halo: int) -> DataFrame:
    """(.., i, read_from, read_to, write_from, write_to): chunks of every row of ``axes`` (.., n) with the range to read for a halo."""
    n, i = F.col("n").cast("long"), F.col("i")
    out = axes.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n / chunk).cast("long") - 1, F.lit(0).cast("long"))))).where("n > 0")
    zero = F.lit(0).cast("long")
    return out.select(*[c for c in axes.columns if c != "n"], "i", F.greatest(zero, i * chunk - halo).alias("read_from"), F.least(n, (i + 1) * chunk + halo).alias("read_to"), (i * chunk).alias("write_from"), F.least(n, (i + 1) * chunk).alias("write_to"))
