"""Sheets in a volume: voxels at which the brightness turns along the local normal, and edits of surfaces as a log."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import kernels as K
from lamina.operators import blocks as B
from lamina.operators import surface as S
from lamina.operators.volume import ZYX, taps
from lamina.sources import scratch

_GRADIENT = "z long, y long, x long, gz double, gy double, gx double"


def gradients(voxels: DataFrame, shape: tuple, chunk: tuple, blur: int = 1) -> DataFrame:
    """(z, y, x, gz, gy, gx): Sobel gradients of the box-blurred volume, by chunks with halos."""

    def kernel(block, first, size):
        a = K.box_blur(block, blur) if blur > 1 else block
        inner = tuple(slice(min(halo, f), min(halo, f) + n) for f, n in zip(first, size, strict=True))
        g = [K.sobel(a, k)[inner].ravel() for k in range(3)]
        z, y, x = (i.ravel() + f for i, f in zip(np.indices(size), first, strict=True))
        return pd.DataFrame({"z": z, "y": y, "x": x, "gz": g[0], "gy": g[1], "gx": g[2]})

    halo = blur // 2 + 1
    return B.over_blocks(B.to_chunks(voxels, chunk), chunk, halo, kernel, shape, _GRADIENT, "cut")


def normal_field(g: DataFrame, shape: tuple, window: int = 16) -> DataFrame:
    """(z, y, x, nz, ny, nx): unit mean gradients of whole windows, linear between their centres when these are spread over the volume from end to end.

    Gradients of zero do not count; a window of them has the normal (1, 0, 0). Where the mean vanishes the normal is zero.
    """
    count = [max(1, (n - window) // window + 1) for n in shape]
    cell = [F.floor(F.col(c) / window).alias(f"t{c}") for c in ZYX]
    some = F.greatest(F.abs("gz"), F.abs("gy"), F.abs("gx")) > 0
    whole = g.select(*cell, *[F.when(some, F.col(f"g{c}")).alias(c) for c in ZYX]).where(" and ".join(f"t{c} < {n}" for c, n in zip(ZYX, count, strict=True)))
    mean = whole.groupBy("tz", "ty", "tx").agg(*[F.avg(c).alias(c) for c in ZYX])
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in ZYX), F.lit(0.0)))
    unit = [F.when(F.col("z").isNull(), 1.0 if c == "z" else 0.0).otherwise(F.col(c) / F.when(size > 1e-8, size).otherwise(1.0)).alias(f"m{c}") for c in ZYX]
    coarse = scratch.cut(mean.select("tz", "ty", "tx", *unit), "normals")
    at = [(F.col(c) * ((n - 1) / (m - 1) if m > 1 else 0.0)).alias(f"p{c}") for c, n, m in zip(ZYX, count, shape, strict=True)]
    t = taps(g.select(*ZYX, *at), "corner").where("w > 0").join(coarse, ["tz", "ty", "tx"])
    n = t.groupBy(*ZYX).agg(*[F.sum(F.col("w") * F.col(f"m{c}")).alias(f"n{c}") for c in ZYX])
    size = F.sqrt(sum((F.col(f"n{c}") * F.col(f"n{c}") for c in ZYX), F.lit(0.0)))
    return n.select(*ZYX, *[(F.col(f"n{c}") / F.when(size > 1e-8, size).otherwise(1.0)).alias(f"n{c}") for c in ZYX])


def _unit(name: str, top: float):
    return F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), F.col(name))) / max(min(top, 1000.0), 1e-8)


def detect(voxels: DataFrame, shape: tuple, chunk: tuple = (32, 32, 32), blur: int = 3, first: float = 0.1, second: float = 0.05, window: int = 16) -> DataFrame:
    """(z, y, x, side, nz, ny, nx): voxels of sheets, "recto" where brightness rises along the normal and "verso", normals turned, where it falls.

    A voxel counts where the first derivative along the normal is over ``first`` of its largest size and the second derivative either is below ``second`` of
    its own largest or changes sign towards the next plane. Where normals cancel out, derivatives along z stand in.
    """
    g = scratch.cut(gradients(voxels, shape, chunk, blur), "gradients")
    n = scratch.cut(normal_field(g, shape, window).join(g, ZYX).withColumn("d", sum((F.col(f"g{c}") * F.col(f"n{c}") for c in ZYX), F.lit(0.0))), "field")
    top, raw = (float(v or 0.0) for v in n.agg(F.max(F.abs("d")), F.max(F.abs("gz"))).first())
    name, most = ("d", top) if top >= 1e-4 and top >= raw * 0.5 else ("gz", raw)
    one = scratch.cut(n.select(*ZYX, *[f"n{c}" for c in ZYX], _unit(name, most).alias("d1")), "first")
    again = gradients(one.select(*ZYX, F.col("d1").alias("v")), shape, chunk)
    two = scratch.cut(one.join(again, ZYX).withColumn("e", sum((F.col(f"g{c}") * F.col(f"n{c}") for c in ZYX), F.lit(0.0))), "second")
    top, raw = (float(v or 0.0) for v in two.agg(F.max(F.abs("e")), F.max(F.abs("gz"))).first())
    d2 = two.withColumn("d2", _unit("gz", raw) if top < 1e-4 else _unit("e", top))
    after = d2.select((F.col("z") - 1).alias("z"), "y", "x", F.col("d2").alias("next"))
    j = d2.join(after, ZYX, "left").withColumn("next", F.coalesce("next", "d2"))
    flat = F.abs("d2") < second
    recto = (flat | ((F.col("d2") > 0) & (F.col("next") <= 0))) & (F.col("d1") > first)
    verso = (flat | ((F.col("d2") < 0) & (F.col("next") >= 0))) & (F.col("d1") < -first)
    side = F.when(recto, "recto").when(verso, "verso")
    return j.withColumn("side", side).where("side is not null").select(*ZYX, "side", *[(F.when(F.col("side") == "verso", -1.0).otherwise(1.0) * F.col(f"n{c}")).alias(f"n{c}") for c in ZYX])


# --- edits


def line(surface: DataFrame, start: tuple, end: tuple, radius: float, delta: float, sigma: float | None = None) -> DataFrame:
    """Displacement along the normals, fixed before the edit, by a brush drawn from ``start`` to ``end`` (row, col) in two dabs a grid unit: the dabs' Gaussian weights add up."""
    sigma = sigma or radius / 2
    n = int(((end[0] - start[0]) ** 2 + (end[1] - start[1]) ** 2) ** 0.5 * 2) + 1
    dabs = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.pow(F.col("row") - (start[0] + i / n * (end[0] - start[0])), 2) + F.pow(F.col("col") - (start[1] + i / n * (end[1] - start[1])), 2))
    weight = F.aggregate(dabs, F.lit(0.0), lambda acc, d2: acc + F.when(d2 <= radius * radius, F.exp(-d2 / (2 * sigma * sigma))).otherwise(0.0))
    return S.normals(surface).withColumn("_w", delta * weight).select("row", "col", *[(F.col(k) + F.col(f"n{k}") * F.col("_w")).alias(k) for k in "xyz"])


def record(before: DataFrame, after: DataFrame, edit: int) -> DataFrame:
    """(edit, row, col, x, y, z): the cells that an edit changed, as they were before it."""
    b = before.select("row", "col", *[F.col(k).alias(f"_{k}") for k in "xyz"])
    moved = F.lit(False)
    for k in "xyz":
        moved |= F.col(k) != F.col(f"_{k}")
    return after.join(b, ["row", "col"]).where(moved).select(F.lit(edit).alias("edit"), "row", "col", *[F.col(f"_{k}").alias(k) for k in "xyz"])


def undo(surface: DataFrame, log: DataFrame, upto: int) -> DataFrame:
    """``surface`` as it was before edit ``upto`` and all later ones: of each cell the oldest of their records."""
    old = log.where(F.col("edit") >= upto).withColumn("_n", F.row_number().over(Window.partitionBy("row", "col").orderBy("edit"))).where("_n = 1")
    old = old.select("row", "col", *[F.col(k).alias(f"_{k}") for k in "xyz"])
    return surface.join(old, ["row", "col"], "left").select("row", "col", *[F.coalesce(f"_{k}", k).alias(k) for k in "xyz"])


def erase(surface: DataFrame, row: float, col: float, radius: float) -> DataFrame:
    """Cells within ``radius`` taken out."""
    return surface.where((F.col("row") - row) ** 2 + (F.col("col") - col) ** 2 > radius * radius)
