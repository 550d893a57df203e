"""Voxel tables (z, y, x, v): maps, filters, joins and aggregations.

Every operator is a DataFrame expression over the long form, so filters and projections reach the scan and group-bys
combine map-side. Absent rows are absent voxels: samplers read them as 0, statistics skip them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZYX = ["z", "y", "x"]


def clamp(v: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def window_level(v: Column, window: float, level: float) -> Column:
    """Map [level - window/2, level + window/2] to 0..255, truncated; 0 for an empty window."""
    if window <= 0:
        return F.lit(0).cast("int")
    return F.floor(clamp((v.cast("double") - (level - window / 2)) * 255.0 / window, 0.0, 255.0)).cast("int")


def window_range(v: Column, low: float, high: float) -> Column:
    """Map normalised [low, high] (at least 1/255 apart) to 0..255, rounded."""
    high = max(high, low + 1 / 255)
    return F.floor(clamp((v.cast("double") / 255.0 - low) / (high - low), 0.0, 1.0) * 255.0 + 0.5).cast("int")


def auto_range(df: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Window (lo, hi) from percentiles; minimum and maximum if they coincide, 0..1 if those do."""
    q = df.agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("q"), F.min("v").cast("double").alias("a"), F.max("v").cast("double").alias("b"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    pick = lambda p, m, d: F.when(hi > lo, p).when(F.col("b") > F.col("a"), m).otherwise(F.lit(d))
    return q.select(pick(lo, F.col("a"), 0.0).alias("lo"), pick(hi, F.col("b"), 1.0).alias("hi"))


def threshold(v: Column, lo: float, hi: float, mode: str = "keep") -> Column:
    """"keep": values in range, else 0; "binary255": 255 or 0; "clip": clipped into the range."""
    inside = v.between(lo, hi)
    if mode == "keep":
        return F.when(inside, v).otherwise(F.lit(0))
    if mode == "binary255":
        return F.when(inside, F.lit(255)).otherwise(F.lit(0))
    if mode == "clip":
        return clamp(v, lo, hi)
    raise ValueError(f"unknown threshold mode {mode}")


def remap(v: Column, lut: list[int]) -> Column:
    """Look 0..255 up in a table of 256 values."""
    if len(lut) != 256:
        raise ValueError("a table needs 256 values")
    return F.element_at(F.array(*map(F.lit, lut)), v.cast("int") + 1)


def scale_unit(df: DataFrame) -> DataFrame:
    """Values divided by the largest magnitude (0 everywhere stays 0)."""
    top = df.agg(F.max(F.abs("v")).alias("_top"))
    return df.join(F.broadcast(top)).withColumn("v", F.when(F.col("_top") > 0, F.col("v") / F.col("_top")).otherwise(F.lit(0.0))).drop("_top")


def crop(df: DataFrame, lo: tuple, hi: tuple) -> DataFrame:
    """Half-open box, rebased to its origin."""
    if any(b <= a for a, b in zip(lo, hi, strict=True)):
        raise ValueError("an empty box")
    inside = reduce(lambda p, q: p & q, [(F.col(c) >= a) & (F.col(c) < b) for c, a, b in zip(ZYX, lo, hi, strict=True)])
    return df.where(inside).select(*[(F.col(c) - a).alias(c) for c, a in zip(ZYX, lo, strict=True)], "v")


def transpose(df: DataFrame, axes: tuple) -> DataFrame:
    """New axis i is old axis ``axes[i]``."""
    return df.select(*[F.col(ZYX[a]).alias(c) for c, a in zip(ZYX, axes, strict=True)], "v")


def any_in_region(df: DataFrame, lo: tuple, hi: tuple) -> DataFrame:
    """One row: is a non-zero voxel in the half-open box?"""
    hit = crop(df, lo, hi).where("v <> 0").limit(1)
    return hit.agg((F.count("*") > 0).alias("found"))


def merge_left(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Left-biased merge of u8 volumes: "max", saturating "add", or "mask" (0 where b is 0); where b has no voxel, a stays."""
    j = a.join(b.withColumnRenamed("v", "w"), ZYX, "left")
    v, w = F.col("v"), F.col("w")
    out = {"max": F.greatest(v, w), "add": F.least(F.lit(255), v + w), "mask": F.when(w == 0, 0).otherwise(v)}[op]
    return j.select(*ZYX, F.when(w.isNull(), v).otherwise(out).alias("v"))


def merge_inner(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Merge of equal grids: "max", "min", clipped "add" or "mean"."""
    v, w = F.col("v"), F.col("w")
    ops = {"max": F.greatest(v, w), "min": F.least(v, w), "add": F.least(F.lit(255), v + w), "mean": F.floor((v + w) / 2)}
    if op not in ops:
        raise ValueError(f"unknown merge {op}")
    return a.join(b.withColumnRenamed("v", "w"), ZYX).select(*ZYX, ops[op].cast("long").alias("v"))


def downsample(df: DataFrame, factor: int = 2) -> DataFrame:
    """Mean over factor^3 blocks, truncated; blocks that are not whole are left out (floor shape)."""
    g = df.groupBy(*[F.floor(F.col(c) / factor).alias(c) for c in ZYX]).agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    return g.where(F.col("n") == factor**3).select(*ZYX, F.floor(F.col("s") / factor**3).alias("v"))


def scale(df: DataFrame, factor: int) -> DataFrame:
    """Sum over blocks divided by factor^3, also at the edges (ceiling shape)."""
    g = df.groupBy(*[F.floor(F.col(c) / factor).alias(c) for c in ZYX]).agg(F.sum("v").alias("s"))
    return g.select(*ZYX, (F.col("s") / float(factor**3)).alias("v"))


def pyramid(df: DataFrame, levels: int) -> DataFrame:
    """All levels (level, z, y, x, v); level n + 1 is the downsampled level n."""
    out, cur = df.withColumn("level", F.lit(0)), df
    for n in range(1, levels):
        cur = downsample(cur)
        out = out.unionByName(cur.withColumn("level", F.lit(n)))
    return out.select("level", *ZYX, "v")


def any_pyramid(df: DataFrame, levels: int) -> DataFrame:
    """Levels of a mask: a block is set if any of its voxels is."""
    cur = df.where("v <> 0").select(*ZYX)
    out = cur.withColumn("level", F.lit(0))
    for n in range(1, levels):
        cur = cur.select(*[F.floor(F.col(c) / 2).alias(c) for c in ZYX]).distinct()
        out = out.unionByName(cur.withColumn("level", F.lit(n)))
    return out.select("level", *ZYX)


def stats(df: DataFrame, *by: str) -> DataFrame:
    """Count, minimum, maximum, mean and sample deviation (0 for one voxel)."""
    return df.groupBy(*by).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"))


def hist256(df: DataFrame, *by: str) -> DataFrame:
    """Counts (bin, n) of 256 bins between minimum and maximum; constant data fall into bin 0."""
    ends = df.groupBy(*by).agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
    j = df.join(ends, list(by)) if by else df.join(F.broadcast(ends))
    t = F.when(F.col("hi") > F.col("lo"), (F.col("v").cast("double") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    return j.withColumn("bin", clamp(F.floor(t * 255.0), 0, 255).cast("int")).groupBy(*by, "lo", "hi", "bin").agg(F.count("*").alias("n"))


def hist256_percentiles(hist: DataFrame, percents: list[int], *by: str) -> DataFrame:
    """Midpoint of the first bin whose running count reaches the share."""
    w = Window.partitionBy(*by).orderBy("bin")
    run = hist.withColumn("cum", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    p = run.withColumn("p", F.explode(F.array(*map(F.lit, percents))))
    hit = p.where(F.col("cum") >= F.col("total") * F.col("p") / 100.0).groupBy(*by, "p", "lo", "hi").agg(F.min("bin").alias("bin"))
    return hit.select(*by, "p", (F.col("lo") + (F.col("bin") + 0.5) / 256.0 * (F.col("hi") - F.col("lo"))).alias("value"))


def histogram(df: DataFrame, bins: int) -> DataFrame:
    """Counts of ``bins`` equal bins with their width; the maximum is in the last one."""
    ends = df.agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
    j = df.join(F.broadcast(ends)).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    b = F.when(F.col("width") > 0, F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / F.col("width")))).otherwise(F.lit(0))
    return j.groupBy(b.cast("int").alias("bin"), "lo", "width").agg(F.count("*").alias("n"))


def histogram_percentile(hist: DataFrame, share: float) -> DataFrame:
    """Upper edge of the first bin whose running count reaches ``share``."""
    run = hist.withColumn("cum", F.sum("n").over(Window.orderBy("bin"))).join(F.broadcast(hist.agg(F.sum("n").alias("total"))))
    return run.where(F.col("cum") >= F.col("total") * share).groupBy().agg(F.min(F.struct("bin", "lo", "width")).alias("b")).select((F.col("b.lo") + (F.col("b.bin") + 1) * F.col("b.width")).alias("value"))


def percentiles(df: DataFrame, shares: list[float]) -> DataFrame:
    """Exact interpolated percentiles with minimum, maximum, mean and population deviation."""
    return df.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), *[F.percentile("v", F.lit(p)).alias(f"p{round(p * 100)}") for p in shares])


def composite(df: DataFrame, mode: str, extinction: float = 0.01) -> DataFrame:
    """Per (y, x) over z: max, min, mean, sum, beer (exp of minus the sum), or alpha (front to back, stops when opaque)."""
    g = df.groupBy("y", "x")
    plain = {"max": F.max("v"), "min": F.min("v"), "mean": F.avg("v"), "sum": F.sum("v"), "beer": F.exp(-extinction * F.sum("v"))}
    if mode in plain:
        return g.agg(plain[mode].cast("double").alias("c"))
    if mode != "alpha":
        raise ValueError(f"unknown mode {mode}")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("z", F.col("v").cast("double").alias("v")))), lambda s: s["v"] / 255.0)
    state = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("a"))
    step = lambda s, v: F.when(s["a"] >= 1.0, s).otherwise(F.struct((s["c"] + (1.0 - s["a"]) * v * v).alias("c"), (s["a"] + (1.0 - s["a"]) * v).alias("a")))
    return g.agg(F.aggregate(ordered, state, step, lambda s: s["c"]).alias("c"))


def taps(points: DataFrame, convention: str = "center") -> DataFrame:
    """The eight voxels (tz, ty, tx) around each point (pz, py, px) with their weights ``w``."""
    shift = 0.5 if convention == "center" else 0.0
    p = points
    for c in ZYX:
        # like an integer cast: towards zero
        f = F.col(f"p{c}") - shift
        p = p.withColumn(f"_f{c}", f).withColumn(f"_i{c}", f.cast("long")).withColumn(f"_r{c}", F.col(f"_f{c}") - F.col(f"_i{c}"))
    corners = F.array(*[F.struct(*[F.lit((k >> i) & 1).alias(c) for i, c in enumerate(ZYX)]) for k in range(8)])
    p = p.withColumn("_o", F.explode(corners))
    weight = reduce(lambda a, b: a * b, [F.when(F.col(f"_o.{c}") == 1, F.col(f"_r{c}")).otherwise(1.0 - F.col(f"_r{c}")) for c in ZYX])
    return p.select(*points.columns, *[(F.col(f"_i{c}") + F.col(f"_o.{c}")).alias(f"t{c}") for c in ZYX], weight.alias("w"))


def sample(points: DataFrame, volume: DataFrame, key: list[str], convention: str = "center") -> DataFrame:
    """Trilinear value at each point (``key``, pz, py, px); voxels that do not exist read 0."""
    t = taps(points, convention).join(volume.select(*[F.col(c).alias(f"t{c}") for c in ZYX], "v"), ["tz", "ty", "tx"], "left")
    return t.groupBy(*key).agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0))).alias("value"))


def plane_grid(spark, width: int, height: int, origin: tuple, u: tuple, v: tuple) -> DataFrame:
    """Points of a width x height grid centred on ``origin`` ((x, y, z)), spanned by ``u`` and ``v``."""
    g = spark.range(width * height).select((F.col("id") % width).alias("i"), F.floor(F.col("id") / width).alias("j"))
    du, dv = F.col("i") - (width - 1) / 2, F.col("j") - (height - 1) / 2
    return g.select("i", "j", *[(F.lit(float(o)) + du * float(a) + dv * float(b)).alias(f"p{c}") for c, o, a, b in zip("xyz", origin, u, v, strict=True)])


def lod_best(want: DataFrame, levels: DataFrame) -> DataFrame:
    """For each wanted voxel (level, z, y, x): the value of the finest level at or above it that has it, with coordinates halved per level."""
    last = levels.agg(F.max("level")).first()[0]
    j = want.where(F.col("level") <= F.lit(-1 if last is None else last)).withColumn("at", F.explode(F.sequence(F.col("level"), F.lit(last or 0).cast("int"))))
    for c in ZYX:
        j = j.withColumn(f"s{c}", F.expr(f"shiftright({c}, at - level)"))
    have = levels.select(F.col("level").alias("at"), *[F.col(c).alias(f"s{c}") for c in ZYX], "v")
    hit = j.join(have, ["at", "sz", "sy", "sx"])
    return hit.groupBy("level", *ZYX).agg(F.min_by("v", "at").alias("v"), F.min("at").alias("found"))


def neighbours6(df: DataFrame) -> DataFrame:
    """Each voxel's coordinates with those of its six neighbours (nz, ny, nx)."""
    steps = F.array(*[F.struct(*[F.lit(s if i == k else 0).alias(c) for i, c in enumerate(ZYX)]) for k in range(3) for s in (-1, 1)])
    return df.withColumn("_s", F.explode(steps)).select(*df.columns, *[(F.col(c) + F.col(f"_s.{c}")).alias(f"n{c}") for c in ZYX])


def boundary(mask: DataFrame) -> DataFrame:
    """Mask voxels with a neighbour outside the mask."""
    m = mask.select(*ZYX)
    near = neighbours6(m).join(m.select(*[F.col(c).alias(f"n{c}") for c in ZYX]), ["nz", "ny", "nx"], "left_anti")
    return near.select(*ZYX).distinct()


def overlap_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """Dice and IoU of two masks; 1 if both are empty."""
    j = a.select(*ZYX, F.lit(1).alias("p")).join(b.select(*ZYX, F.lit(1).alias("q")), ZYX, "full").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.coalesce(F.sum("q"), F.lit(0)).alias("q"), F.coalesce(F.sum(F.col("p") * F.col("q")), F.lit(0)).alias("both"))
    union = F.col("p") + F.col("q") - F.col("both")
    return j.select(F.when(F.col("p") + F.col("q") > 0, 2.0 * F.col("both") / (F.col("p") + F.col("q"))).otherwise(1.0).alias("dice"), F.when(union > 0, F.col("both") / union).otherwise(1.0).alias("iou"))


def error_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest error, mean squared error and PSNR over common voxels."""
    j = a.join(b.withColumnRenamed("v", "w"), ZYX).agg(F.max(F.abs(F.col("v") - F.col("w"))).cast("double").alias("max_err"), F.avg(F.pow(F.col("v") - F.col("w"), 2)).alias("mse"), F.max(F.abs("v")).cast("double").alias("peak"))
    return j.select("max_err", "mse", F.when(F.col("mse") > 0, 10 * F.log10(F.col("peak") * F.col("peak") / F.col("mse"))).alias("psnr"))


def diffuse(field: DataFrame, iterations: int) -> DataFrame:
    """Heat steps: a set voxel with fixed = false becomes the mean of its existing neighbours; ``field`` is (z, y, x, v, fixed)."""
    for _ in range(iterations):
        near = neighbours6(field.select(*ZYX)).join(field.select(*[F.col(c).alias(f"n{c}") for c in ZYX], "v"), ["nz", "ny", "nx"]).groupBy(*ZYX).agg(F.avg("v").alias("m"))
        field = field.join(near, ZYX, "left").select(*ZYX, F.when(F.col("fixed"), F.col("v")).otherwise(F.coalesce("m", "v")).alias("v"), "fixed")
    return field
