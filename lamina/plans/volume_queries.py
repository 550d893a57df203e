"""Queries over the derived volumes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.catalog import register
from lamina.operators import volume as V
from lamina.plans.views import surface, vol, vol2, vol_float, with_views

ZYX = V.ZYX


def _map(name, fn, sql, view="vol"):
    source = {"vol": vol, "volf": vol_float}[view]
    register(name, with_views(f"select z, y, x, {sql} as v from {view}", view))(lambda s, d: source(s, d).select(*ZYX, fn(F.col("v")).alias("v")))


_map("map_window_level", lambda v: V.window_level(v, 100.0, 128.0), "cast(floor(greatest(0e0, least(255e0, (v - 78e0) * 255e0 / 100e0))) as int)")
_map("map_window_range", lambda v: V.window_range(v, 0.2, 0.7), "cast(floor(greatest(0e0, least(1e0, (v / 255e0 - 2e-1) / (7e-1 - 2e-1))) * 255e0 + 5e-1) as int)")
_map("map_wl_norm", lambda v: F.round(V.clamp((v / 255.0 - 0.3) / 0.4 + 0.5, 0.0, 1.0), 9), "round(greatest(0e0, least(1e0, (v / 255e0 - 3e-1) / 4e-1 + 5e-1)), 9)")
_map("map_threshold", lambda v: V.threshold(v, 64, 192).cast("long"), "case when v between 64 and 192 then v else 0 end")
_map("map_threshold_binary", lambda v: V.threshold(v, 64, 192, "binary255").cast("int"), "case when v between 64 and 192 then 255 else 0 end")
_map("map_threshold_clip", lambda v: V.threshold(v, 64, 192, "clip").cast("long"), "greatest(64, least(192, v))")
_map("map_remap_lut", lambda v: V.remap(v, [(i * 7 + 3) % 256 for i in range(256)]), "cast((v * 7 + 3) % 256 as int)")


@register("map_auto_range", with_views("select quantile_cont(v, 0.02) as lo, quantile_cont(v, 0.98) as hi from vol", "vol"))
def _auto_range(s, d):
    return V.auto_range(vol(s, d))


@register("map_scale_m1_1", with_views("select z, y, x, round(v / (select max(abs(v)) from volf), 9) + 0e0 as v from volf", "volf"))
def _unit(s, d):
    return V.scale_unit(vol_float(s, d)).withColumn("v", F.round("v", 9) + 0.0)


@register("map_transpose", with_views("select x as z, z as y, y as x, v from vol", "vol"))
def _transpose(s, d):
    return V.transpose(vol(s, d), (2, 0, 1))


@register("flt_bbox", with_views("select z - 1 as z, y - 2 as y, x - 3 as x, v from vol where z >= 1 and z < 5 and y >= 2 and y < 12 and x >= 3 and x < 14", "vol"))
def _bbox(s, d):
    return V.crop(vol(s, d), (1, 2, 3), (5, 12, 14))


@register("flt_region_any", with_views("select count(*) > 0 as found from vol where v >= 250 and z < 2 and y < 8 and x < 8", "vol"))
def _region_any(s, d):
    return V.any_in_region(vol(s, d).where("v >= 250"), (0, 0, 0), (2, 8, 8))


@register("flt_mask_count", with_views("select count(*) as n from vol where v >= 128", "vol"))
def _mask_count(s, d):
    return vol(s, d).where("v >= 128").agg(F.count("*").alias("n"))


@register("flt_patch_empty", with_views("select z, y // 4 as py, x // 4 as px, max(v) as top from vol group by 1, 2, 3 having max(v) > 240", "vol"))
def _patch_empty(s, d):
    g = vol(s, d).groupBy("z", F.floor(F.col("y") / 4).alias("py"), F.floor(F.col("x") / 4).alias("px"))
    return g.agg(F.max("v").alias("top")).where("top > 240")


for _op, _sql in (("max", "greatest(a.v, b.v)"), ("add", "least(255, a.v + b.v)"), ("mask", "case when b.v = 0 then 0 else a.v end")):
    register(f"jn_merge_{_op}", with_views(f"select a.z, a.y, a.x, case when b.v is null then a.v else {_sql} end as v from vol a left join (select * from vol2 where v % 3 <> 0) b on a.z = b.z and a.y = b.y and a.x = b.x", "vol", "vol2"))(
        lambda s, d, op=_op: V.merge_left(vol(s, d), vol2(s, d).where("v % 3 <> 0"), op)
    )
for _op, _sql in (("max", "greatest(a.v, b.v)"), ("min", "least(a.v, b.v)"), ("add", "least(255, a.v + b.v)"), ("mean", "(a.v + b.v) // 2")):
    register(f"jn_merge_py_{_op}", with_views(f"select a.z, a.y, a.x, {_sql} as v from vol a join vol2 b on a.z = b.z and a.y = b.y and a.x = b.x", "vol", "vol2"))(
        lambda s, d, op=_op: V.merge_inner(vol(s, d), vol2(s, d), op)
    )

_DOWN = "select z // 2 as z, y // 2 as y, x // 2 as x, cast(sum(v) // 8 as bigint) as v from {t} group by 1, 2, 3 having count(*) = 8"


@register("ag_downsample", with_views(_DOWN.format(t="vol"), "vol"))
def _downsample(s, d):
    return V.downsample(vol(s, d))


@register("ag_scale", with_views("select z // 3 as z, y // 3 as y, x // 3 as x, round(sum(v) / 27e0, 9) as v from vol group by 1, 2, 3", "vol"))
def _scale(s, d):
    return V.scale(vol(s, d), 3).withColumn("v", F.round("v", 9))


_PYRAMID = f"with l1 as ({_DOWN.format(t='vol')}), l2 as ({_DOWN.format(t='l1')}), pyr as (select 0 as level, * from vol union all select 1, * from l1 union all select 2, * from l2)"


@register("ag_pyramid", with_views(_PYRAMID + " select * from pyr", "vol"))
def _pyramid(s, d):
    return V.pyramid(vol(s, d), 3)


@register("ag_any_pyramid", with_views("with m as (select z, y, x from vol where v >= 200) select distinct l as level, z >> l as z, y >> l as y, x >> l as x from m, (values (0), (1), (2)) t(l)", "vol"))
def _any_pyramid(s, d):
    return V.any_pyramid(vol(s, d).where("v >= 200"), 3)


_STATS = "count(v) as n, min(v) as lo, max(v) as hi, round(avg(v), 9) as mean, round(coalesce(stddev_samp(v), 0), 6) as std"


def _rounded(df):
    return df.withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 6))


@register("ag_stats", with_views(f"select {_STATS} from vol", "vol"))
def _stats(s, d):
    return _rounded(V.stats(vol(s, d)))


_BINS = "least(255, greatest(0, cast(floor(case when hi > lo then (v - lo) / (hi - lo) * 255e0 else 0e0 end) as int)))"


@register("ag_hist256", with_views(f"with r as (select cast(min(v) as double) as lo, cast(max(v) as double) as hi from vol) select lo, hi, {_BINS} as bin, count(*) as n from vol, r group by 1, 2, 3", "vol"))
def _hist256(s, d):
    return V.hist256(vol(s, d))


@register(
    "wn_cumhist",
    with_views(
        f"with r as (select cast(min(v) as double) as lo, cast(max(v) as double) as hi from vol), h as (select lo, hi, {_BINS} as bin, count(*) as n from vol, r group by 1, 2, 3), c as (select *, sum(n) over (order by bin) as cum, sum(n) over () as total from h) select p, round(lo + (min(bin) + 5e-1) / 256e0 * (hi - lo), 9) as value from c, (values (1), (5), (25), (50), (75), (95), (99)) t(p) where cum >= total * p / 100e0 group by p, lo, hi",
        "vol",
    ),
)
def _cumhist(s, d):
    return V.hist256_percentiles(V.hist256(vol(s, d)), [1, 5, 25, 50, 75, 95, 99]).withColumn("value", F.round("value", 9))


@register(
    "pyramid_stats",
    with_views(
        _PYRAMID + f""", w as (select level, cast(floor(greatest(0e0, least(255e0, (v - 28e0) * 255e0 / 200e0))) as int) as v from pyr),
s as (select level, {_STATS} from w group by level),
r as (select level, cast(min(v) as double) as lo, cast(max(v) as double) as hi from w group by level),
h as (select w.level, r.lo, r.hi, {_BINS} as bin, count(*) as n from w join r on r.level = w.level group by 1, 2, 3, 4),
c as (select *, sum(n) over (partition by level order by bin) as cum, sum(n) over (partition by level) as total from h),
p as (select level, round(lo + (min(bin) + 5e-1) / 256e0 * (hi - lo), 9) as median from c where cum >= total * 50 / 100e0 group by level, lo, hi)
select s.*, median from s join p on p.level = s.level""",
        "vol",
    ),
)
def _pyramid_stats(s, d):
    """Flagship: windowed pyramid, statistics and median from the 256-bin histogram per level."""
    w = V.pyramid(vol(s, d), 3).select("level", V.window_level(F.col("v"), 200.0, 128.0).alias("v"))
    p = V.hist256_percentiles(V.hist256(w, "level"), [50], "level").select("level", F.round("value", 9).alias("median"))
    return _rounded(V.stats(w, "level")).join(p, "level")


_HIST = "with r as (select cast(min(v) as double) as lo, (max(v) - min(v)) / 64e0 as width from volf), h as (select cast(least(63, floor((v - lo) / width)) as int) as bin, lo, width, count(*) as n from volf, r group by 1, 2, 3)"


@register("ag_hist", with_views(_HIST + " select bin, round(lo, 9) as lo, round(width, 9) as width, n from h", "volf"))
def _hist(s, d):
    return V.histogram(vol_float(s, d), 64).select("bin", F.round("lo", 9).alias("lo"), F.round("width", 9).alias("width"), "n")


@register("ag_hist_percentile", with_views(_HIST + ", c as (select *, sum(n) over (order by bin) as cum, sum(n) over () as total from h) select round(lo + (bin + 1) * width, 9) as value from c where cum >= total * 9e-1 order by bin limit 1", "volf"))
def _hist_percentile(s, d):
    return V.histogram_percentile(V.histogram(vol_float(s, d), 64), 0.9).select(F.round("value", 9).alias("value"))


@register("ag_hist_mean", with_views(_HIST + " select round(sum((lo + (bin + 5e-1) * width) * n) / sum(n), 9) as mean from h", "volf"))
def _hist_mean(s, d):
    h = V.histogram(vol_float(s, d), 64)
    return h.agg(F.round(F.sum((F.col("lo") + (F.col("bin") + 0.5) * F.col("width")) * F.col("n")) / F.sum("n"), 9).alias("mean"))


@register("ag_percentile_exact", with_views("select min(v) as lo, max(v) as hi, round(avg(v), 9) as mean, round(stddev_pop(v), 9) as std, quantile_cont(v, 0.05) as p5, quantile_cont(v, 0.5) as p50, quantile_cont(v, 0.95) as p95 from vol", "vol"))
def _percentiles(s, d):
    return V.percentiles(vol(s, d), [0.05, 0.5, 0.95]).withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 9))


for _mode, _sql in (("max", "max(v)"), ("min", "min(v)"), ("mean", "avg(v)"), ("sum", "sum(v)"), ("beer", "exp(-1e-2 * sum(v))")):
    register(f"ag_composite_{_mode}", with_views(f"select y, x, round(cast({_sql} as double), 9) as c from vol group by 1, 2", "vol"))(
        lambda s, d, m=_mode: V.composite(vol(s, d), m).withColumn("c", F.round("c", 9))
    )


@register(
    "ag_composite_alpha",
    with_views(
        """with recursive n as (select y, x, v / 255e0 as v, row_number() over (partition by y, x order by z) as i from vol),
a as (select y, x, 0 as i, 0e0 as c, 0e0 as a from n where i = 1
union all select n.y, n.x, n.i, case when a.a >= 1 then a.c else a.c + (1e0 - a.a) * n.v * n.v end, case when a.a >= 1 then a.a else a.a + (1e0 - a.a) * n.v end from a join n on n.y = a.y and n.x = a.x and n.i = a.i + 1)
select y, x, round(max_by(c, i), 9) as c from a group by 1, 2""",
        "vol",
    ),
)
def _alpha(s, d):
    return V.composite(vol(s, d), "alpha").withColumn("c", F.round("c", 9))




def _taps(key, group=None, value="round(sum(w * coalesce(v, 0)), 6)"):
    """SQL of the eight-tap sampler over points p (fz, fy, fx)."""
    group = group or key
    part = lambda c: f"(case d{c} when 1 then f{c} - trunc(f{c}) else 1e0 - (f{c} - trunc(f{c})) end)"
    at = ", ".join(f"cast(trunc(f{c}) as bigint) + d{c} as t{c}" for c in "zyx")
    return f"""t as (select {key}, {at}, {part("z")} * {part("y")} * {part("x")} as w from p, (values (0), (1)) a(dz), (values (0), (1)) b(dy), (values (0), (1)) c(dx))
select {group}, {value} as value from t left join vol on vol.z = tz and vol.y = ty and vol.x = tx group by {group}"""


@register("jn_slice_quad", with_views("with p as (select row, col, z - 5e-1 as fz, y / 4 - 5e-1 as fy, x / 3 - 5e-1 as fx from surf), " + _taps("row, col", value="round(sum(w * coalesce(v, 0)) + 123e-10, 6)"), "vol", "surf"))
def _slice_quad(s, d):
    p = surface(s, d).select("row", "col", F.col("z").alias("pz"), (F.col("y") / 4).alias("py"), (F.col("x") / 3).alias("px"))
    return V.sample(p, vol(s, d), ["row", "col"]).withColumn("value", F.round(F.col("value") + 123e-10, 6))


@register("jn_sample", with_views("with p as (select z, y, x, z + 25e-2 as fz, y + 5e-1 as fy, x + 75e-2 as fx from vol), " + _taps("p.z, p.y, p.x", "t.z, t.y, t.x"), "vol"))
def _sample(s, d):
    p = vol(s, d).select(*ZYX, (F.col("z") + 0.75).alias("pz"), (F.col("y") + 1.0).alias("py"), (F.col("x") + 1.25).alias("px"))
    return V.sample(p, vol(s, d), ZYX).withColumn("value", F.round("value", 6))


@register("jn_slice_plane", with_views("with g as (select k % 12 as i, k // 12 as j from range(96) t(k)), p as (select i, j, 3e0 + (i - 55e-1) * 0e0 + (j - 35e-1) * 25e-2 - 5e-1 as fz, 8e0 + (i - 55e-1) * 25e-2 + (j - 35e-1) * 1e0 - 5e-1 as fy, 8e0 + (i - 55e-1) * 1e0 + (j - 35e-1) * 0e0 - 5e-1 as fx from g), " + _taps("i, j"), "vol"))
def _slice_plane(s, d):
    g = V.plane_grid(s, 12, 8, (8.0, 8.0, 3.0), (1.0, 0.25, 0.0), (0.0, 1.0, 0.25))
    return V.sample(g, vol(s, d), ["i", "j"]).withColumn("value", F.round("value", 6))


@register("map_trilinear", with_views("with p as (select z, y, x, z + 25e-2 as fz, y + 5e-1 as fy, x + 75e-2 as fx from vol), " + _taps("p.z, p.y, p.x", "t.z, t.y, t.x"), "vol"))
def _trilinear(s, d):
    p = vol(s, d).select(*ZYX, (F.col("z") + 0.25).alias("pz"), (F.col("y") + 0.5).alias("py"), (F.col("x") + 0.75).alias("px"))
    return V.sample(p, vol(s, d), ZYX, "corner").withColumn("value", F.round("value", 6))


@register(
    "ag_composite_normal",
    with_views(
        "with o as (select cast(k as double) as k from range(-2, 3) t(k)), p as (select row, col, k, 3e0 + k - 5e-1 as fz, y / 4 - 5e-1 as fy, x / 3 - 5e-1 as fx from surf, o), s as (with "
        + _taps("row, col, k", value="sum(w * coalesce(v, 0))")
        + ") select row, col, round(max(value), 6) as top, round(avg(value), 6) as mean from s group by 1, 2",
        "vol",
        "surf",
    ),
)
def _composite_normal(s, d):
    p = surface(s, d).withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in range(-2, 3)]))).select("row", "col", "k", (3.0 + F.col("k")).alias("pz"), (F.col("y") / 4).alias("py"), (F.col("x") / 3).alias("px"))
    got = V.sample(p, vol(s, d), ["row", "col", "k"])
    return got.groupBy("row", "col").agg(F.round(F.max("value"), 6).alias("top"), F.round(F.avg("value"), 6).alias("mean"))


@register(
    "jn_lod_best",
    with_views(
        _PYRAMID + """, have as (select * from pyr where not (level = 0 and v % 2 = 1)), want as (select 0 as level, z, y, x from vol where x % 3 = 0),
j as (select w.level, w.z, w.y, w.x, h.v, h.level as lv from want w join have h on h.z = w.z >> h.level and h.y = w.y >> h.level and h.x = w.x >> h.level)
select level, z, y, x, arg_min(v, lv) as v, min(lv) as found from j group by 1, 2, 3, 4""",
        "vol",
    ),
)
def _lod(s, d):
    have = V.pyramid(vol(s, d), 3).where("not (level = 0 and v % 2 = 1)")
    return V.lod_best(vol(s, d).where("x % 3 = 0").select(F.lit(0).alias("level"), *ZYX), have)


_NEAR = "(values (-1,0,0),(1,0,0),(0,-1,0),(0,1,0),(0,0,-1),(0,0,1)) o(dz,dy,dx)"


@register("jn_neighbour", with_views(f"select a.z, a.y, a.x, count(*) as near, sum(b.v) as total from vol a, {_NEAR} join vol b on b.z = a.z + dz and b.y = a.y + dy and b.x = a.x + dx group by 1, 2, 3", "vol"))
def _neighbour(s, d):
    j = V.neighbours6(vol(s, d).select(*ZYX)).join(vol(s, d).select(*[F.col(c).alias(f"n{c}") for c in ZYX], "v"), ["nz", "ny", "nx"])
    return j.groupBy(*ZYX).agg(F.count("*").alias("near"), F.sum("v").alias("total"))


_BOUNDARY = "select distinct m.z, m.y, m.x from {t} m, " + _NEAR + " where not exists (select 1 from {t} b where b.z = m.z + dz and b.y = m.y + dy and b.x = m.x + dx)"


@register("jn_boundary", with_views("with m as (select z, y, x from vol where v >= 100) " + _BOUNDARY.format(t="m"), "vol"))
def _boundary(s, d):
    return V.boundary(vol(s, d).where("v >= 100"))


@register(
    "jn_hausdorff",
    with_views(
        f"with m as (select z, y, x from vol where v >= 200), n as (select z, y, x from vol2 where v >= 200), a as ({_BOUNDARY.format(t='m')}), b as ({_BOUNDARY.format(t='n')}), j as (select a.z as az, a.y as ay, a.x as ax, b.z as bz, b.y as by_, b.x as bx, sqrt(pow(a.z - b.z, 2) + pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) as dist from a, b) select round(greatest((select max(m) from (select min(dist) as m from j group by az, ay, ax)), (select max(m) from (select min(dist) as m from j group by bz, by_, bx))), 6) as hausdorff",
        "vol",
        "vol2",
    ),
)
def _hausdorff(s, d):
    from lamina.operators.spatial import hausdorff

    return hausdorff(V.boundary(vol(s, d).where("v >= 200")), V.boundary(vol2(s, d).where("v >= 200"))).select(F.round("hausdorff", 6).alias("hausdorff"))


@register("ag_dice", with_views("with p as (select z, y, x from vol where v >= 100), q as (select z, y, x from vol2 where v >= 100), n as (select (select count(*) from p) as a, (select count(*) from q) as b, (select count(*) from p join q on p.z = q.z and p.y = q.y and p.x = q.x) as k) select round(2e0 * k / (a + b), 9) as dice, round(k / cast(a + b - k as double), 9) as iou from n", "vol", "vol2"))
def _dice(s, d):
    r = V.overlap_scores(vol(s, d).where("v >= 100"), vol2(s, d).where("v >= 100"))
    return r.select(F.round("dice", 9).alias("dice"), F.round("iou", 9).alias("iou"))


@register("ag_error", with_views("with e as (select cast(max(abs(a.v - b.v)) as double) as max_err, avg(pow(a.v - b.v, 2)) as mse, cast(max(abs(a.v)) as double) as peak from vol a join vol2 b on a.z = b.z and a.y = b.y and a.x = b.x) select max_err, round(mse, 6) as mse, round(10 * log10(peak * peak / mse), 6) as psnr from e", "vol", "vol2"))
def _error(s, d):
    return V.error_metrics(vol(s, d), vol2(s, d)).select("max_err", F.round("mse", 6).alias("mse"), F.round("psnr", 6).alias("psnr"))


@register("wn_zero_cross", with_views("with w as (select z, y, x, v - 100 as s, coalesce(lead(v - 100) over (partition by y, x order by z), v - 100) as n from vol) select z, y, x from w where s * n < 0", "vol"))
def _zero_cross(s, d):
    w = Window.partitionBy("y", "x").orderBy("z")
    e = vol(s, d).withColumn("s", F.col("v") - 100)
    return e.withColumn("n", F.coalesce(F.lead("s").over(w), F.col("s"))).where("s * n < 0").select(*ZYX)


@register("wn_gradient", with_views("with w as (select z, y, x, lag(v) over p as a, lead(v) over p as b, v from vol window p as (partition by z, y order by x)) select z, y, x, case when a is null then b - v when b is null then v - a else (b - a) / 2e0 end as g from w", "vol"))
def _gradient(s, d):
    w = Window.partitionBy("z", "y").orderBy("x")
    e = vol(s, d).withColumn("a", F.lag("v").over(w)).withColumn("b", F.lead("v").over(w))
    g = F.when(F.col("a").isNull(), F.col("b") - F.col("v")).when(F.col("b").isNull(), F.col("v") - F.col("a")).otherwise((F.col("b") - F.col("a")) / 2.0)
    return e.select(*ZYX, g.cast("double").alias("g"))


@register("wn_prefix", with_views("with h as (select v, count(*) as n from vol group by v) select v, n, coalesce(sum(n) over (order by v rows between unbounded preceding and 1 preceding), 0) as before from h", "vol"))
def _prefix(s, d):
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return vol(s, d).groupBy("v").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


@register("so_argmax", with_views("select (z * 16 + y) * 16 + x as flat, v from vol order by v desc, flat limit 1", "vol"))
def _argmax(s, d):
    return vol(s, d).select(((F.col("z") * 16 + F.col("y")) * 16 + F.col("x")).alias("flat"), "v").orderBy(F.desc("v"), "flat").limit(1)


for _name, _spark, _sql in (
    ("st_mask_and", lambda a, b: a.intersect(b), "intersect"),
    ("st_mask_or", lambda a, b: a.union(b).distinct(), "union"),
    ("st_except", lambda a, b: a.exceptAll(b), "except all"),
):
    register(_name, with_views(f"select z, y, x from vol where v >= 100 {_sql} select z, y, x from vol2 where v >= 100", "vol", "vol2"))(
        lambda s, d, f=_spark: f(vol(s, d).where("v >= 100").select(*ZYX), vol2(s, d).where("v >= 100").select(*ZYX))
    )


@register("st_union", with_views("select z, y, x from vol where v >= 250 union all select z, y, x from vol2 where v >= 250", "vol", "vol2"))
def _union(s, d):
    return vol(s, d).where("v >= 250").select(*ZYX).unionByName(vol2(s, d).where("v >= 250").select(*ZYX))


@register("jn_mirror_missing", with_views("select distinct z, y // 4 as cy, x // 4 as cx from vol except select distinct z, y // 4, x // 4 from vol2 where v > 200", "vol", "vol2"))
def _missing(s, d):
    c = lambda t: t.select("z", F.floor(F.col("y") / 4).alias("cy"), F.floor(F.col("x") / 4).alias("cx")).distinct()
    return c(vol(s, d)).join(c(vol2(s, d).where("v > 200")), ["z", "cy", "cx"], "left_anti")


@register(
    "ip_diffusion_discrete",
    with_views(
        "with f0 as (select z, y, x, cast(v as double) as v, v >= 200 as fixed from vol), "
        + ", ".join(f"n{i} as (select a.z, a.y, a.x, avg(b.v) as m from f{i} a, {_NEAR} join f{i} b on b.z = a.z + dz and b.y = a.y + dy and b.x = a.x + dx group by 1, 2, 3), f{i + 1} as (select f.z, f.y, f.x, case when fixed then f.v else coalesce(m, f.v) end as v, fixed from f{i} f left join n{i} n on n.z = f.z and n.y = f.y and n.x = f.x)" for i in range(2))
        + " select z, y, x, round(v, 6) as v from f2",
        "vol",
    ),
)
def _diffusion(s, d):
    f = vol(s, d).select(*ZYX, F.col("v").cast("double").alias("v"), (F.col("v") >= 200).alias("fixed"))
    return V.diffuse(f, 2).select(*ZYX, F.round("v", 6).alias("v"))


@register("ml_infer_blend", with_views("with t as (select z, ty * 4 as ty, tx * 4 as tx from (select distinct z from vol), range(0, 3) a(ty), range(0, 3) b(tx)), p as (select v.z, v.y, v.x, v.v * 1e0 as p, least(least(v.y - ty + 1, 8 - (v.y - ty)), least(v.x - tx + 1, 8 - (v.x - tx))) as w from vol v join t on t.z = v.z and v.y >= ty and v.y < ty + 8 and v.x >= tx and v.x < tx + 8) select z, y, x, round(sum(p * w) / greatest(sum(w), 1e-6), 6) as v from p group by 1, 2, 3", "vol"))
def _blend(s, d):
    from lamina.operators.patches import blend_tiles

    return blend_tiles(vol(s, d), 8, 4, 16).withColumn("v", F.round("v", 6))
