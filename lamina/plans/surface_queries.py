"""Queries over the derived surface, points and meshes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.catalog import register
from lamina.operators import blocks as B
from lamina.operators import spatial as P
from lamina.operators import surface as S
from lamina.plans.views import edges, surface, table, vol, vol2, with_views

_DIFF = ", ".join(f"coalesce(lead({k}) over {w}, {k}) - coalesce(lag({k}) over {w}, {k}) as {p}{k}" for p, w in (("c", "a"), ("r", "d")) for k in "xyz")
_NORMALS = f"""t as (select row, col, x, y, z, {_DIFF} from surf window a as (partition by row order by col), d as (partition by col order by row)),
m as (select *, cy * rz - cz * ry as ux, cz * rx - cx * rz as uy, cx * ry - cy * rx as uz from t),
n as (select row, col, x, y, z, {", ".join(f"case when l > 0 then u{k} / l else {1 if k == 'z' else 0}e0 end as n{k}" for k in "xyz")} from (select *, sqrt(ux * ux + uy * uy + uz * uz) as l from m))"""


def _r(df, n=6):
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("wn_normals", with_views(f"with {_NORMALS} select row, col, round(nx, 6) + 0e0 as nx, round(ny, 6) + 0e0 as ny, round(nz, 6) + 0e0 as nz from n", "surf"))
def _normals(s, d):
    return S.normals(surface(s, d)).select("row", "col", *[(F.round(f"n{k}", 6) + 0.0).alias(f"n{k}") for k in "xyz"])


_QUADS = "q as (select a.row, a.col, " + ", ".join(f"{p}.{k} as {p}_{k}" for p in "abcd" for k in "xyz") + " from surf a join surf b on b.row = a.row and b.col = a.col + 1 join surf c on c.row = a.row + 1 and c.col = a.col join surf d on d.row = a.row + 1 and d.col = a.col + 1)"


def _tri(p, q, r):
    u, v = ([f"({t}_{k} - {p}_{k})" for k in "xyz"] for t in (q, r))
    return "5e-1 * sqrt(" + " + ".join(f"pow({u[i]} * {v[j]} - {u[j]} * {v[i]}, 2)" for i, j in ((1, 2), (2, 0), (0, 1))) + ")"


@register("ag_surface_area", with_views(f"with {_QUADS} select round(sum({_tri('a', 'b', 'c')} + {_tri('b', 'd', 'c')}), 6) as area from q", "surf"))
def _area(s, d):
    return _r(S.area(surface(s, d)))


_LAP = ", ".join(f"(lag({k}) over a + lead({k}) over a + lag({k}) over d + lead({k}) over d) / 4 - {k} as d{k}" for k in "xyz")


@register("ag_surface_metrics", with_views(f"with {_NORMALS}, l as (select {_LAP} from surf window a as (partition by row order by col), d as (partition by col order by row)), g as (select acos(greatest(-1e0, least(1e0, nx * lead(nx) over a + ny * lead(ny) over a + nz * lead(nz) over a))) as p, acos(greatest(-1e0, least(1e0, nx * lead(nx) over d + ny * lead(ny) over d + nz * lead(nz) over d))) as q from n window a as (partition by row order by col), d as (partition by col order by row)), h as (select p as a from g where p is not null union all select q from g where q is not null) select round((select sqrt(avg(dx * dx + dy * dy + dz * dz)) from l where dx is not null and dy is not null and dz is not null), 6) as rms, round((select avg(a) from h), 6) as curvature", "surf"))
def _metrics(s, d):
    return _r(S.smoothness(surface(s, d)).join(S.curvature(surface(s, d))))


@register("jn_surface_diff", with_views("with e as (select sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) as d from surf a join surf2 b on a.row = b.row and a.col = b.col) select round(min(d), 6) as lo, round(max(d), 6) as hi, round(avg(d), 6) as mean, round(sqrt(avg(d * d)), 6) as rms from e", "surf", "surf2"))
def _diff(s, d):
    return _r(S.diff(surface(s, d), surface(s, d, True)))


_M = [[0.0, -1.0, 0.0, 3.0], [1.0, 0.0, 0.0, 2.0], [0.0, 0.0, 2.0, -1.0]]


@register("map_transform", with_views("select row, col, round(-y + 3, 6) as x, round(x + 2, 6) as y, round(2 * z - 1, 6) as z from surf", "surf"))
def _transform(s, d):
    return _r(S.transform(surface(s, d), _M)).select("row", "col", "x", "y", "z")


@register("ag_bbox", with_views("select " + ", ".join(f"round(min({k}), 6) as lo_{k}, round(max({k}), 6) as hi_{k}, round(avg({k}), 6) as mean_{k}" for k in "xyz") + " from surf", "surf"))
def _bounds(s, d):
    return _r(S.bounds(surface(s, d)))


@register("map_quat", with_views("select row, col, round(8e-1 * 8e-1 * x - 6e-1 * 6e-1 * x - 2 * 8e-1 * 6e-1 * y, 6) as x, round(2 * 8e-1 * 6e-1 * x + (8e-1 * 8e-1 - 6e-1 * 6e-1) * y, 6) as y, round(z, 6) as z from surf", "surf"))
def _quat(s, d):
    return _r(S.transform(surface(s, d), S.quat_rotate((0.8, 0.0, 0.0, 0.6)))).select("row", "col", "x", "y", "z")


@register("map_plane", with_views("select row, col, round(((x - 20) * 1 + (y - 25) * 2 + (z - 3) * 2) / 3e0, 6) as dist from surf", "surf"))
def _plane(s, d):
    return surface(s, d).select("row", "col", F.round(S.plane_distance((20.0, 25.0, 3.0), (1.0, 2.0, 2.0)), 6).alias("dist"))


@register("map_vec", with_views("select row, col, round(sqrt(x * x + y * y + z * z), 6) as len, round(x * 1 + y * 2 + z * 3, 6) as dot, round(x + 25e-2 * (1 - x), 6) as lerp_x, round(y * 3 - z * 2, 6) as cross_x from surf", "surf"))
def _vec(s, d):
    v, w = [F.col(k) for k in "xyz"], [F.lit(1.0), F.lit(2.0), F.lit(3.0)]
    return surface(s, d).select("row", "col", F.round(S.length(v), 6).alias("len"), F.round(S.dot(v, w), 6).alias("dot"), F.round(v[0] + 0.25 * (w[0] - v[0]), 6).alias("lerp_x"), F.round(S.cross(v, w)[0], 6).alias("cross_x"))


@register("map_camera", with_views("select row, col, cast(greatest(0, least(5, floor(log2(1e0 / greatest(1 / 32e0, least(4e0, (row + 1) / 50e0)))))) as int) as level from surf", "surf"))
def _camera(s, d):
    return surface(s, d).select("row", "col", S.camera_level((F.col("row") + 1) / 50.0, 6).alias("level"))


def _moved(expr):
    return f"with {_NORMALS}, w as (select *, pow(row - 20, 2) + pow(col - 15, 2) as d2 from n) select row, col, " + ", ".join(f"round({expr.format(k=k)}, 6) as {k}" for k in "xyz") + " from w"


@register("sf_brush", with_views(_moved("{k} + n{k} * (case when d2 <= 36 then 15e-1 * exp(-d2 / 18e0) else 0e0 end)"), "surf"))
def _brush(s, d):
    return _r(S.brush(surface(s, d), 20, 15, 6.0, 1.5))


@register("sf_pushpull", with_views(_moved("case when d2 <= 36 then {k} + n{k} * 75e-2 else {k} end"), "surf"))
def _push(s, d):
    return _r(S.push_pull(surface(s, d), 20, 15, 6.0, 0.75))


@register("sf_approval", with_views("select row, col, case when pow(row - 12, 2) + pow(col - 8, 2) <= 9 then 2 when pow(row - 10, 2) + pow(col - 10, 2) <= 25 then 1 else 0 end as state from surf", "surf"))
def _approval(s, d):
    g = surface(s, d).select("row", "col")
    paint = lambda r, c, rad, state, seq: g.where((F.col("row") - r) ** 2 + (F.col("col") - c) ** 2 <= rad * rad).select("row", "col", F.lit(state).alias("state"), F.lit(seq).alias("seq"))
    last = paint(10, 10, 5, 1, 1).unionByName(paint(12, 8, 3, 2, 2)).groupBy("row", "col").agg(F.max_by("state", "seq").alias("state"))
    return g.join(last, ["row", "col"], "left").select("row", "col", F.coalesce("state", F.lit(0)).alias("state"))


@register("sf_bilinear", with_views(f"with {_QUADS}, p as (select p_partkey as qid, least(1e0, greatest(0e0, p_size / 50e0)) * 39 as fc, least(1e0, greatest(0e0, (p_retailprice - floor(p_retailprice)))) * (select max(row) from surf) as fr from part), r as (select *, least(floor(fr), (select max(row) - 1 from surf)) as r0, least(floor(fc), 38) as c0 from p) select qid, " + ", ".join(f"round((1 - (fr - r0)) * ((1 - (fc - c0)) * a_{k} + (fc - c0) * b_{k}) + (fr - r0) * ((1 - (fc - c0)) * c_{k} + (fc - c0) * d_{k}), 6) as {k}" for k in "xyz") + " from r join q on q.row = r0 and q.col = c0", "surf"))
def _bilinear(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("qid"), (F.col("p_size") / 50.0).alias("u"), (F.col("p_retailprice") - F.floor("p_retailprice")).alias("v"))
    g = surface(s, d)
    return _r(S.bilinear(g, p, g.agg(F.max("row")).first()[0] + 1, 40))


_LINE = "line as (select user_id as id, event_id as seq, cast(event_id % 17 as double) as x, cast(event_id % 5 as double) as y, cast(event_id % 3 as double) as z from events)"


def _line(s, d):
    m = lambda n: (F.col("event_id") % n).cast("double")
    return table(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), m(17).alias("x"), m(5).alias("y"), m(3).alias("z"))


_STEPS = "st as (select *, coalesce(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2) + pow(z - lag(z) over w, 2)), 0) as s, " + ", ".join(f"coalesce(lag({k}) over w, {k}) as p{k}" for k in "xyz") + " from line window w as (partition by id order by seq))"


@register("ag_arclength", f"with {_LINE}, {_STEPS} select id, round(sum(s), 6) as length from st group by 1")
def _arc(s, d):
    return _r(S.arc_length(_line(s, d), "id", "seq"))


@register("wn_arc_sample", f"with {_LINE}, {_STEPS}, c as (select *, sum(s) over (partition by id order by seq) as cum, sum(s) over (partition by id) * 37e-2 as need from st), h as (select * from c where cum >= need qualify row_number() over (partition by id order by seq) = 1) select id, " + ", ".join(f"round(p{k} + (case when s > 0 then 1 - (cum - need) / s else 1 end) * ({k} - p{k}), 5) as {k}" for k in "xyz") + " from h")
def _arc_sample(s, d):
    return _r(S.arc_sample(_line(s, d), "id", "seq", 0.37), 5)


_POINTS = "p as (select s_suppkey as qid, cast(s_suppkey % 40 as double) + 3e-1 as qx, cast(s_suppkey % 50 as double) + 4e-1 as qy, 3e0 as qz from supplier), t as (select row * 40 + col as tid, x as tx, y as ty, z as tz from surf)"


def _points(s, d):
    m = lambda n: (F.col("s_suppkey") % n).cast("double")
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("qid"), (m(40) + 0.3).alias("qx"), (m(50) + 0.4).alias("qy"), F.lit(3.0).alias("qz"))


def _targets(s, d):
    return surface(s, d).select((F.col("row") * 40 + F.col("col")).alias("tid"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))


_DIST = "sqrt((qx - tx) * (qx - tx) + (qy - ty) * (qy - ty) + (qz - tz) * (qz - tz))"


@register("jn_radius", with_views(f"with {_POINTS} select qid, tid, round({_DIST}, 6) as dist from p, t where {_DIST} <= 25e-1", "surf"))
def _radius(s, d):
    return _r(P.within(_points(s, d), _targets(s, d), 2.5).select("qid", "tid", "dist"))


@register("jn_nearest", with_views(f"with {_POINTS}, j as (select qid, tid, {_DIST} as dist from p, t) select qid, tid, round(dist, 6) as dist from j qualify row_number() over (partition by qid order by dist, tid) = 1", "surf"))
def _nearest(s, d):
    return _r(P.nearest(_points(s, d), _targets(s, d), 1.0))


@register("flt_overlap", with_views(f"with {_POINTS} select qid from p where not exists (select 1 from t where {_DIST} < 1)", "surf"))
def _overlap(s, d):
    near = P.within(_points(s, d), _targets(s, d), 1.0).where("dist < 1").select("qid")
    return _points(s, d).join(near, "qid", "left_anti").select("qid")


@register("jn_mask_surface", with_views("select distinct cast(z as bigint) as z, cast(y as bigint) as y, cast(x as bigint) as x from (select vz as z, vy as y, vx as x from surf s, range(0, 8) a(vz), range(0, (select max(row) + 1 from surf)) b(vy), range(0, 40) c(vx) where pow(s.x - vx, 2) + pow(s.y - vy, 2) + pow(s.z - vz, 2) <= 4)", "surf"))
def _mask(s, d):
    p = surface(s, d)
    return P.mark_ball(p, 2, (8, p.agg(F.max("row")).first()[0] + 1, 40))


_BOXES = "b as (select s_suppkey as id, cast(s_suppkey % 7 * 3 as double) as x0, cast(s_suppkey % 7 * 3 + 4 as double) as x1, cast(s_suppkey % 5 * 3 as double) as y0, cast(s_suppkey % 5 * 3 + 4 as double) as y1, cast(s_suppkey % 3 * 5 as double) as z0, cast(s_suppkey % 3 * 5 + 4 as double) as z1 from supplier)"


@register("jn_bbox_overlap", f"with {_BOXES} select a.id as a, b.id as b, round((least(a.x1, b.x1) - greatest(a.x0, b.x0) + 2) * (least(a.y1, b.y1) - greatest(a.y0, b.y0) + 2) * (least(a.z1, b.z1) - greatest(a.z0, b.z0) + 2) / 216e0, 6) as score from b a join b on a.id < b.id and least(a.x1, b.x1) - greatest(a.x0, b.x0) + 2 >= 0 and least(a.y1, b.y1) - greatest(a.y0, b.y0) + 2 >= 0 and least(a.z1, b.z1) - greatest(a.z0, b.z0) + 2 >= 0")
def _boxes(s, d):
    lo = lambda n, k: (F.col("s_suppkey") % n * k).cast("double")
    b = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), lo(7, 3).alias("x0"), (lo(7, 3) + 4).alias("x1"), lo(5, 3).alias("y0"), (lo(5, 3) + 4).alias("y1"), lo(3, 5).alias("z0"), (lo(3, 5) + 4).alias("z1"))
    return _r(P.bbox_overlaps(b))


_CTRL = "c as (select distinct on (p_size) cast(p_size as double) as z, cast(p_partkey as double) as x, p_retailprice as y from part where p_size % 6 = 1 order by p_size, p_partkey), i as (select *, lead(z) over (order by z) as nz, lead(x) over (order by z) as nx, lead(y) over (order by z) as ny, row_number() over (order by z) as i from c)"


def _control(s, d):
    c = table(s, d, "part").where("p_size % 6 = 1").groupBy(F.col("p_size").cast("double").alias("z")).agg(F.min(F.struct("p_partkey", "p_retailprice")).alias("p"))
    return c.select("z", F.col("p.p_partkey").cast("double").alias("x"), F.col("p.p_retailprice").alias("y"))


_ASOF = f"{_CTRL}, q as (select s_suppkey as qid, s_suppkey * 7e-1 - 3 as z from supplier), a as (select qid, q.z, case when nz is null or q.z <= i.z then 0e0 else (q.z - i.z) / (nz - i.z) end as t, i.x, i.y, coalesce(nx, i.x) as nx, coalesce(ny, i.y) as ny from q join i on (q.z >= i.z or i.i = 1) and (q.z < nz or nz is null))"


def _asof(s, d):
    q = table(s, d, "supplier").select(F.col("s_suppkey").alias("qid"), (F.col("s_suppkey") * 0.7 - 3).alias("z"))
    return P.asof_interpolate(q, _control(s, d))


@register("jn_asof_umbilicus", f"with {_ASOF} select qid, round(z, 6) as z, round(x + t * (nx - x), 5) as cx, round(y + t * (ny - y), 5) as cy from a")
def _umbilicus(s, d):
    return _asof(s, d).select("qid", F.round("z", 6).alias("z"), F.round("cx", 5).alias("cx"), F.round("cy", 5).alias("cy"))


@register("jn_umbilicus_dist", f"with {_ASOF}, e as (select qid, qid * 1e0 - (x + t * (nx - x)) as dx, 1e3 - (y + t * (ny - y)) as dy from a) select qid, round(sqrt(dx * dx + dy * dy), 5) as dist, round(case when atan2(dy, dx) < 0 then degrees(atan2(dy, dx)) + 360 else degrees(atan2(dy, dx)) end, 5) as angle from e")
def _umbilicus_dist(s, d):
    dx, dy = F.col("qid") * 1.0 - F.col("cx"), 1000.0 - F.col("cy")
    a = F.degrees(F.atan2(dy, dx))
    return _asof(s, d).select("qid", F.round(F.sqrt(dx * dx + dy * dy), 5).alias("dist"), F.round(F.when(a < 0, a + 360).otherwise(a), 5).alias("angle"))


@register("jn_hit_test", f"with {_LINE}, g as (select id, x, y, coalesce(lead(x) over w, x) as nx, coalesce(lead(y) over w, y) as ny from line window w as (partition by id order by seq)), t as (select *, (nx - x) as dx, (ny - y) as dy from g), u as (select *, case when dx * dx + dy * dy > 0 then greatest(0e0, least(1e0, ((34e-1 - x) * dx + (22e-1 - y) * dy) / (dx * dx + dy * dy))) else 0e0 end as t from t), e as (select id, min(sqrt(pow(x + t * dx - 34e-1, 2) + pow(y + t * dy - 22e-1, 2))) as dist from u group by 1) select id, round(dist, 6) as dist from e where dist < 5e-1 order by e.dist, id limit 1")
def _hit(s, d):
    return _r(S.hit_test(_line(s, d), 3.4, 2.2, 0.5))


@register("flt_coverage", with_views("select round(coalesce(avg(case when v.v is not null and v.v <> 0 then 1e0 else 0e0 end), 1e0), 9) as coverage from surf s left join vol v on v.z = cast(round_even(s.z, 0) as bigint) and v.y = cast(round_even(s.y / 4, 0) as bigint) and v.x = cast(round_even(s.x / 3, 0) as bigint)", "surf", "vol"))
def _covered(s, d):
    p = surface(s, d).select(F.bround("z").cast("long").alias("z"), F.bround(F.col("y") / 4).cast("long").alias("y"), F.bround(F.col("x") / 3).cast("long").alias("x"))
    j = p.join(vol(s, d), ["z", "y", "x"], "left")
    return j.agg(F.round(F.coalesce(F.avg(F.when(F.coalesce("v", F.lit(0)) != 0, 1.0).otherwise(0.0)), F.lit(1.0)), 9).alias("coverage"))


@register("flt_validity", with_views("select row, col, x >= 5 and x <= 30 and y >= 10 and y <= 40 as valid from surf", "surf"))
def _valid(s, d):
    return surface(s, d).select("row", "col", (F.col("x").between(5, 30) & F.col("y").between(10, 40)).alias("valid"))


@register("sf_patch", with_views("select s.row, s.col, k, coalesce(v.v, 0) as v from surf s, range(-1, 2) t(k) left join vol v on v.z = least((select max(z) from vol), greatest(0, cast(floor(s.z) as bigint) + k)) and v.y = s.row and v.x = s.col", "surf", "vol"))
def _patch(s, d):
    v = vol(s, d)
    p = surface(s, d).withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])))
    p = p.select("row", "col", "k", F.least(F.lit(B.shape_of(v)[0] - 1).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor("z") + F.col("k"))).alias("z"), F.col("row").alias("y"), F.col("col").alias("x"))
    return p.join(v, ["z", "y", "x"], "left").select("row", "col", "k", F.coalesce("v", F.lit(0)).alias("v"))


@register("ag_sparse_dup", with_views("select src, dst, round(sum(weight), 6) as v from (select * from edges union all select * from edges) group by 1, 2", "edges"))
def _sparse(s, d):
    e = edges(s, d)
    return e.unionByName(e).groupBy("src", "dst").agg(F.round(F.sum("weight"), 6).alias("v"))


@register("jn_cc_overlap", with_views("with p as (select z, count(*) as n from vol where v >= 150 group by 1), q as (select z, count(*) as n from vol2 where v >= 150 group by 1) select count(*) filter (p.z is not null and q.z is not null) as tp, count(*) filter (q.z is null) as fp, count(*) filter (p.z is null) as fn from p full join q on p.z = q.z", "vol", "vol2"))
def _cc_overlap(s, d):
    a, b = (t.where("v >= 150").select("z").distinct().withColumn(n, F.lit(1)) for t, n in ((vol(s, d), "p"), (vol2(s, d), "q")))
    j = a.join(b, "z", "full")
    return j.agg(F.count_if(F.col("p").isNotNull() & F.col("q").isNotNull()).alias("tp"), F.count_if(F.col("q").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


@register("ag_instances", with_views("with g as (select v % 20 as label, count(*) as n, avg(z) as cz, avg(y) as cy, avg(x) as cx, min(z) as z0, max(z) as z1 from vol group by 1 having count(*) >= 85) select row_number() over (order by label) as id, label, n, round(cz, 6) as cz, round(cy, 6) as cy, round(cx, 6) as cx, z0, z1 from g", "vol"))
def _instances(s, d):
    g = vol(s, d).groupBy((F.col("v") % 20).alias("label")).agg(F.count("*").alias("n"), *[F.round(F.avg(k), 6).alias(f"c{k}") for k in "zyx"], F.min("z").alias("z0"), F.max("z").alias("z1")).where("n >= 85")
    return g.withColumn("id", F.row_number().over(Window.orderBy("label")))


@register("ag_euler", with_views("with m as (select y, x, case when v >= 100 then 1 else 0 end as m from vol where z = 0), e as (select a.m as a, coalesce(b.m, 0) as b, coalesce(c.m, 0) as c, coalesce(d.m, 0) as d from m a left join m b on b.y = a.y and b.x = a.x + 1 left join m c on c.y = a.y + 1 and c.x = a.x left join m d on d.y = a.y + 1 and d.x = a.x + 1) select cast(sum(a) as bigint) as v, cast(sum(a * b) + sum(a * c) as bigint) as e, cast(sum(a * b * c * d) as bigint) as f from e", "vol"))
def _euler(s, d):
    m = vol(s, d).where("z = 0").select("y", "x", (F.col("v") >= 100).cast("int").alias("m"))
    at = lambda dy, dx, n: m.select((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("m").alias(n))
    j = at(0, 0, "a").join(at(0, 1, "b"), ["y", "x"], "left").join(at(1, 0, "c"), ["y", "x"], "left").join(at(1, 1, "d"), ["y", "x"], "left").fillna(0)
    return j.agg(F.sum("a").alias("v"), (F.sum(F.col("a") * F.col("b")) + F.sum(F.col("a") * F.col("c"))).alias("e"), F.sum(F.col("a") * F.col("b") * F.col("c") * F.col("d")).alias("f"))
