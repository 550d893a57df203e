"""Queries over iso-surfaces, skeletons, traced and flattened surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.catalog import register
from lamina.functions.colours import colour
from lamina.operators import blocks as B
from lamina.operators import isosurface as I
from lamina.operators import rays as R
from lamina.operators import sheets as H
from lamina.operators import surface as S
from lamina.operators import tracing as T
from lamina.plans.views import surface, table, vol, vol2, with_views
from lamina.sources import scratch

_ISO = 127.5
_CASES = ", ".join(f"({i}, {k}, {a}, {b}, {c})" for i in range(256) for k, (a, b, c) in enumerate(I.case(i)))
_EDGES = ", ".join(f"({e}, {', '.join(map(str, I.CORNERS[k]))}, {axis})" for e, (k, axis) in enumerate(I.EDGES))
_MESH = f"""kinds(kind, k, e0, e1, e2) as (values {_CASES}), edge(e, dz, dy, dx, axis) as (values {_EDGES}),
on_edge as (select p.z, p.y, p.x, axis, ((p.z * 16 + p.y) * 16 + p.x) * 3 + axis as vid, (1275e-1 - p.v) / (q.v - p.v) as t
  from vol p, range(3) r(axis) join vol q on q.z = p.z + (axis = 0)::int and q.y = p.y + (axis = 1)::int and q.x = p.x + (axis = 2)::int where (p.v >= 1275e-1) <> (q.v >= 1275e-1)),
cell as (select a.z, a.y, a.x, {' + '.join(f"(c{k}.v >= 1275e-1)::int * {1 << k}" for k in range(8))} as kind from vol a
  {' '.join(f"join vol c{k} on c{k}.z = a.z + {o[0]} and c{k}.y = a.y + {o[1]} and c{k}.x = a.x + {o[2]}" for k, o in enumerate(I.CORNERS))})"""


@register(
    "ip_marching_cubes",
    with_views(
        f"with {_MESH} select cell.z, cell.y, cell.x, kinds.k, "
        + ", ".join(f"{p}.vid as {p}, round({p}.x + case when {p}.axis = 2 then {p}.t else 0 end, 6) as {p}x, round({p}.y + case when {p}.axis = 1 then {p}.t else 0 end, 6) as {p}y, round({p}.z + case when {p}.axis = 0 then {p}.t else 0 end, 6) as {p}z" for p in "abc")
        + " from cell join kinds on kinds.kind = cell.kind "
        + " ".join(f"join edge g{i} on g{i}.e = kinds.e{i} join on_edge {p} on {p}.axis = g{i}.axis and {p}.z = cell.z + g{i}.dz and {p}.y = cell.y + g{i}.dy and {p}.x = cell.x + g{i}.dx" for i, p in enumerate("abc")),
        "vol",
    ),
)
def _iso(s, d):
    t = I.marching_cubes(vol(s, d), _ISO, (8, 8, 8))
    return t.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in t.dtypes])


@register("ip_thinning3d")
def _thin(s, d):
    """Skeleton of the bright voxels; tests hold it against thinning of the whole array."""
    v = vol(s, d)
    return B.thin(v.where("v >= 60"), (8, 8, 8), B.shape_of(v))


# --- tracing: the surface lies in the volume's frame, x a third and y a quarter of the grid's


def _traced(s, d):
    return surface(s, d).select("row", "col", (F.col("x") / 3).alias("x"), (F.col("y") / 4).alias("y"), "z")


def _rounded(df, digits=6):
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_SURF = "s as (select row, col, x / 3 as x, y / 4 as y, z from surf)"


def _normal_sql(cells, grid, name, sign=1):
    """CTE ``name``: ``cells`` (row, col, x, y, z) with nx, ny, nz."""
    sides = {"u": (-1, 0), "d": (1, 0), "l": (0, -1), "r": (0, 1)}
    joins = " ".join(f"left join {grid} {n} on {n}.row = c.row + ({r}) and {n}.col = c.col + ({k})" for n, (r, k) in sides.items())
    a, b = ([f"coalesce({q}.{k}, c.{k}) - coalesce({p}.{k}, c.{k})" for k in "xyz"] for p, q in (("l", "r"), ("u", "d")))
    diffs = ", ".join(f"{v} as {n}{k}" for n, w in (("g", a), ("h", b)) for k, v in zip("xyz", w, strict=True))
    return f"""{name}0 as (select c.*, {diffs} from {cells} c {joins}),
{name}1 as (select *, {sign} * (gy * hz - gz * hy) as mx, {sign} * (gz * hx - gx * hz) as my, {sign} * (gx * hy - gy * hx) as mz from {name}0),
{name} as (select * exclude (gx, gy, gz, hx, hy, hz, mx, my, mz), {", ".join(f"case when sqrt(mx * mx + my * my + mz * mz) > 1e-9 then m{k} / sqrt(mx * mx + my * my + mz * mz) else {1 if k == 'z' else 0}e0 end as n{k}" for k in "xyz")} from {name}1)"""


def _sample_sql(points, key, name, rest=""):
    """CTE ``name``: the key, ``rest`` and the value of ``points`` (x, y, z)."""
    part = lambda k: f"(case d{k} when 1 then f{k} - trunc(f{k}) else 1e0 - (f{k} - trunc(f{k})) end)"
    every = f"{key}{', ' + rest if rest else ''}"
    return f"""{name}0 as (select *, {", ".join(f"{k} - 5e-1 as f{k}" for k in "xyz")} from {points}),
{name}1 as (select {every}, {", ".join(f"cast(trunc(f{k}) as bigint) + d{k} as t{k}" for k in "zyx")}, {part("z")} * {part("y")} * {part("x")} as w from {name}0, (values (0), (1)) a(dz), (values (0), (1)) b(dy), (values (0), (1)) c(dx)),
{name} as (select {every}, sum(w * coalesce(v, 0)) as value from {name}1 left join (select z as vz, y as vy, x as vx, v from vol) on vz = tz and vy = ty and vx = tx group by {every})"""


_ENDS = "e as (select min(row) as r0, max(row) as r1, min(col) as c0, max(col) as c1 from s)"
_GO_ON = ", ".join(f"2 * p.{k} - q.{k} as {k}" for k in "xyz")


@register(
    "sf_grow_cli",
    with_views(
        f"""with {_SURF}, {_ENDS},
rows as (select p.row - 1 as row, p.col, {_GO_ON} from e join s p on p.row = e.r0 join s q on q.row = e.r0 + 1 and q.col = p.col union all select p.row + 1, p.col, {_GO_ON} from e join s p on p.row = e.r1 join s q on q.row = e.r1 - 1 and q.col = p.col),
high as (select row, col, x, y, z from s union all select * from rows),
ring as (select * from rows union all select p.row, p.col - 1, {_GO_ON} from e join high p on p.col = e.c0 join high q on q.col = e.c0 + 1 and q.row = p.row union all select p.row, p.col + 1, {_GO_ON} from e join high p on p.col = e.c1 join high q on q.col = e.c1 - 1 and q.row = p.row),
full_grid as (select row, col, x, y, z from s union all select * from ring),
{_normal_sql('ring', 'full_grid', 'n')},
tries as (select row, col, i, {", ".join(f"{k} + n{k} * t as {k}" for k in "xyz")} from n, (select i, case when i = 0 then 0e0 else i / 4e0 - 25e-1 end as t from range(21) r(i))),
{_sample_sql('tries', 'row, col, i', 'v', 'x, y, z')},
g as (select *, round(abs(value - lag(value) over (partition by row, col order by i)), 9) as change from v),
best as (select row, col, x, y, z from g where i > 0 qualify row_number() over (partition by row, col order by change desc, i) = 1)
select row, col, round(x, 6) + 0e0 as x, round(y, 6) + 0e0 as y, round(z, 6) + 0e0 as z from (select row, col, x, y, z from s union all select * from best)""",
        "surf",
        "vol",
    ),
)
def _grow(s, d):
    """The surface with one ring, snapped to the largest change of the volume."""
    return _rounded(T.grow_rings(_traced(s, d), vol(s, d), 1))


_EDGE = "c as (select s.row, s.col, s.x, s.y, s.z from s, e where row in (r0, r1) or col in (c0, c1))"
_KEPT = ", ".join(f"round(coalesce(b.{k}, s.{k}), 6) + 0e0 as {k}" for k in "xyz")


@register(
    "sf_grow_gui",
    with_views(
        f"""with {_SURF}, {_ENDS}, {_EDGE}, {_normal_sql('c', 's', 'n', -1)},
tries as (select row, col, i, {", ".join(f"{k} + n{k} * (i / 32e0 * 8) as {k}" for k in "xyz")} from n, range(1, 33) r(i)),
{_sample_sql('tries', 'row, col, i', 'v', 'x, y, z')},
b as (select * from v qualify row_number() over (partition by row, col order by round(value, 9) desc, i) = 1)
select s.row, s.col, {_KEPT} from s left join b on s.row = b.row and s.col = b.col""",
        "surf",
        "vol",
    ),
)
def _trace(s, d):
    """The edge moved to the brightest voxels along its normals."""
    return _rounded(T.trace_edge(_traced(s, d), vol(s, d)))


@register(
    "sf_grow_extrapolate",
    with_views(
        f"with {_SURF}, {_ENDS}, b as (select p.row, p.col, {', '.join(f'p.{k} + 15e-1 * (p.{k} - q.{k}) / sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) as {k}' for k in 'xyz')} from e join s p on p.col = e.c1 join s q on q.row = p.row and q.col = p.col - 1) select s.row, s.col, {_KEPT} from s left join b on s.row = b.row and s.col = b.col",
        "surf",
    ),
)
def _extrapolate(s, d):
    return _rounded(T.extrapolate_edge(_traced(s, d), "right", 1.5))


def _corrections(s, d):
    m = lambda n: (F.col("s_suppkey") % n).cast("double")
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("tid"), m(13).alias("tx"), m(16).alias("ty"), m(7).alias("tz"))


@register("sf_grow_correct")
def _correct(s, d):
    """The traced edge drawn halfway to the corrections; tests hold it against plain loops."""
    return _rounded(T.correct_edge(_traced(s, d), vol(s, d), _corrections(s, d), weight=0.5))


@register("sf_grow_advanced")
def _advance(s, d):
    """Every cell moved by value and cost, then drawn to near corrections; tests hold it against plain loops."""
    return _rounded(T.advance(_traced(s, d), vol(s, d), noise=0.05, targets=_corrections(s, d), radius=4.0))


_WAYS = "w(k, dr, dc) as (values (0, -1, 0), (1, 1, 0), (2, 0, -1), (3, 0, 1))"
_FAR = "sqrt(pow(x - sx, 2) + pow(y - sy, 2) + pow(z - sz, 2))"


@register(
    "sf_grow_tracer",
    with_views(
        f"""with {_SURF}, {_WAYS}, {_normal_sql('s', 's', 'n')},
claim as (select n.row + dr as row, n.col + dc as col, k, n.x as sx, n.y as sy, n.z as sz, nx, ny, nz from n, w where not exists (select 1 from s o where o.row = n.row + dr and o.col = n.col + dc)),
one as (select * from claim qualify row_number() over (partition by row, col order by k) = 1),
m as (select o.row, o.col, avg(s.x) as ax, avg(s.y) as ay, avg(s.z) as az from one o, w join s on s.row = o.row + dr and s.col = o.col + dc group by 1, 2),
tries as (select one.*, ax, ay, az, i, {", ".join(f"s{k} + n{k} * (case when i > 16 then 3125e-4 else i * 3125e-4 end) as {k}" for k in "xyz")} from one join m using (row, col), range(1, 18) r(i)),
ok as (select tries.* from tries, (select max(z) + 1 as nz_ from vol) where i > 16 or (x >= 0 and x < 16 and y >= 0 and y < 16 and z >= 0 and z < nz_)),
{_sample_sql('ok', 'row, col, i', 'v', 'x, y, z, sx, sy, sz, nx, ny, nz, ax, ay, az')},
c as (select *, 7e-1 * sqrt(pow(x - ax, 2) + pow(y - ay, 2) + pow(z - az, 2)) + pow({_FAR} - 3125e-4, 2) + 1e-1 * pow(z - az, 2)
  + 4 * greatest(0, -((x - sx) * nx + (y - sy) * ny + (z - sz) * nz) / {_FAR}) - case when i > 16 then 0 else 1e-2 * value end as cost from v),
b as (select * from c qualify row_number() over (partition by row, col order by round(cost, 9), i) = 1)
select row, col, round(x, 6) + 0e0 as x, round(y, 6) + 0e0 as y, round(z, 6) + 0e0 as z, 0 as generation from s
union all select row, col, round(x, 6) + 0e0, round(y, 6) + 0e0, round(z, 6) + 0e0, 1 from b""",
        "surf",
        "vol",
    ),
)
def _tracer(s, d):
    """One generation of candidates by cost, without noise."""
    v = vol(s, d)
    return _rounded(T.grow_patch(_traced(s, d), v, B.shape_of(v), 1, noise=0.0))


@register("sf_grow_patch")
def _patch(s, d):
    """Three generations with noise, past the corrections; tests hold them against plain loops."""
    v = vol(s, d)
    out = _corrections(s, d).select(F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"))
    return _rounded(T.grow_patch(_traced(s, d), v, B.shape_of(v), 3, exclusions=out))


# --- rays, overlays, sheets


def _rays(s, d):
    """A ray per part, from below the volume through its middle."""
    o = [F.col("p_size") % 10 / 10.0 + 0.05, F.col("p_partkey") % 16 / 16.0 + 0.03, F.lit(-0.5)]
    go = [0.5 - v for v in o]
    size = S.length(go)
    return table(s, d, "part").select(F.col("p_partkey").alias("ray"), *[v.alias(f"o{k}") for k, v in zip("xyz", o, strict=True)], *[(g / size).alias(f"d{k}") for k, g in zip("xyz", go, strict=True)])


def _marched(s, d):
    """Samples along the rays that differ, written once, and a function that gives every ray what holds for its way."""
    v = scratch.cut(vol(s, d), "volume")
    ways, of = R.distinct(_rays(s, d))
    m = scratch.cut(R.march(ways, v, B.shape_of(v), 0.08), "samples")
    return m, lambda got: of.join(got.withColumnRenamed("ray", "way"), "way").select(*got.columns)


_GO = ", ".join(f"(5e-1 - o{k}) / sqrt((5e-1 - ox) * (5e-1 - ox) + (5e-1 - oy) * (5e-1 - oy) + (5e-1 - oz) * (5e-1 - oz)) as d{k}" for k in "xyz")
_ENTER = "greatest(0e0, " + ", ".join(f"case when abs(d{k}) < 1e-9 then 0e0 else least((0 - o{k}) / d{k}, (1 - o{k}) / d{k}) end" for k in "xyz") + ")"
_LEAVE = "least(" + ", ".join(f"case when abs(d{k}) < 1e-9 then 'infinity'::double else greatest((0 - o{k}) / d{k}, (1 - o{k}) / d{k}) end" for k in "xyz") + ")"


@register(
    "ip_raycast",
    with_views(
        f"""with o as (select p_partkey as ray, p_size % 10 / 1e1 + 5e-2 as ox, p_partkey % 16 / 16e0 + 3e-2 as oy, -5e-1 as oz from part), r as (select *, {_GO} from o),
h as (select *, {_ENTER} as near, {_LEAVE} as far from r), m as (select max(z) as nz from vol),
k as (select *, unnest(range(0, cast(floor((far - near) / 8e-2) as bigint) + 1)) as k from h where near <= far),
p as (select ray, k, near + k * 8e-2 as t, (ox + dx * (near + k * 8e-2)) * 15 as x, (oy + dy * (near + k * 8e-2)) * 15 as y, (oz + dz * (near + k * 8e-2)) * nz as z from k, m),
{_sample_sql('p', 'ray, k', 'v', 't')},
w as (select ray, k, t, value / 255e0 as value, lag(value / 255e0) over (partition by ray order by k) as prev from v),
c as (select ray, t - 8e-2 * (1 - (6e-1 - prev) / (value - prev + 1e-9)) as t from w where prev >= 0 and (prev < 6e-1) <> (value < 6e-1) qualify row_number() over (partition by ray order by k) = 1)
select ray, round(greatest(0e0, mip), 6) as mip, round(c.t, 6) as crossing from (select ray, max(value) as mip from w group by 1) left join c using (ray)""",
        "vol",
    ),
)
def _cast(s, d):
    """The brightest sample and the first crossing of 0.6 along a ray of every part."""
    m, named = _marched(s, d)
    return named(R.brightest(m).join(R.crossing(m, 0.6, 0.08), "ray", "left").select("ray", F.round("mip", 6).alias("mip"), F.round("t", 6).alias("crossing")))


@register("ip_raycast_transfer")
def _transfer(s, d):
    """Colours and opacity along the same rays; tests hold them against plain loops."""
    m, named = _marched(s, d)
    return named(R.transfer(m, 0.08, name="magma"))


_OVER = ", ".join(f"cast(floor(({e}) * 255e0 + 5e-1) as int) as {n}_{k}" for n, every in (("alpha", ("s{k} * 4e-1 + v / 255e0 * (1 - 4e-1)", "4e-1 + 1e0 * (1 - 4e-1)")), ("additive", ("least(v / 255e0 + s{k} * 4e-1, 1e0)", "least(1e0 + 4e-1, 1e0)")), ("multiply", ("v / 255e0 * (1 - 4e-1 + s{k} * 4e-1)", "1e0"))) for k, e in [*[(k, every[0].format(k=k)) for k in "rgb"], ("a", every[1])])
_HOT = ", ".join(f"cast(floor(greatest(0e0, least(1e0, u * 3 - {i})) * 255e0 + 5e-1) as int) / 255e0 as s{k}" for i, k in enumerate("rgb"))


@register("ip_overlay", with_views(f"with u as (select a.z, a.y, a.x, a.v, greatest(0e0, least(1e0, (b.v - 64) / 128e0)) as u from vol a join vol2 b on a.z = b.z and a.y = b.y and a.x = b.x where b.v >= 80), c as (select *, {_HOT} from u) select z, y, x, {_OVER} from c", "vol", "vol2"))
def _overlay(s, d):
    """The second volume, windowed, coloured and above a threshold, over the first in all blend modes."""
    j = vol(s, d).join(vol2(s, d).withColumnRenamed("v", "w"), ["z", "y", "x"]).where("w >= 80")
    gray, over = F.struct(*[F.col("v").alias(k) for k in "rgb"], F.lit(255).alias("a")), colour((F.col("w") - 64) / 128.0, "hot")
    out = j.select("z", "y", "x", *[R.blend(gray, over, F.lit(0.4), m).alias(m) for m in ("alpha", "additive", "multiply")])
    return out.select("z", "y", "x", *[F.col(f"{m}.{k}").alias(f"{m}_{k}") for m in ("alpha", "additive", "multiply") for k in "rgba"])


@register("ip_detect_surfaces")
def _detect(s, d):
    """Sheets of the whole volume with their sides and normals; tests hold them against whole arrays."""
    v = vol(s, d)
    return _rounded(H.detect(v, B.shape_of(v), (8, 8, 8), window=5))


# --- edits of the surface


_DABS = 23
_LINE = f"w as (select n.*, (select sum(case when d2 <= 4 then exp(-d2 / 2) else 0 end) from (select pow(row - (3 + i / {_DABS}e0 * 9), 2) + pow(col - (5 + i / {_DABS}e0 * 7), 2) as d2 from range({_DABS + 1}) r(i))) as w from n)"


@register("sf_line", with_views(f"with s as (select row, col, x, y, z from surf), {_normal_sql('s', 's', 'n')}, {_LINE} select row, col, " + ", ".join(f"round({k} + n{k} * 5e-1 * w, 6) + 0e0 as {k}" for k in "xyz") + " from w", "surf"))
def _line(s, d):
    """A brush drawn across the surface."""
    return _rounded(H.line(surface(s, d), (3.0, 5.0), (12.0, 12.0), 2.0, 0.5, 1.0))


@register("sf_undo", with_views("select row, col, round(x, 6) + 0e0 as x, round(y, 6) + 0e0 as y, round(z, 6) + 0e0 as z from surf", "surf"))
def _undo(s, d):
    """A line, a brush and a push, undone by their log."""
    g = surface(s, d)
    one = H.line(g, (3.0, 5.0), (12.0, 12.0), 2.0, 0.5)
    two = S.brush(one, 8, 8, 3.0, 1.0)
    three = S.push_pull(two, 9, 10, 2.0, -0.5)
    log = H.record(g, one, 1).unionByName(H.record(one, two, 2)).unionByName(H.record(two, three, 3))
    return _rounded(H.undo(three, log, 1))


@register("sf_eraser", with_views("select row, col, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from surf where pow(row - 20, 2) + pow(col - 15, 2) > 30", "surf"))
def _erase(s, d):
    return _rounded(H.erase(surface(s, d), 20, 15, 30**0.5))
