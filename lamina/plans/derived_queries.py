"""Queries over meshes, volumes' shapes, trees and systems that are derived from the tables row by row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lamina.catalog import register
from lamina.functions import topology as T
from lamina.operators import graph as G
from lamina.operators import mesh as X
from lamina.operators import meshing as M
from lamina.operators import patches
from lamina.operators import spatial as P
from lamina.operators import surface as S
from lamina.plans.views import box, collab, edges, surface, table, vol, with_views
from lamina.sources import images, scratch, sinks
from lamina.streaming import server as V

_WIDTH = 40


def _rounded(df, digits=6):
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _faces_sql(surf, name):
    """CTE ``name`` of the faces of a grid surface (fid, i0, i1, i2, ax .. cz; names a_x .. c_z)."""
    at = {"a": "", "b": " + 1", "c": f" + {_WIDTH}", "d": f" + {_WIDTH + 1}"}
    corner = lambda p, q: ", ".join(f"{q}.{k} as {p}_{k}" for k in "xyz")
    half = lambda n, *c: f"select (a.row * {_WIDTH} + a.col) * 2 + {n} as fid, {', '.join(f'a.row * {_WIDTH} + a.col{at[q]} as i{i}' for i, q in enumerate(c))}, {', '.join(corner(p, q) for p, q in zip('abc', c, strict=True))} from q_{name} join {surf} a on a.row = r and a.col = c join {surf} b on b.row = r and b.col = c + 1 join {surf} c on c.row = r + 1 and c.col = q_{name}.c join {surf} d on d.row = r + 1 and d.col = q_{name}.c + 1"
    return f"q_{name} as (select row as r, col as c from {surf}), {name} as ({half(0, 'a', 'b', 'c')} union all {half(1, 'b', 'd', 'c')})"


def _faces(s, d):
    return X.grid_faces(surface(s, d), _WIDTH)


# --- meshes


@register("ag_mesh_quality", with_views(f"with {_faces_sql('surf', 'mesh')}, e as (select *, " + ", ".join(f"sqrt(pow({p}_x - {q}_x, 2) + pow({p}_y - {q}_y, 2) + pow({p}_z - {q}_z, 2)) as {p}{q}" for p, q in ("ab", "bc", "ca")) + " from mesh), t as (select unnest([degrees(acos((ab * ab + ca * ca - bc * bc) / (2 * ab * ca))), degrees(acos((ab * ab + bc * bc - ca * ca) / (2 * ab * bc))), degrees(acos((bc * bc + ca * ca - ab * ab) / (2 * bc * ca)))]) as a, greatest(ab, bc, ca) / least(ab, bc, ca) as aspect from e) select round(min(a), 5) as lo, round(max(a), 5) as hi, round(avg(a), 5) as mean, round(max(aspect), 5) as aspect from t", "surf"))
def _quality(s, d):
    return _rounded(S.mesh_quality(_faces(s, d)), 5)


_STEP = "select v.vid, " + ", ".join(f"v.{k} + 5e-1 * (coalesce(m.{k}, v.{k}) - v.{k}) as {k}" for k in "xyz") + " from {0} v left join (select e.vid, avg(w.x) as x, avg(w.y) as y, avg(w.z) as z from e join {0} w on w.vid = e.t group by 1) m on m.vid = v.vid"


@register("sf_smooth", with_views(f"with {_faces_sql('surf', 'mesh')}, e as (" + " union all ".join(f"select i{p} as vid, i{q} as t from mesh" for p in range(3) for q in range(3) if p != q) + f"), v0 as (select row * {_WIDTH} + col as vid, x, y, z from surf), v1 as ({_STEP.format('v0')}), v2 as ({_STEP.format('v1')}) select vid, round(x + 123e-10, 6) as x, round(y + 123e-10, 6) as y, round(z + 123e-10, 6) as z from v2", "surf"))
def _smooth(s, d):
    """Two smoothing steps of the surface's mesh."""
    v = S.smooth_mesh(X.grid_vertices(surface(s, d), _WIDTH), _faces(s, d), 0.5, 2)
    return v.select("vid", *[F.round(F.col(c) + 123e-10, 6).alias(c) for c in "xyz"])


def _crossing_sql():
    """Pairs by boxes, then the test in steps: normals, distances to the other's plane, positions on the planes' line, intervals."""
    sub = lambda p, q: [f"({p}{c} - {q}{c})" for c in "xyz"]
    cross = lambda u, v: [f"({u[i]} * {v[j]} - {u[j]} * {v[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]
    dot = lambda u, v: "(" + " + ".join(f"{p} * {q}" for p, q in zip(u, v, strict=True)) + ")"
    column = lambda p: [f"{p}{c}" for c in "xyz"]
    steps = [[(f"{t}_m{c}", e) for t in "ab" for c, e in zip("xyz", cross(sub(f"{t}_b", f"{t}_a"), sub(f"{t}_c", f"{t}_a")), strict=True)]]
    steps.append([(f"{t}_n{c}", f"{t}_m{c} / sqrt({dot(column(f'{t}_m'), column(f'{t}_m'))})") for t in "ab" for c in "xyz"])
    steps.append([(f"d{t}{k}", dot(sub(f"{t}_{v}", f"{o}_a"), column(f"{o}_n"))) for t, o in ("ab", "ba") for k, v in enumerate("abc")] + [(f"l{c}", e) for c, e in zip("xyz", cross(column("a_n"), column("b_n")), strict=True)])
    steps.append([(f"p{t}{k}", dot(column("l"), column(f"{t}_{v}"))) for t in "ab" for k, v in enumerate("abc")])
    end = lambda t, i, j: f"p{t}{i} + (p{t}{j} - p{t}{i}) * d{t}{i} / nullif(d{t}{i} - d{t}{j}, 0)"
    alone = lambda t, i: f"d{t}{i} * d{t}{(i + 1) % 3} <= 0 and d{t}{i} * d{t}{(i + 2) % 3} <= 0"
    steps.append([(f"t{t}{n}", f"case when {alone(t, 0)} then {end(t, 0, n)} when {alone(t, 1)} then {end(t, 1, (1 + n) % 3)} else {end(t, 2, (2 + n) % 3)} end") for t in "ab" for n in (1, 2)])
    chain = "".join(f", s{i + 1} as (select *, {', '.join(f'{e} as {n}' for n, e in step)} from s{i})" for i, step in enumerate(steps))
    names = [f"{p}_{k}" for p in "abc" for k in "xyz"]
    cols = ", ".join(f"{t}.{n} as {t}_{n.replace('_', '')}" for t in "ab" for n in names)
    ids = ", ".join(f"{t}.i{k} as {t}_i{k}" for t in "ab" for k in range(3))
    meets = " and ".join(f"greatest(a.a_{k}, a.b_{k}, a.c_{k}) >= least(b.a_{k}, b.b_{k}, b.c_{k}) and greatest(b.a_{k}, b.b_{k}, b.c_{k}) >= least(a.a_{k}, a.b_{k}, a.c_{k})" for k in "xyz")
    mesh = f"sheet as (select row, col, x + 3e-1 as x, y + 2e-1 as y, 33e-1 as z from surf), {_faces_sql('surf', 'one')}, {_faces_sql('sheet', 'two')}, mesh as (select * from one union all select fid + 10000000, i0 + 10000000, i1 + 10000000, i2 + 10000000, {', '.join(names)} from two)"
    shared = " or ".join(f"a_i{p} = b_i{q}" for p in range(3) for q in range(3))
    sides = " and ".join(f"not (d{t}0 * d{t}1 > 0 and d{t}0 * d{t}2 > 0)" for t in "ab")
    return f"with {mesh}, s0 as (select a.fid as a, b.fid as b, {ids}, {cols} from mesh a join mesh b on a.fid < b.fid and {meets}){chain} select a, b from s{len(steps)} where not ({shared}) and {sides} and not (abs(db0) < 1e-6 and abs(db1) < 1e-6 and abs(db2) < 1e-6) and greatest(ta1, ta2) > least(tb1, tb2) + 1e-6 and greatest(tb1, tb2) > least(ta1, ta2) + 1e-6"


@register("jn_self_intersect", with_views(_crossing_sql(), "surf"))
def _crossings(s, d):
    """Crossing faces of the surface and a flat sheet in one mesh."""
    far = F.lit(10_000_000).cast("long")
    sheet = surface(s, d).withColumns({"x": F.col("x") + 0.3, "y": F.col("y") + 0.2, "z": F.lit(3.3)})
    two = X.grid_faces(sheet, _WIDTH).withColumns({c: F.col(c) + far for c in ("fid", "i0", "i1", "i2")})
    return X.self_intersections(_faces(s, d).unionByName(two))


@register("src_obj", with_views(f"with {_faces_sql('surf', 'mesh')} select (fid // 2 // {_WIDTH}) // 4 as part, count(*) as faces, count(distinct i0) as firsts, round(sum(a_z), 4) as z from mesh group by 1", "surf"))
def _obj(s, d):
    """Meshes of four rows of cells as OBJ files, written by the executors and read back."""
    path = scratch.fresh(s, "mesh")

    part = F.floor(F.floor(F.floor(F.col("fid") / 2) / _WIDTH) / 4)
    sinks.write_meshes(_faces(s, d).withColumn("part", part), path, F.col("part"))
    got = images.obj_faces(s, path)
    return got.select(F.regexp_extract("path", r"(\d+)\.obj$", 1).cast("long").alias("part"), "i0", "az").groupBy("part").agg(F.count("*").alias("faces"), F.countDistinct("i0").alias("firsts"), F.round(F.sum("az"), 4).alias("z"))


_SOLID = "p as (select p_partkey as qid, p_partkey % 8 + 5e-1 as qx, p_partkey // 8 % 8 + 5e-1 as qy, p_size % 8 + 5e-1 as qz from part)"


def _points(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select(k.alias("qid"), (k % 8 + 0.5).alias("qx"), (F.floor(k / 8) % 8 + 0.5).alias("qy"), (F.col("p_size") % 8 + 0.5).alias("qz"))


def _angle_sql():
    a, b, c = ([f"({p}_{k} - q{k})" for k in "xyz"] for p in "abc")
    dot = lambda u, v: "(" + " + ".join(f"{x} * {y}" for x, y in zip(u, v, strict=True)) + ")"
    det = f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {a[1]} * ({b[0]} * {c[2]} - {b[2]} * {c[0]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"
    la, lb, lc = (f"sqrt({dot(u, u)})" for u in (a, b, c))
    return f"2 * atan2({det}, {la} * {lb} * {lc} + {dot(a, b)} * {lc} + {dot(b, c)} * {la} + {dot(c, a)} * {lb})"


@register("jn_winding_mesh", with_views(f"with {_SOLID} select qid, abs(round(sum({_angle_sql()}) / (4 * pi()), 5)) as winding from p, box group by 1", "box"))
def _winding(s, d):
    """Winding numbers of the parts' points about the twelve faces of a box."""
    return P.winding(_points(s, d), box(s)).select("qid", F.abs(F.round("winding", 5)).alias("winding"))


@register("jn_voxelize", f"with {_SOLID} select qid, qx > 2 and qx < 5 and qy > 2 and qy < 5 and qz > 2 and qz < 5 as inside from p")
def _voxelize(s, d):
    return P.voxelize(_points(s, d), box(s))


# --- flattening and simplification, every patch of the surface


def _rounds_sql(angles, out):
    """Rounds of angle scaling until no sum was off by 1e-4, 50 at most."""
    clamp = lambda e: f"greatest(1e-5, least(pi() - 1e-5, {e}))"
    face = f"select * replace ({clamp('angle + (pi() - s) * angle / s')} as angle), abs(pi() - s) as off from (select *, sum(angle) over (partition by fid) as s from {out} where i < 50 and worst >= 1e-4)"
    return f"""{out} as (select 0 as i, vid, fid, k, angle, inner_, 1e0 as worst from {angles} union all
select i + 1, vid, fid, k, case when inner_ then {clamp('angle * (2 * pi() / t)')} else angle end, inner_, max(greatest(off, case when inner_ then abs(t - 2 * pi()) else 0e0 end)) over () from (select *, sum(angle) over (partition by vid) as t from ({face})))"""


def _corner_sql(p, q, r):
    u, v = ([f"({x}_{k} - {p}_{k})" for k in "xyz"] for x in (q, r))
    dot = lambda a, b: " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True))
    return f"acos(greatest(-1e0, least(1e0, ({dot(u, v)}) / (sqrt({dot(u, u)}) * sqrt({dot(v, v)})))))"


@register(
    "sf_flatten_abf",
    with_views(
        f"with recursive {_faces_sql('surf', 'mesh')}, c as ("
        + " union all ".join(f"select fid, {k} as k, i{k} as vid, i{(k + 1) % 3} as p, i{(k + 2) % 3} as q, {_corner_sql(*('abc'[(k + j) % 3] for j in range(3)))} as angle from mesh" for k in range(3))
        + "), n as (select vid, count(distinct fid) as f from c group by 1), m as (select vid, count(distinct t) as t from (select vid, p as t from c union all select vid, q from c) group by 1), a0 as (select c.vid, fid, k, angle, m.t = n.f as inner_ from c join n using (vid) join m using (vid)), "
        + _rounds_sql("a0", "a")
        + " select fid, k, vid, round(angle, 6) as angle from (select *, max(i) over () as n from a) where i = n",
        "surf",
    ),
)
def _abf(s, d):
    """Corner angles over the whole surface, after as many rounds as they need or the reference takes at most."""
    return _rounded(X.flat_angles(_faces(s, d)))


_PATCH = 8


def _patches(s, d):
    return surface(s, d).withColumn("pr", F.floor(F.col("row") / _PATCH)).withColumn("pc", F.floor(F.col("col") / _PATCH))


@register("sf_flatten_lscm")
def _flatten(s, d):
    """Conformal maps of all patches of 8 x 8 points; a flat sheet keeps its shape in tests."""
    return _rounded(X.flatten_patches(_patches(s, d), ["pr", "pc"]))


@register("sf_flatten_abf_uv")
def _unfolded(s, d):
    """The same with the angles of the whole surface flattened first."""
    return _rounded(X.flatten_patches(_patches(s, d), ["pr", "pc"], X.flat_angles(_faces(s, d)), _WIDTH))


@register("sf_simplify")
def _simplify(s, d):
    """Quadric collapse of all patches to 60 faces."""

    def run(pdf):
        pdf = pdf.sort_values(["row", "col"])
        r, c = pdf.row.nunique(), pdf.col.nunique()
        f = M.simplify(pdf[["x", "y", "z"]].to_numpy(), M.triangles(r, c), 60)[1] if r * c == len(pdf) else np.zeros((0, 3), int)
        return pd.DataFrame({"pr": pdf.pr.iloc[0], "pc": pdf.pc.iloc[0], "fid": range(len(f)), "i0": f[:, 0], "i1": f[:, 1], "i2": f[:, 2]})

    return _patches(s, d).groupBy("pr", "pc").applyInPandas(run, "pr long, pc long, fid long, i0 long, i1 long, i2 long")


_INSIDE = f"row % {_PATCH} < {_PATCH - 1} and col % {_PATCH} < {_PATCH - 1}"


@register("snk_obj", with_views(f"with {_faces_sql('surf', 'mesh')}, f as (select fid // 2 // {_WIDTH} as row, fid // 2 % {_WIDTH} as col, i0, i1, i2 from mesh), k as (select row // {_PATCH} * 100 + col // {_PATCH} as part, * from f where {_INSIDE}), c as (select part, count(distinct v) as n from (select part, unnest([i0, i1, i2]) as v from k) group by 1) select part, count(*) as faces, any_value(n) as vertices, any_value(n) as textured from k join c using (part) group by 1", "surf"))
def _textured(s, d):
    """Every patch flattened and written as an OBJ with its map as texture; lines of each kind read back."""
    path, g = scratch.fresh(s, "obj"), _patches(s, d)
    uv = X.flatten_patches(g, ["pr", "pc"]).select((F.col("row") * _WIDTH + F.col("col")).alias("vid"), "u", "v")
    row, col = F.floor(F.floor(F.col("fid") / 2) / _WIDTH), F.floor(F.col("fid") / 2) % _WIDTH
    f = _faces(s, d).where((row % _PATCH < _PATCH - 1) & (col % _PATCH < _PATCH - 1)).withColumn("part", F.floor(row / _PATCH) * 100 + F.floor(col / _PATCH))
    for k, p in enumerate("abc"):
        f = f.join(uv.select(F.col("vid").alias(f"i{k}"), F.col("u").alias(f"{p}u"), F.col("v").alias(f"{p}v")), f"i{k}")
    sinks.write_meshes(f, path, F.col("part"))
    lines = s.read.text(path).select(F.regexp_extract(F.input_file_name(), r"(\d+)\.obj$", 1).cast("long").alias("part"), F.substring_index("value", " ", 1).alias("kind"))
    count = lambda k, n: F.count_if(F.col("kind") == k).alias(n)
    return lines.groupBy("part").agg(count("f", "faces"), count("v", "vertices"), count("vt", "textured"))


# --- shapes of many volumes


@register("ml_patch_grid", "with v as (select s_suppkey as id, s_suppkey % 5 + 2 as sz, s_suppkey % 11 + 4 as sy, s_suppkey % 7 + 9 as sx from supplier) select id, unnest(zs) as z, y, x from (select id, generate_series(0, greatest(sz - 2, 0), 2) as zs, y, unnest(generate_series(0, greatest(sx - 4, 0), 3)) as x from (select *, unnest(generate_series(0, greatest(sy - 4, 0), 4)) as y from v))")
def _patch_grid(s, d):
    k = F.col("s_suppkey")
    v = table(s, d, "supplier").select(k.alias("id"), (k % 5 + 2).alias("sz"), (k % 11 + 4).alias("sy"), (k % 7 + 9).alias("sx"))
    return patches.origins(v, (2, 4, 4), (2, 4, 3))


@register("ml_tiles", "with i as (select p_partkey as id, p_size + 3 as height, p_size % 9 + 20 as width from part), y as (select *, unnest(list_distinct(list_append(generate_series(0, greatest(height - 8, 0), 6), greatest(height - 8, 0)))) as ty from i) select id, ty, unnest(list_distinct(list_append(generate_series(0, greatest(width - 8, 0), 6), greatest(width - 8, 0)))) as tx from y")
def _tiles(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 3).alias("height"), (F.col("p_size") % 9 + 20).alias("width"))
    return patches.tiles(p, 8, 6)


@register("wn_overlap_ranges", "with a as (select p_partkey as id, p_size * 7 as n from part) select id, i, greatest(0, i * 16 - 3) as read_from, least(n, i * 16 + 19) as read_to, i * 16 as write_from, least(n, i * 16 + 16) as write_to from (select *, unnest(generate_series(0, cast(ceil(n / 16e0) as bigint) - 1)) as i from a where n > 0)")
def _ranges(s, d):
    return patches.chunk_ranges(table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 7).alias("n")), 16, 3)


def _plan_sql():
    up = lambda e, half: f"({e} + {half} - 1) // {half}"
    level = " union all ".join(f"select volume_id, {lv} as level, " + ", ".join(f"{c}0 // {1 << lv} as {c}0, least({up(f'{c}1', 1 << lv)}, {up(f'g{c}', 1 << lv)}) as {c}1" for c in "zyx") + " from v" for lv in range(3))
    return f"""with v as (select s_suppkey as volume_id, s_suppkey % 4 + 1 as gz, s_suppkey % 3 + 2 as gy, s_suppkey % 5 + 1 as gx, s_suppkey % 2 as z0, 0 as y0, s_suppkey % 3 as x0, s_suppkey % 4 + 1 as z1, s_suppkey % 3 + 1 as y1, s_suppkey % 5 + 1 as x1 from supplier),
l as ({level}), c as (select volume_id, level, z, y, unnest(generate_series(x0, x1 - 1)) as x from (select *, unnest(generate_series(y0, y1 - 1)) as y from (select *, unnest(generate_series(z0, z1 - 1)) as z from l where z1 > z0 and y1 > y0 and x1 > x0))),
w as (select *, row_number() over o as seq, lead(level) over o as after from c window o as (partition by volume_id order by level desc, z, y, x))
select volume_id, cast(seq as int) as seq, level, z, y, x, after is null or after <> level as is_last from w"""


@register("sm_chunk_stream", _plan_sql())
def _chunks(s, d):
    from lamina.streaming.chunks import chunk_plans

    k = F.col("s_suppkey")
    v = table(s, d, "supplier").select(k.alias("volume_id"), (k % 4 + 1).alias("gz"), (k % 3 + 2).alias("gy"), (k % 5 + 1).alias("gx"), (k % 2).alias("z0"), F.lit(0).alias("y0"), (k % 3).alias("x0"), (k % 4 + 1).alias("z1"), (k % 3 + 1).alias("y1"), (k % 5 + 1).alias("x1"))
    return chunk_plans(v, 3)


@register("ml_schedules", "select event_id, round(5e-1 * 1e-2 * (1 + cos(pi() * i / 100)), 12) as cosine, round(1e-2 * pow(1 - i / 100e0, 9e-1), 12) as poly, round(exp(-5e0 * pow(1 - least(1e0, i / 40e0), 2)), 12) as rampup, round(least(1e0, i / 40e0), 12) as linear from (select event_id, event_id % 100 as i from events)")
def _schedules(s, d):
    """Rates at the step that each event stands for."""
    from lamina.functions.schedules import cosine, linear_ramp, polynomial, sigmoid_ramp

    i = (F.col("event_id") % 100).cast("double")
    r = lambda c: F.round(c, 12)
    return table(s, d, "events").select("event_id", r(cosine(i, 100, 0.01)).alias("cosine"), r(polynomial(i, 100, 0.01, 0.9)).alias("poly"), r(sigmoid_ramp(i, 40)).alias("rampup"), r(linear_ramp(i, 40)).alias("linear"))


_TURN = [[f"{'c' if i == j else '0e0'} + (1 - c) * {u * v / 9!r} {'' if i == j else ('+' if (j - i) % 3 == 2 else '-')} {'' if i == j else f'{n[3 - i - j] / 3!r} * s'}" for j, v in enumerate(n)] for n in [(1.0, 2.0, 2.0)] for i, u in enumerate(n)]


@register("sf_axis_rot", "select event_id, " + ", ".join(f"round({e}, 9) + 0e0 as r{i}{j}" for i, row in enumerate(_TURN) for j, e in enumerate(row)) + " from (select event_id, cos(radians(event_id % 360)) as c, sin(radians(event_id % 360)) as s from events)")
def _axis(s, d):
    """Rotations of a slice plane about its normal, by the angle of each event."""
    m = S.axis_rotation(F.radians(F.col("event_id") % 360), (1.0, 2.0, 2.0))
    return table(s, d, "events").select("event_id", *[(F.round(m[i][j], 9) + 0.0).alias(f"r{i}{j}") for i in range(3) for j in range(3)])


# --- graphs and systems


_TREE = "t as (select p_partkey as id, (p_partkey - 1) // 2 as parent, 360e0 * (p_size % 3 - 1) + p_size as k, p_retailprice as init from part)"


@register("gr_winding", f"with recursive {_TREE}, w as (select id, init as f from t where id = 0 union all select c.id, w.f + c.k + round((c.init - w.f - c.k) / 360e0) * 360e0 from w join t c on c.parent = w.id and c.id > 0) select t.id, round(coalesce(w.f, t.init), 6) as f, w.f is not null as visited from t left join w on w.id = t.id")
def _tree(s, d):
    """Angles along the tree in which part n hangs from part (n - 1) / 2."""
    p = table(s, d, "part")
    n = p.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("init"))
    t = p.where("p_partkey > 0").select(F.floor((F.col("p_partkey") - 1) / 2).alias("src"), F.col("p_partkey").alias("dst"), F.lit(1.0).alias("weight"), (360.0 * (F.col("p_size") % 3 - 1) + F.col("p_size")).alias("k"))
    return _rounded(G.assign_winding(n, t, 0))


_X = "cast(id % 7 as double) - id % 3 / 4e0"


@register("sv_cg", with_views(f"with n as (select src as id from edges union select dst from edges) select id as i, round({_X}, 5) + 0e0 as x from n", "edges"))
def _cg(s, d):
    """(Laplacian + 1) x = b of the supplier graph, b made from a known x."""
    e = edges(s, d)
    both = e.select("src", "dst", "weight").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    diagonal = both.groupBy(F.col("src").alias("i")).agg((F.sum("weight") + 1).alias("v")).select("i", F.col("i").alias("j"), "v")
    a = scratch.cut(both.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("weight")).alias("v")).unionByName(diagonal), "system")
    x = a.select(F.col("i").alias("j")).distinct().withColumn("x", (F.col("j") % 7).cast("double") - F.col("j") % 3 / 4.0)
    b = scratch.cut(a.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v")), "system")
    return _rounded(G.conjugate_gradient(a, b), 5)


@register("sv_lm", "select l_suppkey as g, round(1 + l_suppkey % 5, 4) + 0e0 as a, round((1 + l_suppkey % 4) / 1e1, 4) as b from lineitem group by 1 having count(distinct l_linenumber) >= 3")
def _lm(s, d):
    """An exponential fitted per supplier by damped least squares; its points follow a known one. Suppliers are fitted by batches of rows, all at once."""

    def run(batches):
        for pdf in batches:
            size = pdf.x.str.len().to_numpy()
            there = np.arange(size.max(initial=0)) < size[:, None]
            x, y = np.zeros((2, *there.shape))
            for a, c in ((x, "x"), (y, "y")):
                a[there] = np.concatenate([*pdf[c], []])
            fit = M.levenberg_marquardt_many(lambda p, k: np.where(there[k], p[:, :1] * np.exp(-p[:, 1:] * x[k]) - y[k], 0.0), np.ones((len(pdf), 2)), 200)
            yield pd.DataFrame({"g": pdf.g, "a": np.round(fit[:, 0], 4), "b": np.round(fit[:, 1], 4)})

    parts = int(s.conf.get("spark.sql.shuffle.partitions"))
    p = table(s, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_linenumber").cast("double").alias("x")).where("g is not null").distinct()
    y = (1 + F.col("g") % 5) * F.exp(-(1 + F.col("g") % 4) / 10.0 * F.col("x"))
    # few bytes, much work: as many tasks as there are partitions
    many = p.withColumn("y", y).repartition(parts, "g").groupBy("g").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("p")).where("size(p) >= 3")
    return many.select("g", "p.x", "p.y").mapInPandas(run, "g long, a double, b double")


@register(
    "ip_raster",
    """with r as (select user_id, event_id % 30 as y, event_id % 41 as x, event_id % 4 as n, event_id from events),
p as (select user_id, y + dy as y, x + dx as x from r, range(4) a(dy), range(4) b(dx) where event_id % 2 = 0 and dy <= n and dx <= n
  union select user_id, y + dy, x + dx from r, range(-3, 4) a(dy), range(-3, 4) b(dx) where event_id % 2 = 1 and dy * dy + dx * dx <= n * n)
select user_id, count(*) as drawn from p where y between 0 and 31 and x between 0 and 39 group by 1""",
)
def _raster(s, d):
    """Squares and discs of each user's events on a canvas of their own; drawn pixels."""

    def run(pdf):
        c = T.canvas(32, 40)
        for e in pdf.event_id:
            y, x, n = e % 30, e % 41, e % 4
            if e % 2:
                T.draw_disc(c, y, x, n, (0, 255, 0, 255))
            else:
                for k in range(n + 1):
                    T.draw_line(c, y + k, x, y + k, x + n, (255, 0, 0, 255))
        drawn = int((c[..., 3] > 0).sum())
        return pd.DataFrame({"user_id": [pdf.user_id.iloc[0]] if drawn else [], "drawn": [drawn] if drawn else []})

    return table(s, d, "events").select("user_id", "event_id").groupBy("user_id").applyInPandas(run, "user_id long, drawn long")


# --- messages


_CHUNKS = "k as (select z // 4 as cz, y // 8 as cy, x // 8 as cx from vol group by 1, 2, 3)"


def _messages(s, d):
    """A message per event: requests, updates and pings, some of them bad."""
    e = collab(s, d)
    n = F.col("event_id")
    ask = V.chunk_request(F.when(n % 7 == 0, "vol-9").otherwise("vol-1"), F.lit(0), n % 20, n % 3, n % 2)
    json = lambda *kv: F.concat(F.lit("{"), F.concat_ws(",", *kv), F.lit("}")).cast("binary")
    item = lambda k, v: F.concat(F.lit(f'"{k}":"'), v, F.lit('"'))
    update = json(item("volume_id", F.lit("vol-1")), F.when(n % 5 != 0, item("name", F.concat(F.lit("seg "), n.cast("string")))))
    note = json(F.concat(F.lit('"segment_id":'), (n % 11 - 1).cast("string")), item("type", F.lit("point")))
    kind = F.element_at(F.array(*map(F.lit, (V.CHUNK_REQ, V.SEG_UPDATE, V.ANNOT_UPDATE, V.PING, V.PONG))), F.col("edit_type") + 1)
    payload = F.when(F.col("edit_type") == 0, ask).when(F.col("edit_type") == 1, update).when(F.col("edit_type") == 2, note)
    return e.select(n.alias("seq"), F.col("user_id").cast("int").alias("client"), V.frame(kind, payload).alias("data"))


_REPLY = """select event_id as seq, false as to_all, {kind} as kind, {text} as text from collab where {where}"""


@register(
    "sm_server",
    with_views(
        f"with {_CHUNKS}, q as (select event_id, event_id % 7 = 0 as other, k.cz is not null as found from collab left join k on cz = event_id % 20 and cy = event_id % 3 and cx = event_id % 2 where edit_type = 0), r as (select event_id as seq, false as to_all, case when not other and found then 5 else 12 end as kind, case when other then 'unknown volume' when not found then 'chunk not found' else '256 bytes' end as text from q union all "
        + _REPLY.format(kind="case when event_id % 5 <> 0 then 7 else 12 end", text="case when event_id % 5 <> 0 then '{\"id\":' || event_id || '}' else 'bad seg_update' end", where="edit_type = 1")
        + " union all select event_id, true, 6, '{\"volume_id\":\"vol-1\",\"name\":\"seg ' || event_id || '\"}' from collab where edit_type = 1 and event_id % 5 <> 0 union all "
        + _REPLY.format(kind="case when event_id % 11 > 0 then 9 else 12 end", text="case when event_id % 11 > 0 then '{\"id\":' || event_id || '}' else 'bad annot_update' end", where="edit_type = 2")
        + " union all select event_id, true, 8, '{\"segment_id\":' || (event_id % 11 - 1) || ',\"type\":\"point\"}' from collab where edit_type = 2 and event_id % 11 > 0 union all "
        + _REPLY.format(kind="1", text="''", where="edit_type = 3")
        + ") select seq, to_all, cast(kind as int) as kind, text from r",
        "vol",
        "collab",
    ),
)
def _server(s, d):
    """Replies to a frame per event; chunks by their size."""
    from lamina.operators.blocks import to_chunks

    c = to_chunks(vol(s, d), (4, 8, 8)).select(F.lit("vol-1").alias("volume_id"), F.lit(0).alias("level"), F.col("cz").alias("z"), F.col("cy").alias("y"), F.col("cx").alias("x"), F.substring("data", 1, 256).alias("data"))
    r = V.replies(scratch.cut(_messages(s, d), "messages"), c)
    text = F.when(F.col("kind") == V.CHUNK_RESP, F.concat(F.octet_length("payload").cast("string"), F.lit(" bytes"))).otherwise(F.decode("payload", "UTF-8"))
    return r.select("seq", "to_all", "kind", text.alias("text"))
