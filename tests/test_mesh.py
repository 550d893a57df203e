"""Meshes, flattening, fits, positions and searches against plain loops."""

import numpy as np
import pytest

from lamina.operators import graph as G
from lamina.operators import mesh as X
from lamina.operators import patches
from lamina.operators import spatial as P
from lamina.streaming.chunks import chunk_plan, chunk_plans


def sheet(spark, rows, cols, at, key=""):
    rows_ = [(r, c, *map(float, at(r, c))) for r in range(rows) for c in range(cols)]
    return spark.createDataFrame(rows_, "row long, col long, x double, y double, z double")


def test_pairs_of_boxes_of_all_sizes(spark):
    rng = np.random.default_rng(1)
    lo = rng.uniform(-20, 20, (150, 3))
    hi = lo + np.exp(rng.uniform(-3, 3.5, (150, 1))) * rng.random((150, 3))
    hi[:5] = lo[:5]  # points
    hi[5] = lo[5] + 100
    lo[6], hi[6] = hi[5], hi[5] + 1  # they share a corner
    rows = [(i, *[float(v) for p in zip(a, b) for v in p]) for i, (a, b) in enumerate(zip(lo, hi))]
    got = P.box_pairs(spark.createDataFrame(rows, "id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double"))
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if (lo[i] <= hi[j]).all() and (lo[j] <= hi[i]).all()}
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == want


def meets(p, q):
    """Whether an edge of one triangle passes through the inside of the other."""
    for a, b in ((p, q), (q, p)):
        n = np.cross(b[1] - b[0], b[2] - b[0])
        for i in range(3):
            u, v = a[i], a[(i + 1) % 3]
            s, t = (u - b[0]) @ n, (v - b[0]) @ n
            if s * t < 0:
                x = u + (v - u) * s / (s - t)
                if all(np.cross(b[(k + 1) % 3] - b[k], x - b[k]) @ n > 0 for k in range(3)):
                    return True
    return False


def test_crossing_triangles(spark):
    rng = np.random.default_rng(2)
    t = rng.uniform(0, 1, (120, 3, 3)) + rng.uniform(0, 2, (120, 1, 3))
    rows = [(i, 3 * i, 3 * i + 1, 3 * i + 2, *map(float, t[i].ravel())) for i in range(120)]
    rows += [(500, 0, 1000, 1001, *map(float, t[0].ravel()))]  # shares a vertex with face 0, which it covers
    schema = "fid long, i0 long, i1 long, i2 long, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz")
    got = {tuple(r) for r in X.self_intersections(spark.createDataFrame(rows, schema)).collect()}
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if meets(t[i], t[j])}
    assert {p for p in got if p[1] < 500} == want
    assert len(want) > 50
    assert (0, 500) not in got
    flat = [(k, 3 * k, 3 * k + 1, 3 * k + 2, 0.1 * k, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0) for k in range(3)]
    assert X.self_intersections(spark.createDataFrame(flat, schema)).count() == 0


def test_flat_angles_of_a_bump(spark):
    s = sheet(spark, 6, 7, lambda r, c: (c, r, np.exp(-((r - 2.5) ** 2 + (c - 3) ** 2) / 4)))
    faces = X.grid_faces(s, 7)
    a = X.flat_angles(faces, 200).toPandas()
    assert len(a) == 3 * 60
    assert np.allclose(a.groupby("fid").angle.sum(), np.pi, atol=2e-4)
    around = a.groupby("vid").angle.sum()
    inner = [r * 7 + c for r in range(1, 5) for c in range(1, 6)]
    assert np.allclose(around[inner], 2 * np.pi, atol=2e-4)
    assert (around.drop(inner) < 1.9 * np.pi).all()


@pytest.mark.parametrize("with_angles", [False, True])
def test_a_bent_sheet_unrolls(spark, with_angles):
    # a piece of a cylinder has no curvature of its own
    radius = 2.0
    s = sheet(spark, 8, 10, lambda r, c: (radius * np.sin(0.2 * c), 0.4 * r, radius * np.cos(0.2 * c)))
    angles = X.flat_angles(X.grid_faces(s, 10)) if with_angles else None
    uv = X.flatten_patches(s.selectExpr("1 as patch", "*"), ["patch"], angles, 10).orderBy("row", "col").toPandas()
    chord = 2 * radius * np.sin(0.1)
    ratio = (np.hypot(*uv[["u", "v"]].to_numpy()[9])) / (9 * chord)  # the pins are a straight line apart
    want = np.array([[chord * c * ratio, 0.4 * r * ratio] for r in range(8) for c in range(10)])
    assert np.abs(np.abs(uv[["u", "v"]].to_numpy()) - want).max() < 1e-3


def test_patches_that_are_no_grids_stay_open(spark):
    s = sheet(spark, 3, 3, lambda r, c: (c, r, 0)).where("not (row = 1 and col = 1)").selectExpr("1 as patch", "*")
    got = X.flatten_patches(s, ["patch"]).collect()
    assert len(got) == 8
    assert all(r["u"] is None for r in got)


def test_fits_of_many_batches(spark):
    rng = np.random.default_rng(4)
    c = {k: rng.normal(0, 1, 6) for k in (1, 2)}
    rows = []
    for k in c:
        for x, y in rng.uniform(-300, 500, (400, 2)):
            z = sum(v * y**i * x**j for v, (i, j) in zip(c[k], X.polynomial_terms(2)))
            rows.append((k, float(x), float(y), float(z)))
    rows += [(3, 0.0, 0.0, 1.0)] * 3
    got = X.fit_heights(spark.createDataFrame(rows, "g int, x double, y double, z double").repartition(7), "g", 2).collect()
    assert {r["g"] for r in got} == {1, 2}
    for r in got:
        assert r["c"] == pytest.approx(c[r["g"]][X.polynomial_terms(2).index((r["i"], r["j"]))], abs=1e-6)


def test_positions_match_those_of_one_volume(spark):
    v = spark.createDataFrame([(1, 7, 16, 5), (2, 1, 3, 9)], "id int, sz int, sy int, sx int")
    got = patches.origins(v, (2, 4, 4), (2, 4, 3), (1, 2))
    for i, shape in ((1, (7, 16, 5)), (2, (1, 3, 9))):
        want = {tuple(r) for r in patches.grid(spark, shape, (2, 4, 4), (2, 4, 3), (1, 2)).collect()} if (i == 1) else set()
        assert {(r["z"], r["y"], r["x"]) for r in got.where(f"id = {i}").collect()} == want
    sizes = [(k, k, 3 * k) for k in range(1, 20)]
    t = patches.tiles(spark.createDataFrame(sizes, "id int, height int, width int"), 8, 6).collect()
    for k, h, w in sizes:
        assert {(r["ty"], r["tx"]) for r in t if r["id"] == k} == {(a, b) for a in patches.tile_positions(h, 8, 6) for b in patches.tile_positions(w, 8, 6)}
    r = patches.chunk_ranges(spark.createDataFrame([(1, 33), (2, 0)], "id int, n int"), 16, 3).orderBy("i").collect()
    assert [tuple(x) for x in r] == [(1, 0, 0, 19, 0, 16), (1, 1, 13, 33, 16, 32), (1, 2, 29, 33, 32, 33)]


def test_plans_of_many_volumes_are_those_of_each(spark):
    cases = [(1, (4, 4, 4), (0, 0, 0, 4, 4, 4)), (2, (3, 5, 2), (1, 2, 0, 3, 5, 1)), (3, (1, 1, 1), (0, 0, 0, 0, 1, 1))]
    v = spark.createDataFrame([(i, *g, *r) for i, g, r in cases], "volume_id int, gz int, gy int, gx int, z0 int, y0 int, x0 int, z1 int, y1 int, x1 int")
    got = chunk_plans(v, 3).collect()
    for i, g, region in cases:
        half = lambda t: tuple((k + 1) // 2 for k in t)
        want = {tuple(r) for r in chunk_plan(spark, [g, half(g), half(half(g))], region).collect()}
        assert {tuple(r)[1:] for r in got if r["volume_id"] == i} == want


def test_spiral_matches_a_plain_search(spark):
    rng = np.random.default_rng(6)
    m = rng.random((4, 9, 10)) < 0.75
    m[:, 4, 5] = True
    centre = {z: (4, 5 - z % 2) for z in range(4)}
    w = {(z, *centre[z]): 0 for z in range(4) if m[(z, *centre[z])]}
    front = list(w)
    while front:
        new = {}
        for z, y, x in sorted(front):
            uy, ux = centre[z]
            for d in ((-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)):
                q = (z + d[0], y + d[1], x + d[2])
                if all(0 <= a < n for a, n in zip(q, m.shape)) and m[q] and q not in w and q not in new:
                    cross = (int(x < ux <= q[2]) - int(x >= ux > q[2])) if d[2] and y >= uy else 0
                    new[q] = w[z, y, x] + cross
        w |= new
        front = list(new)
    mask = spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(m)], "z long, y long, x long")
    u = spark.createDataFrame([(z, *c) for z, c in centre.items()], "z long, uy int, ux int")
    assert {(r["z"], r["y"], r["x"]): r["w"] for r in G.spiral(mask, u).collect()} == w
    assert len(set(w.values())) > 1
    assert G.spiral(mask, u, 0).count() == sum(v == 0 and k[1:] == centre[k[0]] for k, v in w.items())


def test_as_of_lookup_between_and_beyond(spark):
    rng = np.random.default_rng(8)
    z = np.concatenate([np.sort(rng.uniform(-50, 50, 30)), [500.0]])
    xy = rng.normal(0, 10, (31, 2))
    control = spark.createDataFrame([(float(a), *map(float, b)) for a, b in zip(z, xy)], "z double, x double, y double").repartition(4)
    at = np.concatenate([rng.uniform(-80, 600, 200), z, [-1e9, 1e9]])
    got = P.asof_interpolate(spark.createDataFrame([(i, float(v)) for i, v in enumerate(at)], "qid int, z double"), control).collect()
    assert len(got) == len(at)
    for r in got:
        assert [r["cx"], r["cy"]] == pytest.approx([np.interp(at[r["qid"]], z, xy[:, k]) for k in (0, 1)])
    one = spark.createDataFrame([(3.0, 1.0, 2.0)], "z double, x double, y double")
    q = spark.createDataFrame([(1, -5.0), (2, 3.0), (3, 9.0)], "qid int, z double")
    assert [(r["cx"], r["cy"]) for r in P.asof_interpolate(q, one).collect()] == [(1.0, 2.0)] * 3
    assert P.asof_interpolate(q, one.limit(0)).count() == 0


def test_large_meshes_are_dealt_into_groups(spark, monkeypatch):
    from lamina.plans.views import box

    rng = np.random.default_rng(9)
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.uniform(0, 7, (80, 3)))], "qid int, qx double, qy double, qz double")
    one = {r["qid"]: (round(r["winding"], 9), r["inside"]) for r in P.winding(p, box(spark)).join(P.voxelize(p, box(spark)), "qid").collect()}
    monkeypatch.setattr(P, "FEW_TRIANGLES", 5)
    monkeypatch.setattr(P, "GROUP_TRIANGLES", 5)
    two = {r["qid"]: (round(r["winding"], 9), r["inside"]) for r in P.winding(p, box(spark)).join(P.voxelize(p, box(spark)), "qid").collect()}
    assert one == two
    assert {v[1] for v in one.values()} == {True, False}


def test_crossings_broadcast_no_mesh(spark):
    """Neither a surface's cells nor its faces are joined by broadcasts, however small the planner takes them for."""
    from contextlib import redirect_stdout
    from io import StringIO

    s = spark.range(600).selectExpr("id div 20 as row", "id % 20 as col", "double(id % 20) as x", "double(id div 20) as y", "double(id * 7 % 5) as z")
    out = StringIO()
    with redirect_stdout(out):
        X.self_intersections(X.grid_faces(s, 20)).explain()
        X.grid_faces(s, 20).explain()
    assert "BroadcastHashJoin" not in out.getvalue()
    assert X.grid_faces(s, 20).count() == 2 * 29 * 19


def plain_angles(corners, faces, rounds):
    """Corner angles of ``faces`` after at most so many rounds, and the number of rounds taken."""
    a = {}
    for f, ids in faces.items():
        for k in range(3):
            p, q, r = (np.array(corners[ids[(k + j) % 3]]) for j in range(3))
            a[f, k] = np.arccos(np.clip((q - p) @ (r - p) / np.linalg.norm(q - p) / np.linalg.norm(r - p), -1, 1))
    at = {}
    for f, ids in faces.items():
        for k, v in enumerate(ids):
            at.setdefault(v, []).append((f, k))
    inner = [v for v, c in at.items() if len(c) == len({w for f, _ in c for w in faces[f] if w != v})]
    for done in range(1, rounds + 1):
        off = 0.0
        for target, groups in ((np.pi, [[(f, k) for k in range(3)] for f in faces]), (2 * np.pi, [at[v] for v in inner])):
            for g in groups:
                s = sum(a[c] for c in g)
                off = max(off, abs(target - s))
                for c in g:
                    a[c] = min(max(a[c] * target / s, 1e-5), np.pi - 1e-5)
        if off < 1e-4:
            break
    return a, done


@pytest.mark.parametrize(("task_rows", "rough", "rounds"), [(250_000, 0.1, 50), (250_000, 2.0, 50), (400, 0.1, 50), (200, 2.0, 50), (10, 2.0, 4)])
def test_flat_angles_in_strips(spark, monkeypatch, task_rows, rough, rounds):
    """One strip, several that take many or few rounds at a time, and a round at a time end with the same angles after the same number of rounds."""
    from lamina.sources import scratch

    rng = np.random.default_rng(11)
    z = rng.random((40, 6)) * rough
    s = sheet(spark, 40, 6, lambda r, c: (c, r, z[r, c])).where("not (row = 20 and col = 2)")
    faces = X.grid_faces(s, 6).cache()
    want, done = plain_angles({r * 6 + c: (c, r, z[r, c]) for r in range(40) for c in range(6)}, {r["fid"]: (r["i0"], r["i1"], r["i2"]) for r in faces.collect()}, rounds)
    assert done == rounds if rough > 1 else 4 < done < rounds
    monkeypatch.setattr(scratch, "TASK_ROWS", task_rows)
    got = {(r["fid"], r["k"]): r["angle"] for r in X.flat_angles(faces, rounds).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[c] - want[c]) for c in want) < 1e-9
