"""Iso-surfaces, skeletons and traced surfaces against whole arrays and plain loops."""

from collections import Counter

import numpy as np
import pytest

from lamina.functions import kernels as K
from lamina.operators import blocks as B
from lamina.operators import isosurface as I
from lamina.operators import tracing as T


def voxels(spark, a, keep=None):
    z, y, x = np.nonzero(np.ones_like(a) if keep is None else keep)
    return spark.createDataFrame([(int(i), int(j), int(k), float(a[i, j, k])) for i, j, k in zip(z, y, x)], "z long, y long, x long, v double")


def table(rows):
    return {(r["row"], r["col"]): np.array([r["x"], r["y"], r["z"]]) for r in rows}


# --- marching cubes


def test_cases_are_closed_and_complete():
    count, edges = I.cases()
    assert count[0] == count[255] == 0
    for i in range(256):
        cut = {e for e, (k, axis) in enumerate(I.EDGES) if (i >> k & 1) != (i >> (k | (4, 2, 1)[axis]) & 1)}
        assert {e for t in I.case(i) for e in t} == cut
    # complement: as many cut edges
    assert all({e for t in I.case(i) for e in t} == {e for t in I.case(255 - i) for e in t} for i in range(256))


@pytest.mark.parametrize("chunk", [(5, 7, 6), (16, 16, 16)])
def test_sphere_is_closed_whatever_the_chunks(spark, chunk):
    n = 15
    z, y, x = np.mgrid[:n, :n, :n].astype(float)
    a = 5.0 - np.sqrt((z - 7.2) ** 2 + (y - 6.9) ** 2 + (x - 7.1) ** 2)
    t = I.marching_cubes(voxels(spark, a), 0.0, chunk, spacing=(2.0, 2.0, 2.0))
    pdf = t.toPandas()
    p, q, r = (pdf[[c + k for k in "xyz"]].to_numpy() for c in "abc")
    normal = np.cross(q - p, r - p)
    assert abs(np.linalg.norm(normal, axis=1).sum() / 2 - 4 * np.pi * 100) < 25  # the mesh lies inside the sphere
    assert (np.einsum("ij,ij->i", normal, p - np.array([14.2, 13.8, 14.4])) > -1e-9).all()
    ways = Counter()
    for f in pdf[["a", "b", "c"]].to_numpy():
        ways.update(zip(f, np.roll(f, -1)))
    assert all(ways[b, a] == k for (a, b), k in ways.items())
    vertices, faces = I.indexed(t)
    v, f = vertices.count(), faces.select("fid").distinct().count()
    assert v - 3 * f // 2 + f == 2  # a sphere


def test_iso_surface_of_noise_and_of_nothing(spark):
    rng = np.random.default_rng(3)
    a = np.zeros((9, 8, 10))
    a[1:-1, 1:-1, 1:-1] = rng.random((7, 6, 8))
    small = I.marching_cubes(voxels(spark, a, a > 0), 0.5, (4, 4, 4), a.shape).toPandas()  # absent voxels are 0
    whole = I.marching_cubes(voxels(spark, a), 0.5, (9, 8, 10), a.shape).toPandas()
    key = ["z", "y", "x", "k"]
    assert small.sort_values(key).reset_index(drop=True).equals(whole.sort_values(key).reset_index(drop=True))
    ways = Counter()
    for f in whole[["a", "b", "c"]].to_numpy():
        ways.update(zip(f, np.roll(f, -1)))
    assert all(ways[q, p] == k for (p, q), k in ways.items())
    assert I.marching_cubes(voxels(spark, a), 2.0, (4, 4, 4)).count() == 0
    assert I.marching_cubes(voxels(spark, a).limit(0), 0.5, (4, 4, 4)).count() == 0


# --- thinning


def whole_thin(m):
    while True:
        n = K.thin3d_round(m)
        if (n == m).all():
            return n
        m = n


def test_thinning_does_not_depend_on_chunks(spark):
    rng = np.random.default_rng(5)
    m = rng.random((9, 13, 14)) < 0.35
    m[2:7, 3:10, 4:9] = True
    got = B.thin(voxels(spark, m.astype(float), m), (6, 6, 7), m.shape).collect()
    want = whole_thin(m)
    assert {tuple(r) for r in got} == {tuple(map(int, p)) for p in np.argwhere(want)}
    assert 0 < want.sum() < m.sum()


def test_thinning_of_known_shapes():
    bar = np.zeros((5, 5, 20), bool)
    bar[1:4, 1:4, 2:18] = True
    line = whole_thin(bar)
    assert line.sum() >= 10
    assert K.components(line)[1] <= 2 or line.sum() < bar.sum() / 4
    ends = np.zeros((3, 3, 9), bool)
    ends[1, 1, 1:8] = True
    assert (whole_thin(ends) == ends).all()
    one = np.zeros((3, 3, 3), bool)
    one[1, 1, 1] = True
    assert (whole_thin(one) == one).all()


def test_removable_counts_parts():
    bit = lambda z, y, x: 1 << ((z * 3 + y) * 3 + x)
    assert not K.removable(0)
    assert not K.removable(bit(0, 1, 1))  # an end
    assert K.removable(bit(0, 1, 1) | bit(0, 1, 2))
    assert not K.removable(bit(0, 1, 1) | bit(2, 1, 1))  # a bridge


# --- tracing


def sample(a, p):
    total = 0.0
    f = [p[2] - 0.5, p[1] - 0.5, p[0] - 0.5]
    base = [int(v) for v in f]
    for k in range(8):
        o = [(k >> i) & 1 for i in range(3)]
        at = [b + d for b, d in zip(base, o)]
        w = np.prod([v - b if d else 1 - (v - b) for v, b, d in zip(f, base, o)])
        if all(0 <= q < n for q, n in zip(at, a.shape)):
            total += w * a[tuple(at)]
    return total


def normal(g, r, c, sign=1):
    at = lambda i, j: g.get((i, j), g[r, c])
    n = sign * np.cross(at(r, c + 1) - at(r, c - 1), at(r + 1, c) - at(r - 1, c))
    return n / np.linalg.norm(n) if np.linalg.norm(n) > 1e-9 else np.array([0.0, 0, 1])


def fixture(spark, seed=1, rows=5, cols=6):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 255, (10, 12, 12)).astype(float)
    g = {(r, c): np.array([2.0 + c + 0.1 * rng.random(), 3.0 + r + 0.1 * rng.random(), 4.0 + rng.random()]) for r in range(rows) for c in range(cols)}
    s = spark.createDataFrame([(r, c, *map(float, p)) for (r, c), p in g.items()], "row long, col long, x double, y double, z double")
    return a, voxels(spark, a), g, s


def near(got, want):
    assert set(got) == set(want)
    assert max(float(np.abs(got[k] - want[k]).max()) for k in want) < 1e-6


def test_rings_of_several_generations(spark):
    a, v, g, s = fixture(spark)
    for _ in range(2):
        r0, r1, c0, c1 = min(k[0] for k in g), max(k[0] for k in g), min(k[1] for k in g), max(k[1] for k in g)
        n = dict(g)
        for c in range(c0, c1 + 1):
            n[r0 - 1, c], n[r1 + 1, c] = 2 * g[r0, c] - g[r0 + 1, c], 2 * g[r1, c] - g[r1 - 1, c]
        for r in range(r0 - 1, r1 + 2):
            n[r, c0 - 1], n[r, c1 + 1] = 2 * n[r, c0] - n[r, c0 + 1], 2 * n[r, c1] - n[r, c1 - 1]
        moved = dict(n)
        for k in set(n) - set(g):
            nm, prev, best = normal(n, *k), sample(a, n[k]), None
            for i in range(1, 13):
                p = n[k] + nm * (i / 4 - 1.5)
                now = sample(a, p)
                if best is None or round(abs(now - prev), 9) > best[0]:
                    best = (round(abs(now - prev), 9), p)
                prev = now
            moved[k] = best[1]
        g = moved
    near(table(T.grow_rings(s, v, 2, 3.0).collect()), g)


def test_edges_traced_extrapolated_and_corrected(spark):
    a, v, g, s = fixture(spark, 2)
    on = lambda r, c: r in (0, 4) or c in (0, 5)

    def brightest(k):
        nm = normal(g, *k, -1)
        tries = [(round(sample(a, g[k] + nm * (i * 0.25)), 9), -i) for i in range(1, 33)]
        return g[k] + nm * (-max(tries)[1] * 0.25)

    near(table(T.trace_edge(s, v).collect()), {k: brightest(k) if on(*k) else p for k, p in g.items()})
    up = {k: p + 0.5 * (p - g[1, k[1]]) / np.linalg.norm(p - g[1, k[1]]) if k[0] == 0 else p for k, p in g.items()}
    near(table(T.extrapolate_edge(s, "up", 0.5).collect()), up)
    targets = [(1, np.array([0.0, 0, 0])), (2, np.array([9.0, 9, 9])), (3, g[0, 0])]
    t = spark.createDataFrame([(i, *map(float, p)) for i, p in targets], "tid long, tx double, ty double, tz double")
    want = {}
    for k, p in g.items():
        if not on(*k):
            want[k] = p
            continue
        d, _, q = min((np.linalg.norm(q - p), i, q) for i, q in targets)
        drawn = p + (q - p) / d * min(1.0, d) if d > 1e-6 else p
        want[k] = brightest(k) + 0.4 * (drawn - brightest(k))
    near(table(T.correct_edge(s, v, t, weight=0.4).collect()), want)


def test_advance_by_value_and_cost(spark):
    a, v, g, s = fixture(spark, 3)
    out = [np.array([4.0, 5.0, 6.0]), np.array([6.0, 4.0, 5.5])]
    targets = [(1, np.array([2.0, 3, 4])), (2, np.array([7.0, 7, 4]))]
    want = {}
    for (r, c), p in g.items():
        nm, best, d3, d2 = normal(g, r, c), None, np.array([0.0, 0, 1]), np.array([1.0, 0])
        if r > 0:
            d = p - g[r - 1, c]
            d3, d2 = d / np.linalg.norm(d), d[:2] / (np.linalg.norm(d) + 1e-9)
        for i in range(17):
            q = p + nm * (i / 16 * 3)
            if any(np.linalg.norm(q - e) < 1 for e in out):
                continue
            go = q - p
            far, flat = np.linalg.norm(go), np.hypot(*go[:2])
            cost = 0.02 * (1 - go @ d3 / far if far > 1e-6 else 0) + 0.01 * (1 - go[:2] @ d2 / flat if flat > 1e-6 else 0) + 0.3 * far + 0.1 * abs(go[2])
            score = round(sample(a, q) - 50 * cost, 9)
            if score > -1 and (best is None or score > best[0]):
                best = (score, q)
        q = best[1] if best else p
        far, _, at = min((np.linalg.norm(t - p), i, t) for i, t in targets)
        want[r, c] = q + 0.3 * (at - q) if far < 3 else q
    x = spark.createDataFrame([tuple(map(float, p)) for p in out], "x double, y double, z double")
    t = spark.createDataFrame([(i, *map(float, p)) for i, p in targets], "tid long, tx double, ty double, tz double")
    near(table(T.advance(s, v, radius=3.0, straight_2d=0.01, straight_3d=0.02, distance=0.3, z_weight=0.1, targets=t, exclusions=x).collect()), want)


def plain_patch(a, g, generations, direction, out, edt, guide):
    ways = [w for w in T.STEPS.values() if direction == "all" or w[0 if direction == "row" else 1]]
    state, age = dict(g), {k: 0 for k in g}
    for gen in range(1, generations + 1):
        new = {}
        for k in [k for k in state if age[k] == gen - 1]:
            for o, (dr, dc) in enumerate(ways):
                to = (k[0] + dr, k[1] + dc)
                if to not in state and (to not in new or o < new[to][0]):
                    new[to] = (o, k)
        found = {}
        for to, (_, k) in new.items():
            src, nm = state[k], normal(state, *k)
            mean = np.mean([state[to[0] + r, to[1] + c] for r, c in T.STEPS.values() if (to[0] + r, to[1] + c) in state], 0)
            best = None
            for i in range(1, 10):
                q = src + nm * (0.25 if i > 8 else i * 0.25)
                if i <= 8 and not all(0 <= p < n for p, n in zip(q, a.shape[::-1])) or any(np.linalg.norm(q - e) < 1.5 for e in out):
                    continue
                far = np.linalg.norm(q - src)
                cost = 0.7 * np.linalg.norm(q - mean) + (far - 0.25) ** 2 + 0.1 * (q[2] - mean[2]) ** 2 + 4 * max(0, -(q - src) @ nm / far) + sample(edt, q) - 0.5 * sample(guide, q) - (0.01 * sample(a, q) if i <= 8 else 0)
                if best is None or round(cost, 9) < best[0]:
                    best = (round(cost, 9), q)
            found[to] = best[1] if best else mean
        state |= found
        age |= {k: gen for k in found}
    return state, age


@pytest.mark.parametrize("direction", ["all", "row", "col"])
def test_patch_grows_by_least_cost(spark, direction):
    a, v, g, s = fixture(spark, 4, 4, 4)
    rng = np.random.default_rng(9)
    edt, guide = rng.random(a.shape), rng.random(a.shape)
    out = [np.array([2.0, 2.0, 4.5]), np.array([7.0, 5.0, 4.0])]
    x = spark.createDataFrame([tuple(map(float, p)) for p in out], "x double, y double, z double")
    got = T.grow_patch(s, v, a.shape, 3, direction, steps=8, radius=2.0, noise=0.0, exclusions=x, edt=voxels(spark, edt), guide=voxels(spark, guide)).collect()
    want, age = plain_patch(a, g, 3, direction, out, edt, guide)
    near(table(got), want)
    assert {(r["row"], r["col"]): r["generation"] for r in got} == age


def test_noise_is_small_and_repeats(spark):
    a, v, _, s = fixture(spark, 4, 4, 4)
    one, two = (table(T.grow_patch(s, v, a.shape, 1, noise=0.05).collect()) for _ in range(2))
    near(one, two)
    assert any(np.abs(one[k] - p).max() > 1e-9 for k, p in table(T.grow_patch(s, v, a.shape, 1, noise=0.0).collect()).items())


def test_empty_seed(spark):
    _, v, _, s = fixture(spark)
    assert T.grow_patch(s.limit(0), v, (10, 12, 12), 2).count() == 0
    assert T.grow_rings(s.limit(0), v, 1).count() == 0
