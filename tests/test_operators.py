import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import kernels as K
from lamina.operators import blocks as B
from lamina.operators import catalog as C
from lamina.operators import graph as G
from lamina.operators import patches as P
from lamina.operators import spatial as X
from lamina.operators import surface as S
from lamina.operators import volume as V
from lamina.streaming import chunks, locks


def voxels(spark, a):
    return spark.createDataFrame([(*map(int, p), float(v)) for p, v in np.ndenumerate(a)], "z long, y long, x long, v double")


def dense(df, shape):
    a = np.zeros(shape)
    for r in df.collect():
        a[r["z"], r["y"], r["x"]] = r["v"]
    return a


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(3).integers(0, 255, (8, 8, 8)).astype(float)


def test_empty_volume(spark):
    e = spark.createDataFrame([], "z long, y long, x long, v long")
    assert V.stats(e).first()["n"] == 0
    assert V.downsample(e).count() == 0
    assert V.composite(e, "alpha").count() == 0
    assert V.overlap_scores(e, e).first()["dice"] == 1.0
    assert not V.any_in_region(e, (0, 0, 0), (2, 2, 2)).first()["found"]
    with pytest.raises(ValueError, match="empty box"):
        V.crop(e, (0, 0, 0), (0, 1, 1))
    with pytest.raises(ValueError, match="unknown merge"):
        V.merge_inner(e, e, "nope")


def test_sampling_a_ramp_is_exact(spark):
    a = np.indices((6, 6, 6)).sum(0).astype(float)
    p = spark.createDataFrame([(1, 2.5, 3.25, 2.0), (2, 4.0, 1.5, 3.75)], "id int, pz double, py double, px double")
    got = {r["id"]: r["value"] for r in V.sample(p, voxels(spark, a), ["id"]).collect()}
    # the voxel centre convention: coordinates are half a voxel ahead
    assert got == pytest.approx({1: 2.5 + 3.25 + 2.0 - 1.5, 2: 4.0 + 1.5 + 3.75 - 1.5})


def test_constant_histogram_and_std_of_one(spark):
    one = spark.createDataFrame([(0, 0, 0, 7)], "z long, y long, x long, v long")
    assert V.stats(one).first()["std"] == 0.0
    assert V.histogram(one, 8).first()["bin"] == 0
    assert V.hist256(one).first()["bin"] == 0


def test_block_kernels_match_whole_arrays(spark, cube):
    c = B.to_chunks(voxels(spark, cube), (4, 4, 4))
    for halo, f in ((3, lambda a: K.gauss(a, 1.0)), (1, lambda a: K.sobel(a, 1)), (4, lambda a: K.derivative(a, 0))):
        got = dense(B.to_voxels(B.with_halo(c, (4, 4, 4), halo, lambda a, o, f=f: f(a), (8, 8, 8)), (4, 4, 4)), (8, 8, 8))
        assert np.abs(got - f(cube)).max() < 1e-9
    a = np.random.default_rng(4).random((19, 10, 17)) * 200
    c, chunk = B.to_chunks(voxels(spark, a), (8, 8, 8)), (8, 8, 8)
    # kernels of several steps, whose reach adds up
    for halo, f in ((7, lambda a: K.structure_tensor(a, 0.3, 0.0)["yx"]), (5, lambda a: K.frangi(a, [1.0])), (3, lambda a: K.box_blur(K.box_blur(a, 3), 5)), (2, lambda a: K.sobel(K.sobel(a, 0), 2))):
        got = dense(B.to_voxels(B.with_halo(c, chunk, halo, lambda a, o, f=f: f(a), a.shape), chunk), a.shape)
        assert np.abs(got - f(a)).max() < 1e-9
    c = B.to_chunks(voxels(spark, cube), (4, 4, 4))
    with pytest.raises(ValueError, match="halo"):
        B.with_halo(c, (4, 4, 4), 5, lambda a, o: a, (8, 8, 8))


def test_edt_and_components(spark, cube):
    mask = cube > 230
    f = voxels(spark, np.where(mask, 0.0, np.inf))
    for axis in "xyz":
        f = B.lines(f, axis, K.edt_line)
    at = np.argwhere(mask)
    want = np.array([((at - p) ** 2).sum(1).min() for p in np.ndindex(8, 8, 8)]).reshape(8, 8, 8)
    assert (dense(f, (8, 8, 8)) == want).all()
    x = np.arange(100)
    v = np.where(x % 17 == 3, 0.0, np.inf)
    assert (K._envelope(x.astype(float), v) == [min((i - j) ** 2 for j in range(3, 100, 17)) for i in x]).all()
    two = np.zeros((10, 5, 5), bool)
    two[:3], two[6:] = True, True
    assert K.components(two)[1] == 2
    assert K.components(np.ones((5, 5, 5), bool))[1] == 1
    assert K.components(np.zeros((5, 5, 5), bool))[1] == 0


def test_dijkstra_join_matches_heap(spark):
    cost = np.random.default_rng(5).integers(1, 9, (3, 4, 4)).astype(float)
    got = dense(G.relax(voxels(spark, cost), (0, 0, 0)).withColumnRenamed("d", "v"), (3, 4, 4))
    assert (got == K.dijkstra(cost, (0, 0, 0))).all()


def test_spanning_forest_weight(spark):
    rng = np.random.default_rng(1)
    e = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 12, 40), rng.integers(0, 12, 40), rng.integers(1, 9, 40)) if a != b]
    n = spark.createDataFrame([(i,) for i in range(12)], "id long")
    t = G.max_spanning_forest(n, spark.createDataFrame(e, "src long, dst long, weight double")).collect()
    root = list(range(12))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    want = 0.0
    for a, b, w in sorted(e, key=lambda r: -r[2]):
        if top(a) != top(b):
            root[top(a)] = top(b)
            want += w
    assert sum(r["weight"] for r in t) == want
    assert len(t) == 12 - len({top(i) for i in range(12)})


def test_belief_on_a_chain_of_agreement(spark):
    n = spark.createDataFrame([(0, [0.9, 0.1]), (1, [0.5, 0.5]), (2, [0.45, 0.55])], "id long, prior array<double>")
    e = spark.createDataFrame([(0, 1, 0.1), (1, 2, 0.1)], "src long, dst long, weight double")
    assert {r["id"]: r["label"] for r in G.belief(n, e, 2, 5).collect()} == {0: 0, 1: 0, 2: 0}


def test_versions_locks_and_catalog(spark):
    log = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, "b", 5)], "version int, key string, value int")
    assert [r["key"] for r in C.snapshot(log, 1).collect()] == ["a"]
    assert [tuple(r) for r in C.snapshot(log, 3).collect()] == [("b", 5)]
    owner = {}
    assert locks.claim(owner, 1, locks.cells(0.5, 0.5, 0.08))
    assert not locks.claim(owner, 2, locks.cells(0.55, 0.5, 0.08))
    assert locks.claim(owner, 1, locks.cells(0.55, 0.5, 0.08))
    h = {r["s"]: r["h"] for r in spark.createDataFrame([("",), ("a",), ("foobar",)], "s string").select("s", C.fnv1a(F.col("s")).alias("h")).collect()}

    def fnv(s):
        x = 0xCBF29CE484222325
        for b in s.encode():
            x = (x ^ b) * 0x100000001B3 % 2**64
        return f"{x:016x}"

    assert h == {s: fnv(s) for s in h}


def test_chunk_plan_counts_levels(spark):
    rows = chunks.chunk_plan(spark, [(4, 4, 4), (2, 2, 2)], (0, 0, 0, 3, 4, 1)).orderBy("seq").collect()
    assert [r["level"] for r in rows] == [1] * 4 + [0] * 12
    assert [r["seq"] for r in rows if r["is_last"]] == [4, 16]


def test_locks_stream(spark, tmp_path):
    e = [(1, 1, 10, 1, 0.5, 0.5, 0.08), (1, 2, 11, 2, 0.5, 0.5, 0.08), (2, 2, 12, 3, 0.5, 0.5, 0.08)]
    ddl = "surface_id long, user_id long, ts_ms long, seq long, u double, v double, r double"
    spark.createDataFrame(e, ddl).write.parquet(f"{tmp_path}/in")
    out = locks.grant_stream(spark.readStream.schema(ddl).parquet(f"{tmp_path}/in"))
    q = out.writeStream.format("memory").queryName("granted").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["seq"]: r["granted"] for r in spark.table("granted").collect()} == {1: True, 2: False, 3: True}


def test_patches(spark):
    assert P.tile_positions(10, 4, 3) == [0, 3, 6]
    assert P.tile_positions(10, 4, 4) == [0, 4, 6]
    assert P.tile_positions(3, 4, 4) == [0]
    got = P.extract(voxels(spark, np.ones((2, 2, 2))), P.grid(spark, (2, 2, 2), (2, 2, 2), (1, 1, 1)), (2, 2, 3)).first()
    assert got["image"] == [1, 1, 0, 1, 1, 0] * 2
    assert got["mask"] == [1, 1, 0, 1, 1, 0] * 2
    b = P.batches(spark.range(10), 4, 1, "id", drop_last=True)
    assert b.count() == 8


def test_surface_metrics(spark):
    flat = spark.createDataFrame([(r, c, float(c), float(r), 0.0) for r in range(4) for c in range(5)], "row int, col int, x double, y double, z double")
    assert S.area(flat).first()[0] == pytest.approx(12.0)
    assert S.smoothness(flat).first()[0] == pytest.approx(0.0)
    assert {(r["nx"], r["ny"], abs(r["nz"])) for r in S.normals(flat).collect()} == {(0.0, 0.0, 1.0)}


def test_nearest_with_no_targets_and_ties(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "qid int, qx double, qy double, qz double")
    t = spark.createDataFrame([(7, 1.0, 0.0, 0.0), (3, -1.0, 0.0, 0.0)], "tid int, tx double, ty double, tz double")
    assert X.nearest(p, t, 0.25).first()["tid"] == 3
    assert X.nearest(p, t.limit(0), 1.0, 3).count() == 0
    assert X.within(p, t, 0.0).count() == 0


def test_kernels_keep_constants_and_lines():
    c = np.full((6, 6, 6), 4.0)
    assert np.allclose(K.gauss(c, 1.5), 4)
    assert np.allclose(K.frangi(c, [1.0]), 0)
    ramp = np.indices((20, 9, 9))[0].astype(float)
    assert np.allclose(K.derivative(ramp, 0)[5:-5], 1)
    line = np.zeros((9, 9), bool)
    line[3:6, 1:8] = True
    thin = K.thin2d(line)
    assert 0 < thin.sum() < line.sum()
    hole = np.zeros((7, 7), bool)
    hole[3, 3] = True
    assert K.inpaint(np.full((7, 7), 5.0), hole)[3, 3] == pytest.approx(5)


def test_nearest_reaches_far_targets(spark):
    import itertools
    import math

    from lamina.operators import spatial

    q = [(0, 0.0, 0.0, 0.0), (1, 3.0, 1.0, 2.0), (2, 1e6, -2e5, 7.0), (3, float("nan"), 0.0, 0.0)]
    t = [(10, 5e5, 0.0, 0.0), (11, 5e5, 0.0, 0.0), (12, -4e5, 3.0, 1.0)]
    points, targets = spark.createDataFrame(q, "qid long, qx double, qy double, qz double"), spark.createDataFrame(t, "tid long, tx double, ty double, tz double")
    got = {r["qid"]: (r["tid"], r["dist"]) for r in spatial.nearest(points, targets, 0.5).collect()}
    want = {}
    for a, b in itertools.product(q[:3], t):
        want[a[0]] = min(want.get(a[0], (math.inf, 0)), (math.dist(a[1:], b[1:]), b[0]))
    assert {k: v[0] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][0]) < 1e-6 for k in want)
    assert spatial.nearest(points, targets.limit(0), 0.5).count() == 0


def test_best_level_beyond_eight(spark):
    from lamina.operators import volume

    want = spark.createDataFrame([(9, 4, 5, 6), (3, 64, 80, 96), (12, 0, 0, 0)], "level int, z long, y long, x long")
    levels = spark.createDataFrame([(10, 2, 2, 3, 7)], "level int, z long, y long, x long, v int")
    got = {(r["level"], r["v"], r["found"]) for r in volume.lod_best(want, levels).collect()}
    assert got == {(9, 7, 10)}
    assert volume.lod_best(want, levels.limit(0)).count() == 0
