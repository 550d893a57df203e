"""Registered queries where tables grow, have gaps or saturate: against their SQL, or against values that follow from the input."""

import os
import sys
from collections import Counter

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


def tables(folder, **frames):
    """The small tables with some of them replaced."""
    for name in os.listdir(SMALL):
        stem = name.split(".")[0]
        if stem in frames:
            frames[stem].to_parquet(f"{folder}/{name}", index=False)
        else:
            os.symlink(f"{SMALL}/{name}", f"{folder}/{name}")
    return str(folder)


def against_sql(spark, name, d):
    import __spark_entry__ as entry
    import duckdb

    got = [tuple(r) for r in entry.queries()[name](spark, d).collect()]
    c = duckdb.connect()
    for f in os.listdir(d):
        c.execute(f"create view {f.split('.')[0]} as select * from '{d}/{f}'")
    want = c.execute(entry.oracle_sql()[name]).fetchall()
    assert want
    assert Counter(got) == Counter(want)


def lineitems(keys, **columns):
    """``lineitem`` rows at (order, supplier, part) keys; other columns as in the first row of the small table unless given."""
    base = pd.read_parquet(f"{SMALL}/lineitem.parquet").head(1)
    out = pd.concat([base] * len(keys), ignore_index=True)
    for c, v in (*zip(("l_orderkey", "l_suppkey", "l_partkey"), np.array(keys).T, strict=True), *columns.items()):
        out[c] = pd.Series(v).astype(base[c].dtype) if base[c].dtype != object else v
    return out


def test_gridstore_leaves_out_planes_that_the_sql_does_not_ask_for(spark, tmp_path):
    against_sql(spark, "src_gridstore", tables(tmp_path, lineitem=lineitems([(z * 1000, 1, 1) for z in (1, 3, 99)])))


def test_render_of_equal_columns(spark, tmp_path):
    """Over many planes every column's largest value is the same; there is no range to divide by."""
    against_sql(spark, "ag_render", tables(tmp_path, lineitem=lineitems([(1, 1, 1), (1, 2, 3), (1001, 1, 1)], l_quantity=[50.0, 50.0, 7.0])))


def test_belief_at_a_node_of_many_neighbours(spark):
    """The product of thousands of messages is smaller than any double; their ratio is not."""
    from lamina.operators import graph as G

    n = 3000
    nodes = spark.createDataFrame([(i, [0.3, 0.7]) for i in range(n + 1)], "id long, prior array<double>")
    edges = spark.createDataFrame([(i, n, 0.4) for i in range(n)], "src long, dst long, weight double")
    got = dict(tuple(r) for r in G.belief(nodes, edges, 2, 3).collect())
    assert got == dict.fromkeys(range(n + 1), 1)


#: A full plane, one with three voxels (one of value 0), none, and one voxel far along z.
GAPS = [(1, y, x) for y in range(16) for x in range(16)] + [(1001, 3, 4), (1001, 9, 15), (1001, 0, 0), (9001, 7, 7)]


@pytest.mark.parametrize("name", ["snk_chunk", "src_npy", "src_nrrd", "src_ppm", "src_shard", "src_tiff", "src_zarr_v2", "src_zarr_v3", "src_open"])
def test_files_tell_absent_voxels_from_zeros(spark, tmp_path, name):
    q = [float(i % 50 + 1) for i in range(len(GAPS))]
    q[256:] = [0.0, 255.0, 9.0, 7.0]
    against_sql(spark, name, tables(tmp_path, lineitem=lineitems(GAPS, l_quantity=q)))


@pytest.mark.parametrize("name", ["ip_gauss2d", "ip_gauss3d"])
def test_absent_voxels_take_no_part_in_a_blur(spark, tmp_path, name):
    against_sql(spark, name, tables(tmp_path, lineitem=lineitems(GAPS, l_quantity=[float(i * 37 % 251) for i in range(len(GAPS))])))


def _heap(a, source):
    import heapq

    best, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        d, p = heapq.heappop(heap)
        for axis in range(3):
            for s in (-1, 1):
                q = tuple(c + (s if k == axis else 0) for k, c in enumerate(p))
                if all(0 <= c < n for c, n in zip(q, a.shape, strict=True)) and not np.isnan(a[q]) and d + a[q] < best.get(q, np.inf):
                    best[q] = d + a[q]
                    heapq.heappush(heap, (best[q], q))
    return best


def test_shortest_ways_through_blocks(spark):
    """Walls make ways cross blocks to and fro; the rounds are those of blocks, so a long volume ends soon."""
    from lamina.operators import graph as G

    a = np.random.default_rng(5).integers(1, 200, (9, 7, 8)).astype(float)
    a[np.random.default_rng(6).random(a.shape) < 0.3] = np.nan
    a[2, :, 1:], a[5, :, :-1], a[0, 1, 1] = np.nan, np.nan, 3.0
    at = np.argwhere(~np.isnan(a))
    cost = spark.createDataFrame([(*map(int, p), float(a[tuple(p)])) for p in at], "z long, y long, x long, v double")
    got = {tuple(r[:3]): r[3] for r in G.relax(cost, (0, 1, 1), (3, 4, 4)).collect()}
    assert got == _heap(a, (0, 1, 1))
    line = spark.range(1500).selectExpr("id as z", "0L as y", "0L as x", "1.0D as v")
    spark.sparkContext.setJobGroup("line", "")
    assert G.relax(line, (0, 0, 0)).agg({"d": "max"}).first()[0] == 1499.0
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("line"))
    assert 0 < jobs < 200


def test_nearest_meets_copies_of_a_target_once(spark, monkeypatch):
    """A far search reaches every target; thousands at a few places must not be thousands of pairs a point."""
    from lamina.operators import spatial

    met, within = [], spatial.within

    def counted(points, targets, radius):
        out = within(points, targets, radius)
        met.append(out.count())
        return out

    monkeypatch.setattr(spatial, "within", counted)
    points = spark.range(50).selectExpr("id as qid", "0D as qx", "1000D + id as qy", "0D as qz")
    targets = spark.range(3000).selectExpr("id as tid", "double(id % 3) as tx", "0D as ty", "0D as tz")
    got = [tuple(r) for r in spatial.nearest(points, targets, 4.0).collect()]
    assert sorted(got) == [(i, 0, 1000.0 + i) for i in range(50)]
    assert sum(met) <= 150


def test_winding_broadcasts_no_tree(spark, monkeypatch):
    from contextlib import redirect_stdout
    from io import StringIO

    from lamina.operators import graph as G

    plans, cut = StringIO(), G._cut

    def seen(df):
        with redirect_stdout(plans):
            df.explain()
        return cut(df)

    monkeypatch.setattr(G, "_cut", seen)
    nodes = spark.range(7).selectExpr("id", "double(0) as init")
    tree = spark.range(1, 7).selectExpr("(id - 1) div 2 as src", "id as dst", "1D as weight", "360D as k")
    out = G.assign_winding(nodes, tree, 0)
    seen(out)
    assert "BroadcastHashJoin" not in plans.getvalue()
    assert sorted(r["visited"] for r in out.collect()) == [True] * 7


def test_a_radius_join_sends_a_point_to_few_cells(spark, monkeypatch):
    from lamina.operators import spatial

    sent, kind = [], type(spark.range(1))
    join = kind.join

    def counted(self, *a, **k):
        sent.append(self.count())
        return join(self, *a, **k)

    r = np.random.default_rng(3).integers(-6, 7, (2, 60, 3)) / 2.0
    points, targets = (spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], f"{k}id int, {k}x double, {k}y double, {k}z double") for k, x in zip("qt", r, strict=True))
    monkeypatch.setattr(kind, "join", counted)
    near = spatial.within(points, targets, 1.5)
    monkeypatch.undo()
    far = np.sqrt(((r[0][:, None] - r[1][None]) ** 2).sum(-1))
    assert sorted(tuple(x) for x in near.select("qid", "tid").collect()) == sorted(map(tuple, np.argwhere(far <= 1.5).tolist()))
    assert sent[0] < 16 * 60


def test_thinning_keeps_nothing_between_blocks():
    """Kinds of neighbourhoods grow with the volume; a worker that remembered them would, too."""
    import tracemalloc

    from lamina.functions import kernels as K

    r = np.random.default_rng(9)
    K.thin3d_round(r.random((16, 16, 16)) < 0.5)
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for _ in range(10):
        K.thin3d_round(r.random((16, 16, 16)) < 0.5)
    grown = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert grown < 100_000


def test_equal_boxes_meet_once(spark, monkeypatch):
    """Thousands of boxes at a few places must not be thousands of candidates a cell; ids are paired after places."""
    from lamina.operators import spatial

    met, pairs = [], spatial.box_pairs

    def counted(boxes):
        met.append(boxes.count())
        return pairs(boxes)

    monkeypatch.setattr(spatial, "box_pairs", counted)
    rows = [(i, 3.0 * (i % 3), 3.0 * (i % 3) + 1, 0.0, 1.0 + i % 2, 0.0, 1.0) for i in range(1300)] + [(5000, 99.0, 99.5, 0.0, 1.0, 0.0, 1.0), (5001, None, 1.0, 0.0, 1.0, 0.0, 1.0)]
    boxes = spark.createDataFrame(rows, "id int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    out = spatial.bbox_overlaps(boxes)
    assert dict(out.dtypes)["a"] == "int"
    got = out.toPandas()
    b = np.array(rows[:1300])
    over = np.prod([np.minimum(b[:, None, k + 1], b[None, :, k + 1]) - np.maximum(b[:, None, k], b[None, :, k]) + 2 for k in (1, 3, 5)], axis=0)
    size = np.prod([b[:, k + 1] - b[:, k] + 2 for k in (1, 3, 5)], axis=0)
    close = np.abs(b[:, None, 1] - b[None, :, 1]) <= 3
    want = {(i, j) for i, j in np.argwhere(close & (over >= 0)) if i < j}
    assert len(got) == len(want) and set(zip(got.a, got.b, strict=True)) == want
    assert np.allclose(got.score, over[got.a, got.b] / np.minimum(size[got.a], size[got.b]))
    assert max(met) <= 8


def test_rounds_of_a_spiral_do_not_compute_the_mask_again(spark):
    from lamina.operators import graph as G

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    mask = spark.range(12).selectExpr("0L as z", "0L as y", "id as x").mapInPandas(seen, "z long, y long, x long")
    got = G.spiral(mask, spark.createDataFrame([(0, 0, 0)], "z long, uy long, ux long"))
    assert sorted(r["x"] for r in got.collect()) == list(range(12))
    assert read.value == 12


@pytest.mark.parametrize("name", ["ip_raycast", "ip_raycast_transfer"])
def test_equal_rays_are_marched_once(spark, tmp_path, monkeypatch, name):
    import __spark_entry__ as entry
    from lamina.operators import volume as V

    met, sample = [], V.sample

    def counted(points, *rest):
        met.append(points.count())
        return sample(points, *rest)

    monkeypatch.setattr(V, "sample", counted)
    part = pd.concat([pd.read_parquet(f"{SMALL}/part.parquet").head(1)] * 400, ignore_index=True)
    part["p_partkey"], part["p_size"] = np.arange(400) * 8, 7
    d = tables(tmp_path, part=part, lineitem=lineitems([(z * 1000, y, x) for z in range(4) for y in range(16) for x in range(16)], l_quantity=[float(i * 37 % 251) for i in range(1024)]))
    if name == "ip_raycast":
        against_sql(spark, name, d)
    rows = entry.queries()[name](spark, d).collect()
    assert len(rows) == 400 and len({tuple(r)[1:] for r in rows}) <= 2
    assert max(met) <= 2 * 30


def test_suppliers_are_fitted_together(spark, tmp_path, monkeypatch):
    """A fit a supplier is a call and hundreds of small arrays each; their number grows with the suppliers."""
    from lamina.operators import meshing

    def alone(*_):
        raise AssertionError("fitted one by one")

    monkeypatch.setattr(meshing, "levenberg_marquardt", alone)
    keys = [(i, i % 40, 1) for i in range(400)]
    against_sql(spark, "sv_lm", tables(tmp_path, lineitem=lineitems(keys, l_linenumber=[i // 40 % (2 + i % 6) + 1 for i in range(400)])))


def test_fits_at_once_equal_fits_alone():
    from lamina.operators import meshing as M

    r = np.random.default_rng(4)
    x, y = r.random((2, 30, 6))
    f = lambda p, x, y: p[..., :1] * np.exp(-p[..., 1:] * x) - y
    got = M.levenberg_marquardt_many(lambda p, k: f(p, x[k], y[k]), np.ones((30, 2)), 200)
    assert np.allclose(got, [M.levenberg_marquardt(lambda p, k=k: f(p, x[k], y[k]), np.ones(2), 200) for k in range(30)], atol=1e-5)


def test_rows_of_a_task_do_not_grow_with_a_mesh(spark, monkeypatch):
    """Sorts of angles and neighbours are dealt by the rows that there are, beyond the usual number of partitions."""
    from contextlib import redirect_stdout
    from io import StringIO

    from lamina.operators import mesh as X
    from lamina.operators import tracing as T
    from lamina.sources import scratch

    plans, cut = StringIO(), scratch.cut

    def seen(df, tag):
        with redirect_stdout(plans):
            df.explain()
        return cut(df, tag)

    monkeypatch.setattr(scratch, "cut", seen)
    monkeypatch.setattr(scratch, "TASK_ROWS", 30, raising=False)
    s = spark.range(100).selectExpr("id div 10 as row", "id % 10 as col", "double(id % 10) as x", "double(id div 10) as y", "double(id % 3) as z")
    assert X.flat_angles(X.grid_faces(s, 10), 1).count() == 81 * 2 * 3
    seen(T.neighbours(s, s), "")
    assert plans.getvalue().count("REPARTITION_BY_NUM") >= 4


@pytest.mark.parametrize("few", [0, 50_000])
def test_samples_of_points_near_and_far(spark, monkeypatch, few):
    from lamina.operators import tracing as T
    from lamina.operators import volume as V

    monkeypatch.setattr(T, "FEW_ROWS", few, raising=False)
    r = np.random.default_rng(8)
    volume = spark.createDataFrame([(z, y, x, int(r.integers(256))) for z in range(4) for y in range(4) for x in range(4) if r.random() < 0.8], "z long, y long, x long, v long")
    rows = [(i, 0, 0, *map(float, p)) for i, p in enumerate(r.random((60, 3)) * 8 - 2)] + [(60, 0, 0, 900.0, 900.0, 900.0), (61, 0, 0, None, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "row long, col long, i int, x double, y double, z double")
    got = {x["row"]: x["value"] for x in T.sampled(points, volume).collect()}
    want = {x["row"]: x["value"] for x in V.sample(points.selectExpr("row", "x as px", "y as py", "z as pz"), volume, ["row"]).collect()}
    assert got.keys() == want.keys() and got.pop(61) is None and want.pop(61) is None
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_short_lines_share_a_group(spark):
    from lamina.functions import kernels as K
    from lamina.operators import blocks as B

    r = np.random.default_rng(2)
    rows = [(z, y, x, 0.0 if r.random() < 0.2 else float("inf")) for z in range(9) for y in range(5) for x in range(7) if r.random() < 0.7]
    v = spark.createDataFrame(rows, "z long, y long, x long, v double")
    for axis in "zyx":
        got, want = (sorted(map(tuple, B.lines(v, axis, K.edt_line, *tile).collect())) for tile in (((4, 3),), ()))
        assert got == want and len(got) == len(rows)


def test_components_write_their_mask_once(spark, tmp_path, monkeypatch):
    from lamina.plans import iterative_queries as Q

    tags, cut = [], Q.scratch.cut
    monkeypatch.setattr(Q.scratch, "cut", lambda df, tag: (tags.append(tag), cut(df, tag))[1])
    against_sql(spark, "ip_cc3d", tables(tmp_path, lineitem=lineitems([(1, 2, 3), (1, 2, 4), (1, 9, 9)], l_quantity=[200.0, 210.0, 250.0])))
    assert tags.count("mask") == 1


def events(times, users, **columns):
    """``events`` rows at times (seconds) by users; other columns as in the first row of the small table unless given."""
    base = pd.read_parquet(f"{SMALL}/events.parquet").head(1)
    out = pd.concat([base] * len(times), ignore_index=True)
    given = {"event_id": range(len(times)), "ts": pd.to_datetime(pd.Series(times, dtype="float64"), unit="s").astype(base["ts"].dtype), "user_id": users}
    for c, v in (given | columns).items():
        out[c] = pd.Series(v, dtype="Int64") if c.endswith("_id") else v
    return out


def test_broadcast_at_the_edges_of_hours_and_without_ids(spark, tmp_path, monkeypatch):
    """Hours are cut as the SQL cuts them, before 1970 too; chunks and bands that are full, short or alone lose no pair and repeat none."""
    from lamina.operators import catalog as C

    monkeypatch.setattr(C, "CHUNK_EVENTS", 7)
    monkeypatch.setattr(C, "BAND_USERS", 5)
    times = [-7200, -3600.001, -3600, -1, -0.0005, 0, 1, 3599.999, 3600, 9000, None, 9001] + [20000 + i for i in range(50)]
    users = [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, None] + [i * i % 23 for i in range(50)]
    ids = [None, *range(1, 60), 59, 59]
    against_sql(spark, "sm_broadcast", tables(tmp_path, events=events(times, users, event_id=ids)))


def test_broadcast_is_written_in_runs(spark, tmp_path):
    """What a file of the pairs takes is far less than a number for each of them."""
    import __spark_entry__ as entry

    d = tables(tmp_path, events=events([i % 3600 for i in range(2000)], [i * 7919 % 1000003 for i in range(2000)]))
    entry.queries()["sm_broadcast"](spark, d).coalesce(1).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").distinct().count() == 2000 * 1999
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 2000 * 1999 / 4


def test_angles_are_scaled_until_they_fit(spark, tmp_path):
    """A sheet of two heights needs more than a few rounds; the queries take them all, where a price is missing too."""
    import __spark_entry__ as entry

    part = pd.concat([pd.read_parquet(f"{SMALL}/part.parquet").head(1)] * 480, ignore_index=True)
    part["p_partkey"], part["p_size"] = range(480), pd.Series([3 if 120 < k < 360 and k % 40 in range(10, 30) else 2 for k in range(480)]).astype(part["p_size"].dtype)
    d = tables(tmp_path, part=part)
    a = entry.queries()["sf_flatten_abf"](spark, d).toPandas()
    around = a.groupby("vid").angle.sum()
    inner = [r * 40 + c for r in range(1, 11) for c in range(1, 39)]
    assert np.abs(a.groupby("fid").angle.sum() - np.pi).max() < 1e-3
    assert np.abs(around[inner] - 2 * np.pi).max() < 1e-3
    against_sql(spark, "sf_flatten_abf", d)
    part.loc[200, "p_retailprice"] = None
    (tmp_path / "gap").mkdir()
    against_sql(spark, "sf_flatten_abf", tables(tmp_path / "gap", part=part))


def test_maps_follow_from_the_fitted_angles(spark, tmp_path):
    import __spark_entry__ as entry
    from lamina.operators import mesh as X
    from lamina.plans import derived_queries as Q

    d = tables(tmp_path)
    got, want = ({(r["row"], r["col"]): (r["u"], r["v"]) for r in df.collect()} for df in (entry.queries()["sf_flatten_abf_uv"](spark, d), X.flatten_patches(Q._patches(spark, d), ["pr", "pc"], X.flat_angles(Q._faces(spark, d), 50), 40)))
    assert got.keys() == want.keys()
    assert any(v[0] is not None for v in want.values())
    assert all((got[k][0] is None and v[0] is None) or np.allclose(got[k], v, atol=2e-6) for k, v in want.items())


def test_smoothing_broadcasts_no_vertices(spark, tmp_path, monkeypatch):
    """Neither vertices nor their means are joined by broadcasts, however small the planner takes them for; no round is computed twice."""
    from contextlib import redirect_stdout
    from io import StringIO

    import __spark_entry__ as entry
    from lamina.sources import scratch

    plans, cut = StringIO(), scratch.cut

    def seen(df, tag):
        with redirect_stdout(plans):
            df.explain()
        return cut(df, tag)

    monkeypatch.setattr(scratch, "cut", seen)
    d = tables(tmp_path)
    seen(entry.queries()["sf_smooth"](spark, d), "")
    assert "BroadcastHashJoin" not in plans.getvalue()
    assert 2 <= plans.getvalue().count("SortMergeJoin") <= 4
    against_sql(spark, "sf_smooth", d)
