import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import augment, colours
from lamina.operators import meshing as M
from lamina.operators import surface as S
from lamina.sources import codecs


def grid(rows, cols, z=lambda r, c: 0.0):
    return np.array([[c, r, z(r, c)] for r in range(rows) for c in range(cols)], float)


def test_simplify_keeps_a_plane_and_copies_small_meshes():
    v, f = M.simplify(grid(6, 6), M.triangles(6, 6), 20)
    assert len(f) <= 20
    assert np.abs(v[:, 2]).max() == 0
    w, g = M.simplify(grid(2, 2), M.triangles(2, 2), 10)
    assert (w == grid(2, 2)).all()
    assert len(g) == 2


def test_optimiser():
    x = np.linspace(0, 2, 20)
    y = 3 * np.exp(-1.5 * x)
    assert M.levenberg_marquardt(lambda p: p[0] * np.exp(-p[1] * x) - y, np.array([1.0, 1.0])) == pytest.approx([3, 1.5], abs=1e-5)


def test_upsampling_keeps_constants():
    assert np.allclose(codecs.lanczos_upsample(np.full((3, 4), 7.0)), 7)


def test_augmentation_depends_on_seed_and_key():
    a = np.random.default_rng(0).random((8, 8))
    one, two = (augment.apply(a, a > 0.5, 3, 9) for _ in range(2))
    assert (one[0] == two[0]).all()
    assert any((augment.apply(a, a > 0.5, 3, k)[0] != one[0]).any() for k in range(5))
    assert one[1].sum() == (a > 0.5).sum()


def test_colours(spark):
    r = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "t double").select(colours.colour(F.col("t"), "hot").alias("c")).collect()
    assert [tuple(x["c"]) for x in r] == [(0, 0, 0), (255, 255, 255), (255, 255, 255)]
    with pytest.raises(ValueError, match="colour map"):
        colours.colour(F.col("t"), "nope")


def test_mesh_smoothing_matches_numpy(spark):
    v = np.random.default_rng(2).random((6, 3))
    f = np.array([[0, 1, 2], [2, 1, 3], [3, 4, 5], [0, 2, 5]])
    got = S.smooth_mesh(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "vid long, x double, y double, z double"), spark.createDataFrame(f.tolist(), "i0 long, i1 long, i2 long"), 0.4, 3)
    for _ in range(3):
        s, n = np.zeros((6, 3)), np.zeros(6)
        for t in f:
            for a in t:
                for b in t:
                    if a != b:
                        s[a] += v[b]
                        n[a] += 1
        v = v + 0.4 * (s / n[:, None] - v)
    rows = sorted((tuple(r) for r in got.collect()))
    assert np.allclose([r[1:] for r in rows], v)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert [r["level"] for r in e.entry(spark).orderBy("level").collect()] == [0, 1]  # the smallest tables give two planes
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 250
