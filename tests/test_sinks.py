"""Files written by groups, and codecs, read back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import topology as T
from lamina.sources import codecs, images, sinks, zarr
from test_shapes import voxels


@pytest.fixture(scope="module")
def stack(spark):
    a = np.random.default_rng(1).integers(0, 256, (7, 5, 6)).astype(float)
    return a, voxels(spark, a)


def pages(rows, shape):
    return {(int(r["path"].rsplit("/", 1)[1].split(".")[0]), r["n"]): np.frombuffer(bytes(r["data"]), "u1").reshape(shape) for r in rows}


def test_stacks_and_clips(spark, stack, tmp_path):
    a, v = stack
    done = sinks.write_stacks(v, str(tmp_path / "s"), 3, (5, 6)).collect()
    assert {r["name"]: r["rows"] for r in done} == {"0.tif": 90, "1.tif": 90, "2.tif": 30}
    got = pages(images.read_tiff(spark, str(tmp_path / "s")).withColumnRenamed("page", "n").collect(), (5, 6))
    assert all((got[z // 3, z % 3] == a[z]).all() for z in range(7))
    sinks.write_clips(v, str(tmp_path / "c"), 4, (5, 6), 30)
    got = pages(sinks.read_clips(spark, str(tmp_path / "c")).withColumnRenamed("frame", "n").collect(), (5, 6))
    assert len(got) == 7
    assert all((got[z // 4, z % 4] == a[z]).all() for z in range(7))
    assert (tmp_path / "c" / "0.y4m").read_bytes().startswith(b"YUV4MPEG2 W6 H5 F30:1")
    for bad in (b"RIFF W1 H1\n", sinks.clip_bytes(a[:1])[:-1]):
        with pytest.raises(ValueError, match="clip"):
            sinks.parse_clip(bad)


def test_surfaces_with_holes(spark, tmp_path):
    rows = [(1, r, c, float(c), float(r), 0.5 * r) for r in range(4) for c in range(3) if (r, c) != (1, 1)] + [(2, 9, 0, 1.0, 2.0, 3.0)]
    s = spark.createDataFrame(rows, "id int, row int, col int, x double, y double, z double")
    for kind, read in (("json", lambda p: images.read_surface_json(spark, p, named=True)), ("tif", lambda p: images.read_tifxyz(spark, p))):
        sinks.write_surfaces(s, str(tmp_path / kind), F.col("id"), kind)
        got = read(str(tmp_path / kind)).where("x is not null and not isnan(x)").withColumn("id", F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("int")).collect()
        # rows count from the first of the file
        assert {(r["id"], r["row"], r["col"], r["x"], r["y"], r["z"]) for r in got} == {(i, r - (9 if i == 2 else 0), *rest) for i, r, *rest in rows}


def test_meshes_with_texture(spark, tmp_path):
    rows = [(1, 10, 20, 30, *range(9), 0.0, 0.0, 1.0, 0.0, 0.0, 1.0), (1, 20, 30, 40, *range(3, 9), 9, 9, 9, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    names = ["part", "i0", "i1", "i2", *[p + c for p in "abc" for c in "xyz"], *[p + c for p in "abc" for c in "uv"]]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], names).selectExpr("cast(part as int) part", *[f"cast(i{k} as long) i{k}" for k in range(3)], *names[4:])
    sinks.write_meshes(df, str(tmp_path), F.col("part"))
    text = (tmp_path / "1.obj").read_text()
    assert text.count("\nvt ") == 4
    assert "f 1/1 2/2 3/3" in text
    got = images.obj_faces(spark, str(tmp_path)).orderBy("fid").collect()
    assert [(r["i0"], r["i1"], r["i2"]) for r in got] == [(0, 1, 2), (1, 2, 3)]
    assert [got[1][p + c] for p in "abc" for c in "xyz"] == [3, 4, 5, 6, 7, 8, 9, 9, 9]


def test_obj_text():
    v, f = images.parse_obj("v 0 0 0\nv 1 0 0\n\n# x\nv 1 1 0\nv 0 1 0\nf 1//1 2//1 3//1 4//1\nf -3 -2 -1\nf 1 2 3 4 1\nf 1 2\n")
    assert v.shape == (4, 3)
    assert f.tolist() == [[0, 1, 2], [0, 2, 3], [1, 2, 3], [0, 1, 2]]


@pytest.mark.parametrize("size", [0, 1, 7, 4000, 300_000])
@pytest.mark.parametrize("width", [1, 2, 8])
def test_blosc_containers(size, width):
    data = (np.arange(size) // 5 % 250).astype("u1").tobytes()
    assert codecs.blosc_decode(codecs.blosc_encode(data, width, 1 << 16)) == data
    noise = np.random.default_rng(size).bytes(size)
    assert codecs.blosc_decode(codecs.blosc_encode(noise, width)) == noise


def test_float_chunks():
    a = np.random.default_rng(2).normal(0, 30, 500)
    assert np.abs(codecs.chunk_decode(codecs.chunk_encode(a)) - a).max() <= np.abs(a).max() / 254 + 1e-6
    assert (codecs.chunk_decode(codecs.chunk_encode(np.zeros(5))) == 0).all()
    with pytest.raises(ValueError, match="chunk"):
        codecs.chunk_decode(b"nope" + bytes(20))


def test_scales(tmp_path):
    zarr.create(str(tmp_path), 0, (4, 4, 4), (2, 2, 2))
    assert zarr.scales(str(tmp_path)) == {}
    zarr.finalize(str(tmp_path), 2)
    assert zarr.scales(str(tmp_path)) == {0: [1.0] * 3, 1: [2.0] * 3}


def test_parts_and_holes():
    m = np.zeros((7, 9), bool)
    m[1:6, 1:6] = True
    m[3, 3] = False
    m[1, 8] = True
    assert tuple(T.betti2d(m)) == (2, 1)
