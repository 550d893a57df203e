import gzip
import struct

import numpy as np
import pytest

from lamina.sources import codecs, images, zarr


@pytest.mark.parametrize(("version", "shard", "codec"), [(2, None, "zstd"), (2, None, None), (3, None, "gzip"), (3, (8, 8, 8), "zstd"), (3, (8, 8, 8), None)])
def test_zarr_round_trip(spark, tmp_path, version, shard, codec):
    spark.dataSource.register(zarr.ZarrChunks)
    a = (np.arange(512) % 256).astype(np.uint8).reshape(8, 8, 8)
    meta = zarr.create(str(tmp_path), 0, (8, 8, 8), (4, 4, 4), "uint8", codec, version, shard)
    rows = [(k // 4, k // 2 % 2, k % 2, a[k // 4 * 4 :, k // 2 % 2 * 4 :, k % 2 * 4 :][:4, :4, :4].tobytes()) for k in (0, 3, 5)]
    zarr.write(spark.createDataFrame([(*r[:3], bytearray(r[3])) for r in rows], "cz long, cy long, cx long, data binary"), str(tmp_path), meta)
    zarr.finalize(str(tmp_path), 1)
    got = spark.read.format("zarr_chunks").load(str(tmp_path))
    assert sorted((r["cz"], r["cy"], r["cx"], bytes(r["data"])) for r in got.collect()) == sorted(rows)
    v = {(r["z"], r["y"], r["x"]): r["v"] for r in zarr.voxels(got, zarr.metadata(str(tmp_path))[0]).collect()}
    assert len(v) == 3 * 64
    assert all(v[p] == a[p] for p in v)


def test_zarr_metadata_fails_on_missing_and_unknown(tmp_path):
    with pytest.raises(FileNotFoundError):
        zarr.metadata(str(tmp_path))
    with pytest.raises(ValueError, match="unknown type"):
        zarr.parse_v3(b'{"zarr_format":3,"node_type":"array","data_type":"complex64","shape":[1],"chunk_grid":{"configuration":{"chunk_shape":[1]}}}')


def test_rans_round_trip():
    rng = np.random.default_rng(1)
    for data in (b"", b"a", b"aaaa" * 100, rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), np.minimum(255, rng.geometric(0.2, 5000)).astype(np.uint8).tobytes()):
        f = codecs.frequencies(data)
        assert not data or f.sum() == 4096
        assert codecs.rans_decode(codecs.rans_encode(data, f), f, len(data)) == data


def test_residuals_and_pyramid():
    rng = np.random.default_rng(2)
    v = rng.normal(0, 10, 400)
    assert np.abs(codecs.residual_decode(codecs.residual_encode(v, 0.5), 400, 0.5) - v).max() <= 0.25 + 1e-9
    base = rng.normal(100, 5, (8, 8, 8))
    levels = [base, base.reshape(4, 2, 4, 2, 4, 2).mean((1, 3, 5))]
    got = codecs.pyramid_decode(codecs.pyramid_encode(levels, 0.5), [(4, 4, 4), (8, 8, 8)])
    assert np.abs(got[1] - base).max() <= 0.25 + 1e-9


def test_blosc_container():
    import zstandard

    raw = np.arange(200, dtype="<u2").tobytes()
    shuffled = np.frombuffer(raw, np.uint8).reshape(-1, 2).T.tobytes()
    body = zstandard.ZstdCompressor().compress(shuffled)
    blob = struct.pack("<BBBBIII", 2, 1, 1 | 16 | (4 << 5), 2, len(raw), len(raw), 0) + struct.pack("<I", 20) + struct.pack("<i", len(body)) + body
    assert codecs.blosc_decode(blob) == raw
    assert codecs.decompress("zstd", codecs.compress("zstd", raw)) == raw
    with pytest.raises(ValueError, match="unknown codec"):
        codecs.decompress("nope", b"")


def test_images(spark, tmp_path):
    for a in (np.arange(12, dtype="u1").reshape(3, 4), np.arange(12, dtype="u2").reshape(3, 4) * 1000, np.linspace(0, 1, 24, dtype="f4").reshape(2, 4, 3)):
        got = images.parse_tiff(images.tiff_bytes([a, a]))
        assert len(got) == 2
        assert (got[1].reshape(a.shape) == a).all()
    (tmp_path / "a.tif").write_bytes(images.tiff_bytes([np.ones((2, 3), "u1"), np.zeros((2, 3), "u1")]))
    assert images.read_tiff(spark, str(tmp_path / "a.tif")).count() == 2
    rgb = np.arange(18, dtype="u1").reshape(2, 3, 3)
    assert (images.parse_ppm(images.ppm_bytes(rgb)) == rgb).all()
    head = b"NRRD0004\ntype: ushort\ndimension: 3\nsizes: 4 3 2\nendian: little\nencoding: gzip\n\n"
    a, fields = images.parse_nrrd(head + gzip.compress(np.arange(24, dtype="<u2").tobytes()))
    assert a.shape == (2, 3, 4)
    assert a[1, 2, 3] == 23
    np.save(tmp_path / "v.npy", np.ones((2, 2)))
    assert images.read_npy(spark, str(tmp_path / "v.npy")).first()["shape"] == [2, 2]
    xyz = np.random.default_rng(0).random((3, 4, 3)).astype("f4")
    (tmp_path / "s.tif").write_bytes(images.tiff_bytes([xyz]))
    assert images.read_tifxyz(spark, str(tmp_path / "s.tif")).where("valid").count() == 12


def test_surface_json_and_obj(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"rows": 2, "cols": 2, "points": [[0,0,0],[1,0,0],[0,1,0],[1,1,5]]}')
    s = images.read_surface_json(spark, str(tmp_path / "s.json"))
    assert images.surface_json(s) == '{"rows": 2, "cols": 2, "points": [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 1.0, 5.0]]}'
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nvn 0 0 1\nf 1//1 2//1 3//1 4//1\nf 1 2 3\n")
    v, f = images.read_obj(spark, str(tmp_path / "m.obj"))
    assert v.count() == 4
    assert [tuple(r) for r in f.orderBy("fid").collect()] == [(0, 0, 1, 2), (1, 0, 2, 3), (2, 0, 1, 2)]
    assert images.obj_lines(v, f)[-1] == "f 1 2 3"
