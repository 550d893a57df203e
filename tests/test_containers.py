import numpy as np
import pytest

from lamina.functions import topology as T
from lamina.sources import containers as C


def test_container_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    v = rng.normal(0, 20, (2, 64))
    level = {"shape": (4, 4, 8), "chunk": (4, 4, 4), "chunks": [(0, 0, 0, v[0]), (0, 0, 1, v[1])]}
    data = C.container_bytes([level, {"shape": (2, 2, 4), "chunk": (4, 4, 4), "chunks": []}], 0.5)
    (tmp_path / "a.bin").write_bytes(data)
    rows = C.read_container(spark, str(tmp_path / "a.bin")).orderBy("cx").collect()
    assert [(r["level"], r["cx"]) for r in rows] == [(0, 0), (0, 1)]
    assert all(np.abs(np.frombuffer(r["data"]) - v[k]).max() <= 0.25 + 1e-9 for k, r in enumerate(rows))
    for bad in (b"nope", data[:-4] + b"xxxx"):
        with pytest.raises(ValueError, match="container"):
            C.parse_container(bad)


def test_masks():
    m = np.random.default_rng(1).integers(0, 2, (2, 3, 4)).astype("u1")
    assert (C.parse_mask(C.mask_bytes(m)) == m).all()


def test_mirror_copies_what_is_missing(spark, tmp_path):
    rows = [(0, 0, 0, k, bytearray(b"x")) for k in range(4)]
    df = spark.createDataFrame(rows, "level int, cz long, cy long, cx long, data binary")
    assert C.mirror(df.where("cx < 2"), f"{tmp_path}/m").count() == 2
    assert C.mirror(df, f"{tmp_path}/m").count() == 4
    assert C.recompress(df, "zstd").first()["raw"] == 4


def test_topology():
    ring = np.ones((7, 7), bool)
    ring[2:5, 2:5] = False
    assert T.betti2d(ring) == (1, 1)
    assert T.betti2d(np.zeros((3, 3), bool)) == (0, 0)
    assert T.betti_loss(ring, np.ones((7, 7))) == 1
    assert T.cl_dice(ring, ring) == pytest.approx(1.0)
    assert T.cl_dice(np.zeros((3, 3), bool), np.zeros((3, 3), bool)) == 1.0
    c = T.canvas(5, 5)
    T.draw_rectangle(c, 0, 0, 4, 9, (1, 2, 3, 4))
    T.draw_disc(c, 2, 2, 1, (9, 9, 9, 9))
    assert tuple(c[0, 4]) == (1, 2, 3, 4)
    assert tuple(c[2, 2]) == (9, 9, 9, 9)
    assert T.blend(np.full((1, 1), 100), np.full((1, 1), 200), 0.5)[0, 0] == 150
