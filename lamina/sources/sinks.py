"""Files written by the executors, one per group of rows: image planes and stacks, clips, surfaces, meshes, masks, containers.

Every writer takes a table and a column (or rule) that tells the files apart, writes each group as one file of the folder and
returns (name, rows). Groups bound what a task holds; nothing passes through the driver but the number of files.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.sources import images, scratch

#: The first words of a clip of one grey frame after the other: fixed values of the format.
Y4M = b"YUV4MPEG2"


def write_groups(rows: DataFrame, path: str, name: Column, encode: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """Write ``encode(rows of a group)`` as the file ``name`` for every value of it; (name, rows, bytes)."""

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        body = encode(pdf)
        scratch.put(f"{path}/{pdf['_name'].iloc[0]}", body)
        return pd.DataFrame({"name": [pdf["_name"].iloc[0]], "rows": [len(pdf)], "bytes": [len(body)]})

    done = rows.withColumn("_name", name).groupBy("_name").applyInPandas(put, "name string, rows long, bytes long")
    return scratch.cut(done, "written")


def dense(pdf: pd.DataFrame, axes: str, shape: tuple | None = None, dtype: str = "u1", fill: int = 0) -> np.ndarray:
    """The group's values ``v`` as an array over ``axes``, from each axis' smallest coordinate on ("z") or from 0 (others); ``fill`` where there is none."""
    at = [pdf[c].to_numpy() - (pdf[c].min() if c == "z" else 0) for c in axes]
    out = np.full(shape or [int(a.max()) + 1 for a in at], fill, dtype)
    out[tuple(at)] = pdf["v"]
    return out


def write_planes(voxels: DataFrame, path: str, kind: str, encode: Callable[[np.ndarray], bytes], shape: tuple, dtype: str = "u1", fill: int = 0) -> DataFrame:
    """A file per plane of a voxel table; absent voxels hold ``fill``."""
    return write_groups(voxels, path, F.format_string(f"%d.{kind}", "z"), lambda pdf: encode(dense(pdf, "yx", shape, dtype, fill)))


def write_stacks(voxels: DataFrame, path: str, depth: int, shape: tuple) -> DataFrame:
    """Multi-page TIFFs of ``depth`` planes."""
    slab = F.format_string("%d.tif", F.floor(F.col("z") / depth))
    return write_groups(voxels, path, slab, lambda pdf: images.tiff_bytes(list(dense(pdf, "zyx", (int(pdf.z.max() - pdf.z.min()) + 1, *shape)))))


def clip_bytes(frames: np.ndarray, rate: int = 25) -> bytes:
    """Frames (n, height, width) of bytes as one uncompressed grey clip."""
    head = b"%s W%d H%d F%d:1 Ip A1:1 Cmono\n" % (Y4M, frames.shape[2], frames.shape[1], rate)
    return head + b"".join(b"FRAME\n" + np.ascontiguousarray(f, "u1").tobytes() for f in frames)


def parse_clip(data: bytes) -> np.ndarray:
    head, _, body = data.partition(b"\n")
    words = head.split()
    if words[0] != Y4M or b"Cmono" not in words:
        raise ValueError("not a grey clip")
    w, h = (int(next(x[1:] for x in words[1:] if x[:1] == k)) for k in (b"W", b"H"))
    size = len(b"FRAME\n") + w * h
    if len(body) % size:
        raise ValueError("a clip that ends inside a frame")
    return np.frombuffer(body, "u1").reshape(-1, size)[:, -w * h :].reshape(-1, h, w)


def write_clips(frames: DataFrame, path: str, depth: int, shape: tuple, rate: int = 25) -> DataFrame:
    """Clips of ``depth`` planes of a voxel table, a plane a frame."""
    clip = F.format_string("%d.y4m", F.floor(F.col("z") / depth))
    return write_groups(frames, path, clip, lambda pdf: clip_bytes(dense(pdf, "zyx", (int(pdf.z.max() - pdf.z.min()) + 1, *shape)), rate))


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, height, width, data) of all clips in a folder."""

    def parse(p, b):
        for i, f in enumerate(parse_clip(b)):
            yield p, i, f.shape[0], f.shape[1], np.ascontiguousarray(f).tobytes()

    return images._files(spark, path, parse, "path string, frame int, height int, width int, data binary")


def _grid(pdf: pd.DataFrame) -> np.ndarray:
    out = np.full((int(pdf.row.max() - pdf.row.min()) + 1, int(pdf.col.max()) + 1, 3), np.nan)
    out[pdf.row - pdf.row.min(), pdf.col] = pdf[["x", "y", "z"]]
    return out


def write_surfaces(surface: DataFrame, path: str, name: Column, kind: str) -> DataFrame:
    """A file per surface or band of rows: "json" documents or "tif" grids of float triples; a cell without a point is not a number."""

    def as_json(pdf):
        g = _grid(pdf)
        points = [[None if np.isnan(v) else float(v) for v in p] for p in g.reshape(-1, 3)]
        return json.dumps({"rows": g.shape[0], "cols": g.shape[1], "points": points}).encode()

    encode = {"json": as_json, "tif": lambda pdf: images.tiff_bytes([_grid(pdf).astype("f4")])}[kind]
    return write_groups(surface, path, F.concat(name.cast("string"), F.lit(f".{kind}")), encode)


def obj_bytes(pdf: pd.DataFrame) -> bytes:
    """An OBJ of faces (i0, i1, i2, ax .. cz) with their own vertices, and as texture coordinates u, v per corner if there are columns au .. cv."""
    ids, inverse = np.unique(pdf[["i0", "i1", "i2"]].to_numpy(), return_inverse=True)
    inverse = inverse.reshape(-1, 3)
    textured = "au" in pdf.columns
    at, uv = np.zeros((len(ids), 3)), np.zeros((len(ids), 2))
    for k, p in enumerate("abc"):
        at[inverse[:, k]] = pdf[[f"{p}x", f"{p}y", f"{p}z"]]
        if textured:
            uv[inverse[:, k]] = pdf[[f"{p}u", f"{p}v"]]
    out = io.StringIO()
    out.writelines(f"v {x!r} {y!r} {z!r}\n" for x, y, z in at.tolist())
    if textured:
        out.writelines(f"vt {u!r} {v!r}\n" for u, v in uv.tolist())
    out.writelines("f " + " ".join(f"{i + 1}/{i + 1}" if textured else str(i + 1) for i in f) + "\n" for f in inverse)
    return out.getvalue().encode()


def write_meshes(faces: DataFrame, path: str, name: Column) -> DataFrame:
    """OBJ files of faces, one per value of ``name``."""
    return write_groups(faces, path, F.concat(name.cast("string"), F.lit(".obj")), obj_bytes)
