"""Image, volume and mesh files, parsed from ``binaryFile`` rows or text lines."""

from __future__ import annotations

import gzip
import io
import json
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "path string, page int, width int, height int, channels int, dtype string, data binary"
# tag numbers of the TIFF format: fixed values
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, COUNTS, FORMAT = 256, 257, 258, 259, 273, 277, 279, 339


def parse_tiff(data: bytes) -> list[np.ndarray]:
    """Pages of an uncompressed TIFF (8, 16 bit or float32, either byte order), as (height, width, channels)."""
    e = {b"II": "<", b"MM": ">"}[data[:2]]
    (at,) = struct.unpack(e + "I", data[4:8])
    pages = []
    while at:
        (n,) = struct.unpack(e + "H", data[at : at + 2])
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack(e + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
            form, width = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, ("B", 1))
            raw = data[at + 10 + 12 * k : at + 14 + 12 * k]
            if width * count > 4:
                (where,) = struct.unpack(e + "I", raw)
                raw = data[where : where + width * count]
            tags[tag] = struct.unpack(f"{e}{count}{form}", raw[: width * count])
        if tags.get(COMPRESSION, (1,))[0] != 1:
            raise ValueError("compressed TIFF")
        w, h, c = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
        bits, form = tags.get(BITS, (8,))[0], tags.get(FORMAT, (1,))[0]
        kind = {(8, 1): "u1", (16, 1): "u2", (32, 3): "f4"}[bits, form]
        body = b"".join(data[o : o + s] for o, s in zip(tags[OFFSETS], tags[COUNTS], strict=True))
        pages.append(np.frombuffer(body, e + kind, w * h * c).reshape(h, w, c).astype(kind))
        (at,) = struct.unpack(e + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])
    return pages


def tiff_bytes(pages: list[np.ndarray]) -> bytes:
    """An uncompressed little-endian TIFF of (height, width[, channels]) pages."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for p in pages:
        p = p[..., None] if p.ndim == 2 else p
        h, w, c = p.shape
        body = np.ascontiguousarray(p).astype(p.dtype.newbyteorder("<")).tobytes()
        start = len(out)
        out += body + b"\0" * (len(body) % 2)
        bits_at = len(out)
        out += struct.pack(f"<{c}H", *[p.dtype.itemsize * 8] * c) + struct.pack(f"<{c}H", *[3 if p.dtype.kind == "f" else 1] * c)
        short = lambda tag, v: struct.pack("<HHIHH", tag, 3, 1, v, 0)
        many = lambda tag, at, v: struct.pack("<HHII", tag, 3, c, at) if c > 2 else struct.pack("<HHI", tag, 3, c) + struct.pack(f"<{c}H", *[v] * c).ljust(4, b"\0")
        rows = [struct.pack("<HHII", WIDTH, 4, 1, w), struct.pack("<HHII", HEIGHT, 4, 1, h), many(BITS, bits_at, p.dtype.itemsize * 8), short(COMPRESSION, 1), short(262, 1 if c < 3 else 2), struct.pack("<HHII", OFFSETS, 4, 1, start), short(SAMPLES, c), struct.pack("<HHII", 278, 4, 1, h), struct.pack("<HHII", COUNTS, 4, 1, len(body)), many(FORMAT, bits_at + 2 * c, 3 if p.dtype.kind == "f" else 1)]
        here = len(out)
        out[link : link + 4] = struct.pack("<I", here)
        out += struct.pack("<H", len(rows)) + b"".join(rows) + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


def parse_ppm(data: bytes) -> np.ndarray:
    """A binary PPM or PGM, (height, width, channels)."""
    m = re.match(rb"P([56])\s+(?:#.*\n\s*)*(\d+)\s+(?:#.*\n\s*)*(\d+)\s+(?:#.*\n\s*)*(\d+)\s", data)
    if m is None:
        raise ValueError("not a binary PPM or PGM")
    c, w, h, top = 3 if m[1] == b"6" else 1, int(m[2]), int(m[3]), int(m[4])
    return np.frombuffer(data[m.end() :], ">u2" if top > 255 else "u1", w * h * c).reshape(h, w, c).astype("u2" if top > 255 else "u1")


def ppm_bytes(a: np.ndarray) -> bytes:
    a = a[..., None] if a.ndim == 2 else a
    wide = a.dtype.itemsize > 1 and a.dtype.kind == "u"
    return b"P%d\n%d %d\n%d\n" % (6 if a.shape[2] == 3 else 5, a.shape[1], a.shape[0], 65535 if wide else 255) + a.astype(">u2" if wide else "u1").tobytes()


_NRRD = {"uchar": "u1", "unsigned char": "u1", "uint8": "u1", "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "float": "f4", "double": "f8"}


def parse_nrrd(data: bytes, detached=None) -> tuple[np.ndarray, dict]:
    """Array (slowest axis first) and header of an NRRD file; ``detached(name)`` gives the bytes of a separate data file."""
    head, _, body = data.partition(b"\n\n")
    if not head.startswith(b"NRRD"):
        raise ValueError("not an NRRD file")
    fields = dict(re.split(r":=?\s*", line, maxsplit=1) for line in head.decode().splitlines()[1:] if ":" in line and not line.startswith("#"))
    name = fields.get("data file", fields.get("datafile"))
    body = detached(name) if name else body
    if fields.get("encoding", "raw") in ("gzip", "gz"):
        body = gzip.decompress(body)
    kind = np.dtype(_NRRD.get(fields.get("type", ""), "u1")).newbyteorder(">" if fields.get("endian") == "big" else "<")
    sizes = [int(n) for n in fields["sizes"].split()]
    return np.frombuffer(body, kind, int(np.prod(sizes))).reshape(sizes[::-1]), fields


def _files(spark: SparkSession, path: str, parse, schema: str = PIXELS) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                yield pd.DataFrame(list(parse(r.path, bytes(r.content))), columns=[f.split()[0] for f in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def _pages(path, arrays):
    for i, a in enumerate(arrays):
        yield path, i, a.shape[1], a.shape[0], a.shape[2], str(a.dtype), a.tobytes()


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    """A row per page."""
    return _files(spark, path, lambda p, b: _pages(p, parse_tiff(b)))


def read_ppm(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, lambda p, b: _pages(p, [parse_ppm(b)]))


VOLUME = "path string, shape array<long>, dtype string, data binary"


def read_nrrd(spark: SparkSession, path: str) -> DataFrame:
    """A row per file with attached data."""

    def parse(p, b):
        a, _ = parse_nrrd(b)
        yield p, list(a.shape), str(a.dtype), a.tobytes()

    return _files(spark, path, parse, VOLUME)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """A row per .npy file, or per .npz file: its entry data, volume, 0 or the first."""

    def parse(p, b):
        a = np.load(io.BytesIO(b), allow_pickle=False)
        if not isinstance(a, np.ndarray):
            a = a[next((k for k in ("data", "volume", "0") if k in a), a.files[0])]
        yield p, list(a.shape), str(a.dtype), np.ascontiguousarray(a).tobytes()

    return _files(spark, path, parse, VOLUME)


SURFACE = "path string, row int, col int, x double, y double, z double, valid boolean"


def read_tifxyz(spark: SparkSession, path: str) -> DataFrame:
    """Surface points of a float TIFF with three channels, as three pages or interleaved."""

    def parse(p, b):
        pages = parse_tiff(b)
        a = np.stack([x[..., 0] for x in pages[:3]], -1) if len(pages) >= 3 else pages[0]
        if a.shape[-1] != 3:
            raise ValueError("three coordinates are needed")
        for i, j in np.ndindex(a.shape[:2]):
            x, y, z = map(float, a[i, j])
            yield p, i, j, x, y, z, bool(np.isfinite([x, y, z]).all() and (x, y, z) != (0, 0, 0))

    return _files(spark, path, parse, SURFACE)


def read_surface_json(spark: SparkSession, path: str, named: bool = False) -> DataFrame:
    """Points (row, col, x, y, z) of {"rows", "cols", "points"} documents, with their file's ``path`` if ``named``; wrong lengths fail."""
    t = spark.read.option("multiLine", True).schema("rows int, cols int, points array<array<double>>").json(path)
    ok = F.assert_true(F.size("points") == F.col("rows") * F.col("cols"), F.lit("points do not fill the grid"))
    p = t.select("cols", F.col("_metadata.file_path").alias("path"), F.posexplode("points").alias("i", "p"), ok.alias("_ok")).where("_ok is null")
    return p.select(*(["path"] if named else []), F.floor(F.col("i") / F.col("cols")).cast("int").alias("row"), (F.col("i") % F.col("cols")).cast("int").alias("col"), *[F.col("p")[k].alias(c) for k, c in enumerate("xyz")])


def surface_json(points: DataFrame) -> str:
    """The same document of one surface's points."""
    rows = points.orderBy("row", "col").select("row", "col", "x", "y", "z").collect()
    return json.dumps({"rows": max((r["row"] for r in rows), default=-1) + 1, "cols": max((r["col"] for r in rows), default=-1) + 1, "points": [[r["x"], r["y"], r["z"]] for r in rows]})


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z) and triangles (fid, i0, i1, i2) of one OBJ file, read as one ordered text.

    Quads give two triangles; of larger polygons only the first triangle is kept.
    """
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    v = text.where("line like 'v %'").select("at", F.split(F.trim("line"), r"\s+").alias("p"))
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy("at")) - 1
    vertices = v.select(n.cast("long").alias("vid"), *[F.col("p")[k + 1].cast("double").alias(c) for k, c in enumerate("xyz")])
    corner = lambda k: F.split(F.col("p")[k], "/")[0].cast("long") - 1
    f = text.where("line like 'f %'").select("at", F.split(F.trim("line"), r"\s+").alias("p"))
    tri = lambda a, b, c: F.struct(corner(a).alias("i0"), corner(b).alias("i1"), corner(c).alias("i2"))
    tris = f.select("at", F.posexplode(F.when(F.size("p") == 5, F.array(tri(1, 2, 3), tri(1, 3, 4))).otherwise(F.array(tri(1, 2, 3)))).alias("k", "t"))
    order = F.row_number().over(Window.orderBy("at", "k")) - 1
    return vertices, tris.select(order.cast("long").alias("fid"), "t.i0", "t.i1", "t.i2")


def parse_obj(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles (from 0) of an OBJ file; quads give two triangles, of larger polygons only the first is kept. Negative indices count back."""
    points, faces = [], []
    for line in text.splitlines():
        p = line.split()
        if not p:
            continue
        if p[0] == "v":
            points.append([float(x) for x in p[1:4]])
        elif p[0] == "f":
            i = [int(x.split("/")[0]) for x in p[1:]]
            i = [k - 1 if k > 0 else len(points) + k for k in i]
            faces += [i[:3], [i[0], i[2], i[3]]] if len(i) == 4 else [i[:3]] if len(i) > 2 else []
    return np.array(points, float).reshape(-1, 3), np.array(faces, int).reshape(-1, 3)


def obj_faces(spark: SparkSession, path: str) -> DataFrame:
    """(path, fid, i0, i1, i2, ax .. cz) of all OBJ files in a folder, a file a row of the scan."""
    names = ["path", "fid", "i0", "i1", "i2", *[p + c for p in "abc" for c in "xyz"]]

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                v, f = parse_obj(bytes(r.content).decode())
                yield pd.DataFrame(dict(zip(names, [r.path, np.arange(len(f)), *f.T, *v[f].reshape(-1, 9).T], strict=True)))[names]

    schema = "path string, fid long, i0 long, i1 long, i2 long, " + ", ".join(f"{c} double" for c in names[5:])
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.obj").load(path).select("path", "content").mapInPandas(run, schema)


def obj_lines(vertices: DataFrame, faces: DataFrame) -> list[str]:
    """Lines of an OBJ file."""
    v = [f"v {r['x']:g} {r['y']:g} {r['z']:g}" for r in vertices.orderBy("vid").toLocalIterator()]
    return v + [f"f {r['i0'] + 1} {r['i1'] + 1} {r['i2'] + 1}" for r in faces.orderBy("fid").toLocalIterator()]
