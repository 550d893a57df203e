"""Zarr volumes (format 2 and 3, sharded or not) as a Spark data source of chunk rows.

``spark.read.format("zarr_chunks").load(path)`` gives (level, cz, cy, cx, data): one task per run of chunk files, a
whole shard in one task. Missing chunks give no row. Metadata is read on the driver.
"""

from __future__ import annotations

import itertools
import json
import math
import struct

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lamina.sources.codecs import compress, decompress

ABSENT = 2**64 - 1
_TYPES = {"uint8": "|u1", "uint16": "<u2", "float32": "<f4", "float64": "<f8", "int16": "<i2", "int32": "<i4"}


def open_path(path: str):
    """(file system, path) of a local path or URI."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _get(system, path: str) -> bytes | None:
    try:
        with system.open_input_file(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


def parse_v2(text: bytes) -> dict:
    """Array metadata of a ``.zarray`` document."""
    m = json.loads(text)
    c = m.get("compressor")
    return {"version": 2, "shape": m["shape"], "chunks": m["chunks"], "dtype": m["dtype"], "order": m.get("order", "C"), "codec": c and c["id"], "sep": m.get("dimension_separator", "."), "fill": m.get("fill_value") or 0, "shard": None}


def parse_v3(text: bytes) -> dict:
    """Array metadata of a ``zarr.json`` document; a sharding codec makes the outer chunk a shard."""
    m = json.loads(text)
    if m.get("zarr_format") != 3 or m.get("node_type") != "array":
        raise ValueError("not a format 3 array")
    if m["data_type"] not in _TYPES:
        raise ValueError(f"unknown type {m['data_type']}")
    outer, codecs, shard = m["chunk_grid"]["configuration"]["chunk_shape"], m.get("codecs", []), None
    for c in codecs:
        if c["name"] == "sharding_indexed":
            shard, outer, codecs = outer, c["configuration"]["chunk_shape"], c["configuration"].get("codecs", [])
            break
    names = [c["name"] for c in codecs if c["name"] not in ("bytes", "transpose", "crc32c")]
    sep = m.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
    return {"version": 3, "shape": m["shape"], "chunks": outer, "dtype": _TYPES[m["data_type"]], "order": "C", "codec": names[0] if names else None, "sep": sep, "fill": m.get("fill_value") or 0, "shard": shard}


def metadata(path: str) -> list[dict]:
    """Metadata of all levels: sub-folders 0, 1, ... until the first that is missing, or the array itself."""
    system, root = open_path(path)
    out = []
    for level in itertools.count():
        base = f"{root.rstrip('/')}/{level}"
        if (text := _get(system, f"{base}/zarr.json")) is not None:
            out.append(parse_v3(text) | {"level": level, "base": base})
        elif (text := _get(system, f"{base}/.zarray")) is not None:
            out.append(parse_v2(text) | {"level": level, "base": base})
        else:
            break
    if not out:
        for name, parse in (("zarr.json", parse_v3), (".zarray", parse_v2)):
            if (text := _get(system, f"{root.rstrip('/')}/{name}")) is not None:
                return [parse(text) | {"level": 0, "base": root.rstrip("/")}]
        raise FileNotFoundError(path)
    return out


def _key(m: dict, at: tuple) -> str:
    name = m["sep"].join(map(str, at))
    return f"{m['base']}/c{m['sep']}{name}" if m["version"] == 3 else f"{m['base']}/{name}"


def read_shard(data: bytes, slots: int) -> list[bytes | None]:
    """Inner chunks of a shard by its trailing index of (offset, size) pairs."""
    index = struct.unpack(f"<{2 * slots}Q", data[-16 * slots :])
    return [None if o == ABSENT else data[o : o + n] for o, n in zip(index[::2], index[1::2], strict=True)]


class Chunks(InputPartition):
    def __init__(self, meta: dict, keys: list):
        self.meta, self.keys = meta, keys


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.level, self.run = options["path"], options.get("level"), int(options.get("run", 16))

    def partitions(self):
        out = []
        for m in metadata(self.path):
            if self.level is not None and int(self.level) != m["level"]:
                continue
            outer = m["shard"] or m["chunks"]
            keys = list(itertools.product(*[range(math.ceil(n / c)) for n, c in zip(m["shape"], outer, strict=True)]))
            run = 1 if m["shard"] else self.run
            out += [Chunks(m, keys[i : i + run]) for i in range(0, len(keys), run)]
        return out

    def read(self, part):
        m = part.meta
        system, _ = open_path(self.path)
        size = int(np.prod(m["chunks"])) * np.dtype(m["dtype"]).itemsize
        for at in part.keys:
            data = _get(system, _key(m, at))
            if data is None:
                continue
            if m["shard"]:
                per = [s // c for s, c in zip(m["shard"], m["chunks"], strict=True)]
                for inner, piece in zip(itertools.product(*map(range, per)), read_shard(data, int(np.prod(per))), strict=True):
                    if piece is not None:
                        yield (m["level"], *[a * p + i for a, p, i in zip(at, per, inner, strict=True)], self._raw(m, piece, size))
            else:
                yield (m["level"], *at, self._raw(m, data, size))

    @staticmethod
    def _raw(m, data, size):
        raw = decompress(m["codec"], data, size)
        a = np.frombuffer(raw, m["dtype"])
        if m["order"] == "F":
            a = a.reshape(m["chunks"], order="F").ravel()
        return a.astype(np.dtype(m["dtype"]).newbyteorder("<")).tobytes()


class ZarrChunks(DataSource):
    """Chunk rows of a three-dimensional Zarr volume."""

    @classmethod
    def name(cls):
        return "zarr_chunks"

    def schema(self):
        return "level int, cz long, cy long, cx long, data binary"

    def reader(self, schema):
        return Reader(self.options)


def voxels(chunks: DataFrame, meta: dict, gaps: bool = False) -> DataFrame:
    """Voxel rows (z, y, x, v) of one level's chunk rows, cut to the volume's shape; with ``gaps``, those of the fill value are absent, as missing chunks are."""
    shape, chunk, dtype = meta["shape"], meta["chunks"], np.dtype(meta["dtype"]).newbyteorder("<")

    def split(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples():
                a = np.frombuffer(r.data, dtype).reshape(chunk)
                z, y, x = (i.ravel() for i in np.indices(chunk))
                z, y, x = z + r.cz * chunk[0], y + r.cy * chunk[1], x + r.cx * chunk[2]
                ok = (z < shape[0]) & (y < shape[1]) & (x < shape[2])
                if gaps:
                    ok &= a.ravel() != meta["fill"]
                yield pd.DataFrame({"z": z[ok], "y": y[ok], "x": x[ok], "v": a.ravel()[ok].astype(float)})

    return chunks.where(f"level = {meta['level']}").mapInPandas(split, "z long, y long, x long, v double")


def create(path: str, level: int, shape: tuple, chunk: tuple, dtype: str = "uint8", codec: str | None = "zstd", version: int = 2, shard: tuple | None = None, fill: int = 0) -> dict:
    """Write a level's metadata and return it."""
    system, root = open_path(path)
    base = f"{root.rstrip('/')}/{level}"
    system.create_dir(base, recursive=True)
    if version == 2:
        doc, name = {"zarr_format": 2, "shape": shape, "chunks": chunk, "dtype": _TYPES[dtype], "compressor": codec and {"id": codec}, "fill_value": fill, "order": "C", "filters": None}, ".zarray"
    else:
        inner = [{"name": "bytes", "configuration": {"endian": "little"}}, *([{"name": codec, "configuration": {}}] if codec else [])]
        codecs = [{"name": "sharding_indexed", "configuration": {"chunk_shape": chunk, "codecs": inner}}] if shard else inner
        doc, name = {"zarr_format": 3, "node_type": "array", "shape": shape, "data_type": dtype, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": shard or chunk}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": fill, "codecs": codecs}, "zarr.json"
    text = json.dumps(doc).encode()
    with system.open_output_stream(f"{base}/{name}") as f:
        f.write(text)
    return (parse_v2 if version == 2 else parse_v3)(text) | {"level": level, "base": base}


def write(chunks: DataFrame, path: str, meta: dict) -> None:
    """Write chunk rows (cz, cy, cx, data) under a level that ``create`` made; the chunks of a shard are gathered by one task."""
    per = [s // c for s, c in zip(meta["shard"], meta["chunks"], strict=True)] if meta["shard"] else [1, 1, 1]

    def put(key, pdf):
        import pandas as pd

        system, _ = open_path(path)
        at = tuple(int(k) for k in key)
        packed = {tuple(int(v) % p for v, p in zip((r.cz, r.cy, r.cx), per, strict=True)): compress(meta["codec"], bytes(r.data)) for r in pdf.itertuples()}
        if meta["shard"]:
            body, index = b"", []
            for inner in itertools.product(*map(range, per)):
                piece = packed.get(inner)
                index += [ABSENT, ABSENT] if piece is None else [len(body), len(piece)]
                body += piece or b""
            body += struct.pack(f"<{len(index)}Q", *index)
        else:
            body = packed[0, 0, 0]
        name = _key(meta, at)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(name) as f:
            f.write(body)
        return pd.DataFrame({"bytes": [len(body)]})

    from pyspark.sql import functions as F

    keyed = chunks.select("cz", "cy", "cx", "data", *[F.floor(F.col(f"c{c}") / p).alias(f"s{c}") for c, p in zip("zyx", per, strict=True)])
    keyed.groupBy("sz", "sy", "sx").applyInPandas(put, "bytes long").agg(F.sum("bytes")).collect()


def finalize(path: str, levels: int) -> None:
    """OME multiscales metadata with scales 2**level."""
    system, root = open_path(path)
    data = [{"path": str(n), "coordinateTransformations": [{"type": "scale", "scale": [float(2**n)] * 3}]} for n in range(levels)]
    with system.open_output_stream(f"{root.rstrip('/')}/.zattrs") as f:
        f.write(json.dumps({"multiscales": [{"version": "0.4", "axes": [{"name": a, "type": "space"} for a in "zyx"], "datasets": data}]}).encode())


def scales(path: str) -> dict[int, list[float]]:
    """Scale of each level in the multiscales metadata; empty if there is none."""
    system, root = open_path(path)
    text = _get(system, f"{root.rstrip('/')}/.zattrs")
    doc = json.loads(text) if text is not None else {}
    found = {}
    for d in (doc.get("multiscales") or [{}])[0].get("datasets", []):
        for t in d.get("coordinateTransformations", []):
            if t.get("type") == "scale":
                found[int(d["path"])] = t["scale"]
    return found
