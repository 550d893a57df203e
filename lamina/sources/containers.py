"""Container files of encoded chunks and of masks, and copies of remote volumes."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.sources.codecs import residual_decode, residual_encode

# marks and version of the two formats: fixed values
MAGIC, END, VERSION = b"C4DV", b"END4", 1
MASK = b"VMSK"


def container_bytes(levels: list[dict], scale: float) -> bytes:
    """A container: mark, version, number of levels and scale; per level its shape, chunk shape and number of chunks, then
    (z, y, x, size, code) per chunk; an end mark. A level is {"shape", "chunk", "chunks": [(z, y, x, values)]}."""
    out = [MAGIC, struct.pack("<IIf", VERSION, len(levels), scale)]
    s = struct.unpack("<f", struct.pack("<f", scale))[0]
    for level in levels:
        out.append(struct.pack("<7q", *level["shape"], *level["chunk"], len(level["chunks"])))
        for z, y, x, values in level["chunks"]:
            code = residual_encode(np.asarray(values, float).ravel(), s)
            out.append(struct.pack("<qqqQ", z, y, x, len(code)) + code)
    return b"".join([*out, END])


def parse_container(data: bytes) -> tuple[float, list[dict]]:
    """Scale and levels of a container, with (z, y, x, code) as chunks."""
    if data[:4] != MAGIC:
        raise ValueError("not a chunk container")
    _, count, scale = struct.unpack("<IIf", data[4:16])
    at, levels = 16, []
    for _ in range(count):
        *sizes, n = struct.unpack("<7q", data[at : at + 56])
        at, chunks = at + 56, []
        for _ in range(n):
            z, y, x, size = struct.unpack("<qqqQ", data[at : at + 32])
            chunks.append((z, y, x, data[at + 32 : at + 32 + size]))
            at += 32 + size
        levels.append({"shape": tuple(sizes[:3]), "chunk": tuple(sizes[3:]), "chunks": chunks})
    if data[at : at + 4] != END:
        raise ValueError("a container without its end")
    return scale, levels


def read_container(spark: SparkSession, path: str) -> DataFrame:
    """Decoded chunk rows (path, level, cz, cy, cx, coded, data as float64) of container files."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                scale, levels = parse_container(bytes(r.content))
                for n, level in enumerate(levels):
                    for z, y, x, code in level["chunks"]:
                        data = residual_decode(code, int(np.prod(level["chunk"])), scale).tobytes()
                        yield pd.DataFrame([(r.path, n, z, y, x, len(code), data)], columns=["path", "level", "cz", "cy", "cx", "coded", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, level int, cz long, cy long, cx long, coded long, data binary")


def mask_bytes(mask: np.ndarray) -> bytes:
    """A mask file: mark, three 16-bit sizes (depth, height, width), six zero bytes, one byte a voxel."""
    return MASK + struct.pack("<HHH", *mask.shape) + bytes(6) + mask.astype("u1").tobytes()


def parse_mask(data: bytes) -> np.ndarray:
    if data[:4] != MASK:
        raise ValueError("not a mask file")
    shape = struct.unpack("<HHH", data[4:10])
    return np.frombuffer(data[16:], "u1", int(np.prod(shape))).reshape(shape)


def mirror(remote: DataFrame, path: str) -> DataFrame:
    """Copy the chunk rows (level, cz, cy, cx, data) that ``path`` does not hold yet, and return all that it holds."""
    spark, key = remote.sparkSession, ["level", "cz", "cy", "cx"]
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        remote = remote.join(spark.read.schema(remote.schema).parquet(path).select(*key), key, "left_anti")
    remote.select(*key, "data").write.mode("append").parquet(path)
    return spark.read.schema(remote.select(*key, "data").schema).parquet(path)


def recompress(chunks: DataFrame, codec: str) -> DataFrame:
    """Per level: raw and encoded bytes and their ratio under a codec."""
    from lamina.sources.codecs import compress

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"level": pdf.level, "raw": pdf.data.map(len), "coded": pdf.data.map(lambda b: len(compress(codec, bytes(b))))})

    sizes = chunks.select("level", "data").mapInPandas(run, "level int, raw long, coded long")
    return sizes.groupBy("level").agg(F.sum("raw").alias("raw"), F.sum("coded").alias("coded"), (F.sum("coded") / F.sum("raw")).alias("ratio"))
