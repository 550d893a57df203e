"""Folders for files that all executors can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, tag: str) -> str:
    """A new path under ``spark.checkpoint.dir``, as Spark names it; a temporary folder only for local sessions without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = tempfile.mkdtemp(prefix="lamina-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/files/{tag}-{uuid.uuid4().hex}"


def fresh(spark: SparkSession, tag: str) -> str:
    """The same as a local path or URI, for readers and writers outside Spark."""
    path = shared(spark, tag)
    return path.replace("file:///", "/").replace("file:/", "/") if path.startswith("file:") else path


def cut(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, where a checkpoint computes twice."""
    path = shared(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task that sorts them or keeps them in a hash table.
TASK_ROWS = 250_000


def parts(df: DataFrame, times: int = 1) -> int:
    """Partitions for ``times`` as many rows as a written ``df`` has, so that a task's rows do not grow with the table; few for a small one."""
    rows, usual = df.count() * times, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(usual, rows // 100_000), -(-rows // TASK_ROWS))


def put(path: str, data: bytes) -> None:
    """Write a file through Arrow's file systems, making its folder."""
    from lamina.sources.zarr import open_path

    system, name = open_path(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(name) as f:
        f.write(data)
