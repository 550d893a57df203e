"""Tables and files in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for local sessions that name none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lamina-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/lamina/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    It cuts the lineage without a second computation, survives the loss of any executor, and later
    passes read only the columns they use.
    """
    path = fresh_dir(df.sparkSession, tag)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Delete everything this package left in the shared folder."""
    jvm, path = spark._jvm, f"{shared_dir(spark)}/lamina"
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
