"""Session builder with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "lamina", **extra: str) -> SparkSession:
    """A UTC session with AQE on; ``extra`` overrides any setting (dots written as ``__``)."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in extra.items()}
    return SparkSession.builder.master(master).appName(app).config(map=conf).getOrCreate()
