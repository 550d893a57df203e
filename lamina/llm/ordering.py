"""Deterministic shuffles and distributed running totals, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the order key that ``order_key`` returns.
KEY_BITS = 52


def order_key(*cols: Column, seed: str = "") -> Column:
    """A uniform pseudo-random long in [0, 2**52), a function of the values of ``cols`` and ``seed`` alone."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def order_key_sql(*cols: str, seed: str = "") -> str:
    """``order_key``, for DuckDB."""
    text = "".join(f" || '|' || coalesce(cast({c} as varchar), '')" for c in cols)
    return f"cast('0x' || substr(md5('{seed}'{text}), 1, {KEY_BITS // 4}) as bigint)"


def bucket_count(rows: int, least: int = 256) -> int:
    """Buckets for ``rows`` rows: each holds about max(``least``, sqrt(rows)) rows, so that neither a bucket nor the list of buckets gets large."""
    return max(1, math.ceil(rows / max(least, math.isqrt(max(rows, 1)))))


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of an order key; buckets are ranges of the key, so bucket order is key order."""
    return F.floor(key / F.lit(float(2**KEY_BITS)) * F.lit(float(buckets))).cast("long")


def bucket_offsets(df: DataFrame, group: list[str], bucket: str, value: Column, name: str = "before") -> DataFrame:
    """Per (group, bucket): the total of ``value`` in the group's earlier buckets. A group with a third of all rows counts only its buckets here."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(w), F.lit(0)).cast("long").alias(name))
