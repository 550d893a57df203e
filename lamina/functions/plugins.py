"""Extension points: named operators, message handlers, row callbacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable] = {}


def plugin(name: str):
    """Register a function on DataFrames under a name; a later one replaces it."""

    def keep(fn):
        OPERATORS[name] = fn
        return fn

    return keep


def run(name: str, df: DataFrame, *args, **kwargs) -> DataFrame:
    if name not in OPERATORS:
        raise KeyError(f"no operator {name}")
    return OPERATORS[name](df, *args, **kwargs)


def dispatch(kind: Column, handlers: dict[int, Column], otherwise: Column) -> Column:
    """The reply of each message type's handler."""
    out = None
    for k, reply in handlers.items():
        out = F.when(kind == k, reply) if out is None else out.when(kind == k, reply)
    return otherwise if out is None else out.otherwise(otherwise)


def for_each_point(points: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A callback over batches of points, in parallel."""

    def batches(it: Iterator[pd.DataFrame]):
        for pdf in it:
            yield fn(pdf)

    return points.mapInPandas(batches, schema)


def each_row(df: DataFrame, callback: Callable[[object], bool]) -> int:
    """Hand rows to a callback until it returns false; rows are fetched a partition at a time. Returns how many it saw."""
    seen = 0
    for r in df.toLocalIterator():
        seen += 1
        if not callback(r):
            break
    return seen
