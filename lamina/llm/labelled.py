"""Labelled rows: folds by id and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import order_key


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def training_texts(docs: DataFrame, labels: DataFrame, label: str, usable: Column, bound: int, id_col: str = "doc_id", text_col: str = "text", seed: str = "train") -> DataFrame:
    """(id, y, text) of at most about ``bound`` labelled rows, those with the smallest keyed hash of their id.

    The sample is bounded before any text is read, so its ids can be broadcast: ``bound`` ids and labels.
    Ids with conflicting labels and null labels are left out; a repeated id counts once.
    """
    known = labels.where(usable & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label).alias("y"), F.max(label).alias("_z")).where("y = _z")
    sample = known.orderBy(order_key(F.col(id_col), seed=seed), id_col).limit(bound).select(F.col(id_col).alias("id"), "y")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # a repeated document id gives one example
    return texts.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
