"""A corpus pipeline: quality, near-duplicates, benchmark leaks, mixing, training order.

Each stage takes the documents that the stage before it kept, written as Parquet and read again; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import decontaminate, materialise, minhash, mixing, quality
from lamina.llm.store import materialize

#: Least quality score that stays.
QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least ``QUALITY``; learnt from the labelled ones."""
    scored = quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=True)
    return scored.where(F.col("score") >= QUALITY).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8; rows of one id with different texts are documents of their own."""
    return minhash.deduplicated(docs, 5, 80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; rows of null or repeated ids are judged one by one."""
    rows, key = docs, "doc_id"
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        rows, key = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows"), "_row"
    found = decontaminate.leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    gone = materialize(found.select(F.col("doc_id").alias(key)).distinct(), "leaks")
    # few enough to be sent to the texts, else the texts are shuffled
    return rows.join(F.broadcast(gone) if gone.count() <= decontaminate.BROADCAST_IDS else gone, key, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in order of virtual finish time."""
    return mixing.mix(docs).select(*docs.columns)


def token_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Index of the token shards in training order."""
    return materialise.materialise_order(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
    ("token-ID output", token_order),
]

#: Scores, candidate search and tokens have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
