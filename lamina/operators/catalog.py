"""Segments, annotations, reviews, versions, projects and logs as append-only tables with views on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUS = ["Pending", "Approved", "Rejected", "Needs changes"]


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row of each key, by ``order`` (the last column breaks ties)."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def newest(log: DataFrame, key: str, limit: int, *order: str) -> DataFrame:
    """The ``limit`` newest rows of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def ring(log: DataFrame, size: int, *order: str) -> DataFrame:
    """The last ``size`` events of the whole log."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(size)


#: Events of a chunk and users of a band, which meet in one row; users of a block of the band, who pass with each event of the chunk.
CHUNK_EVENTS, BAND_USERS, BLOCK_USERS = 4096, 4096, 128


def fan_out(log: DataFrame, group: str) -> DataFrame:
    """Every event (event_id, user_id, group) with each other user of its group as receiver: (event_id, receiver).

    The pairs are the result, so their number grows with the square of a group. What is shuffled for them are chunks of events and bands of users; a task
    holds a few of each and hands on their pairs in small batches. An event stays while a block of users passes, and the same block comes again with the
    next event, so columns written in this order are runs and repetitions.
    """
    kinds = dict(log.dtypes)
    known = log.where(F.col("user_id").isNotNull() & F.col(group).isNotNull()).select(group, "event_id", "user_id")
    nth = lambda size, *order: F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / size)
    told = known.withColumn("chunk", nth(CHUNK_EVENTS, "user_id", "event_id"))
    told = told.groupBy(group, "chunk").agg(F.array_sort(F.collect_list(F.struct("user_id", "event_id"))).alias("told"))
    users = known.select(group, "user_id").distinct().withColumn("band", nth(BAND_USERS, "user_id"))
    users = users.groupBy(group, "band").agg(F.array_sort(F.collect_list("user_id")).alias("users"))
    # as many tasks as there are partitions: few rows become many pairs
    met = told.join(users.hint("merge"), group).repartition(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), group, "chunk", "band")
    return met.select("told", "users").mapInArrow(_fanned, f"event_id {kinds['event_id']}, receiver {kinds['user_id']}")


def _fanned(batches):
    """The pairs of each row's events and users, without an event's own, in batches of 65,536 pairs at most."""
    for batch in batches:
        for told, users in zip(batch["told"], batch["users"], strict=True):
            ids, own, band = told.values.field("event_id"), told.values.field("user_id").to_numpy(), users.values.to_numpy()
            for b in range(0, len(band), BLOCK_USERS):
                block = band[b : b + BLOCK_USERS]
                for at in range(0, len(own), 65536 // BLOCK_USERS):
                    event, user = np.nonzero(own[at : at + 65536 // BLOCK_USERS, None] != block)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(event + at)), pa.array(block[user])], ["event_id", "receiver"])


def report(segments: DataFrame, reviews: DataFrame) -> DataFrame:
    """Segments with the label of their latest review; without one they are pending."""
    last = latest(reviews, "surface_id", "ts", "id").select(F.col("surface_id").alias("id"), "status", "ts")
    label = F.element_at(F.array(*map(F.lit, STATUS)), F.coalesce("status", F.lit(0)) + 1)
    return segments.join(last, "id", "left").select("id", "name", F.coalesce("status", F.lit(0)).alias("status"), label.alias("label"), "ts")


def apply_reviews(log: DataFrame) -> DataFrame:
    """Current state per review: the last write wins, as an in-place update would leave it."""
    return latest(log, "id", "ts", "seq").drop("seq")


def delete_segment(segments: DataFrame, annotations: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables without the segments that ``gone`` marks and their annotations, and the number of rows that went."""
    dead = segments.where(gone).select(F.col("id").alias("segment_id"))
    left = segments.join(dead.withColumnRenamed("segment_id", "id"), "id", "left_anti")
    return left, annotations.join(dead, "segment_id", "left_anti"), dead.agg(F.count("*").alias("changed"))


def tag(tags: Column, name: str) -> Column:
    """With the tag; adding twice changes nothing."""
    return F.array_union(tags, F.array(F.lit(name)))


def untag(tags: Column, name: str) -> Column:
    return F.array_remove(tags, name)


def search(df: DataFrame, text: str) -> DataFrame:
    """Entries with the text in their name or path."""
    return df.where(F.col("name").contains(text) | F.col("path").contains(text))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def size_label(n: Column) -> Column:
    """Bytes with a unit and one decimal."""
    f = lambda d, u: F.format_string(f"%.1f {u}", n / F.lit(float(d)))
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, f(1024, "KB")).when(n < 1024**3, f(1024**2, "MB")).otherwise(f(1024**3, "GB"))


def nice_scale(v: Column) -> Column:
    """The largest of 1, 2, 5 times a power of ten that is not above ``v``."""
    p = F.pow(F.lit(10.0), F.floor(F.log10(v)))
    m = v / p
    return F.when(m >= 5, 5 * p).when(m >= 2, 2 * p).otherwise(p)


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, as hexadecimal; products are split so that nothing overflows."""
    # constants of the hash: fixed values
    offset, prime = "cbf29ce484222325", 0x100000001B3
    hi, lo = int(offset[:8], 16), int(offset[8:], 16)
    bytes_ = F.filter(F.split(F.regexp_replace(F.hex(text.cast("binary")), "(..)", "$1,"), ","), lambda b: b != "")
    state = F.struct(F.lit(hi).cast("long").alias("h"), F.lit(lo).cast("long").alias("l"))
    mask = 0xFFFFFFFF

    def step(s, b):
        low = s["l"].bitwiseXOR(F.conv(b, 16, 10).cast("long"))
        # prime = 2^40 + 0x1b3
        a = low * F.lit(prime & mask)
        h = s["h"] * F.lit(prime & mask) + F.shiftright(a, 32) + F.shiftleft(low.bitwiseAND(F.lit((1 << 24) - 1)), 8)
        return F.struct(h.bitwiseAND(F.lit(mask)).alias("h"), a.bitwiseAND(F.lit(mask)).alias("l"))

    return F.aggregate(bytes_, state, step, lambda s: F.concat(F.lpad(F.lower(F.hex(s["h"])), 8, "0"), F.lpad(F.lower(F.hex(s["l"])), 8, "0")))


def layered(project: DataFrame, globals_: DataFrame, defaults: DataFrame) -> DataFrame:
    """Settings (name, value): project before global before default."""
    j = defaults.withColumnRenamed("value", "d").join(globals_.withColumnRenamed("value", "g"), "name", "full").join(project.withColumnRenamed("value", "p"), "name", "full")
    return j.select("name", F.coalesce("p", "g", "d").alias("value"))


def resolve(ours: DataFrame, theirs: DataFrame, rule: str) -> DataFrame:
    """Conflicting versions (key, version, value): "ours", "theirs", or "merge" (the newer; ties: theirs)."""
    j = ours.select("key", F.struct("version", F.lit(0).alias("t"), "value").alias("o")).join(theirs.select("key", F.struct("version", F.lit(1).alias("t"), "value").alias("x")), "key", "full")
    pick = {"ours": F.coalesce("o", "x"), "theirs": F.coalesce("x", "o"), "merge": F.greatest("o", "x")}[rule]
    return j.select("key", pick["value"].alias("value"))


def snapshot(log: DataFrame, version: int) -> DataFrame:
    """A persistent map at a version of its change log (version, key, value; null value: deleted)."""
    return latest(log.where(F.col("version") <= version), "key", "version").where("value is not null").select("key", "value")
