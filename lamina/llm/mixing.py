r"""Mixing sources to target weights by weighted fair queueing (operator 7), with DataFrame functions only.

Documents of a source are shuffled by a keyed hash of id and text and queue up once per epoch. A copy's virtual finish time is
the source's words so far, this copy included, divided by the source's target. All copies are put in order of
finish time and the order is cut where its running total would pass the budget. Every source has taken its
target at time 1, so each source's words differ from its target by about one document.

Running totals are distributed: sums per (source, hash range) give each range its start, and only the rows of
one range are ordered together, so a source with a third of all rows is worked on by many tasks.

Edge cases: null text has size 0; documents of size 0 are never taken; a null source is a source of its own,
after all others; rows of null or repeated ids are told apart by their texts and other plain columns, and rows equal in all of them
change places without effect; a source of size 0 has target 0; an empty table gives an empty result. Columns named like the
added ones are replaced; all other columns pass through (helper columns begin with ``_mix_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import bucket_count, bucket_of, bucket_offsets, order_key, order_key_sql
from .store import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words in ``text``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """Targets per source (columns _mix_src, source_size, target) from per-source sizes.

    The total ``share`` * all sizes is dealt by weight; a source stops at ``repeats`` * its size and the rest is
    dealt again among the others until none is above. Sorted by limit per weight, the sources that stop are a
    prefix, so the level at which the dealing settles is the first one that the next source's limit reaches.
    """
    order = F.row_number().over(Window.orderBy("_mix_src")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(order, F.lit(len(weights))) + 1).cast("int")).cast("long")
    s = sizes.withColumn("_mix_w", weight).withColumn("_mix_cap", F.col("source_size") * repeats)
    s = s.withColumn("_mix_r", F.col("_mix_cap").cast("double") / F.col("_mix_w"))
    before = Window.orderBy("_mix_r", "_mix_src").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("_mix_cap").over(before), F.lit(0))) / (F.sum("_mix_w").over(every) - F.coalesce(F.sum("_mix_w").over(before), F.lit(0)))
    s = s.withColumn("_mix_level", level)
    settled = F.min(F.when(F.col("_mix_level") <= F.col("_mix_r"), F.struct("_mix_r", "_mix_src", "_mix_level"))).over(every)["_mix_level"]
    return s.select("_mix_src", "source_size", F.coalesce(F.least(F.col("_mix_cap").cast("double"), settled * F.col("_mix_w")), F.col("_mix_cap").cast("double")).alias("target"))


def schedule(df: DataFrame, size: Column | None = None, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``df`` with size, source_size, target, ``copies`` (times the mix takes the row) and ``finish`` (virtual finish times of those copies, in epochs' order).

    Rows are read twice: once for the narrow totals, once for the result, which is shuffled once by (source, hash range).
    """
    size = word_count(F.col(text_col)) if size is None else size
    src = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))
    df = df.drop("size", "source_size", "target", "copies", "finish")
    plain = [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    text = [F.md5(F.col(text_col))] if text_col in df.columns else []
    keyed = df.withColumn("size", size).withColumn("_mix_src", src).withColumn("_mix_h", order_key(F.col(id_col), *text, seed=seed)).withColumn("_mix_x", F.xxhash64(*plain))
    narrow = set(df.columns) <= {id_col, source_col, text_col}
    slim = materialize(keyed.select(*([id_col, source_col] if narrow else []), "_mix_src", "_mix_h", "_mix_x", "size"), "mix")
    n = bucket_count(slim.count())

    def timed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_mix_b", bucket_of(F.col("_mix_h"), n))
        w = Window.partitionBy("_mix_src", "_mix_b").orderBy("_mix_h", "_mix_x").rowsBetween(Window.unboundedPreceding, 0)
        return rows.join(starts, ["_mix_src", "_mix_b"]).withColumn("_mix_cum", F.col("before") + F.sum("size").over(w)).drop("before", "_mix_b")

    targets = source_targets(slim.groupBy("_mix_src").agg(F.sum("size").alias("source_size")), weights, share, repeats)
    starts = bucket_offsets(slim.withColumn("_mix_b", bucket_of(F.col("_mix_h"), n)), ["_mix_src"], "_mix_b", F.col("size")).join(targets, "_mix_src")
    finish = [(F.col("_mix_cum") + F.lit(e) * F.col("source_size")) / F.col("target") for e in range(repeats)]
    out = timed(keyed)
    slow = timed(slim).where("size > 0 and target > 0").select("size", "_mix_src", "_mix_h", "_mix_x", F.posexplode(F.array(*finish)).alias("_mix_epoch", "_mix_finish"))
    cut = cut_off(materialize(slow, "mix"), n, share)
    if cut is None:
        taken = F.lit(0)
    else:
        upto = F.struct(*[F.lit(cut[c]).cast(t).alias(c) for c, t in (("_mix_finish", "double"), ("_mix_src", "string"), ("_mix_epoch", "int"), ("_mix_h", "long"), ("_mix_x", "long"))])
        reach = [F.struct(f.alias("_mix_finish"), F.col("_mix_src"), F.lit(e).alias("_mix_epoch"), F.col("_mix_h"), F.col("_mix_x")) <= upto for e, f in enumerate(finish)]
        taken = F.when((F.col("size") > 0) & (F.col("target") > 0), sum((x.cast("int") for x in reach), F.lit(0))).otherwise(0)
    out = out.withColumn("copies", taken).withColumn("finish", F.slice(F.array(*[F.when(F.col("target") > 0, f) for f in finish]), F.lit(1), F.col("copies")))
    return out.select(*df.columns, "size", "source_size", "target", "copies", "finish") if not narrow else out.select(*[c for c in df.columns if c in out.columns], "size", "source_size", "target", "copies", "finish")


def cut_off(copies: DataFrame, buckets: int, share: float):
    """The last copy, in order of finish time, with which the running total stays within the budget; None if there is none.

    A histogram over finish times finds the range in which the total passes the budget; only that range is sorted.
    """
    budget = copies.where("_mix_epoch = 0").agg(F.sum("size")).first()[0]
    if not budget:
        return None
    budget = share * budget
    # finish times up to 2 get ranges of their own; the cut is near 1
    b = F.least(F.floor(F.col("_mix_finish") * buckets), F.lit(2 * buckets)).cast("long")
    sums = copies.groupBy(b.alias("_mix_fb")).agg(F.sum("size").alias("_mix_s"))
    upto = sums.select("_mix_fb", F.sum("_mix_s").over(Window.orderBy("_mix_fb")).alias("_mix_upto"), "_mix_s")
    at = upto.where(F.col("_mix_upto") > budget).orderBy("_mix_fb").first()
    if at is None:  # everything fits
        return copies.select(F.max(F.struct("_mix_finish", "_mix_src", "_mix_epoch", "_mix_h", "_mix_x")).alias("m")).first()["m"]
    order = Window.orderBy("_mix_finish", "_mix_src", "_mix_epoch", "_mix_h", "_mix_x").rowsBetween(Window.unboundedPreceding, 0)
    inside = copies.where(b == at["_mix_fb"]).withColumn("_mix_run", F.lit(at["_mix_upto"] - at["_mix_s"]) + F.sum("size").over(order))
    key = F.struct("_mix_finish", "_mix_src", "_mix_epoch", "_mix_h", "_mix_x")
    last = inside.where(F.col("_mix_run") <= budget).select(F.max(key).alias("m")).first()["m"]
    return last or copies.where(b < at["_mix_fb"]).select(F.max(key).alias("m")).first()["m"]


def mix(df: DataFrame, partitions: int | None = None, **options) -> DataFrame:
    """The mixed rows, each as often as it is taken, globally sorted by virtual finish time (column ``finish``)."""
    out = schedule(df, **options)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.withColumn("finish", F.explode("finish")).repartitionByRange(n, "finish").sortWithinPartitions("finish")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return schedule(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


OP7_SQL = rf"""
with d as (
  select doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         case when source is null then '1' else '0' || source end as src, {order_key_sql("doc_id", "md5(text)", seed="mix")} as h
  from documents),
s as (select src, cast(sum(size) as bigint) as source_size, cast(sum(size) * 2 as bigint) as cap,
             [3, 1, 2][cast((row_number() over (order by src) - 1) % 3 + 1 as int)] as w from d group by src),
l as (select *, cast(cap as double) / w as r,
        (cast(1.5 as double) * cast(sum(source_size) over () as double) - cast(coalesce(sum(cap) over b, 0) as double))
        / cast(sum(w) over () - coalesce(sum(w) over b, 0) as double) as level
      from s window b as (order by cast(cap as double) / w, src rows between unbounded preceding and 1 preceding)),
t as (select src, source_size,
        coalesce(least(cast(cap as double), w * (select level from l where level <= r order by r, src limit 1)), cast(cap as double)) as target from l),
c as (select d.*, source_size, target, sum(size) over (partition by d.src order by h, doc_id rows unbounded preceding) as cum
      from d join t on d.src = t.src),
e as (select *, cast(cum + ep * source_size as double) / target as f from c, (values (0), (1)) x(ep) where size > 0 and target > 0),
k as (select doc_id, size, sum(size) over (order by f, src, ep, h, doc_id rows unbounded preceding) as run from e),
n as (select doc_id, cast(sum(size) as bigint) as taken from k
      where cast(run as double) <= 1.5 * (select cast(sum(size) as double) from d) group by doc_id)
select c.doc_id, cast(size as bigint) as size, source_size, target, coalesce(n.taken, 0) as taken from c left join n on c.doc_id = n.doc_id
"""
