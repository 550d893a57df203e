"""Volumes, surfaces, graphs and catalogs derived from the test tables, as DataFrames and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Orders of a plane of the volumes.
PLANE = 1000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _voxels(spark, d, value) -> DataFrame:
    li = table(spark, d, "lineitem")
    keys = [F.floor(F.col("l_orderkey") / PLANE).alias("z"), (F.col("l_suppkey") % 16).alias("y"), (F.col("l_partkey") % 16).alias("x")]
    return li.groupBy(*keys).agg((F.sum(value).cast("long") % 256).alias("v"))


def vol(spark, d) -> DataFrame:
    """u8 volume (z, y, x, v) of summed quantities: a plane of 16 x 16 voxels for every thousand orders."""
    return _voxels(spark, d, F.col("l_quantity"))


def vol2(spark, d) -> DataFrame:
    """A second volume on the same grid."""
    return _voxels(spark, d, F.col("l_linenumber") * 7 + F.round(F.col("l_discount") * 100).cast("long"))


def vol_float(spark, d) -> DataFrame:
    """Float volume of the embeddings: 16 vectors a plane, one component a column."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    return e.select(F.floor(F.col("vec_id") / 16).alias("z"), (F.col("vec_id") % 16).alias("y"), F.col("x").cast("long").alias("x"), F.round(F.col("e").cast("double"), 4).alias("v"))


def surface(spark, d, shift: bool = False) -> DataFrame:
    """Surface grid (row, col, x, y, z) of 40 columns; ``shift`` gives its second version."""
    p = table(spark, d, "part")
    z = F.col("p_size") % 7 + F.col("p_retailprice") / 1e4 + (F.col("p_size") if shift else F.lit(0))
    row, col = F.floor(F.col("p_partkey") / 40), F.col("p_partkey") % 40
    return p.select(row.alias("row"), col.alias("col"), col.cast("double").alias("x"), row.cast("double").alias("y"), z.cast("double").alias("z"))


def edges(spark, d) -> DataFrame:
    """Bipartite graph of groups of ten suppliers and part classes (src, dst, weight, k)."""
    li = table(spark, d, "lineitem")
    g = li.groupBy(F.floor(F.col("l_suppkey") / 10).alias("src"), (F.lit(100000) + F.col("l_partkey") % 50).alias("dst")).agg((F.count("*") / 200.0).cast("double").alias("weight"))
    return g.withColumn("k", F.lit(360.0))


def reviews(spark, d) -> DataFrame:
    """Review log (id, surface_id, reviewer_id, status, ts) of the orders."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(0)
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("surface_id"), F.col("o_custkey").alias("reviewer_id"), status.alias("status"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz))").alias("ts"))


def segments(spark, d) -> DataFrame:
    """Segments (id, volume_id, name, surface_path) of the suppliers."""
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("vol-"), F.col("s_nationkey")).alias("volume_id"), F.col("s_name").alias("name"), F.concat(F.lit("/surfaces/"), F.lower("s_name"), F.lit(".obj")).alias("surface_path"))


def annotations(spark, d) -> DataFrame:
    """Annotations (id, segment_id, type, data_json) of the labels."""
    x = table(spark, d, "labels")
    kind = F.when(F.col("toxic") == 1, "circle").when(F.col("quality") == 1, "point").otherwise("line")
    return x.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 10).alias("segment_id"), kind.alias("type"), F.to_json(F.struct("quality", "toxic")).alias("data_json"))


def collab(spark, d) -> DataFrame:
    """Collaboration events (event_id, user_id, ts_ms, edit_type, payload) of the events."""
    e = table(spark, d, "events")
    kind = F.expr("case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end")
    return e.select("event_id", "user_id", F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("ts_ms"), kind.alias("edit_type"), F.col("props").alias("payload"), "value")


def projects(spark, d) -> DataFrame:
    """Project entries (name, path, type, is_remote, tags) of the documents."""
    x = table(spark, d, "documents").select("doc_id", "lang", "source")
    kind = F.expr("case cast(doc_id % 4 as int) when 0 then 'segments' when 1 then 'zarr_volume' when 2 then 'tiff_stack' else 'normal_grid' end")
    return x.select(F.concat(F.lit("entry-"), "doc_id").alias("name"), F.concat(F.lit("/data/"), "lang", F.lit("/"), "doc_id").alias("path"), kind.alias("type"), (F.col("doc_id") % 5 == 0).alias("is_remote"), F.array("lang", "source").alias("tags"), F.col("doc_id").alias("id"))


#: Triangles (fid, and three corners) of the box [2, 5]^3, wound outwards.
BOX_CORNERS = [(x, y, z) for x in (2.0, 5.0) for y in (2.0, 5.0) for z in (2.0, 5.0)]
BOX_FACES = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


def box_rows() -> list[tuple]:
    return [(f, *BOX_CORNERS[a], *BOX_CORNERS[b], *BOX_CORNERS[c]) for f, (a, b, c) in enumerate(BOX_FACES)]


BOX_COLUMNS = ["fid", "ax", "ay", "az", "bx", "by", "bz", "cx", "cy", "cz"]


def box(spark) -> DataFrame:
    return spark.createDataFrame(box_rows(), ", ".join(f"{c} {'int' if c == 'fid' else 'double'}" for c in BOX_COLUMNS))


SQL = {
    "vol": "vol as (select l_orderkey // 1000 as z, l_suppkey % 16 as y, l_partkey % 16 as x, cast(sum(l_quantity) as bigint) % 256 as v from lineitem group by 1, 2, 3)",
    "vol2": "vol2 as (select l_orderkey // 1000 as z, l_suppkey % 16 as y, l_partkey % 16 as x, cast(sum(l_linenumber * 7 + cast(round(l_discount * 100) as bigint)) as bigint) % 256 as v from lineitem group by 1, 2, 3)",
    "volf": "volf as (select vec_id // 16 as z, vec_id % 16 as y, cast(i - 1 as bigint) as x, round(cast(embedding[i] as double), 4) as v from embeddings, unnest(range(1, 65)) t(i) where i <= len(embedding))",
    "surf": "surf as (select p_partkey // 40 as row, p_partkey % 40 as col, cast(p_partkey % 40 as double) as x, cast(p_partkey // 40 as double) as y, cast(p_size % 7 + p_retailprice / 1e4 as double) as z from part)",
    "surf2": "surf2 as (select p_partkey // 40 as row, p_partkey % 40 as col, cast(p_partkey % 40 as double) as x, cast(p_partkey // 40 as double) as y, cast(p_size % 7 + p_retailprice / 1e4 + p_size as double) as z from part)",
    "edges": "edges as (select l_suppkey // 10 as src, 100000 + l_partkey % 50 as dst, cast(count(*) as double) / 200 as weight, cast(360 as double) as k from lineitem group by 1, 2)",
    "reviews": "reviews as (select o_orderkey as id, o_custkey % 100 as surface_id, o_custkey as reviewer_id, case o_orderstatus when 'F' then 1 when 'P' then 2 else 0 end as status, cast(epoch(o_orderdate) as bigint) as ts from orders)",
    "segments": "segments as (select s_suppkey as id, 'vol-' || s_nationkey as volume_id, s_name as name, '/surfaces/' || lower(s_name) || '.obj' as surface_path from supplier)",
    "annotations": "annotations as (select doc_id as id, doc_id % 10 as segment_id, case when toxic = 1 then 'circle' when quality = 1 then 'point' else 'line' end as type, '{\"quality\":' || quality || ',\"toxic\":' || toxic || '}' as data_json from labels)",
    "collab": "collab as (select event_id, user_id, epoch_us(ts) // 1000 as ts_ms, case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as edit_type, props as payload, value from events)",
    "projects": "projects as (select 'entry-' || doc_id as name, '/data/' || lang || '/' || doc_id as path, case doc_id % 4 when 0 then 'segments' when 1 then 'zarr_volume' when 2 then 'tiff_stack' else 'normal_grid' end as type, doc_id % 5 = 0 as is_remote, [lang, source] as tags, doc_id as id from documents)",
    "box": "box(" + ", ".join(c if c == "fid" else f"{c[0]}_{c[1]}" for c in BOX_COLUMNS) + ") as (values " + ", ".join("(" + ", ".join(f"{x!r}::double" if isinstance(x, float) else str(x) for x in r) + ")" for r in box_rows()) + ")",
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` (a select, or further CTEs and a select) behind the named views."""
    head = ", ".join(SQL[n] for n in names)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {head}, {body[15:]}"
    return f"with {head}, {body[5:]}" if body.lower().startswith("with ") else f"with {head} {body}"
