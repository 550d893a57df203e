"""Queries over the derived catalogs, logs and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.catalog import register
from lamina.operators import catalog as C
from lamina.operators.ranking import numbered
from lamina.plans.views import annotations, collab, projects, reviews, segments, surface, table, with_views


@register("wn_latest", with_views("select surface_id, id, status, ts from reviews qualify row_number() over (partition by surface_id order by ts desc, id desc) = 1", "reviews"))
def _latest(s, d):
    return C.latest(reviews(s, d), "surface_id", "ts", "id").select("surface_id", "id", "status", "ts")


@register("wn_versions", with_views("select surface_id, id, ts, row_number() over (partition by surface_id order by ts desc, id desc) as rank from reviews qualify rank <= 3", "reviews"))
def _versions(s, d):
    return C.newest(reviews(s, d), "surface_id", 3, "ts", "id").select("surface_id", "id", "ts", "rank")


@register("wn_ring", with_views("select event_id, user_id, ts_ms, edit_type from collab order by ts_ms desc, event_id desc limit 512", "collab"))
def _ring(s, d):
    return C.ring(collab(s, d), 512, "ts_ms", "event_id").select("event_id", "user_id", "ts_ms", "edit_type")


@register("ag_review_counts", with_views("select status, count(*) as n from reviews group by status", "reviews"))
def _review_counts(s, d):
    return reviews(s, d).groupBy("status").agg(F.count("*").alias("n"))


@register("jn_report", with_views("with l as (select surface_id, status, ts from reviews qualify row_number() over (partition by surface_id order by ts desc, id desc) = 1) select g.id, name, coalesce(status, 0) as status, ['Pending', 'Approved', 'Rejected', 'Needs changes'][coalesce(status, 0) + 1] as label, ts from segments g left join l on l.surface_id = g.id", "reviews", "segments"))
def _report(s, d):
    return C.report(segments(s, d), reviews(s, d))


@register("so_pending", with_views("select id, surface_id, ts from reviews where status = 0 order by ts, id limit 20", "reviews"))
def _pending(s, d):
    return reviews(s, d).where("status = 0").orderBy("ts", "id").limit(20).select("id", "surface_id", "ts")


@register("so_segments", with_views("select * from segments where volume_id = 'vol-7' order by id", "segments"))
def _segments(s, d):
    return segments(s, d).where("volume_id = 'vol-7'").orderBy("id")


@register("so_annotations", with_views("select * from annotations where segment_id = 3 order by id", "annotations"))
def _annotations(s, d):
    return annotations(s, d).where("segment_id = 3").orderBy("id")


@register("so_surface", with_views("select id, name, row_number() over (order by name desc, id) as place from segments", "segments"))
def _so_surface(s, d):
    return numbered(segments(s, d).select("id", "name"), F.desc("name"), F.col("id"), name="place", start=1)


@register("so_limit", with_views("select id from segments order by id limit 7", "segments"))
def _so_limit(s, d):
    return segments(s, d).orderBy("id").limit(7).select("id")


@register("so_umb", "select cast(p_size as double) as z, p_partkey as x, p_retailprice as y from part order by z, x")
def _so_umb(s, d):
    return table(s, d, "part").select(F.col("p_size").cast("double").alias("z"), F.col("p_partkey").alias("x"), F.col("p_retailprice").alias("y")).orderBy("z", "x")


_TOP = "select event_type as name, round(sum(value), 6) as total, round(avg(value), 9) as mean, max(value) as top, count(*) as n from events group by 1 order by sum(value) desc, name limit 3"


@register("ag_profile_top", _TOP)
def _profile(s, d):
    e = table(s, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.sum("value").alias("t"), F.avg("value").alias("m"), F.max("value").alias("top"), F.count("*").alias("n"))
    return e.orderBy(F.desc("t"), "name").limit(3).select("name", F.round("t", 6).alias("total"), F.round("m", 9).alias("mean"), "top", "n")


@register("so_topk", "select user_id, count(*) as n from events group by 1 order by n desc, user_id limit 10")
def _topk(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@register("so_recent", "select event_type, max(ts) as seen from events group by 1 order by seen desc, event_type limit 3")
def _recent(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.max("ts").alias("seen")).orderBy(F.desc("seen"), "event_type").limit(3)


@register("ag_counters", with_views("select edit_type, cast(sum(case when event_id % 3 = 0 then -1 else 1 end) as bigint) as value from collab group by 1", "collab"))
def _counters(s, d):
    return collab(s, d).groupBy("edit_type").agg(F.sum(F.when(F.col("event_id") % 3 == 0, -1).otherwise(1)).alias("value"))


@register("ag_cache_level", with_views("select edit_type as level, count(*) as reads, sum(case when event_id % 4 <> 0 then 1 else 0 end)::bigint as hits, round(sum(case when event_id % 4 <> 0 then 1 else 0 end) / cast(count(*) as double), 9) as hit_rate from collab group by 1", "collab"))
def _cache(s, d):
    hit = (F.col("event_id") % 4 != 0).cast("int")
    return collab(s, d).groupBy(F.col("edit_type").alias("level")).agg(F.count("*").alias("reads"), F.sum(hit).alias("hits"), F.round(F.sum(hit) / F.count("*"), 9).alias("hit_rate"))


@register("ag_approval_coverage", with_views("select surface_id, round(avg(case when status = 1 then 1e0 else 0e0 end), 9) as coverage from reviews group by 1", "reviews"))
def _coverage(s, d):
    return reviews(s, d).groupBy("surface_id").agg(F.round(F.avg((F.col("status") == 1).cast("double")), 9).alias("coverage"))


@register("ag_proof_stats", with_views("select count(*) as n, count(*) filter (status = 0) as pending, count(*) filter (status = 1) as approved, count(*) filter (status = 2) as rejected from reviews", "reviews"))
def _proof(s, d):
    return reviews(s, d).agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == k).alias(x) for k, x in enumerate(("pending", "approved", "rejected"))])


@register("ml_proofread", with_views("with l as (select surface_id, status from reviews qualify row_number() over (partition by surface_id order by ts desc, id desc) = 1) select id, name from segments where id in (select surface_id from l where status = 1)", "reviews", "segments"))
def _export(s, d):
    good = C.latest(reviews(s, d), "surface_id", "ts", "id").where("status = 1").select(F.col("surface_id").alias("id"))
    return segments(s, d).join(good, "id", "left_semi").select("id", "name")


@register("flt_by_type", with_views("select name, path from projects where type = 'zarr_volume' order by id limit 25", "projects"))
def _by_type(s, d):
    return projects(s, d).where("type = 'zarr_volume'").orderBy("id").limit(25).select("name", "path")


@register("flt_by_tag", with_views("select name, type from projects where list_contains(tags, 'src3')", "projects"))
def _by_tag(s, d):
    return projects(s, d).where(F.array_contains("tags", "src3")).select("name", "type")


@register("flt_count_type", with_views("select type, is_remote, count(*) as n from projects group by 1, 2", "projects"))
def _count_type(s, d):
    return projects(s, d).groupBy("type", "is_remote").agg(F.count("*").alias("n"))


@register("flt_substring", with_views("select name, path from projects where contains(name, '-12') or contains(path, '-12')", "projects"))
def _substring(s, d):
    return C.search(projects(s, d), "-12").select("name", "path")


@register("flt_console", with_views("select event_id, edit_type, payload from collab where edit_type >= 2 and lower(payload) like '%7%' order by event_id desc limit 50", "collab"))
def _console(s, d):
    return collab(s, d).where((F.col("edit_type") >= 2) & F.lower("payload").contains("7")).orderBy(F.desc("event_id")).limit(50).select("event_id", "edit_type", "payload")


@register("flt_file_ext", with_views("select name, is_remote, row_number() over (order by is_remote desc, name) as place from projects where path like '%/1%'", "projects"))
def _file_ext(s, d):
    return projects(s, d).where("path like '%/1%'").select("name", "is_remote").transform(numbered, F.desc("is_remote"), F.col("name"), name="place", start=1)


@register("map_split_tags", with_views("select name, list_sort(list_filter(case when list_contains(tags, 'scan') then tags else list_append(tags, 'scan') end, lambda t: t <> 'en')) as tags from projects", "projects"))
def _tags(s, d):
    return projects(s, d).select("name", F.array_sort(C.untag(C.tag(F.col("tags"), "scan"), "en")).alias("tags"))


@register("map_json_extract", with_views("select event_id, cast(json_extract_string(payload, '$.k') as bigint) as k from collab", "collab"))
def _json(s, d):
    return collab(s, d).select("event_id", F.get_json_object("payload", "$.k").cast("long").alias("k"))


@register("map_fmt", "select doc_id, case when n_chars < 1024 then printf('%d B', n_chars) when n_chars < 1048576 then printf('%.1f KB', round(n_chars / 1024e0, 1)) else printf('%.1f MB', round(n_chars / 1048576e0, 1)) end as size, strftime(make_timestamp(n_chars * 1000000000), '%Y-%m-%d %H:%M UTC') as at, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as safe from documents")
def _fmt(s, d):
    at = F.date_format(F.timestamp_seconds(F.col("n_chars") * 1000), "yyyy-MM-dd HH:mm 'UTC'")
    return table(s, d, "documents").select("doc_id", C.size_label(F.col("n_chars")).alias("size"), at.alias("at"), C.html_escape(F.col("text")).alias("safe"))


@register("map_nice_scale", "select p_partkey, case when p_retailprice / pow(10, floor(log10(p_retailprice))) >= 5 then 5 * pow(10, floor(log10(p_retailprice))) when p_retailprice / pow(10, floor(log10(p_retailprice))) >= 2 then 2 * pow(10, floor(log10(p_retailprice))) else pow(10, floor(log10(p_retailprice))) end as nice from part")
def _nice(s, d):
    return table(s, d, "part").select("p_partkey", C.nice_scale(F.col("p_retailprice")).alias("nice"))


@register("map_hash")
def _hash(s, d):
    """FNV-1a has no SQL form in DuckDB without wide products; tests hold it against a plain loop."""
    return table(s, d, "supplier").select("s_suppkey", C.fnv1a(F.col("s_name")).alias("hash"))


@register("dml_segment", with_views("select 'segment' as kind, count(*) as n from segments where id % 7 <> 0 union all select 'annotation', count(*) from annotations where segment_id not in (select id from segments where id % 7 = 0) union all select 'gone', count(*) from segments where id % 7 = 0", "segments", "annotations"))
def _dml_segment(s, d):
    left, notes, gone = C.delete_segment(segments(s, d), annotations(s, d), F.col("id") % 7 == 0)
    n = lambda df, kind, c=None: df.agg((F.count("*") if c is None else F.max(c)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(left, "segment").unionByName(n(notes, "annotation")).unionByName(n(gone, "gone", "changed"))


@register("dml_annotation", with_views("select * from annotations where id % 5 <> 0 union all select 1000000 + id, segment_id, 'text', '{}' from annotations where id % 50 = 0", "annotations"))
def _dml_annotation(s, d):
    a = annotations(s, d)
    gone = a.where("id % 5 = 0").select("id")
    added = a.where("id % 50 = 0").select((F.lit(1000000) + F.col("id")).alias("id"), "segment_id", F.lit("text").alias("type"), F.lit("{}").alias("data_json"))
    return a.join(gone, "id", "left_anti").unionByName(added)


@register("dml_review", with_views("select id, surface_id, case when id % 3 = 0 then 2 else status end as status, case when id % 3 = 0 then ts + 60 else ts end as ts from reviews", "reviews"))
def _dml_review(s, d):
    r = reviews(s, d).select("id", "surface_id", "status", "ts", F.lit(0).alias("seq"))
    edits = r.where("id % 3 = 0").select("id", "surface_id", F.lit(2).alias("status"), (F.col("ts") + 60).alias("ts"), F.lit(1).alias("seq"))
    return C.apply_reviews(r.unionByName(edits))


@register("dml_version", with_views("select row, col, z from surf2", "surf2"))
def _dml_version(s, d):
    log = surface(s, d).withColumn("version_id", F.lit(1)).unionByName(surface(s, d, True).withColumn("version_id", F.lit(2)))
    head = log.agg(F.max("version_id").alias("version_id"))
    return log.join(F.broadcast(head), "version_id").select("row", "col", "z")


@register("jn_version_diff", with_views("select a.row, a.col, b.x - a.x as dx, b.y - a.y as dy, round(b.z - a.z, 9) as dz from surf a join surf2 b on a.row = b.row and a.col = b.col", "surf", "surf2"))
def _version_diff(s, d):
    a, b = surface(s, d).alias("a"), surface(s, d, True).alias("b")
    return a.join(b, ["row", "col"]).select("row", "col", (F.col("b.x") - F.col("a.x")).alias("dx"), (F.col("b.y") - F.col("a.y")).alias("dy"), F.round(F.col("b.z") - F.col("a.z"), 9).alias("dz"))


@register("dml_hamt", with_views("select user_id as key, arg_max(value, event_id) as value from collab where event_id <= 500 and edit_type <> 4 group by 1", "collab"))
def _hamt(s, d):
    log = collab(s, d).where("edit_type <> 4").select(F.col("event_id").alias("version"), F.col("user_id").alias("key"), "value")
    return C.snapshot(log, 500)


@register("dml_hashmap", with_views("select edit_type, map_from_entries(list((user_id, n) order by user_id)) as m from (select edit_type, user_id, count(*) as n from collab group by 1, 2) group by 1", "collab").replace("map_from_entries(list((user_id, n) order by user_id)) as m", "string_agg(user_id || ':' || n, ',' order by user_id) as m"))
def _hashmap(s, d):
    g = collab(s, d).groupBy("edit_type", "user_id").agg(F.count("*").alias("n"))
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("user_id", "n"))))
    return g.groupBy("edit_type").agg(m.alias("m")).select("edit_type", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("m"))


@register("dml_git", with_views("select id, surface_id, ts, status from reviews qualify row_number() over (partition by surface_id order by ts desc, id desc) <= 10", "reviews"))
def _git(s, d):
    w = Window.partitionBy("surface_id").orderBy(F.desc("ts"), F.desc("id"))
    return reviews(s, d).withColumn("n", F.row_number().over(w)).where("n <= 10").select("id", "surface_id", "ts", "status")


@register("map_settings", "select n_name as name, coalesce(case when n_nationkey % 4 = 0 then 'project' end, case when n_nationkey % 3 = 0 then 'global' end, 'default') as value from nation")
def _settings(s, d):
    n = table(s, d, "nation")
    layer = lambda f, v: n.where(f).select(F.col("n_name").alias("name"), F.lit(v).alias("value"))
    return C.layered(layer("n_nationkey % 4 = 0", "project"), layer("n_nationkey % 3 = 0", "global"), layer("true", "default"))


for _rule, _sql in (("ours", "case when o.key is not null then o.value else x.value end"), ("theirs", "case when x.key is not null then x.value else o.value end"), ("merge", "case when x.key is null or o.version > x.version then o.value else x.value end")):
    register(f"sm_conflict_{_rule}", f"with o as (select user_id as key, max(event_id) as version, arg_max(value, event_id) as value from events where event_type = 'click' group by 1), x as (select user_id as key, max(event_id) as version, arg_max(value, event_id) as value from events where event_type = 'view' group by 1) select coalesce(o.key, x.key) as key, {_sql} as value from o full join x on o.key = x.key")(
        lambda s, d, r=_rule: C.resolve(*[table(s, d, "events").where(F.col("event_type") == t).groupBy(F.col("user_id").alias("key")).agg(F.max("event_id").alias("version"), F.max_by("value", "event_id").alias("value")) for t in ("click", "view")], r)
    )


@register("sm_broadcast", with_views("select c.event_id, u.user_id as receiver from collab c join (select distinct user_id, ts_ms // 3600000 as h from collab) u on u.h = c.ts_ms // 3600000 and u.user_id <> c.user_id", "collab"))
def _broadcast(s, d):
    """An event goes to the other users who are there in its hour."""
    return C.fan_out(collab(s, d).withColumn("hour", F.expr("ts_ms div 3600000")), "hour")


@register("sm_handlers", with_views("select event_id, case when edit_type in (0, 1) and payload is not null then 'ack' when edit_type = 2 then 'chunk' else 'error' end as reply from collab", "collab"))
def _handlers(s, d):
    reply = F.when(F.col("edit_type").isin(0, 1) & F.col("payload").isNotNull(), "ack").when(F.col("edit_type") == 2, "chunk").otherwise("error")
    return collab(s, d).select("event_id", reply.alias("reply"))


@register("sm_presence", with_views("select user_id, max(ts_ms) as seen, (row_number() over (order by user_id) - 1) % 8 as colour from collab group by user_id qualify row_number() over (order by user_id) <= 64", "collab"))
def _presence(s, d):
    u = collab(s, d).groupBy("user_id").agg(F.max("ts_ms").alias("seen"))
    n = F.row_number().over(Window.orderBy("user_id"))
    return u.withColumn("n", n).where("n <= 64").select("user_id", "seen", ((F.col("n") - 1) % 8).cast("long").alias("colour"))


@register("sm_autocommit", with_views("select user_id, ts_ms // 3600000 as slot, count(*) as edits, max(ts_ms) as last_edit from collab group by 1, 2", "collab"))
def _autocommit(s, d):
    return collab(s, d).groupBy("user_id", F.floor(F.col("ts_ms") / 3600000).alias("slot")).agg(F.count("*").alias("edits"), F.max("ts_ms").alias("last_edit"))


@register("sm_locks")
def _locks(s, d):
    """All-or-nothing cell claims in event order; tests hold it against a plain loop."""
    from lamina.streaming.locks import grant

    e = collab(s, d)
    return grant(e.select((F.col("user_id") % 5).alias("surface_id"), "user_id", "ts_ms", F.col("event_id").alias("seq"), (F.col("value") % 1.0).alias("u"), ((F.col("event_id") * 7) % 20 / 20.0).alias("v"), F.lit(0.08).alias("r")))


@register("sm_windows", "select time_bucket(interval 10 minutes, ts) as start, event_type, count(*) as n from events group by 1, 2")
def _windows(s, d):
    g = table(s, d, "events").groupBy(F.window("ts", "10 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n")


@register("sm_sessions", "with l as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as fresh from events), g as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as g from l) select user_id, min(ts) as first, count(*) as n from g group by user_id, g")
def _sessions(s, d):
    g = table(s, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("first"), "n")


@register("src_s3_list", with_views("select path, length(path) as size from projects where lower(path) like '%/en/1%' and length(path) - length(replace(path, '/', '')) <= 4", "projects"))
def _s3_list(s, d):
    depth = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    return projects(s, d).where(F.lower("path").like("%/en/1%") & (depth <= 4)).select("path", F.length("path").cast("long").alias("size"))


@register("src_scan_dir", "select url, case when url like '%utm%' then 'tracked' when url like '%#%' then 'anchor' when url like '%?%' then 'query' else 'plain' end as kind from pages")
def _scan_dir(s, d):
    u = F.col("url")
    return table(s, d, "pages").select("url", F.when(u.contains("utm"), "tracked").when(u.contains("#"), "anchor").when(u.contains("?"), "query").otherwise("plain").alias("kind"))


@register("ml_batch", "select event_id, (event_id - (select min(event_id) from events)) // 32 as batch from events")
def _batch(s, d):
    e = table(s, d, "events").select("event_id")
    return e.join(F.broadcast(e.agg(F.min("event_id").alias("m")))).select("event_id", F.floor((F.col("event_id") - F.col("m")) / 32).alias("batch"))


@register("ml_two_stream", "with a as (select doc_id, row_number() over (order by doc_id) as i from labels), b as (select d.doc_id, row_number() over (order by d.doc_id) as i from documents d where d.doc_id not in (select doc_id from labels)) select a.doc_id as labelled, b.doc_id as unlabelled from a join b on a.i = b.i")
def _two_stream(s, d):
    lab = table(s, d, "labels").select("doc_id")
    un = table(s, d, "documents").select("doc_id").join(lab, "doc_id", "left_anti")
    n = lambda df, c: numbered(df.withColumnRenamed("doc_id", c), c, name="i")
    return n(lab, "labelled").join(n(un, "unlabelled"), "i").drop("i")
