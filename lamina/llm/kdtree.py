"""Sharding by a k-d tree over document metadata (operator 8), with DataFrame functions.

A node that holds more than one shard is split along its widest metadata dimension (its range over the whole
table's range) at the weighted median: the first row, in order of (dimension, hash, row key), with which the
running bytes reach the left side's share. Medians of all nodes of a level are found together: histograms
of up to 1024 bins narrow each node's interval until few rows are left, and only those are sorted. Ties of the
dimension are narrowed further by the hash, ties of the hash (repeated ids) by the row key, so a value that a third of all rows share is split like any other.

The driver holds the tree, a few numbers a node and as many nodes as shards, and ``CELLS`` bins of a level at most. Null metadata counts as -1, null
texts have size 1; rows of a null id are hashed by their row key; an empty table gives an empty result; dimensions are renamed, so any name serves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import bucket_count, bucket_of, bucket_offsets, order_key, order_key_sql
from .store import materialize

#: Bins of a node's histogram, bins of all nodes of a level (16 a node at least), rows that are sorted at once.
BINS, CELLS, SORTED_ROWS = 1024, 1 << 20, 4096
#: Sort key of rows in a node.
KEY = ("v", "h", "r")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def default_dimensions() -> dict[str, Column]:
    """Metadata as numbers: size, and fixed codes of source and language."""
    code = lambda c: F.coalesce(F.crc32(F.col(c).cast("binary")).cast("double"), F.lit(-1.0))
    return {"d0": F.col("size").cast("double"), "d1": code("source"), "d2": code("lang")}


def _pick(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """``df`` with its node's figures; one row a node, at most as many as shards."""
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, schema)), "node")


def split_points(slim: DataFrame, nodes: dict[int, dict]) -> dict[int, tuple]:
    """Per node the key of its weighted median; ``nodes`` maps node to dim, its range and need (bytes on the left). ``slim`` has node, size, h, r and the dimensions."""
    dims = sorted({x["dim"] for x in nodes.values()})
    val = F.coalesce(*[F.when(F.col("_dim") == d, F.col(d)) for d in dims])
    rows = materialize(_pick(slim, [(n, x["dim"]) for n, x in nodes.items()], "node long, _dim string").select("node", "size", "h", "r", val.alias("v")), "split")
    open_ = {n: {"box": [(x["lo"], x["hi"]), (0, 2**52), (0, 2**62)], "level": int(x["lo"] == x["hi"]), "before": 0, "need": x["need"], "n": x["n"]} for n, x in nodes.items()}
    ready: dict[int, dict] = {}
    while True:
        for n in [n for n, o in open_.items() if o["n"] <= SORTED_ROWS or (o["level"] == 2 and o["box"][2][0] == o["box"][2][1])]:
            ready[n] = open_.pop(n)
        if not open_:
            break
        bins = max(16, min(BINS, CELLS // len(open_)))
        at = lambda *cols: F.element_at(F.array(*[F.col(c).cast("double") for c in cols]), F.col("_level") + 1)
        lo, hi = at("_lo0", "_lo1", "_lo2"), at("_hi0", "_hi1", "_hi2")
        bin_ = F.least(F.lit(bins - 1), F.floor((at(*KEY) - lo) / (hi - lo) * bins)).cast("int")
        got = _inside(rows, open_).groupBy("node", bin_.alias("bin")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), *[f(c).alias(f"{c}_{k}") for c in KEY for k, f in (("lo", F.min), ("hi", F.max))]).collect()
        by: dict[int, list] = {}
        for g in sorted(got, key=lambda g: g["bin"]):
            by.setdefault(g["node"], []).append(g)
        for n, o in open_.items():
            run = o["before"]
            for g in by[n]:
                if run + g["s"] >= o["need"]:
                    box = [(g[f"{c}_lo"], g[f"{c}_hi"]) for c in KEY]
                    o["box"][o["level"] :] = box[o["level"] :]
                    while o["level"] < 2 and o["box"][o["level"]][0] == o["box"][o["level"]][1]:
                        o["level"] += 1
                    o |= {"before": run, "n": g["n"]}
                    break
                run += g["s"]
    run = F.sum("size").over(Window.partitionBy("node").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0))
    found = _inside(rows, ready).withColumn("_run", F.col("_before") + run).where(F.col("_run") >= F.col("_need"))
    return {r["node"]: tuple(r["k"]) for r in found.groupBy("node").agg(F.min(F.struct(*KEY)).alias("k")).collect()}


def _inside(rows: DataFrame, open_: dict) -> DataFrame:
    """Rows in their node's current interval."""
    narrow = [(n, o["level"], *[x for (lo, hi), kind in zip(o["box"], (float, int, int), strict=True) for x in (kind(lo), kind(hi))], int(o["before"]), float(o["need"])) for n, o in open_.items()]
    x = _pick(rows, narrow, "node long, _level int, _lo0 double, _hi0 double, _lo1 long, _hi1 long, _lo2 long, _hi2 long, _before long, _need double")
    return x.where(F.col("v").between(F.col("_lo0"), F.col("_hi0")) & ((F.col("_level") < 1) | F.col("h").between(F.col("_lo1"), F.col("_hi1"))) & ((F.col("_level") < 2) | F.col("r").between(F.col("_lo2"), F.col("_hi2"))))


def grow_tree(slim: DataFrame, dims: list[str], shards: int) -> list[dict]:
    """The splits, level by level: each maps a node to (dim, value, hash, row key, left's first shard ...). ``slim`` has size, h, id and ``dims``."""
    whole = slim.agg(*[f(d).alias(f"{d}_{k}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))]).first()
    if whole[0] is None:
        return []
    levels, kids = [], {0: (0, shards)}
    current = slim.withColumn("node", F.lit(0).cast("long"))
    while any(k > 1 for _, k in kids.values()):
        live = [n for n, (_, k) in kids.items() if k > 1]
        current_live = _pick(current, [(n,) for n in live], "node long")
        stats = current_live.groupBy("node").agg(F.sum("size").alias("s"), F.count("*").alias("n"), *[f(d).alias(f"{d}_{k}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))]).collect()
        asked = {}
        for r in stats:
            width = {d: (r[f"{d}_hi"] - r[f"{d}_lo"]) / (whole[f"{d}_hi"] - whole[f"{d}_lo"]) if whole[f"{d}_hi"] > whole[f"{d}_lo"] else 0.0 for d in dims}
            dim = max(dims, key=lambda d: width[d])  # noqa: B023  ties: the first
            k = kids[r["node"]][1]
            asked[r["node"]] = {"dim": dim, "need": r["s"] * (k // 2) / k, "n": r["n"], "lo": r[f"{dim}_lo"], "hi": r[f"{dim}_hi"]}
        level = {n: (asked[n]["dim"], *key) for n, key in split_points(current_live, asked).items()}
        levels.append(level)
        kids = {c: x for n, (first, k) in kids.items() for c, x in ({2 * n + 1: (first, k // 2), 2 * n + 2: (first + k // 2, k - k // 2)} if n in level else {n: (first, k)}).items() if n in level or k <= 1}
        current = descend(current, level)
    return [*levels, kids]


def descend(df: DataFrame, level: dict[int, tuple]) -> DataFrame:
    """Rows moved to their node of the next level; nodes without a split stay."""
    dims = sorted({x[0] for x in level.values()})
    cuts = df.sparkSession.createDataFrame([(n, *x) for n, x in level.items()], "node long, _dim string, _v double, _h long, _r long")
    x = df.join(F.broadcast(cuts), "node", "left")
    val = F.coalesce(*[F.when(F.col("_dim") == d, F.col(d)) for d in dims])
    left = F.struct(val.alias("v"), "h", "r") <= F.struct(F.col("_v").alias("v"), F.col("_h").alias("h"), F.col("_r").alias("r"))
    node = F.when(F.col("_dim").isNull(), F.col("node")).otherwise(F.when(left, 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2))
    return x.withColumn("node", node).drop("_dim", "_v", "_h", "_r")


def shard(df: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", seed: str = "kd") -> DataFrame:
    """``df``'s ids with size, text_crc32, shard and slot (position in the shard, gapless from 0).

    ``target_bytes`` sets the number of shards if ``shards`` is not given. Texts are read once; everything after works on a narrow table.
    """
    dims = {f"_kd{i}": c for i, c in enumerate((dimensions or default_dimensions()).values())}
    text = F.col(text_col)
    base = df.withColumn("size", text_bytes(text))
    slim = materialize(base.select(F.col(id_col).alias("id"), "size", F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.monotonically_increasing_id().alias("r"), *[c.alias(d) for d, c in dims.items()]).withColumn("h", F.when(F.col("id").isNull(), order_key(F.col("r"), seed=seed)).otherwise(order_key(F.col("id"), seed=seed))), "kd")
    if shards is None:
        shards = max(1, round((slim.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    *levels, leaves = grow_tree(slim, list(dims), shards) or [{0: (0, 1)}]
    x = slim.withColumn("node", F.lit(0).cast("long"))
    for level in levels:
        x = descend(x, level)
    x = _pick(x, [(n, first) for n, (first, _) in leaves.items()], "node long, shard int")
    placed = materialize(x.select("id", "size", "text_crc32", "shard", "h", "r"), "kd")
    b = bucket_of(F.col("h"), bucket_count(placed.count()))
    rows = placed.withColumn("_b", b)
    starts = bucket_offsets(rows, ["shard"], "_b", F.lit(1))
    w = Window.partitionBy("shard", "_b").orderBy("h", "r")
    return rows.join(starts, ["shard", "_b"]).withColumn("slot", F.col("before") + F.row_number().over(w) - 1).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")


def op8_kdtree(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return shard(docs, 8).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _sql(levels: int = 3, dims: tuple[str, ...] = ("d0", "d1", "d2")) -> str:
    """Three levels of exact weighted medians. DuckDB has no crc32, so it is spelled out over the bytes of a text."""
    byte = "[cast('0x' || b as ubigint) for b in regexp_extract_all(hex(encode({x})), '..')]"
    crc = "xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, {b}), lambda c, b: xor(c >> 8, t[cast(xor(c, b) & 255 as int) + 1])))"
    bits = "list_reduce(list_prepend(i::ubigint, [0::ubigint for _ in range(8)]), lambda c, z: case when c % 2 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end)"
    of = lambda x: crc.format(b=byte.format(x=x))
    sql = f"""with crc_table as (select list({bits} order by i) as t from range(256) r(i)),
  codes as (select x, cast(cast({of("x")} as bigint) as double) as code from (select source as x from documents union select lang from documents), crc_table where x is not null),
  n0 as (select doc_id, coalesce(octet_length(encode(text)), 0) + 1 as size, cast(coalesce({of("text")}, 0) as bigint) as text_crc32,
     {order_key_sql("doc_id", seed="kd")} as h, 0 as node,
     cast(coalesce(octet_length(encode(text)), 0) + 1 as double) as d0, coalesce(s.code, -1) as d1, coalesce(l.code, -1) as d2
     from documents cross join crc_table left join codes s on s.x = source left join codes l on l.x = lang)"""
    for i in range(levels):
        wide = ", ".join(f"(max({d}) - min({d})) / nullif((select max({d}) - min({d}) from n0), 0) as w_{d}" for d in dims)
        best = " ".join(f"when coalesce(w_{d}, 0) >= greatest({', '.join(f'coalesce(w_{e}, 0)' for e in dims)}) then '{d}'" for d in dims)
        sql += f""",
  x{i} as (select node, sum(size) / 2.0 as need, {wide} from n{i} group by node),
  y{i} as (select n.*, need, case dim {" ".join(f"when '{d}' then {d}" for d in dims)} end as v
     from n{i} n join (select node, need, case {best} end as dim from x{i}) x on x.node = n.node),
  r{i} as (select *, sum(size) over (partition by node order by v, h, doc_id) as run from y{i}),
  c{i} as (select node, min(row(v, h, doc_id)) as k from r{i} where run >= need group by node),
  n{i + 1} as (select doc_id, size, text_crc32, h, 2 * y.node + case when row(v, h, doc_id) <= k then 0 else 1 end as node, {", ".join(dims)} from y{i} y join c{i} c on c.node = y.node)"""
    return sql + f"""
  select doc_id, cast(size as bigint) as size, text_crc32, 'bytes' as law, cast(node as int) as shard,
    row_number() over (partition by node order by h, doc_id) - 1 as slot, cast(null as int) as grown_shard from n{levels}"""


OP8_SQL = _sql()
