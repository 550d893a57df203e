"""MinHash near-duplicates by an LSH forest (operator 2).

A text's set holds its distinct word shingles. Texts with equal sets form a class, of which the smallest id goes
on. Each class gets one key per tree: the minima of eight hash functions of its set. The keys of a tree are
sorted over the whole cluster, and neighbours with a long common prefix are candidates: all pairs of a region of
equal prefix if it is small; in a larger region the depth grows until the regions are small, and rows that agree in all
of it meet their successors. A group of thousands of copies so gives a few candidates per member and tree,
which connect it. Rows at the borders of sort partitions meet in a step of their own.
Candidates are confirmed on full sets, links are closed to components, and a component is named by its smallest id.

Rows of larger regions (``crowded``) are then joined exactly across the components found so far, by prefix filter: with shingles ordered
by rarity, two linked sets share one of their first n - ceil(percent * n / 100) + 1 shingles, at places that leave room for the
overlap, and parity bitmaps of the sets differ in no more bits than the sets may differ in shingles. So true links among many texts that share a passage are found, while a group of copies, one component by then, makes no pairs.

A pair at similarity s shares a prefix of ``DEPTH`` in a tree with probability s**3, and is then compared or in the exact join; over 12
trees a pair at 0.85 is missed once in about 100,000, one at 0.8 once in about 5,000.

Edge cases: null, empty and blank texts have an empty set and are linked with nothing; a text with fewer words
than a shingle is one shingle; where an id is null or repeated with different texts, rows are told apart by a key of their own
and a component is named by the smallest id of its rows (null if it has none); an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import materialize
from .textgrid import grids, mix

#: Trees, hash functions a tree, least common prefix, rows of a region that is compared in full.
TREES, LENGTH, DEPTH, SMALL = 12, 8, 3, 4
#: Buckets that count shingles for their order by rarity (any order is exact); rows of a shingle that meet in one block.
BUCKETS, CHUNK = 1 << 20, 1024
#: Bits of a set's parity bitmap; each shingle that only one of two sets holds changes at most one of them.
BITS = 512

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 2**63, TREES * LENGTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, TREES * LENGTH, dtype=np.uint64)


def shingles(g, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each text's distinct shingles, sorted by both."""
    h = g.hashes(g.starts, g.ends)
    n = len(h) - words + 1
    if n > 0:
        whole = g.row[:n] == g.row[words - 1 :]
        x = np.zeros(n, np.uint64)
        for k in range(words):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        row, value = g.row[:n][whole], x[whole]
    else:
        row, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((g.words > 0) & (g.words < words))
    if len(short):
        at = np.searchsorted(g.row, short)
        extra = np.array([_short(h[i : i + g.words[r]]) for r, i in zip(short, at, strict=True)], np.uint64)
        row, value = np.concatenate([row, short]), np.concatenate([value, extra])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _short(h: np.ndarray) -> np.uint64:
    x = np.full(1, len(h), np.uint64)
    for v in h:
        x = mix(x * np.uint64(0xD6E8FEB86659FD93) + v)
    return x[0]


def _signed(words: int):
    def run(batches):
        for b in batches:
            for g in grids(b.column(1)):
                row, value = shingles(g, words)
                n = np.bincount(row, minlength=g.rows) if len(row) else np.zeros(g.rows, int)
                full = np.flatnonzero(n)
                at = np.searchsorted(row, full)
                digest = np.zeros((2, g.rows), np.int64)
                keys = np.zeros((g.rows, TREES * LENGTH), ">u2")
                if len(full):
                    for k, salt in enumerate((0x1234567, 0x89ABCDEF)):
                        digest[k, full] = np.add.reduceat(mix(value + np.uint64(salt)), at).view(np.int64)
                    for j in range(TREES * LENGTH):
                        low = np.minimum.reduceat((value * _MULTIPLY[j] + _ADD[j]) >> np.uint64(16), at)
                        keys[full, j] = mix(low + np.uint64(j)) & np.uint64(0xFFFF)
                data = [[r[t * LENGTH : (t + 1) * LENGTH].tobytes() for t in range(TREES)] if n[i] else [] for i, r in enumerate(keys)]
                yield pa.record_batch([b.column(0).slice(g.first_row, g.rows), pa.array(n, pa.int64()), pa.array(digest[0]), pa.array(digest[1]), pa.array(data, pa.list_(pa.binary()))], names=["id", "n", "s1", "s2", "keys"])

    return run


def _crowded(tree: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Marks of sorted rows whose region of the least depth holds more than ``SMALL`` rows, or may go on before or behind them."""
    same = (tree[1:] == tree[:-1]) & (key[1:, :DEPTH] == key[:-1, :DEPTH]).all(1)
    cut = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
    many = np.diff(cut) > SMALL
    many[[0, -1]] = True
    return np.repeat(many, np.diff(cut))


def _pairs(tree: np.ndarray, key: np.ndarray, ids: np.ndarray):
    """Candidate pairs (positions) of rows in sorted order."""
    n = len(ids)
    if n < 2:
        return np.zeros(0, int), np.zeros(0, int)
    step = np.cumprod(key[1:] == key[:-1], axis=1).sum(1) * (tree[1:] == tree[:-1])  # common prefix with the next row
    size = np.zeros((LENGTH + 1, n), np.int32)  # rows of the region of each depth
    for d in range(DEPTH, LENGTH + 1):
        cut = np.flatnonzero(np.concatenate([[True], step < d, [True]]))
        size[d] = np.repeat(np.diff(cut), np.diff(cut))
    out_a, out_b, common = [], [], step.copy()
    for o in range(1, SMALL):
        i = np.arange(n - o)
        if o > 1:
            common = np.minimum(common[: n - o], step[o - 1 :])
        ok = common >= DEPTH
        if o > 1:
            ok &= size[common, i] <= SMALL
        out_a.append(i[ok])
        out_b.append(i[ok] + o)
    return np.concatenate(out_a), np.concatenate(out_b)


_CANDIDATES = "a long, b long, part int, at int, tree int, key binary"


def _neighbours(batches):
    """Pairs of neighbours, and the first and last rows of the partition with their place."""
    from pyspark import TaskContext

    part, seen, held, head = TaskContext.get().partitionId(), 0, None, None

    def cells(b):
        return np.asarray(b.column(0)), np.frombuffer(b"".join(b.column(1).to_pylist()), ">u2").reshape(-1, LENGTH), np.asarray(b.column(2))

    def made(a, b):
        n = len(a)
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["a", "b", "part", "at", "tree", "key"])

    def marked(ids):
        n = len(ids)
        return pa.record_batch([pa.array(ids), pa.nulls(n, pa.int64()), pa.array([-1] * n, pa.int32()), *[pa.nulls(n, pa.int32())] * 2, pa.nulls(n, pa.binary())], names=["a", "b", "part", "at", "tree", "key"])

    def border(rows, at):
        tree, key, ids = rows
        n = len(ids)
        return pa.record_batch([pa.array(ids), pa.nulls(n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int32()), pa.array(tree, pa.int32()), pa.array([k.tobytes() for k in key], pa.binary())], names=["a", "b", "part", "at", "tree", "key"])

    for b in batches:
        if not b.num_rows:
            continue
        rows = cells(b)
        old = 0 if held is None else len(held[2])
        if held is not None:
            rows = tuple(np.concatenate([x, y]) for x, y in zip(held, rows, strict=True))
        if head is None:
            head = tuple(x[: SMALL - 1] for x in rows)
        i, j = _pairs(*rows)
        new = j >= old
        yield made(rows[2][i[new]], rows[2][j[new]])
        yield marked(np.unique(rows[2][_crowded(*rows[:2])]))
        seen += b.num_rows
        held = tuple(x[-(SMALL - 1) :] for x in rows)
    if seen:
        yield border(head, 0)
        if seen > SMALL - 1:
            last = min(SMALL - 1, seen - (SMALL - 1))
            yield border(tuple(x[-last:] for x in held), seen - last)


def _borders(batches):
    rows = [r for b in batches for r in b.to_pylist()]
    if len(rows) > 1:
        key = np.frombuffer(b"".join(r["key"] for r in rows), ">u2").reshape(-1, LENGTH)
        ids = np.array([r["a"] for r in rows])
        i, j = _pairs(np.array([r["tree"] for r in rows]), key, ids)
        yield pa.record_batch([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], names=["a", "b"])


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs (a, b), a < b, of ``classes`` (id, keys), and the ids of rows in regions that are not compared in full."""
    spark = classes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = classes.select("id", F.posexplode("keys").alias("tree", "key")).select("tree", "key", "id")
    order = ("tree", "key", "id")
    near = materialize(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_neighbours, _CANDIDATES), "near")
    # a handful of rows for each sort partition
    edge = near.where("b is null and part >= 0").repartition(1).sortWithinPartitions("part", "at").select("a", "tree", "key").mapInArrow(_borders, "a long, b long")
    pairs = near.where("b is not null").select("a", "b").unionByName(edge).where("a <> b").distinct()
    return pairs, near.where("part = -1").select(F.col("a").alias("id")).distinct()


def _confirmed(words: int, percent: int):
    def run(batches):
        for b in batches:
            sets = []
            for c in (2, 3):
                out = []
                for g in grids(b.column(c)):
                    row, value = shingles(g, words)
                    at = np.searchsorted(row, np.arange(g.rows + 1))
                    out += [value[at[i] : at[i + 1]] for i in range(g.rows)]
                sets.append(out)
            both = np.array([np.intersect1d(x, y, assume_unique=True).size for x, y in zip(*sets, strict=True)], np.int64)
            union = np.array([x.size + y.size for x, y in zip(*sets, strict=True)], np.int64) - both
            ok = pa.array((100 * both >= percent * union) & (both > 0))
            yield pa.record_batch([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    return run


def _bucket(value: np.ndarray) -> np.ndarray:
    return (mix(value) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _counted(words: int):
    def run(batches):
        for b in batches:
            for g in grids(b.column(0)):
                at, n = np.unique(_bucket(shingles(g, words)[1]), return_counts=True)
                yield pa.record_batch([pa.array(at), pa.array(n.astype(np.int64))], names=["bucket", "c"])

    return run


_PARITY = [f"p{i}" for i in range(BITS // 64)]


def _prefixes(words: int, percent: int, counts):
    """(id, n, at, token, parity): each text's rarest shingles, of which two linked texts share one, and their places from 0."""

    def run(batches):
        often = counts.value
        for b in batches:
            for g in grids(b.column(1)):
                row, value = shingles(g, words)
                c = often[_bucket(value)]
                order = np.lexsort((value, c, row))
                value, c = value[order], c[order]
                n = np.bincount(row, minlength=g.rows)
                at = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                need = (percent * n + 99) // 100
                odd = np.bincount(row * BITS + (mix(value + np.uint64(BITS)) & np.uint64(BITS - 1)).astype(np.int64), minlength=g.rows * BITS) & 1
                parity = np.packbits(odd.astype(np.uint8).reshape(g.rows, BITS), axis=1).view(np.int64)
                keep = (at < np.minimum(n - need + 1, n)[row]) & (c > 1)  # a shingle counted once stands in no other text
                ids = b.column(0).slice(g.first_row, g.rows).take(pa.array(row[keep]))
                yield pa.record_batch([ids, pa.array(n[row[keep]]), pa.array(at[keep]), pa.array(value[keep].view(np.int64)), *map(pa.array, parity[row[keep]].T)], names=["id", "n", "at", "token", *_PARITY])

    return run


def crowded_pairs(crowd: DataFrame, roots: DataFrame, words: int, percent: int) -> DataFrame:
    """Every pair (a, b), a < b, of ``crowd`` (id, text) that may be linked and is not in one component of ``roots`` (node, root)."""
    counts = np.ones(BUCKETS, np.int32)
    found = crowd.select("text").mapInArrow(_counted(words), "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).where("c > 1").toArrow()
    counts[np.asarray(found["bucket"])] = np.minimum(np.asarray(found["c"]), 2**31 - 1)
    shared = crowd.sparkSession.sparkContext.broadcast(counts)
    rows = crowd.select("id", "text").mapInArrow(_prefixes(words, percent, shared), "id long, n long, at long, token long, " + ", ".join(f"{c} long" for c in _PARITY))
    rows = materialize(rows.join(roots.withColumnRenamed("node", "id"), "id", "left").select("token", F.coalesce("root", "id").alias("root"), "id", "n", "at", *_PARITY), "prefixes")
    # a token's largest component does not meet itself: its rows are only met by those of the others
    by = rows.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("c"), F.count("*").alias("roots"))
    mixed = materialize(by.where("roots > 1").select("token", F.col("most.root").alias("main"), F.ceil(F.col("c") / CHUNK).cast("int").alias("chunks")), "mixed")
    all_rows = rows.join(mixed, "token")
    build = all_rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks")
    probe = all_rows.where("root <> main").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("token", "chunk", *[F.col(c).alias(f"_{c}") for c in ("root", "id", "n", "at", *_PARITY)])
    most = F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at"))  # overlap from this token on
    differ = reduce(add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in _PARITY])
    met = build.join(probe, ["token", "chunk"]).where(F.col("root") != F.col("_root")).where(differ * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("_n")))
    met = met.where((F.col("root") == F.col("main")) | (F.col("id") < F.col("_id"))).where(100 * most >= percent * (F.col("n") + F.col("_n") - most))
    return met.select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b")).distinct()


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_shingles, component_id and kept (the row names its component).

    Texts with 100 * |intersection| >= ``percent`` * |union| are linked. Whole texts are read once for their
    sets; those of candidates and of crowded rows are read again to confirm.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialize(texts.mapInArrow(_signed(words), "id long, n long, s1 long, s2 long, keys array<binary>"), "signed")
    same = ["s1", "s2", "n"]
    if not signed.groupBy("id").agg(F.min(F.struct(*same)).alias("x"), F.max(F.struct(*same)).alias("y")).where("id is null or x <> y").isEmpty():
        return _by_row(texts, words, percent, id_col)
    classes = materialize(signed.where("n > 0").groupBy(*same).agg(F.min("id").alias("id"), F.first("keys").alias("keys")), "classes")
    near, crowded = candidates(classes.select("id", "keys"))
    pairs = materialize(near, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id"), F.lit(False).alias("crowded")).unionByName(crowded.withColumn("crowded", F.lit(True))).groupBy("id").agg(F.max("crowded").alias("crowded"))
    # ``wanted`` grows with the input, so it is never broadcast; rows of one id have one text here
    few = materialize(texts.join(wanted.hint("merge"), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("crowded").alias("crowded")), "wanted")

    def confirmed(pairs):
        met = pairs.join(few.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(few.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
        return met.select("a", "b", "x", "y").mapInArrow(_confirmed(words, percent), "a long, b long")

    roots = connected_components(confirmed(pairs))
    more = materialize(crowded_pairs(few.where("crowded"), roots, words, percent), "more")
    if not more.isEmpty():
        more = materialize(confirmed(more), "more")
        if not more.isEmpty():
            roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    named = classes.select(*same, "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select(*same, F.coalesce("root", "id").alias("component_id"))
    out = signed.select("id", *same).join(named, same, "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _by_row(texts: DataFrame, words: int, percent: int, id_col: str) -> DataFrame:
    """``near_duplicates`` of (id, text) whose ids do not tell texts apart."""
    rows = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows, words, percent, "row", "text").select("row", "n_shingles", F.col("component_id").alias("root"))
    found = rows.select("row", "id").join(found, "row")
    names = found.groupBy("root").agg(F.min("id").alias("component_id"))
    return found.join(names, "root").select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one of the smallest id."""
    if docs.groupBy(id_col).count().where(f"count > 1 or {id_col} is null").isEmpty():
        gone = near_duplicates(docs, words, percent, id_col, text_col).where("not kept").select(id_col)
        return docs.join(gone, id_col, "left_anti").select(*docs.columns)
    # ids do not tell rows apart: rows in order of their id get a key
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows, words, percent, "_row", text_col)
    best = rows.select("_row", F.col(id_col).alias("_own")).join(found.select("_row", "component_id"), "_row").groupBy("component_id").agg(F.min(F.struct(F.col("_own").isNull(), "_own", "_row")).alias("m"))
    return rows.join(best.select(F.col("m._row").alias("_row")), "_row", "left_semi").select(*docs.columns)


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)


OP2_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) >= 3 then [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as sh from w),
n as (select doc_id, count(*) as n from s group by 1),
i as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
e as (select a as u, b as v from l union select b, a from l),
r as (select doc_id as u, doc_id as root from documents union select e.v, r.root from r join e on e.u = r.u),
c as (select u, min(root) as component_id from r group by u)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join n on n.doc_id = d.doc_id join c on c.u = d.doc_id
"""
