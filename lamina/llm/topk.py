"""Exact top-k inner-product search with norm buckets (operator 10).

Vectors are sorted by length into blocks, and each block into small buckets. For a query whose k-th best
score so far is t, a bucket whose longest vector is l has the local cosine threshold t / (|q| l): above 1
the bucket is skipped; when it is high, coordinate pruning keeps only vectors whose normalised focus
coordinates can still reach it; otherwise length pruning keeps the prefix of vectors long enough. What
survives is verified with exact products. Pruning only ever uses strict bounds, so ties are exact too.

Edge cases: null vectors and vectors with a null or non-finite component take no part, neither as query nor
as candidate; vectors of different dimension are never compared; vectors of dimension 0 score 0 with each
other; rows of a repeated id are queries and candidates of their own (each such query gets its ``k`` rows, and only the row itself
is left out); null ids take no part; extra columns are not read; empty input gives an empty result. Scaled components beyond +-2**62 count as +-2**62, and scores
beyond the range of long are clipped to it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

#: Rows of one stored block, queries of one query block (a candidate block is sent once for each), queries worked on together, rows of one bucket inside a block.
BLOCK_ROWS, QUERY_ROWS, TOGETHER, BUCKET_ROWS = 16384, 8192, 1024, 2048
#: Stored blocks that may share a key in the join of blocks.
GROUP_BLOCKS = 256
#: Local cosine threshold from which coordinates prune better than lengths, and the focus coordinates used.
COORDINATE_FROM, FOCUS = 0.5, 4
#: Products are exact in float64 while |q| |p| stays below this.
EXACT64, EXACT32 = 2.0**53, 2.0**24

_TYPES = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}


def _narrow(q: np.ndarray) -> np.ndarray:
    top = int(np.abs(q).max(initial=0))
    return q.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64)


def _quantised(scale: float):
    def run(batches):
        for b in batches:
            ids, vecs = b.column(0), b.column(1)
            flat, at = vecs.flatten(), np.asarray(vecs.value_lengths().fill_null(0))
            values = np.floor(scale * np.asarray(flat.cast(pa.float64()).fill_null(math.nan), dtype=np.float64))
            ends = np.cumsum(at)
            bad = np.add.reduceat(np.append(~np.isfinite(values), False), np.minimum(ends - at, len(values))) if len(at) else np.zeros(0)
            bad = np.where(at > 0, bad, 0).astype(bool)
            null = np.asarray(vecs.is_null()) | np.asarray(ids.is_null())
            rows, asked = b.column(2).to_pylist(), b.column(3).to_pylist()
            out = {"row": [], "vec_id": [], "asked": [], "dim": [], "norm": [], "data": []}
            for i in np.flatnonzero(~(bad | null)):
                v = np.clip(values[ends[i] - at[i] : ends[i]], -(2.0**62), 2.0**62).astype(np.int64)
                f = v.astype(np.float64)
                out["row"].append(rows[i])
                out["asked"].append(asked[i])
                out["vec_id"].append(ids[int(i)].as_py())
                out["dim"].append(int(at[i]))
                out["norm"].append(float(np.sqrt(f @ f)))
                out["data"].append(_narrow(v).tobytes())
            yield pa.record_batch([pa.array(out["row"], pa.int64()), pa.array(out["vec_id"], pa.int64()), pa.array(out["asked"], pa.bool_()), pa.array(out["dim"], pa.int32()), pa.array(out["norm"], pa.float64()), pa.array(out["data"], pa.binary())], names=list(out))

    return run


_BLOCK = "block long, dim int, n int, width int, norms binary, rows binary, ids binary, data binary, longest double"


def _packed(rows: int):
    """Blocks of at most ``rows`` vectors from rows sorted by dimension and falling length."""

    def run(batches):
        from pyspark import TaskContext

        part, made, held = TaskContext.get().partitionId(), 0, []

        def block(part_rows):
            nonlocal made
            dim = part_rows[0][1]
            m = _narrow(np.stack([np.frombuffer(x[3], _TYPES[len(x[3]) // dim] if dim else np.int16).astype(np.int64) for x in part_rows]))
            norms = np.array([x[2] for x in part_rows])
            made += 1
            return {"block": (part << 32) + made, "dim": dim, "n": len(part_rows), "width": m.dtype.itemsize, "norms": norms.tobytes(), "rows": np.array([x[4] for x in part_rows], np.int64).tobytes(), "ids": np.array([x[0] for x in part_rows], np.int64).tobytes(), "data": m.tobytes(), "longest": float(norms.max())}

        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (len(held) == rows or held[0][1] != x[1]):
                    yield _batch([block(held)])
                    held = []
                held.append(x)
        if held:
            yield _batch([block(held)])

    return run


def _batch(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("norms", pa.binary()), ("rows", pa.binary()), ("ids", pa.binary()), ("data", pa.binary()), ("longest", pa.float64())])
    return pa.RecordBatch.from_pylist(rows, schema)


class Block:
    """Vectors of one dimension, longest first."""

    def __init__(self, n, dim, width, norms, rows, ids, data):
        """``rows`` tell rows of one id apart."""
        self.rows, self.ids, self.norms = np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(norms, np.float64)
        self.m = np.frombuffer(data, _TYPES[width]).reshape(n, dim)

    def part(self, first: int, upto: int) -> "Block":
        out = Block.__new__(Block)
        out.rows, out.ids, out.norms, out.m = self.rows[first:upto], self.ids[first:upto], self.norms[first:upto], self.m[first:upto]
        return out


def products(q: np.ndarray, p: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer products of all rows; ``bound`` is at least |q| |p|."""
    if bound < EXACT32:
        return (q.astype(np.float32) @ p.astype(np.float32).T).astype(np.int64)
    if bound < EXACT64:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ p.astype(object).T if q.shape[1] else np.zeros((len(q), len(p)), object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def search(queries: Block, block: Block, k: int, floor: np.ndarray, first: int = 0, upto: int | None = None):
    """Best ``k`` of ``block`` for each query as (query index, ids, scores); ``floor``: known lower bounds of the k-th score, -inf if none.

    Queries are worked on ``TOGETHER`` at a time.
    """
    if upto is None:
        return [x for at in range(0, len(queries.ids), TOGETHER) for x in search(queries, block, k, floor, at, min(at + TOGETHER, len(queries.ids)))]
    queries, floor = queries.part(first, upto), floor[first:upto]
    nq = upto - first
    best_s = np.full((nq, k), np.iinfo(np.int64).min, np.int64)
    best_i = np.full((nq, k), np.iinfo(np.int64).max, np.int64)
    got = np.zeros(nq, int)
    qn = queries.norms
    unit = queries.m / np.maximum(qn, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
    slack = 1 + 1e-9
    for at in range(0, len(block.ids), BUCKET_ROWS):
        end = min(at + BUCKET_ROWS, len(block.ids))
        lengths, ids, rows, p = block.norms[at:end], block.ids[at:end], block.rows[at:end], block.m[at:end]
        theta = np.where(got >= k, np.maximum(floor, best_s[:, -1].astype(float)), floor)
        reach = qn * lengths[0] * slack + 1e-9
        live = np.flatnonzero(reach >= theta)
        if not len(live):
            continue
        local = np.where(reach[live] > 0, theta[live] / reach[live], -1.0)
        by_coordinate = live[local >= COORDINATE_FROM] if block.m.shape[1] else live[:0]
        by_length = live[~np.isin(live, by_coordinate)]
        if len(by_length):
            need = np.where(qn[by_length] > 0, theta[by_length] / np.maximum(qn[by_length] * slack, 1e-300), -np.inf)
            upto = np.searchsorted(-lengths, -(need - 1e-9), side="right")
            last = int(upto.max(initial=0))
            if last:
                s = products(queries.m[by_length], p[:last], float(qn[by_length].max() * lengths[0]))
                _merge(best_s, best_i, got, by_length, np.broadcast_to(ids[:last], s.shape), rows[None, :last], s, k, queries.rows, theta, np.arange(last)[None, :] < upto[:, None])
        if len(by_coordinate):
            pu = p / np.maximum(lengths, 1e-300)[:, None]
            for q in by_coordinate:
                f, t = focus[q], min(1.0, theta[q] / max(reach[q], 1e-300))
                a = unit[q, f]
                # a vector with cosine >= t has a coordinate x with a x + sqrt(1-a^2) sqrt(1-x^2) >= t
                x = pu[:, f]
                fits = (a * x + np.sqrt(np.maximum(0, 1 - a * a)) * np.sqrt(np.maximum(0, 1 - x * x)) >= t - 1e-9).all(axis=1)
                c = np.flatnonzero(fits & (lengths * qn[q] * slack + 1e-9 >= theta[q]))
                if len(c):
                    s = products(queries.m[q : q + 1], p[c], float(qn[q] * lengths[0]))
                    _merge(best_s, best_i, got, np.array([q]), ids[c][None, :], rows[c][None, :], s, k, queries.rows, theta, None)
    return [(first + q, best_i[q, : got[q]], best_s[q, : got[q]]) for q in range(nq) if got[q]]


def _merge(best_s, best_i, got, rows, ids, keys, s, k, own, theta, allowed):
    ok = (keys != own[rows][:, None]) & (s >= theta[rows][:, None])
    if allowed is not None:
        ok &= allowed
    for j in np.flatnonzero(ok.any(axis=1)):
        q, c = rows[j], np.flatnonzero(ok[j])
        sc, ic = s[j, c], ids[j, c]
        if len(c) > 4 * k:  # keep everything that ties with the k-th
            kth = -np.partition(-sc, k - 1)[k - 1]
            sc, ic = sc[sc >= kth], ic[sc >= kth]
        sc, ic = np.concatenate([best_s[q, : got[q]], sc]), np.concatenate([best_i[q, : got[q]], ic])
        order = np.lexsort((ic, -sc))[:k]
        got[q] = len(order)
        best_s[q, : got[q]], best_i[q, : got[q]] = sc[order], ic[order]


def _searched(k: int):
    def run(batches):
        for b in batches:
            out = {"row": [], "query_id": [], "vec_id": [], "score": []}
            for r in b.to_pylist():
                queries = Block(r["q_n"], r["dim"], r["q_width"], r["q_norms"], r["q_rows"], r["q_ids"], r["q_data"])
                floor = np.frombuffer(r["q_floor"], np.float64) if r["q_floor"] else np.full(r["q_n"], -np.inf)
                for q, ids, scores in search(queries, Block(r["n"], r["dim"], r["width"], r["norms"], r["rows"], r["ids"], r["data"]), k, floor):
                    out["row"] += [int(queries.rows[q])] * len(ids)
                    out["query_id"] += [int(queries.ids[q])] * len(ids)
                    out["vec_id"] += ids.tolist()
                    out["score"] += scores.tolist()
            yield pa.record_batch([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    return run


def _floored(k: int):
    """The query blocks with their k-th scores in the longest block of their dimension."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                queries, floor = Block(r["n"], r["dim"], r["width"], r["norms"], r["rows"], r["ids"], r["data"]), np.full(r["n"], -np.inf)
                if r["s_n"]:
                    for q, ids, scores in search(queries, Block(r["s_n"], r["dim"], r["s_width"], r["s_norms"], r["s_rows"], r["s_ids"], r["s_data"]), k, floor.copy()):
                        if len(ids) == k:
                            floor[q] = scores[-1]
                need = np.where(queries.norms > 0, floor / np.maximum(queries.norms, 1e-300), np.where(floor <= 0, -np.inf, np.inf))
                yield pa.RecordBatch.from_pylist(
                    [{"q_block": r["block"], "dim": r["dim"], "q_n": r["n"], "q_width": r["width"], "q_norms": r["norms"], "q_rows": r["rows"], "q_ids": r["ids"], "q_data": r["data"], "q_floor": floor.tobytes(), "needs": float(need.min())}],
                    pa.schema([("q_block", pa.int64()), ("dim", pa.int32()), ("q_n", pa.int32()), ("q_width", pa.int32()), ("q_norms", pa.binary()), ("q_rows", pa.binary()), ("q_ids", pa.binary()), ("q_data", pa.binary()), ("q_floor", pa.binary()), ("needs", pa.float64())]),
                )

    return run


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each row that ``is_query`` marks, the ``k`` other rows with the highest integer inner product of floor(``scale`` * x).

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id. All rows are candidates. Query
    blocks meet candidate blocks by an equi-join on dimension and group of blocks; a pair of blocks whose lengths cannot
    reach the queries' lower bounds is dropped before any vector is sent.
    """
    rows = df.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>"), F.monotonically_increasing_id(), F.coalesce(is_query, F.lit(False)))
    # written once, so that a row keeps its key
    vectors = materialize(rows.mapInArrow(_quantised(scale), "row long, vec_id long, asked boolean, dim int, norm double, data binary"), "quantised")
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(vectors.count() / BLOCK_ROWS))

    def blocks(x: DataFrame, n: int, size: int) -> DataFrame:
        order = ("dim", F.col("norm").desc(), "vec_id")
        return materialize(x.select("vec_id", "dim", "norm", "data", "row").repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_packed(size), _BLOCK), "vectors")

    stored = blocks(vectors, parts, BLOCK_ROWS)
    asked = blocks(vectors.where("asked"), max(1, parts // 4), QUERY_ROWS)
    longest = stored.groupBy("dim").agg(F.max_by("block", F.struct("longest", F.col("block") * -1)).alias("block"))
    seed = stored.join(longest, ["dim", "block"], "left_semi").select("dim", *[F.col(c).alias(f"s_{c}") for c in ("n", "width", "norms", "rows", "ids", "data")])
    queries = materialize(
        asked.join(seed, "dim", "left").mapInArrow(_floored(k), "q_block long, dim int, q_n int, q_width int, q_norms binary, q_rows binary, q_ids binary, q_data binary, q_floor binary, needs double"),
        "queries",
    )
    # blocks of one dimension are dealt into groups, so that no key meets all pairs
    groups = max(1, parts // GROUP_BLOCKS)
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group")
    met = queries.select("dim", "q_block", "needs", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))
    pairs = met.join(stored.select("dim", "block", "longest", group), ["dim", "group"]).where("longest * (1 + 1e-9) + 1e-9 >= needs").select("q_block", "block")
    met = pairs.join(stored, "block").join(queries.drop("dim", "needs"), "q_block")
    found = met.mapInArrow(_searched(k), "row long, query_id long, vec_id long, score long")
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    """Top 5 inner products for every fiftieth vector against all vectors."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
with v as (
  select vec_id, row_number() over () as r, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as q
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.r, a.vec_id as query_id, b.vec_id, cast(list_sum([a.q[i] * b.q[i] for i in range(1, len(a.q) + 1)]) as bigint) as score
  from v a join v b on a.r <> b.r and len(a.q) = len(b.q)
  where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by s.r order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""
