r"""Hard negatives by distributed radix selection (operator 12).

A *window* is an anchor with a range of scores, and asks for the first ``k`` rows whose score lies in it, highest first. A
selection never sorts or gathers the rows of a window. It narrows the range instead: every task counts the scores of its rows
in up to 256 equal bins of the range, the counts are added up per window and bin, and the bin in which the
k-th row falls becomes the new range (one digit of the score). That goes on until few rows lie above the range's
lower end, or the range is a single score. Only rows from that score on are gathered, of each task and window at most ``k`` (by
score, then id), so ties are exact and no group of equal rows gets large.

Mining uses it twice: the windows of all same-label rows give each anchor's positives, and the scores from ``low`` to ``high``
percent of a positive's give the windows of its negatives.

Vectors are stored as blocks of rows. Blocks of anchors meet groups of row blocks by an equi-join of their
numbers; scores live only inside the task in which they meet. Rows are dealt to blocks as they come, whatever their label,
so a label with most of all rows does no harm. Every round writes its windows to the shared folder.

Edge cases: rows with a null id, label or vector, or a null or non-finite component take no part; vectors of different dimension are
never compared; rows of a repeated id are rows of their own (each such anchor mines for itself, and only the row itself is no positive);
a negative positive score gives an empty window; scaled components beyond +-2**62 count as +-2**62 and
scores beyond +-(2**62 - 1) are clipped to it; labels wrap as given by ``label``; extra columns are not read; empty input gives an empty
result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize
from .topk import _TYPES, _narrow, products

#: Rows of a stored block, row blocks of a group, anchors of a block, anchors scored together.
BLOCK_ROWS, GROUP_BLOCKS, ANCHORS, TOGETHER = 4096, 64, 8192, 512
#: Bits of a digit; rows that may be gathered for each one asked for.
DIGIT, SPARE = 8, 8
#: Largest score.
TOP = 2**62 - 1

_ROW = "row long, vec_id long, label long, anchor boolean, dim int, norm double, data binary"
_BLOCK = "block long, dim int, n int, width int, longest double, rows binary, ids binary, labels binary, data binary"


def _quantised(scale: float):
    def run(batches):
        for b in batches:
            vecs = b.column(3)
            n = np.asarray(vecs.value_lengths().fill_null(0), np.int64)
            values = np.floor(scale * np.asarray(vecs.flatten().cast(pa.float64()).fill_null(math.nan), dtype=np.float64))
            ends = np.cumsum(n)
            broken = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            usable = (broken[ends] == broken[ends - n]) & ~np.asarray(vecs.is_null())
            for i in (1, 2):
                usable &= ~np.asarray(b.column(i).is_null())
            at = np.flatnonzero(usable)
            q = [np.clip(values[ends[i] - n[i] : ends[i]], -(2.0**62), 2.0**62).astype(np.int64) for i in at]
            norms = [float(np.sqrt(v.astype(np.float64) @ v.astype(np.float64))) for v in q]
            took = b.take(pa.array(at))
            yield pa.record_batch([took.column(0), took.column(1), took.column(2), took.column(4), pa.array(n[at], pa.int32()), pa.array(norms, pa.float64()), pa.array([_narrow(v).tobytes() for v in q], pa.binary())], names=["row", "vec_id", "label", "anchor", "dim", "norm", "data"])

    return run


def _matrix(data: list[bytes], dim: int) -> np.ndarray:
    if not dim:
        return np.zeros((len(data), 0), np.int16)
    return _narrow(np.stack([np.frombuffer(x, _TYPES[len(x) // dim]).astype(np.int64) for x in data]))


def _packed(batches):
    """Blocks of vectors of one dimension, from rows sorted by it."""
    from pyspark import TaskContext

    part, made, held = TaskContext.get().partitionId(), 0, None
    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("longest", pa.float64()), *((c, pa.binary()) for c in ("rows", "ids", "labels", "data"))])

    def block(t: pa.Table) -> pa.RecordBatch:
        nonlocal made
        made += 1
        dim = t["dim"][0].as_py()
        m = _matrix(t["data"].to_pylist(), dim)
        row = {"block": (part << 32) + made, "dim": dim, "n": len(m), "width": m.dtype.itemsize, "longest": float(np.max(t["norm"])), "data": m.tobytes()}
        return pa.RecordBatch.from_pylist([row | {k: np.asarray(t[c], np.int64).tobytes() for k, c in (("rows", "row"), ("ids", "vec_id"), ("labels", "label"))}], schema)

    for b in batches:
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        while held.num_rows:
            dims = np.asarray(held["dim"])
            same = int(np.searchsorted(dims, dims[0], side="right"))
            if same < BLOCK_ROWS and same == held.num_rows:
                break
            yield block(held.slice(0, min(same, BLOCK_ROWS)))
            held = held.slice(min(same, BLOCK_ROWS))
    if held is not None and held.num_rows:
        yield block(held)


def _scores(left: pa.Table, right: pa.Table, same: bool):
    """(anchors' positions, their scores, which of those count, the block's ids) of each tile of anchors and block of rows."""
    label, own, dims, norms = (np.asarray(left[c]) for c in ("label", "row", "dim", "norm"))
    low, high = np.asarray(left["least"]), np.asarray(left["most"])
    blocks = right.select(["dim", "n", "width", "longest", "rows", "ids", "labels", "data"]).to_pylist()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        m = _matrix(left["data"].take(pa.array(at)).to_pylist(), int(dim))
        for r in blocks:
            if r["dim"] != dim:
                continue
            p = np.frombuffer(r["data"], _TYPES[r["width"]]).reshape(r["n"], dim)
            rows, ids, labels = (np.frombuffer(r[c], np.int64) for c in ("rows", "ids", "labels"))
            for k in range(0, len(at), TOGETHER):
                a = at[k : k + TOGETHER]
                s = np.clip(products(m[k : k + TOGETHER], p, float(norms[a].max() * r["longest"] * (1 + 1e-9))), -TOP, TOP)
                ok = (label[a][:, None] == labels[None, :]) == same
                ok &= (s >= low[a][:, None]) & (s <= high[a][:, None]) & (rows[None, :] != own[a][:, None])
                yield a, s, ok, ids


def _counting(same: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        windows = left["windows"].to_pylist()
        counts = np.zeros((len(windows), max((len(w) for w in windows), default=0), 2 << DIGIT), np.int64)
        for a, s, ok, _ in _scores(left, right, same):
            for j in np.flatnonzero(ok.any(axis=1)):
                x = s[j, ok[j]]
                for w, win in enumerate(windows[a[j]]):
                    inside = x[(x >= win["lo"]) & (x <= win["hi"])]
                    if len(inside):
                        c = np.bincount((win["hi"] - inside) >> win["shift"])
                        counts[a[j], w, : len(c)] += c
        i, w, bins = np.nonzero(counts)
        row, slot = np.asarray(left["row"])[i] if len(i) else i, [windows[x][y]["slot"] for x, y in zip(i, w, strict=True)]
        return pa.table({"row": pa.array(row, pa.int64()), "slot": pa.array(slot, pa.int32()), "bin": pa.array(bins, pa.int32()), "n": pa.array(counts[i, w, bins], pa.int64())})

    return run


def _gathering(same: bool, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        windows, best = left["windows"].to_pylist(), {}
        for a, s, ok, ids in _scores(left, right, same):
            for j in np.flatnonzero(ok.any(axis=1)):
                x, y = s[j, ok[j]], ids[ok[j]]
                for w, win in enumerate(windows[a[j]]):
                    fits = (x >= win["lo"]) & (x <= win["hi"])
                    if fits.any():
                        had = best.get((a[j], w), (x[:0], y[:0]))
                        xs, ys = np.concatenate([had[0], x[fits]]), np.concatenate([had[1], y[fits]])
                        first = np.lexsort((ys, -xs))[:k]
                        best[a[j], w] = xs[first], ys[first]
        rows = np.asarray(left["row"])
        out = [(int(rows[i]), windows[i][w]["slot"], v, x) for (i, w), (xs, ys) in best.items() for x, v in zip(xs.tolist(), ys.tolist(), strict=True)]
        names = (("row", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64()))
        return pa.table({c: pa.array([o[i] for o in out], t) for i, (c, t) in enumerate(names)})

    return run


class Selection:
    """Anchors and rows, stored as blocks that can meet."""

    def __init__(self, df: DataFrame, is_anchor: Column, label: Column, scale: float, id_col: str, vec_col: str):
        spark = df.sparkSession
        rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
        # written once, so that a row keeps its key
        vectors = materialize(rows.mapInArrow(_quantised(scale), _ROW), "quantised")
        n, asked, self.longest = vectors.agg(F.count("*"), F.count_if("anchor"), F.max("norm")).first()
        self.rows = n
        cores = spark.sparkContext.defaultParallelism
        self.groups = max(math.ceil(n / (BLOCK_ROWS * GROUP_BLOCKS)), min(cores, math.ceil(n / BLOCK_ROWS)), 1)
        self.asks = max(1, math.ceil(asked / ANCHORS))
        vectors = vectors.withColumn("ask", F.pmod(F.xxhash64("row"), F.lit(self.asks)).cast("int"))
        self.anchors = vectors.where("anchor").drop("anchor")
        self.blocks = materialize(vectors.select("row", "vec_id", "label", "dim", "norm", "data").sortWithinPartitions("dim").mapInArrow(_packed, _BLOCK), "blocks")

    def _met(self, windows: DataFrame, kernel, schema: str) -> DataFrame:
        """``kernel(anchors with their windows, blocks)`` for each block of anchors and group of row blocks."""
        held = windows.groupBy("row").agg(F.collect_list(F.struct("slot", "lo", "hi", "shift")).alias("windows"), F.min("lo").alias("least"), F.max("hi").alias("most"))

        def every(n):
            return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

        left = self.anchors.join(held, "row").select("ask", "row", "label", "dim", "norm", "data", "windows", "least", "most", every(self.groups).alias("group"))
        right = self.blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(self.groups)).cast("int")).withColumn("ask", every(self.asks))
        return left.groupBy("ask", "group").cogroup(right.groupBy("ask", "group")).applyInArrow(kernel, schema)

    def first(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """(row, slot, rank, vec_id, score): the first ``k`` rows in each window (row, slot, lo, hi); of the anchor's label (``same``) or others'."""
        width = F.col("hi") - F.col("lo") + 1
        shift = F.greatest(F.lit(0), F.ceil(F.log2(width.cast("double"))).cast("int") - DIGIT)
        # rows seen above the range, and whether the range's lower end is low enough to gather from
        state = windows.where("lo <= hi").select("row", "slot", "lo", "hi", F.lit(0).cast("long").alias("above"), F.col("hi").alias("top"), F.lit(False).alias("done")).withColumn("shift", shift)
        state = materialize(state, "windows")
        while not (live := state.where("not done")).isEmpty():
            counted = self._met(live, _counting(same), "row long, slot int, bin int, n long").groupBy("row", "slot", "bin").agg(F.sum("n").alias("n"))
            running = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("row", "slot").orderBy("bin")))
            narrow = running.join(live.select("row", "slot", F.lit(k) - F.col("above")), ["row", "slot"]).toDF("row", "slot", "bin", "n", "upto", "need")
            at = narrow.groupBy("row", "slot").agg(F.min(F.when(F.col("upto") >= F.col("need"), F.struct("bin", "upto", "n"))).alias("at"))
            step = state.join(at, ["row", "slot"], "left")
            moves = ~F.col("done") & F.col("at").isNotNull()
            hi = F.col("hi") - F.call_function("shiftleft", F.col("at.bin").cast("long"), F.col("shift"))
            lo = F.greatest(F.col("lo"), hi - (F.call_function("shiftleft", F.lit(1).cast("long"), F.col("shift")) - 1))
            seen = F.col("above") + F.col("at.upto")
            state = step.select(
                "row",
                "slot",
                F.when(moves, lo).otherwise(F.col("lo")).alias("lo"),
                F.when(moves, hi).otherwise(F.col("hi")).alias("hi"),
                F.when(moves, seen - F.col("at.n")).otherwise(F.col("above")).alias("above"),
                "top",
                (F.col("done") | F.col("at").isNull() | (seen <= SPARE * k) | (lo >= hi)).alias("done"),
            ).withColumn("shift", shift)
            state = materialize(state, "windows")
        ranges = state.select("row", "slot", "lo", F.col("top").alias("hi"), "shift")
        found = self._met(ranges, _gathering(same, k), "row long, slot int, vec_id long, score long")
        w = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("row", "slot", "rank", "vec_id", "score")


def mine(df: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row that ``is_anchor`` marks and each of its best ``positives`` rows of the same ``label``: the best ``negatives`` rows of
    other labels whose score, the integer product of floor(``scale`` * x), is ``low`` to ``high`` percent of the positive's.
    """
    s = Selection(df, is_anchor, label, scale, id_col, vec_col)
    # no product exceeds that of the lengths
    reach = F.least(F.lit(float(TOP // 2)), F.ceil(F.col("norm") * F.lit((s.longest or 0.0) * (1 + 1e-9))) + 1).cast("long") if (s.longest or 0.0) ** 2 < TOP / 4 else F.lit(TOP).cast("long")
    every = s.anchors.select("row", F.lit(0).alias("slot"), (-reach).alias("lo"), reach.alias("hi"))
    near = materialize(s.first(every, positives, True).select("row", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    def share(percent, rounded):
        return rounded(F.col("positive_score").cast("decimal(20,0)") * F.lit(percent).cast("decimal(5,0)") * F.expr("0.01bd")).cast("long")

    windows = near.select("row", "slot", share(low, F.ceil).alias("lo"), share(high, F.floor).alias("hi"))
    found = s.first(windows, negatives, False).select("row", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(near, ["row", "slot"]).join(s.anchors.select("row", F.col("vec_id").alias("anchor_id")), "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; the labels of every seventh row are moved on by one first."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(df, F.col("vec_id") % 100 == 0, label)


OP12_SQL = """
with v as (
  select vec_id, row_number() over () as r, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end as label,
         [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.r, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_sum([a.q[i] * b.q[i] for i in range(1, len(a.q) + 1)]) as bigint) as score
  from v a join v b on a.r <> b.r and len(a.q) = len(b.q)
  where a.vec_id % 100 = 0),
p as (select *, row_number() over (partition by r order by score desc, vec_id) as k from s where same),
n as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
         row_number() over (partition by p.r, p.k order by s.score desc, s.vec_id) as rank
  from p join s on s.r = p.r and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score
  where p.k <= 5)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""
