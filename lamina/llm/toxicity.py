"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine (operator 5).

Terms are lower-cased words and their first letters. Every term of the sample that goes with the label in either direction (likelihood
ratio of at least ``TELLING``; near copies of a text count about once) spans the vectors, pure or not: words that clean texts use too stay, and clean
examples are neighbours like toxic ones. A bounded sample of labelled rows gives the examples. An
inverted index holds each term's weights in blocks of examples with the block's largest weight; postings of frequent terms are rows over
all examples, added up for a batch of texts by one product. A block's bound is its largest such sum and the largest weights of the other
terms. The blocks with the highest bounds are looked at first, then all whose bound reaches the k-th cosine found there, and what may be
among the nearest is summed again in double precision, so a document's nearest
examples are exact; they vote with their cosine, and their ids are the evidence. Votes become scores by a monotone
calibration, fitted to the votes that each example gets from the others.

Broadcast: at most ``EXAMPLES`` examples over the telling terms of their texts.

Edge cases: texts without such a term, empty and null ones too, get the smoothed rate of label 1 among examples
without one; without usable labels every score is 0.5; examples of equal cosine count in a fixed order (heaviest term, id); ids with
conflicting labels teach nothing; each row of a repeated id is scored on its own text; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, training_texts
from .textgrid import grids, mix

#: Labelled rows at most; examples a block; voters; blocks that are looked at first.
EXAMPLES, BLOCK, VOTERS, FIRST = 12000, 128, 25, 8
#: Terms in more than one example of so many are added up for a batch of texts at once; texts a batch.
FREQUENT, BATCH = 16, 64
#: Bytes of the word beginnings that are terms of their own.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Likelihood ratio from which a term is telling (chance gives it to one term in about 600).
TELLING = 10.0

_SIGNS = np.zeros(256, bool)
_SIGNS[[i for i in range(128) if not chr(i).isalnum()]] = True


def terms(g) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every word, stripped of ASCII signs at its end and start, and of its beginnings."""
    s, e, row = g.starts.copy(), g.ends.copy(), g.row
    for _ in range(4):
        s += (s < e) & _SIGNS[g.data[np.minimum(s, len(g.data) - 1)]] if len(s) else 0
        e -= (s < e) & _SIGNS[g.data[e - 1]] if len(e) else 0
    full = s < e
    s, e, row = s[full], e[full], row[full]
    rows, out = [row], [g.hashes(s, e)]
    for n in BEGINNINGS:
        long = e - s > n
        rows.append(row[long])
        out.append(mix(g.hashes(s[long], s[long] + n) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(out).view(np.int64)


def _distinct(batches):
    for b in batches:
        for g in grids(b.column(2)):
            row, term = terms(g)
            order = np.lexsort((term, row))
            row, term = row[order], term[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
            row, term = row[new], term[new]
            at = np.searchsorted(row, np.arange(g.rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(term, pa.int64()))
            yield pa.record_batch([b.column(0).slice(g.first_row, g.rows), b.column(1).slice(g.first_row, g.rows), lists], names=["id", "y", "terms"])


def telling_terms(known: DataFrame, bar: float = TELLING) -> list[int]:
    """Terms (of rows id, y, terms) whose rate of y = 1 differs from that of all rows, by the likelihood ratio."""
    # a text's two smallest term hashes are those of most of its near copies: a group of copies counts about once
    known = known.groupBy("y", F.slice("terms", 1, 2)).agg(F.first("terms").alias("terms"))
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or not ones or ones == n:
        return []
    p = ones / n
    counts = known.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("y").alias("a")).where("n >= 2")
    a, m = F.col("a"), F.col("n")
    part = lambda x, q: F.when(x > 0, x * F.log(x / (m * q))).otherwise(0.0)
    ratio = 2 * (part(a, F.lit(p)) + part(m - a, F.lit(1 - p)))
    return [r["term"] for r in counts.where(ratio >= bar).select("term").collect()]


def weighted(row: np.ndarray, term: np.ndarray, vocabulary: np.ndarray):
    """(row, position in the sorted vocabulary, count) of the terms in it."""
    if not len(vocabulary) or not len(term):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
    hit = vocabulary[at] == term
    key, count = np.unique(row[hit].astype(np.int64) * len(vocabulary) + at[hit], return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), count


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising curve from votes ``x`` to rates of ``y``: pools of adjacent votes whose rates would fall, each drawn a little to the overall rate."""
    order, base = np.argsort(x, kind="stable"), float(y.mean())
    pools: list[list[float]] = []  # sum of y, rows, sum of x
    for v, t in zip(x[order], y[order], strict=True):
        pools.append([t, 1.0, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    s, n, at = np.array(pools).T
    return at / n, np.maximum.accumulate((s + base) / (n + 1))


class Index:
    """Examples' unit vectors by term, in blocks with their largest weights."""

    def __init__(self, vocabulary, examples: list[tuple], voters: int = VOTERS):
        """``examples``: (id, y, terms' positions, counts)."""
        # examples with the same heaviest term stand together, which lowers the bounds of the other blocks
        df = np.bincount(np.concatenate([x[2] for x in examples] or [np.zeros(0, int)]).astype(int), minlength=len(vocabulary))
        self.idf = np.log((1 + len(examples)) / (1 + df)) + 1
        examples = sorted(examples, key=lambda x: (int(x[2][np.argmax(self.weights(x[2], x[3]))]) if len(x[2]) else -1, x[0]))
        self.vocabulary, self.voters = vocabulary, voters
        self.ids, self.y = [x[0] for x in examples], np.array([x[1] for x in examples], float)
        n, v = len(examples), len(vocabulary)
        self.blocks = -(-n // BLOCK)
        term = np.concatenate([x[2] for x in examples] or [np.zeros(0, int)]).astype(int)
        owner = np.repeat(np.arange(n), [len(x[2]) for x in examples])
        weight = np.concatenate([self.weights(x[2], x[3]) for x in examples] or [np.zeros(0)])
        # the same by example, for exact cosines
        self.row_term, self.row_weight = term.astype(np.int32), weight
        self.rows = np.searchsorted(owner, np.arange(n + 1))
        order = np.lexsort((owner, term))
        term, self.owner, self.weight = term[order], owner[order].astype(np.int32), weight[order]
        cell = term * self.blocks + self.owner // BLOCK
        self.bounds = np.zeros(v * self.blocks)
        np.maximum.at(self.bounds, cell, self.weight * (1 + 1e-9))
        self.bounds = self.bounds.reshape(v, self.blocks)
        # where each term's examples of each block begin
        self.starts = np.searchsorted(cell, np.arange(v * self.blocks + 1)).astype(np.int32)
        self.base = float(self.y.mean()) if n else 0.5
        empty = [x[1] for x in examples if not len(x[2])]
        self.without = (sum(empty) + self.base) / (len(empty) + 1) if n else 0.5
        self._known: dict = {}
        self._spread()
        self.knots = None
        full = [i for i, x in enumerate(examples) if len(x[2])]
        if full:
            votes = np.array([self._share(*found) for found in self.nearest_of([examples[i][2:] for i in full], full)])
            self.knots = monotone(votes, self.y[full])

    def __getstate__(self):
        # the rows of frequent terms are drawn up again from their postings where the index is used
        return self.__dict__ | {"_known": {}, "often": None}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._spread()

    def _spread(self):
        """Postings of frequent terms as rows over all examples, which a batch of texts adds up at once."""
        size = np.diff(self.starts[:: self.blocks]) if self.blocks else np.zeros(len(self.vocabulary), int)
        frequent = np.flatnonzero(size * FREQUENT > len(self.y))
        self.slot = np.full(len(self.vocabulary), -1)
        self.slot[frequent] = np.arange(len(frequent))
        self.often = np.zeros((len(frequent), self.blocks * BLOCK), np.float32)
        for k, t in enumerate(frequent):
            i, j = self.starts[t * self.blocks], self.starts[(t + 1) * self.blocks]
            self.often[k, self.owner[i:j]] = self.weight[i:j]
        # single precision only chooses what is looked at: sums of products of unit vectors are off by less
        self.slack = 1.2e-7 * (len(frequent) + 8)

    def weights(self, at, count) -> np.ndarray:
        w = (1 + np.log(count)) * self.idf[at]
        return w / max(np.linalg.norm(w), 1e-12) if len(at) else w

    def _opened(self, at, w, blocks, sums) -> np.ndarray:
        """Cosines with the examples of some blocks, but for the slack: sums of frequent terms and the postings of the others."""
        got = sums[blocks].astype(float)
        if len(at):
            cells = (at[:, None] * self.blocks + blocks[None, :]).ravel()
            first, n = self.starts[cells], self.starts[cells + 1] - self.starts[cells]
            where = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            place = np.repeat(np.tile(np.arange(len(blocks)), len(at)), n) * BLOCK + self.owner[where] % BLOCK
            got += np.bincount(place, np.repeat(np.repeat(w, len(blocks)), n) * self.weight[where], minlength=got.size).reshape(got.shape)
        return got.ravel()

    def _exact(self, at, w, examples) -> np.ndarray:
        """Cosines with some examples in double precision, each summed in the order of its terms."""
        whole = np.zeros(len(self.vocabulary))
        whole[at] = w
        first, n = self.rows[examples], self.rows[examples + 1] - self.rows[examples]
        where = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(np.repeat(np.arange(len(examples)), n), whole[self.row_term[where]] * self.row_weight[where], minlength=len(examples))

    def _search(self, at, w, sums, without: int) -> tuple[np.ndarray, np.ndarray]:
        rare = self.slot[at] < 0
        some, x = at[rare], w[rare]
        # the largest sum of frequent terms in a block and the other terms' largest weights bound its cosines
        bound = sums.max(axis=1) + x @ self.bounds[some]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        wanted, least = self.voters + (without >= 0), 0.0
        examples, near = np.zeros(0, int), np.zeros(0)
        for blocks in (order[:FIRST], order[FIRST:]):
            blocks = blocks[bound[blocks] + self.slack >= least]
            if len(blocks):
                got = self._opened(some, x, blocks, sums)
                keep = np.flatnonzero((got > 0) & (got + self.slack >= least))
                examples = np.concatenate([examples, blocks[keep // BLOCK] * BLOCK + keep % BLOCK])
                near = np.concatenate([near, got[keep]])
                if len(near) >= wanted:
                    least = np.partition(near, -wanted)[-wanted] - self.slack
        examples = np.sort(examples[(near + self.slack >= least) & (examples != without)])
        cos = self._exact(at, w, examples)
        top = np.lexsort((examples, -cos))[: self.voters]
        return examples[top], cos[top]

    def nearest_of(self, texts: list[tuple], without: list[int] | None = None):
        """``nearest`` of many (terms' positions, counts), a batch at a time."""
        for lo in range(0, len(texts), BATCH):
            part = [(np.asarray(at, int), self.weights(np.asarray(at, int), count)) for at, count in texts[lo : lo + BATCH]]
            batch = np.zeros((len(part), len(self.often)), np.float32)
            for r, (at, w) in enumerate(part):
                slot = self.slot[at]
                batch[r, slot[slot >= 0]] = w[slot >= 0]
            sums = (batch @ self.often).reshape(len(part), self.blocks, BLOCK)
            for r, (at, w) in enumerate(part):
                yield self._search(at, w, sums[r], -1 if without is None else without[lo + r])

    def nearest(self, at: np.ndarray, count: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The examples (but ``without``) with the largest cosines (ties: the first) and the cosines; only those above 0."""
        return next(self.nearest_of([(at, count)], [without]))

    def _share(self, i: np.ndarray, c: np.ndarray) -> float:
        """Cosine-weighted share of label 1, drawn a little to the overall rate."""
        return float((c @ self.y[i] + 0.2 * self.base) / (c.sum() + 0.2))

    def votes(self, texts: list[tuple]) -> list[tuple[float, list]]:
        """Score and the ids of the nearest examples, for each (terms' positions, counts)."""
        keys = [(at.tobytes(), count.tobytes()) for at, count in texts]
        if len(self._known) > 50_000:
            self._known.clear()
        new = {k: x for k, x in zip(keys, texts, strict=True) if k not in self._known}
        for k, (i, c) in zip(new, self.nearest_of(list(new.values())), strict=True):
            self._known[k] = (float(np.interp(self._share(i, c), *self.knots)), [self.ids[j] for j in i[:5]]) if len(i) else (self.without, [])
        return [self._known[k] for k in keys]

    def vote(self, at: np.ndarray, count: np.ndarray) -> tuple[float, list]:
        """``votes`` of one text."""
        return self.votes([(at, count)])[0]


def fit(docs: DataFrame, labels: DataFrame, usable=None, label: str = "toxic", examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of a bounded sample of labelled rows."""
    from .store import materialize

    usable = F.lit(True) if usable is None else usable
    sample = training_texts(docs, labels, label, usable, examples, id_col, text_col, "toxic")
    known = materialize(sample.select("id", F.col("y").cast("int").alias("y"), "text").mapInArrow(_distinct, f"id {dict(docs.dtypes)[id_col]}, y int, terms array<long>"), "toxic")
    chosen = np.sort(np.array(telling_terms(known), np.int64))

    def counted(batches):
        for b in batches:
            for g in grids(b.column(2)):
                row, at, count = weighted(*terms(g), chosen)
                cut = np.searchsorted(row, np.arange(g.rows + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int32())) for x in (at, count)]
                yield pa.record_batch([b.column(0).slice(g.first_row, g.rows), b.column(1).slice(g.first_row, g.rows), *lists], names=["id", "y", "at", "count"])

    rows = sample.select("id", F.col("y").cast("int").alias("y"), "text").mapInArrow(counted, f"id {dict(docs.dtypes)[id_col]}, y int, at array<int>, count array<int>").collect()
    return Index(chosen, [(r["id"], r["y"], np.array(r["at"], int), np.array(r["count"], int)) for r in sorted(rows, key=lambda r: r["id"])])


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, evidence): the score of every whole text and the ids of its nearest examples."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = dict(docs.dtypes)[id_col]

    def scored(batches):
        m = shared.value
        for b in batches:
            for g in grids(b.column(1)):
                row, at, count = weighted(*terms(g), m.vocabulary)
                out: list = [(m.without, [])] * g.rows
                cut = np.searchsorted(row, np.arange(g.rows + 1))
                some = np.unique(row)
                for r, found in zip(some, m.votes([(at[cut[r] : cut[r + 1]], count[cut[r] : cut[r + 1]]) for r in some]), strict=True):
                    out[r] = found
                ids = b.column(0).slice(g.first_row, g.rows)
                yield pa.record_batch([ids, pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.list_(ids.type))], names=["id", "score", "evidence"])

    return docs.select(id_col, text_col).mapInArrow(scored, f"id {kind}, score double, evidence array<{kind}>").withColumnRenamed("id", id_col)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt without the held-out fold."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, fit(docs, labels, fold(F.col("doc_id"), 3) != 1))
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")
