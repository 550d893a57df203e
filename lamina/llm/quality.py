"""Quality scores by nearest neighbours in a latent space (operator 9).

Words become surface features (their first and last character classes, lengths, pairs of neighbours, repeats
and hashed forms). A bounded sample of labelled rows gives inverse document frequencies and, from the
features' Gram matrix, a latent basis. Each document is projected on it and compared with all labelled vectors by
blocked exact cosine products; the nearest ones vote with their similarity.

The sample is projected and its basis computed in one task of bounded size; the driver only passes the finished model on.

Broadcast: the basis and at most ``EXAMPLES`` vectors of ``LATENT`` numbers, a few megabytes at any input size.

Edge cases: null and empty texts, and every text if no labelled row can be used, get the base rate (0.5 without labels);
equal texts get equal scores, as cosines are rounded to four places and examples that tie with the last voter share its weight;
a repeated id is scored for each of its rows; extra columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, training_texts
from .textgrid import grids, mix

#: Labelled rows at most; hashed features; latent dimensions; voters; documents a block.
EXAMPLES, FEATURES, LATENT, VOTERS, BLOCK = 8192, 2048, 64, 25, 256
#: Documents whose cosines are held at once.
SLICE = 1024

_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 65, 97, 97, 48


def features(g) -> np.ndarray:
    """Square roots of relative feature frequencies, a row per text of the slice."""
    out = np.zeros((g.rows, FEATURES), np.float32)
    if not len(g.starts):
        return out
    s, e, row = g.starts, g.ends, g.row
    c = _CLASS[g.data]
    n = e - s
    last = [np.where(n > k, c[np.maximum(e - 1 - k, 0)], 0).astype(np.uint64) for k in range(3)]
    shape = mix(c[s] + (last[0] << np.uint64(8)) + (last[1] << np.uint64(16)) + (last[2] << np.uint64(24)) + np.uint64(1 << 40))
    word = g.hashes(s, e)
    same = np.zeros(len(s), bool)
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    pair = np.zeros(len(s), np.uint64)
    pair[1:] = np.where(row[1:] == row[:-1], mix(shape[1:] + shape[:-1] * np.uint64(3)), 0)
    third, half = np.uint64(FEATURES // 2), np.uint64(FEATURES // 4)
    ids = [shape % half, half + pair % half, third + word % half, third + half + np.minimum(n, 30).astype(np.uint64) * np.uint64(2) + same.astype(np.uint64)]
    weights = [1.0, 1.0, 0.3, 1.0]
    total = np.maximum(g.words, 1)[:, None]
    flat = row.astype(np.int64) * FEATURES
    for f, w in zip(ids, weights, strict=True):
        got = np.bincount(flat + f.astype(np.int64), minlength=g.rows * FEATURES).reshape(g.rows, FEATURES)
        out += (w * np.sqrt(got / total)).astype(np.float32)
    return out


def _examples(batches):
    for b in batches:
        for g in grids(b.column(2)):
            x = features(g)
            rows = [(np.flatnonzero(r).astype(np.int16).tobytes(), r[r > 0].astype(np.float32).tobytes()) for r in x]
            yield pa.record_batch([b.column(0).slice(g.first_row, g.rows), b.column(1).slice(g.first_row, g.rows), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["id", "y", "at", "x"])


class Model:
    """Latent basis and labelled latent vectors."""

    def __init__(self, basis, idf, vectors, y, voters: int = VOTERS):
        self.basis, self.idf, self.vectors, self.y, self.voters = basis, idf, vectors, y, voters
        self.base = float(y.mean()) if len(y) else 0.5

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """Cosines with all examples, by blocks of equal shape, rounded so that equal texts agree whatever block they stand in."""
        out = np.empty((len(x), len(self.y)), np.float32)
        for i in range(0, len(x), BLOCK):
            block = np.zeros((BLOCK, x.shape[1]), np.float32)
            block[: len(x) - i] = x[i : i + BLOCK]
            out[i : i + BLOCK] = (self.latent(block) @ self.vectors.T)[: len(x) - i]
        return np.round(out, 4)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest examples, drawn a little to the base rate.

        Examples that tie with the last voter share its weight, so no order among them matters.
        """
        full = x.any(axis=1)
        if not len(self.y):
            return np.full(len(x), self.base)
        k, n = min(self.voters, len(self.y)), len(x)
        cos = self.cosines(x)
        last = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k]
        row, at = np.nonzero(cos >= last[:, None])
        c = cos[row, at]
        tied = c == last[row]
        ties = np.bincount(row[tied], minlength=n)
        above = np.bincount(row, minlength=n) - ties
        w = c.clip(0).astype(np.float64) ** 8 * np.where(tied, ((k - above) / ties)[row], 1.0)
        votes, weight = np.bincount(row, w * self.y[at], n), np.bincount(row, w, n)
        return np.where(full, (votes + 0.1 * self.base) / (weight + 0.1), self.base)


def fit(x: np.ndarray, y: np.ndarray, latent: int = LATENT) -> Model:
    """A model from feature rows and their labels."""
    if not len(x):
        return Model(np.zeros((FEATURES, 1), np.float32), np.ones(FEATURES, np.float32), np.zeros((0, 1), np.float32), y)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.3).astype(np.float32)
    z = x * idf
    values, vectors = np.linalg.eigh((z.T @ z).astype(np.float64))
    basis = np.ascontiguousarray(vectors[:, ::-1][:, : min(latent, len(x))]).astype(np.float32)
    m = Model(basis, idf, np.zeros((0, 1), np.float32), y)
    m.vectors = m.latent(x)
    return m


def _fitted(batches):
    """The model of all examples, fitted in one task: at most ``EXAMPLES`` rows of ``FEATURES`` numbers."""
    x, y = np.zeros((0, FEATURES), np.float32), []
    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
    x, y = np.zeros((len(rows), FEATURES), np.float32), np.array([r[1] for r in rows], np.float64)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r[2], np.int16)] = np.frombuffer(r[3], np.float32)
    yield pa.record_batch([pa.array([pickle.dumps(fit(x, y))], pa.binary())], names=["model"])


def score(docs: DataFrame, labels: DataFrame, usable=None, label: str = "quality", examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``score`` (0 to 1, higher: label 1 likelier) of every whole text, with the id, or with all columns if ``keep``."""
    usable = F.lit(True) if usable is None else usable
    sample = training_texts(docs, labels, label, usable, examples, id_col, text_col, "quality")
    examples = sample.mapInArrow(_examples, f"id {dict(docs.dtypes)[id_col]}, y int, at binary, x binary")
    shared = docs.sparkSession.sparkContext.broadcast(examples.repartition(1).mapInArrow(_fitted, "model binary").first()["model"])

    def scored(batches):
        m = pickle.loads(shared.value)
        for b in batches:
            text = b.column(b.schema.get_field_index(text_col))
            out = [np.concatenate([m.scores(x[i : i + SLICE]) for i in range(0, len(x), SLICE)]) for g in grids(text) for x in [features(g)]]
            got = pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
            kept = [b.column(i) for i, f in enumerate(b.schema) if keep or f.name == id_col]
            yield pa.record_batch([*kept, got], names=[*[f.name for f in b.schema if keep or f.name == id_col], "score"])

    base = docs.drop("score") if keep else docs.select(id_col, text_col)
    fields = [f"`{c}` {t}" for c, t in base.dtypes if keep or c == id_col]
    return base.mapInArrow(scored, ", ".join([*fields, "score double"]))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt without the held-out fold."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs.select("doc_id", "text"), labels, fold(F.col("doc_id"), 5) != 0)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
