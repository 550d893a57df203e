"""Triangle meshes as tables: grids as meshes, pairs of triangles that cross, flattening angles, fits.

Faces are rows (fid, i0, i1, i2, ax .. cz): the ids of their vertices and the positions of their corners.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import spatial as P
from lamina.operators import surface as S
from lamina.operators.meshing import polynomial_terms
from lamina.sources import scratch

XYZ = ("x", "y", "z")


def grid_faces(surface: DataFrame, width: int) -> DataFrame:
    """Two faces a cell of a grid surface of ``width`` columns; vertex ids are row * width + col."""
    q = S.quads(surface)
    at = {k: (F.col("row") + dr) * width + F.col("col") + dc for k, dr, dc in (("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1))}

    def half(n, *corners):
        ids = [at[k].cast("long").alias(f"i{i}") for i, k in enumerate(corners)]
        return F.struct((at["a"] * 2 + n).cast("long").alias("fid"), *ids, *[F.col(k + c).alias(p + c) for p, k in zip("abc", corners, strict=True) for c in XYZ])

    return q.select(F.explode(F.array(half(0, "a", "b", "c"), half(1, "b", "d", "c"))).alias("f")).select("f.*")


def grid_vertices(surface: DataFrame, width: int) -> DataFrame:
    return surface.select((F.col("row") * width + F.col("col")).cast("long").alias("vid"), *XYZ)


# --- self-intersection


def crosses(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether triangles ``p[n]`` and ``q[n]`` (corners by coordinates) cross: each has corners on both sides of the other's plane, and their
    intervals on the line in which the planes meet overlap in more than a point. Triangles in one plane do not cross."""

    def normal(t):
        n = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
        return n / np.linalg.norm(n, axis=1, keepdims=True)

    def sides(t, o, n):
        return ((t - o[:, :1]) * n[:, None, :]).sum(2)

    def interval(along, d):
        alone = [(d[:, i] * d[:, (i + 1) % 3] <= 0) & (d[:, i] * d[:, (i + 2) % 3] <= 0) for i in range(2)]
        i = np.where(alone[0], 0, np.where(alone[1], 1, 2))
        at = np.arange(len(d))
        ends = []
        for k in (1, 2):
            j = (i + k) % 3
            ends.append(along[at, i] + (along[at, j] - along[at, i]) * d[at, i] / (d[at, i] - d[at, j]))
        return np.minimum(*ends), np.maximum(*ends)

    with np.errstate(all="ignore"):
        n, m = normal(p), normal(q)
        dq, dp = sides(q, p, n), sides(p, q, m)
        line = np.cross(n, m)
        p0, p1 = interval((p * line[:, None, :]).sum(2), dp)
        q0, q1 = interval((q * line[:, None, :]).sum(2), dq)
        apart = [(d[:, 0] * d[:, 1] > 0) & (d[:, 0] * d[:, 2] > 0) for d in (dq, dp)]
        flat = (np.abs(dq) < 1e-6).all(1)
        return ~apart[0] & ~apart[1] & ~flat & (p1 > q0 + 1e-6) & (q1 > p0 + 1e-6)


def self_intersections(faces: DataFrame) -> DataFrame:
    """Pairs (a < b) of faces that cross each other and share no vertex. Only pairs whose boxes meet in a grid cell of their size are tested.

    Meshes look small to the planner after their columns are cut; merge joins keep them off the driver.
    """
    faces = scratch.cut(faces, "faces")
    boxes = faces.select(F.col("fid").alias("id"), *[f(*[F.col(p + c) for p in "abc"]).alias(f"{c}{n}") for c in XYZ for n, f in ((0, F.least), (1, F.greatest))])
    corners = F.array(*[F.col(p + c) for p in "abc" for c in XYZ])
    side = lambda t: faces.select(F.col("fid").alias(t), F.array(*[f"i{k}" for k in range(3)]).alias(f"i{t}"), corners.alias(f"p{t}"))
    x = P.box_pairs(boxes).join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").where(~F.arrays_overlap("ia", "ib")).select("a", "b", "pa", "pb")

    def tested(batches):
        for pdf in batches:
            if len(pdf):
                p, q = (np.stack(pdf[c].to_numpy()).reshape(-1, 3, 3) for c in ("pa", "pb"))
                yield pdf.loc[crosses(p, q), ["a", "b"]]

    return x.mapInPandas(tested, "a long, b long")


# --- angles for flattening


def _corner(p: str, q: str, r: str) -> Column:
    u, v = [F.col(q + c) - F.col(p + c) for c in XYZ], [F.col(r + c) - F.col(p + c) for c in XYZ]
    size = S.length(u) * S.length(v)
    return F.when(size < 1e-8, math.pi / 3).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), S.dot(u, v) / size))))


#: Smallest and largest angle of a corner.
LEAST, MOST = 1e-5, math.pi - 1e-5


def flat_angles(faces: DataFrame, iterations: int = 50, tolerance: float = 1e-4) -> DataFrame:
    """(fid, k, vid, angle): corner angles near those of ``faces`` that a flat mesh can have.

    Rounds scale the angles of each face to sum to pi, then those around each inner vertex to 2 pi, until no sum was off by
    more than ``tolerance``. A vertex is inner if it has as many faces as neighbours.

    No face spans more than a band of vertex ids, so a round carries a change no further than to the next band. A task takes a strip of bands through
    many rounds, with a margin of a band for each of them. Where a band alone is too much for a task, every round deals the corners by faces and by vertices.
    """
    ids = [F.col(f"i{k}").cast("long") for k in range(3)]
    angles = [_corner(*("abc"[(k + j) % 3] for j in range(3))) for k in range(3)]
    f = faces.select("fid", *[c.alias(f"i{k}") for k, c in enumerate(ids)], *[c.alias(f"a{k}") for k, c in enumerate(angles)], F.least(*ids).alias("at"), (F.greatest(*ids) - F.least(*ids)).alias("span"))
    f = scratch.cut(f, "faces")
    band = max(1, f.agg(F.max("span")).first()[0] or 0)
    most = f.groupBy(F.floor(F.col("at") / band)).count().agg(F.max("count")).first()[0] or 1
    strip = scratch.TASK_ROWS // (3 * most)
    if strip < 1:
        return _angles_by_rounds(f, iterations, tolerance)
    now, left = f.drop("span"), iterations
    while left > 0:
        before, rounds = now, min(left, strip)
        now = scratch.cut(_strips(before, rounds, band, band * strip), "angles")
        off = now.select(F.posexplode("off").alias("round", "off")).groupBy("round").agg(F.max("off").alias("off")).where(F.col("off") < tolerance).agg(F.min("round")).first()[0]
        if off is not None:
            # the rounds after that one are not taken
            now = now if off + 1 == rounds else scratch.cut(_strips(before, off + 1, band, band * strip), "angles")
            break
        now, left = now.drop("off"), left - rounds
    return now.select("fid", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"i{k}").alias("vid"), F.col(f"a{k}").alias("angle")) for k in range(3)])).alias("c")).select("fid", "c.*")


def _strips(f: DataFrame, rounds: int, band: int, size: int) -> DataFrame:
    """``f`` after ``rounds`` rounds; one face of each strip of ``size`` vertex ids has ``off``, by how much a sum of the strip's was off in each round."""
    strip = lambda by: F.floor((F.col("at") + by * band) / size)
    sent = f.withColumn("strip", F.explode(F.sequence(strip(-rounds), strip(rounds)))).withColumn("own", F.col("strip") == strip(0))
    return sent.groupBy("strip").applyInPandas(lambda pdf: _settled(pdf, rounds), ", ".join(f"{c} {t}" for c, t in f.dtypes) + ", off array<double>")


def _settled(pdf: pd.DataFrame, rounds: int) -> pd.DataFrame:
    """A strip's own faces after the rounds, which the faces of its margin go through as well."""
    own = pdf.own.to_numpy()
    a = pdf[["a0", "a1", "a2"]].to_numpy()
    v, at = np.unique(pdf[["i0", "i1", "i2"]].to_numpy().ravel(), return_inverse=True)
    n, at = len(v), at.reshape(-1, 3)
    sides = np.concatenate([at[:, p] * n + at[:, q] for p in range(3) for q in range(3) if p != q])
    inner = np.bincount(np.unique(sides) // n, minlength=n) == np.bincount(at.ravel(), minlength=n)
    turned, mine = inner[at], np.zeros(n, bool)
    mine[at[own]] = True
    mine &= inner
    off = np.zeros(rounds)
    with np.errstate(all="ignore"):
        for r in range(rounds if own.any() else 0):
            s = a.sum(1, keepdims=True)
            # of equal corners every angle and so the sum may be zero; the largest angle takes the place of what has no value
            a = np.fmax(LEAST, np.fmin(MOST, a + (math.pi - s) * a / s))
            t = np.bincount(at.ravel(), a.ravel(), n)
            a = np.where(turned, np.fmax(LEAST, np.fmin(MOST, a * (2 * math.pi / t)[at])), a)
            off[r] = max(np.abs(math.pi - s[own]).max(), np.abs(t[mine] - 2 * math.pi).max(initial=0.0))
    out = pdf.assign(a0=a[:, 0], a1=a[:, 1], a2=a[:, 2])[own].drop(columns=["strip", "own"])
    out["off"] = pd.Series([off.tolist(), *[None] * len(out)][: len(out)], out.index, object)
    return out


def _angles_by_rounds(f: DataFrame, iterations: int, tolerance: float) -> DataFrame:
    """The same for faces in any order of vertices: both sums are windows, so a mesh of any size is spread by faces and by vertices."""
    corners = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"i{k}").alias("vid"), F.col(f"i{(k + 1) % 3}").alias("p"), F.col(f"i{(k + 2) % 3}").alias("q"), F.col(f"a{k}").alias("angle")) for k in range(3)])
    # explicit numbers of partitions: a task's rows stay the same however large the mesh is
    n = scratch.parts(f, 3)
    c = f.select("fid", F.explode(corners).alias("c")).select("fid", "c.*").repartition(n, "vid")
    ring = c.select("vid", "fid", F.explode(F.array("p", "q")).alias("to")).groupBy("vid").agg((F.countDistinct("to") == F.countDistinct("fid")).alias("inner"))
    now = scratch.cut(c.select("fid", "k", "vid", "angle").join(ring, "vid"), "angles")
    least, most = F.lit(LEAST), F.lit(MOST)
    for _ in range(iterations):
        face, around = F.sum("angle").over(Window.partitionBy("fid")), F.sum("angle").over(Window.partitionBy("vid"))
        one = now.repartition(n, "fid").withColumn("_s", face).withColumn("off", F.abs(math.pi - F.col("_s")))
        one = one.withColumn("angle", F.greatest(least, F.least(most, F.col("angle") + F.try_divide((math.pi - F.col("_s")) * F.col("angle"), F.col("_s")))))
        two = one.repartition(n, "vid").withColumn("_t", around).withColumn("off", F.greatest("off", F.when(F.col("inner"), F.abs(F.col("_t") - 2 * math.pi)).otherwise(0.0)))
        two = two.withColumn("angle", F.when(F.col("inner"), F.greatest(least, F.least(most, F.col("angle") * (2 * math.pi / F.col("_t"))))).otherwise(F.col("angle")))
        now = scratch.cut(two.select("vid", "fid", "k", "angle", "inner", "off"), "angles")
        if (now.agg(F.max("off")).first()[0] or 0.0) < tolerance:
            break
        now = now.drop("off")
    return now.select("fid", "k", "vid", "angle")


def conformal_rows(faces: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(c0, c1, cos, sin, c2): each face turned so that its largest angle comes last; c2 - c0 is c1 - c0 turned by the first angle and stretched by the ratio of the others' sines."""
    turn = (np.argmax(angles, 1)[:, None] + np.array([1, 2, 3])) % 3
    f, a = np.take_along_axis(faces, turn, 1), np.take_along_axis(angles, turn, 1)
    ratio = np.sin(a[:, 1]) / np.maximum(np.sin(a[:, 2]), 1e-12)
    return f[:, 0], f[:, 1], np.cos(a[:, 0]) * ratio, np.sin(a[:, 0]) * ratio, f[:, 2]


def unfold(n: int, faces: np.ndarray, angles: np.ndarray, pins: tuple[int, int], far: float, iterations: int = 4000, tolerance: float = 1e-10) -> np.ndarray:
    """Least-squares (u, v) of ``n`` vertices for these corner angles, with one pin at the origin and the other at (``far``, 0): conjugate gradients on the normal equations, which are never formed."""
    i, j, c, s, k = conformal_rows(faces, angles)

    def residual(p):
        d = p[j] - p[i]
        return p[k] - p[i] - np.stack([c * d[:, 0] - s * d[:, 1], s * d[:, 0] + c * d[:, 1]], 1)

    def back(r):
        turned = np.stack([c * r[:, 0] + s * r[:, 1], -s * r[:, 0] + c * r[:, 1]], 1)
        out = np.stack([np.bincount(k, r[:, x], n) - np.bincount(i, r[:, x], n) - np.bincount(j, turned[:, x], n) + np.bincount(i, turned[:, x], n) for x in (0, 1)], 1)
        out[list(pins)] = 0
        return out

    p = np.zeros((n, 2))
    p[pins[1]] = (far, 0)
    r = back(-residual(p))
    d, rr = r.copy(), float((r * r).sum())
    first = rr
    for _ in range(iterations):
        if rr <= tolerance**2 * max(first, 1e-300):
            break
        a = back(residual(d))
        alpha = rr / float((d * a).sum())
        p, r = p + alpha * d, r - alpha * a
        new = float((r * r).sum())
        d, rr = r + new / rr * d, new
    return p


def flatten_patches(surface: DataFrame, key: list[str], angles: DataFrame | None = None, width: int = 0) -> DataFrame:
    """(key, row, col, u, v) of every full grid patch of ``surface``: conformal maps with the patch's first corner at the origin and its first row's end on the u axis.

    ``angles`` are those of ``flat_angles`` over ``grid_faces`` of the patches (``width`` as given there); without, the patch's own.
    Each patch is one group, so patches bound the work of a task.
    """
    types = dict(surface.dtypes)
    fields = ", ".join(f"{k} {types[k]}" for k in key)
    flat, given = surface, angles is not None
    if given:
        own = angles.groupBy((F.floor(F.col("fid") / 2) * 1).alias("cell"), (F.col("fid") % 2).alias("half")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "angle"))), lambda x: x["angle"]).alias("a"))
        by = own.groupBy("cell").agg(*[F.max(F.when(F.col("half") == h, F.col("a"))).alias(f"h{h}") for h in (0, 1)])
        flat = surface.withColumn("cell", (F.col("row") * width + F.col("col")).cast("long")).join(by, "cell", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        r, c = pdf.row.nunique(), pdf.col.nunique()
        out = pdf[[*key, "row", "col"]].copy()
        if r < 2 or c < 2 or r * c != len(pdf):
            out["u"], out["v"] = None, None
            return out
        at = np.arange(r * c).reshape(r, c)
        f = np.concatenate([np.stack([at[:-1, :-1].ravel(), at[:-1, 1:].ravel(), at[1:, :-1].ravel()], 1), np.stack([at[:-1, 1:].ravel(), at[1:, 1:].ravel(), at[1:, :-1].ravel()], 1)])
        p = pdf[["x", "y", "z"]].to_numpy()
        if not given:
            a = np.stack([_angle(p, f, k) for k in range(3)], 1)
        else:
            cells = at[:-1, :-1].ravel()
            a = np.concatenate([np.array([list(x) for x in pdf[h].to_numpy()[cells]]) for h in ("h0", "h1")])
        uv = unfold(r * c, f, a, (0, c - 1), float(np.linalg.norm(p[c - 1] - p[0])))
        out["u"], out["v"] = uv[:, 0], uv[:, 1]
        return out

    return flat.groupBy(*key).applyInPandas(run, f"{fields}, row long, col long, u double, v double")


def _angle(p: np.ndarray, f: np.ndarray, k: int) -> np.ndarray:
    u, v = p[f[:, (k + 1) % 3]] - p[f[:, k]], p[f[:, (k + 2) % 3]] - p[f[:, k]]
    size = np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1)
    return np.where(size < 1e-8, np.pi / 3, np.arccos(np.clip((u * v).sum(1) / np.maximum(size, 1e-300), -1, 1)))


# --- fits


def fit_heights(points: DataFrame, key: str, degree: int) -> DataFrame:
    """(key, i, j, c): least-squares z = sum c y^i x^j per group of points (x, y, z); groups of fewer than four points are left out.

    Every batch of rows is reduced to a triangular factor per group, and a group's factors to one, so no group is gathered.
    """
    terms = polynomial_terms(degree)
    kind = dict(points.dtypes)[key]

    def factor(a: np.ndarray) -> np.ndarray:
        return np.linalg.qr(a, mode="r")

    def reduced(batches):
        for pdf in batches:
            out = []
            for k, g in pdf.groupby(key, dropna=False):
                a = np.stack([*[g.y**i * g.x**j for i, j in terms], g.z], 1).astype(float)
                out.append((k, len(g), factor(a).ravel().tolist()))
            yield pd.DataFrame(out, columns=[key, "n", "r"])

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.n.sum() < 4:
            return pd.DataFrame({key: [], "i": [], "j": [], "c": []})
        r = factor(np.concatenate([np.array(x).reshape(-1, len(terms) + 1) for x in pdf.r]))
        c = np.linalg.lstsq(r[:, :-1], r[:, -1], rcond=None)[0]
        return pd.DataFrame({key: pdf[key].iloc[0], "i": [t[0] for t in terms], "j": [t[1] for t in terms], "c": c})

    small = points.select(key, "x", "y", "z").mapInPandas(reduced, f"{key} {kind}, n long, r array<double>")
    return small.groupBy(key).applyInPandas(solved, f"{key} {kind}, i int, j int, c double")
