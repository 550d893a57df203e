"""Iso-surfaces: triangles where a volume crosses a value (marching cubes), block by block.

The cases of a cell are not listed but follow from a rule. On every face of the cell, seen from outside, each run of inside
corners is cut off by a segment from the edge where the run ends to the edge where it begins. The rule depends on the face's four
corners only, so neighbouring cells agree on it, also where a face has two runs; the segments of a cell's faces join into
loops, and a loop is a fan of triangles. Surfaces are therefore closed except where the volume ends.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import blocks as B

#: Corner k of a cell has offsets (z, y, x) = the bits 4, 2, 1 of k.
CORNERS = [(k >> 2 & 1, k >> 1 & 1, k & 1) for k in range(8)]
#: Edges as (lower corner, axis: 0 z, 1 y, 2 x).
EDGES = [(k, axis) for axis in range(3) for k in range(8) if not CORNERS[k][axis]]
TRIANGLES = "z long, y long, x long, k int, a long, b long, c long, " + ", ".join(f"{p}{k} double" for p in "abc" for k in "xyz")


def _faces() -> list[list[int]]:
    """The corners of the six faces, all turning the same way seen from outside."""
    out = []
    for axis in range(3):
        p, q = [(1, 2), (2, 0), (0, 1)][axis]
        for side in (0, 1):
            ring = []
            for u, v in ((0, 0), (1, 0), (1, 1), (0, 1)):
                at = [0, 0, 0]
                at[axis], at[p], at[q] = side, u, v
                ring.append(at[0] * 4 + at[1] * 2 + at[2])
            out.append(ring if side == 0 else ring[::-1])
    return out


@cache
def case(inside: int) -> tuple[tuple[int, int, int], ...]:
    """Triangles of a cell whose inside corners are the bits of ``inside``, as triples of edges; normals point outside."""
    edge = {frozenset((k, k | (4, 2, 1)[axis])): e for e, (k, axis) in enumerate(EDGES)}
    after = {}
    for ring in _faces():
        on = [inside >> k & 1 for k in ring]
        for i in range(4):
            if on[i] and not on[(i + 1) % 4]:
                j = i
                while on[(j - 1) % 4]:
                    j -= 1
                after[edge[frozenset((ring[i], ring[(i + 1) % 4]))]] = edge[frozenset((ring[(j - 1) % 4], ring[j % 4]))]
    out = []
    while after:
        first = at = min(after)
        loop = []
        while at in after:
            loop.append(at)
            at = after.pop(at)
        assert at == first
        out += [(loop[0], loop[i + 1], loop[i]) for i in range(1, len(loop) - 1)]
    return tuple(out)


def cases() -> tuple[np.ndarray, np.ndarray]:
    """Number of triangles of every case, and their edges (-1 beyond)."""
    count = np.array([len(case(i)) for i in range(256)])
    edges = np.full((256, count.max(), 3), -1)
    for i in range(256):
        edges[i, : count[i]] = np.array(case(i), int).reshape(-1, 3)
    return count, edges


def _kernel(iso: float, shape: tuple, spacing: tuple):
    count, table = cases()

    def run(block: np.ndarray, first: tuple, size: tuple) -> pd.DataFrame:
        # cells begin at the chunk's voxels and end at the volume's last
        n = [min(s, m - 1 - f) for s, m, f in zip(size, shape, first, strict=True)]
        if min(n) <= 0:
            return pd.DataFrame(columns=[c.split()[0] for c in TRIANGLES.split(", ")])
        corner = [block[tuple(slice(1 + o, 1 + o + k) for o, k in zip(off, n, strict=True))] for off in CORNERS]
        index = sum((c >= iso).astype(int) << k for k, c in enumerate(corner))
        cell = np.stack(np.nonzero(count[index]), 1)
        kind = index[tuple(cell.T)]
        rows, k = np.repeat(np.arange(len(cell)), count[kind]), np.concatenate([np.arange(c) for c in count[kind]]) if len(cell) else np.zeros(0, int)
        out = {c: cell[rows, i] + first[i] for i, c in enumerate("zyx")} | {"k": k}
        for p, e in zip("abc", table[kind[rows], k].T, strict=True):
            low = np.array([CORNERS[q] for q, _ in EDGES])[e]
            axis = np.array([a for _, a in EDGES])[e]
            at = cell[rows] + low
            v0 = block[tuple(at.T + 1)]
            step = np.eye(3, dtype=int)[axis]
            v1 = block[tuple((at + step).T + 1)]
            t = (iso - v0) / (v1 - v0)
            g = at + np.array(first)
            out[p] = ((g[:, 0] * shape[1] + g[:, 1]) * shape[2] + g[:, 2]) * 3 + axis
            for i, c in zip((2, 1, 0), "xyz", strict=True):
                out[p + c] = (g[:, i] + np.where(axis == i, t, 0.0)) * spacing[i]
        return pd.DataFrame(out)[[c.split()[0] for c in TRIANGLES.split(", ")]]

    return run


def marching_cubes(voxels: DataFrame, iso: float, chunk: tuple = (32, 32, 32), shape: tuple | None = None, spacing: tuple = (1.0, 1.0, 1.0)) -> DataFrame:
    """Triangles of the surface between voxels below ``iso`` and the others (absent voxels are 0).

    A row has the cell (z, y, x), the number ``k`` of the triangle in it, the ids a, b, c of its vertices and their
    positions. The id names the voxel edge that a vertex lies on, so triangles of all cells share vertices
    without a join. ``spacing`` (z, y, x) scales positions. Each chunk sends its neighbours one layer of voxels.
    """
    shape = shape or B.shape_of(voxels)
    return B.over_blocks(B.to_chunks(voxels, chunk), chunk, 1, _kernel(iso, shape, spacing), shape, TRIANGLES)


def indexed(triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z) and faces (fid, i0, i1, i2) of triangles."""
    corners = F.explode(F.array(*[F.struct(F.col(p).alias("vid"), *[F.col(p + c).alias(c) for c in "xyz"]) for p in "abc"]))
    vertices = triangles.select(corners.alias("p")).groupBy("p.vid").agg(*[F.min(f"p.{c}").alias(c) for c in "xyz"])
    ids = F.struct("z", "y", "x", "k")
    return vertices, triangles.select(F.xxhash64(ids).alias("fid"), F.col("a").alias("i0"), F.col("b").alias("i1"), F.col("c").alias("i2"))
