"""Dense blocks: voxel tables become chunk rows, kernels run on chunks with halos.

A chunk row is (cz, cy, cx, data) with float64 values in raster order, padded to the full chunk; NaN marks
absent voxels. A kernel that needs neighbours gets them by the halo exchange: every chunk sends the slabs that its
neighbours need, and one grouped task assembles a chunk with its surroundings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = "cz long, cy long, cx long, data binary"


def to_chunks(voxels: DataFrame, chunk: tuple) -> DataFrame:
    """Chunk rows of a voxel table (z, y, x, v)."""

    def build(key, pdf):
        out = np.full(chunk, np.nan)
        out[pdf.z % chunk[0], pdf.y % chunk[1], pdf.x % chunk[2]] = pdf.v
        return pd.DataFrame([(*key, out.tobytes())], columns=["cz", "cy", "cx", "data"])

    keyed = voxels.select(*[F.floor(F.col(c) / n).alias(f"c{c}") for c, n in zip("zyx", chunk, strict=True)], "z", "y", "x", F.col("v").cast("double").alias("v"))
    return keyed.groupBy("cz", "cy", "cx").applyInPandas(build, CHUNK)


def to_voxels(chunks: DataFrame, chunk: tuple) -> DataFrame:
    """Voxel rows of chunk rows; absent voxels are left out."""

    def split(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                a = np.frombuffer(r.data).reshape(chunk)
                z, y, x = np.nonzero(~np.isnan(a))
                yield pd.DataFrame({"z": z + r.cz * chunk[0], "y": y + r.cy * chunk[1], "x": x + r.cx * chunk[2], "v": a[z, y, x]})

    return chunks.mapInPandas(split, "z long, y long, x long, v double")


SLAB = "tz long, ty long, tx long, oz long, oy long, ox long, nz int, ny int, nx int, data binary"


def shape_of(voxels: DataFrame) -> tuple[int, int, int]:
    """One past the largest coordinates (z, y, x) of a voxel table."""
    top = voxels.agg(*[F.coalesce(F.max(c), F.lit(-1)).alias(c) for c in "zyx"]).first()
    return tuple(int(top[c]) + 1 for c in "zyx")


def _slabs(chunk: tuple, halo: int, counts: list):
    """Each chunk for itself, and the parts of it within ``halo`` of a neighbour for that neighbour; nothing else is sent."""

    def cut(n, d):
        return slice(0, halo) if d < 0 else slice(n - halo, n) if d > 0 else slice(0, n)

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                a, out = np.frombuffer(r.data).reshape(chunk), []
                for d in np.ndindex(3, 3, 3):
                    d = [k - 1 for k in d]
                    to = [c + k for c, k in zip((r.cz, r.cy, r.cx), d, strict=True)]
                    if any(not 0 <= t < n for t, n in zip(to, counts, strict=True)) or (any(d) and not halo):
                        continue
                    at = tuple(cut(n, k) for n, k in zip(chunk, d, strict=True))
                    part = np.ascontiguousarray(a[at])
                    out.append((*to, *[c * n + x.start for c, n, x in zip((r.cz, r.cy, r.cx), chunk, at, strict=True)], *part.shape, part.tobytes()))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in SLAB.split(", ")])

    return run


def over_blocks(chunks: DataFrame, chunk: tuple, halo: int, kernel: Callable[[np.ndarray, tuple, tuple], pd.DataFrame], shape: tuple, schema: str, outside: str = "edge", absent: float = 0.0) -> DataFrame:
    """Rows of ``kernel(block, first voxel of the chunk, size of the chunk)`` for every chunk and its surroundings of ``halo`` voxels.

    Voxels outside the volume repeat its last ones (``outside`` "edge"), are 0 ("zero"), or are left out, so that blocks end where the volume does ("cut");
    absent voxels inside are ``absent``. ``halo`` may not exceed the chunk.
    """
    if halo > min(chunk):
        raise ValueError("a halo reaches into the next chunk only")
    counts = [-(-n // c) for n, c in zip(shape, chunk, strict=True)]

    def run(key, pdf):
        key = [int(k) for k in key]
        first = [k * c for k, c in zip(key, chunk, strict=True)]
        size = tuple(min(c, n - f) for c, n, f in zip(chunk, shape, first, strict=True))
        lo = [max(0, f - halo) for f in first]
        hi = [min(n, f + c + halo) for f, c, n in zip(first, chunk, shape, strict=True)]
        block = np.full([b - a for a, b in zip(lo, hi, strict=True)], absent)
        for r in pdf.itertuples():
            at, n = (r.oz, r.oy, r.ox), (r.nz, r.ny, r.nx)
            a = np.nan_to_num(np.frombuffer(r.data).reshape(n), nan=absent)
            cut = [(max(p, q), min(p + m, e)) for p, q, m, e in zip(at, lo, n, hi, strict=True)]
            if all(e > s for s, e in cut):
                block[tuple(slice(s - q, e - q) for (s, e), q in zip(cut, lo, strict=True))] = a[tuple(slice(s - p, e - p) for (s, e), p in zip(cut, at, strict=True))]
        pad = [(halo - (f - a), halo - (b - f - m)) for f, a, b, m in zip(first, lo, hi, size, strict=True)]
        if outside != "cut":
            block = np.pad(block, pad, **({"mode": "edge"} if outside == "edge" else {}))
        return kernel(block, tuple(first), size)

    return chunks.mapInPandas(_slabs(chunk, halo, counts), SLAB).groupBy("tz", "ty", "tx").applyInPandas(run, schema)


def with_halo(chunks: DataFrame, chunk: tuple, halo: int, kernel: Callable[[np.ndarray, tuple], np.ndarray], shape: tuple, outside: str = "cut", absent: float = 0.0) -> DataFrame:
    """Apply ``kernel(block with halo, origin of the block)`` to every chunk. The kernel returns an array of the block's size; its inside becomes the chunk.

    Blocks end where the volume does, so a kernel of several steps treats the volume's edge at every step as it would on the whole array.
    A kernel that asks for ``absent`` voxels as NaN may give them back as such; they stay absent.
    """

    def run(block, first, size):
        lead = [min(halo, f) if outside == "cut" else halo for f in first]
        got = kernel(block, tuple(f - k for f, k in zip(first, lead, strict=True)))
        out = np.full(chunk, np.nan)
        out[tuple(slice(0, n) for n in size)] = got[tuple(slice(k, k + n) for k, n in zip(lead, size, strict=True))]
        return pd.DataFrame([(*[f // c for f, c in zip(first, chunk, strict=True)], out.tobytes())], columns=["cz", "cy", "cx", "data"])

    return over_blocks(chunks, chunk, halo, run, shape, CHUNK, outside, absent)


def lines(voxels: DataFrame, axis: str, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], tile: tuple = (1, 1)) -> DataFrame:
    """Apply ``kernel(coordinates, values)`` to every line along ``axis``. A group holds the lines of a ``tile`` over the other axes, so that short lines need no group each."""
    rest = [c for c in "zyx" if c != axis]

    def run(pdf):
        pdf = pdf.sort_values([*rest, axis])
        first = np.flatnonzero((pdf[rest].diff() != 0).any(axis=1).to_numpy())
        at, v = pdf[axis].to_numpy(), pdf.v.to_numpy()
        ends = zip(first, [*first[1:], len(v)], strict=True)
        return pdf.assign(v=np.concatenate([kernel(at[i:j], v[i:j]) for i, j in ends]))[["z", "y", "x", "v"]]

    return voxels.groupBy(*[F.floor(F.col(c) / n) for c, n in zip(rest, tile, strict=True)]).applyInPandas(run, "z long, y long, x long, v double")


def thin(mask: DataFrame, chunk: tuple, shape: tuple, rounds: int | None = None) -> DataFrame:
    """Skeleton (z, y, x) of the voxels of ``mask``: rounds of directional thinning until nothing changes, or ``rounds`` of them.

    A round depends on six voxels around each one, so one exchange of six layers serves its six directions; the result does
    not depend on the chunks. Chunks without voxels are not kept.
    """
    from lamina.functions.kernels import thin3d_round
    from lamina.sources import scratch

    def some(batches):
        for pdf in batches:
            yield pdf[[bool((np.nan_to_num(np.frombuffer(x)) != 0).any()) for x in pdf.data]]

    def total(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [int(sum(np.nan_to_num(np.frombuffer(x)).sum() for x in pdf.data))]})

    now = scratch.cut(to_chunks(mask.select("z", "y", "x", F.lit(1.0).alias("v")), chunk), "thin")
    left, done = now.mapInPandas(total, "n long").agg(F.sum("n")).first()[0], 0
    while rounds is None or done < rounds:
        now = scratch.cut(with_halo(now, chunk, 6, lambda a, o: thin3d_round(a > 0).astype(float), shape, "zero").mapInPandas(some, CHUNK), "thin")
        before, left, done = left, now.mapInPandas(total, "n long").agg(F.sum("n")).first()[0], done + 1
        if left == before:
            break
    return to_voxels(now, chunk).where("v > 0").select("z", "y", "x")
