"""Words of Arrow text columns as NumPy arrays, a slice of rows at a time.

Whole texts are seen; a slice holds rows of about a megabyte together, or one longer row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int):
    """Powers 0 .. n - 1 of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for k, b in enumerate((_BASE, _INVERSE)):
            x = np.full(size, np.uint64(b))
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


class Grid:
    """Rows of a text column with the starts, ends and rows of their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first_row: int):
        self.data, self.offsets, self.first_row, self.rows = data, offsets, first_row, len(offsets) - 1
        n = len(data)
        solid = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.ones(n, bool)
        before[1:] = ~solid[:-1]
        after = np.ones(n, bool)
        after[:-1] = ~solid[1:]
        self.starts = np.flatnonzero(solid & (before | edge[:n]))
        self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        self.words = np.bincount(self.row, minlength=self.rows) if len(self.row) else np.zeros(self.rows, int)
        self._sums: dict = {}

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
        """64-bit hashes of the byte ranges; equal bytes hash alike wherever they stand."""
        if lower not in self._sums:
            up, _ = _power(len(self.data))
            total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[_LOWER[self.data] if lower else self.data] * up, out=total[1:])
            self._sums[lower] = total
        total, (_, down) = self._sums[lower], _power(len(self.data))
        return mix((total[ends] - total[starts]) * down[np.minimum(starts, len(self.data) - 1)] + (ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)


def grids(column, limit: int = SLICE_BYTES):
    """Slices of a text column (array or chunked array); null texts are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        to = min(to, len(column))
        yield Grid(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at], at)
        at = to
