"""Region locks of collaborative editing: all-or-nothing claims of grid cells."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

#: Side of a lock cell in surface coordinates.
CELL = 0.05


def cells(u: float, v: float, r: float) -> set[tuple[int, int]]:
    """Cells of the square around (u, v), by truncation."""
    lo, hi = (int((u - r) / CELL), int((v - r) / CELL)), (int((u + r) / CELL), int((v + r) / CELL))
    return {(i, j) for i in range(lo[0], hi[0] + 1) for j in range(lo[1], hi[1] + 1)}


def claim(owner: dict, user: int, wanted: set) -> bool:
    """Give ``user`` all cells if no one else holds any; holders may claim again."""
    if any(owner.get(c, user) != user for c in wanted):
        return False
    owner.update(dict.fromkeys(wanted, user))
    return True


def _surface(pdf: pd.DataFrame) -> pd.DataFrame:
    owner: dict = {}
    pdf = pdf.sort_values(["ts_ms", "seq"])
    granted = [claim(owner, r.user_id, cells(r.u, r.v, r.r)) for r in pdf.itertuples()]
    return pd.DataFrame({"surface_id": pdf.surface_id, "seq": pdf.seq, "user_id": pdf.user_id, "granted": granted})


def grant(events: DataFrame) -> DataFrame:
    """(surface_id, seq, user_id, granted) of lock requests (surface_id, user_id, ts_ms, seq, u, v, r), a surface's in order of time."""
    return events.groupBy("surface_id").applyInPandas(_surface, "surface_id long, seq long, user_id long, granted boolean")


def _stateful(key, batches, state):
    owner = {tuple(map(int, c.split(","))): u for c, u in zip(*state.get, strict=True)} if state.exists else {}
    for pdf in batches:
        pdf = pdf.sort_values(["ts_ms", "seq"])
        out = [(key[0], r.seq, r.user_id, claim(owner, r.user_id, cells(r.u, r.v, r.r))) for r in pdf.itertuples()]
        yield pd.DataFrame(out, columns=["surface_id", "seq", "user_id", "granted"])
    state.update(([f"{i},{j}" for i, j in owner], [int(u) for u in owner.values()]))


def grant_stream(events: DataFrame) -> DataFrame:
    """The same over a stream, with the owners of cells as state per surface."""
    return events.groupBy("surface_id").applyInPandasWithState(_stateful, "surface_id long, seq long, user_id long, granted boolean", "cells array<string>, owners array<long>", "append", "NoTimeout")
