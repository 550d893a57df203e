"""Registry of the volume, surface and catalog queries."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    """Register the decorated ``(spark, sf_dir) -> DataFrame`` as query ``name``."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def _load() -> None:
    """Import the modules that register queries."""
    for module in ("volume_queries", "surface_queries", "catalog_queries", "iterative_queries", "more_queries", "file_queries", "shape_queries", "derived_queries"):
        importlib.import_module(f"lamina.plans.{module}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLES)
