"""Queries of this package and their SQL."""

from __future__ import annotations

import importlib

#: Module and name of each registered query; its SQL, if any, is the module's OP<N>_SQL.
NAMES = {
    "op6_render": "render",
    "op3_decontaminate": "decontaminate",
    "op2_minhash": "minhash",
    "op5_toxicity": "toxicity",
    "op9_quality": "quality",
    "op1_order": "materialise",
    "op4_warc": "warc",
    "op7_mixing": "mixing",
    "op8_kdtree": "kdtree",
    "op10_topk": "topk",
    "op11_secrets": "secrets",
    "op12_negatives": "negatives",
    "op13_infill": "infill",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in NAMES.items()}


def oracle_sql() -> dict:
    found = {}
    for name, module in NAMES.items():
        sql = getattr(importlib.import_module(f"{__package__}.{module}"), name.split("_")[0].upper() + "_SQL", None)
        if sql:
            found[name] = sql
    return found
