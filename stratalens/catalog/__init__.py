"""Named queries over the driver tables, each with the SQL an independent engine answers it by."""

from __future__ import annotations

from importlib import import_module

MODULES = ["panel", "selection", "metrics", "ledger", "quality", "sources", "models"]


def load() -> dict:
    """name -> (callable(spark, folder), oracle SQL or None)"""
    out: dict = {}
    for module in MODULES:
        for name, pair in import_module(f"{__name__}.{module}").QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} is defined twice")
            out[name] = pair
    return out
