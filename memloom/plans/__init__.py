"""Registered queries: operators bound to tables, each with the DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

for _name in ("search", "context", "graph", "lexical", "vectors", "temporal", "integrity", "policy", "extraction", "languages", "contracts", "frames", "surface"):
    import_module(f"{__name__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
