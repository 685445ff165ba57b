"""Registered queries with their DuckDB equivalents."""

from __future__ import annotations

import importlib

from corpusflow.plans import registry

MODULES = ("clean", "retrieval", "structure", "chunking", "expansion", "context", "dedup", "quality", "search")


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"corpusflow.plans.{module}")


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
