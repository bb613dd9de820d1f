"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from importlib import import_module

from assayloom.catalog.registry import ORACLE, QUERIES

_MODULES = (
    "rows", "summaries", "maps", "windowed", "sampled", "sources", "sinks", "scalars", "models", "streams",
)


def _load() -> None:
    for module in _MODULES:
        import_module(f"assayloom.catalog.{module}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
