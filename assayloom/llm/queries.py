"""Loads every module that registers queries."""

from __future__ import annotations

from importlib import import_module

from assayloom.llm.registry import ORACLE, QUERIES

_MODULES = (
    "exact_dedup", "jaccard_join", "bpe", "byte_cnn", "reply_trees", "license_scan", "pii", "token_rollup", "impact_search", "mixing",
    "hnsw", "prefix_trie", "collocations",
)


def llm_queries() -> dict:
    for module in _MODULES:
        import_module(f"assayloom.llm.{module}")
    return dict(QUERIES)


def llm_sql() -> dict[str, str]:
    llm_queries()
    return dict(ORACLE)
