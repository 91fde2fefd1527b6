"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

import importlib

#: Modules of this subpackage that register queries.
MODULES = ("q_tokens", "q_quality", "q_decontaminate", "q_embedding", "q_minhash", "q_substring", "q_ppm", "q_pieces", "q_pages", "q_toxicity", "q_infill", "q_codebooks", "q_private")

_QUERIES: dict = {}
_ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def add(query):
        _QUERIES[name] = query
        if sql is not None:
            _ORACLES[name] = sql
        return query

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(_ORACLES)
