"""Registered queries and their SQL counterparts on the given tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ("windows", "cleaning", "forecasting", "evaluation", "network", "learning", "live", "capture")


def load() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        for key, (query, sql) in module.ENTRIES.items():
            if key in queries:
                raise ValueError(f"duplicate query name {key}")
            queries[key] = query
            if sql:
                oracles[key] = sql
    return queries, oracles
