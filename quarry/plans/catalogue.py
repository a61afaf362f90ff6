"""Registry of the engine's queries: each plan function with its SQL."""

from __future__ import annotations

import importlib

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a plan ``f(t)``, where ``t(name)`` reads a driver table, with its equivalent SQL."""

    def add(f):
        from quarry.sources.readers import table

        _QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for name in ("facts", "entities", "text", "routing", "signals", "scalars", "claims", "disposition", "corroborate", "scoring", "scans", "selection", "discovery", "coverage"):
        importlib.import_module(f"quarry.plans.{name}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
