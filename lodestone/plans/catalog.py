"""Registry of the engine's queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: adds a query, and the SQL that gives the same rows where there is one."""

    def add(query: Query) -> Query:
        _QUERIES[name] = query
        if sql:
            _ORACLES[name] = sql
        return query

    return add


def _load() -> None:
    for name in ("knowledge", "dialogue", "web"):
        import_module(f"lodestone.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
