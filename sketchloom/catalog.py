"""Registry of the library's own queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    """Add a query; ``sql`` is its DuckDB counterpart, if there is one."""
    _QUERIES[name] = fn
    if sql is not None:
        _ORACLES[name] = sql


def _load() -> None:
    """Import the modules that register the queries; they import this one, so not at the top."""
    import sketchloom.plans.queries
    import sketchloom.plans.stored_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
