"""Registered queries: each binds an operator to the driver tables, next to its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, the equivalent DuckDB statement."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> None:
    """Import every catalog module once."""
    from importlib import import_module

    for m in ("panels", "features", "joins", "profiles", "scores", "alerts", "ensembles", "sources", "series", "models"):
        import_module(f"tallycast.catalog.{m}")
