"""The named queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("placement_queries", "scalar_queries", "spatial_queries", "area_queries", "graph_queries", "graph_data_queries", "export_queries")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql: the same for DuckDB, where SQL can say it."""

    def add(function: Query) -> Query:
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return add


def _load() -> None:
    for module in _MODULES:
        import_module(f"netweave.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
