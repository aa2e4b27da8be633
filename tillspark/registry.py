"""Named queries over the driver's test tables, each with its DuckDB twin.

``register(key, sql)`` records a ``(spark, sf_dir) -> DataFrame`` callable
and, when the operator is SQL-expressible, the oracle text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    import tillspark.plans.extended  # noqa: F401
    import tillspark.plans.queries  # noqa: F401
