"""The registered queries: name -> (DataFrame function, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its oracle."""

    def add(f: Query) -> Query:
        REGISTRY[name] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    from collatium.plans import load  # noqa: F401  registers

    return {k: f for k, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {k: sql for k, (_, sql) in REGISTRY.items() if sql}
