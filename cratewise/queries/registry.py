"""Registry of named queries: a Spark callable, and where SQL can express it, the DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cratewise.queries.roles import Roles, sql_with_roles


@dataclass(frozen=True)
class Query:
    run: Callable[[Roles], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(roles) -> DataFrame``. ``sql`` may use any role or stage name as a table."""

    def keep(fn: Callable[[Roles], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(fn, sql)
        return fn

    return keep


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query):
        return lambda spark, folder: q.run(Roles.of(spark, folder))

    return {name: bind(q) for name, q in QUERIES.items()}


def duckdb_queries() -> dict[str, str]:
    return {name: sql_with_roles(q.sql) for name, q in QUERIES.items() if q.sql}
