"""A registry of queries and their SQL for one module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """Queries, oracles, and a decorator that puts a query in under its name, with SQL where there is any."""
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}

    def query(name: str, sql: str | None = None):
        def keep(function: Query) -> Query:
            queries[name] = function
            if sql:
                oracles[name] = sql
            return function

        return keep

    return queries, oracles, query
