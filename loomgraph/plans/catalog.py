"""Registry of the library's queries and of the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans import audit_queries, graph_queries, item_queries, learning_queries, match_queries, mention_queries, overlay_queries, posting_queries, profile_queries, relational_queries, series_queries, shape_queries, store_queries, taxonomy_queries, text_queries, time_queries, vector_queries

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (graph_queries, overlay_queries, relational_queries, series_queries, text_queries, posting_queries, match_queries, vector_queries, taxonomy_queries, learning_queries, mention_queries, time_queries, audit_queries, store_queries, shape_queries, item_queries, profile_queries)


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
