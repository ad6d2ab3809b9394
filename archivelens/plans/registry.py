"""All queries of the engine by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from archivelens.plans import catalog_queries, index_queries, more_queries, report_queries, search_queries, work_queries

MODULES = (catalog_queries, search_queries, work_queries, more_queries, index_queries, report_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
