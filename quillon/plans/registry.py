"""Queries over the driver's tables and the equivalent SQL for the checking engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.plans import catalog_queries, metric_queries, pair_queries, text_queries, vector_queries

MODULES = (text_queries, pair_queries, vector_queries, metric_queries, catalog_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
