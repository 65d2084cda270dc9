"""All queries over the catalogue tables and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.plans import client_queries, crawl_queries, page_queries, state_queries, timed_queries, url_queries

FLAGSHIP = "discovery_stats_by_host"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (url_queries, page_queries, crawl_queries, state_queries, timed_queries, client_queries):
    QUERIES.update(_part.QUERIES)
    ORACLE_SQL.update(_part.ORACLE)
