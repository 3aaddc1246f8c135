"""All queries of the event-analytics engine by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberline.plans import evidence_queries, incident_queries, log_queries, pack_queries, pattern_queries, report_queries, source_queries, statistics_queries, store_queries

ALL = {**log_queries.QUERIES, **evidence_queries.QUERIES, **statistics_queries.QUERIES, **store_queries.QUERIES, **report_queries.QUERIES, **incident_queries.QUERIES, **source_queries.QUERIES, **pack_queries.QUERIES, **pattern_queries.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
