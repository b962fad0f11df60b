"""All core queries by name, with the DuckDB statements that check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from presswork.plans import analysis_queries, flow_queries, record_queries, skew_queries, stream_queries, study_queries, table_queries, text_queries

MODULES = [skew_queries, text_queries, table_queries, analysis_queries, record_queries, flow_queries, study_queries, stream_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.ORACLE
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["domain_blocklist_metrics"](spark, sf_dir)
