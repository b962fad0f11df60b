"""Queries of problem 3: a few keys hold most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from presswork.operators.skew import heavy_keys, per_key_summary
from presswork.session import read_table

KEY_FIELDS = ["search_string", "source_domain"]
HEAVY_SHARE = 0.04


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "rss_items").select(*KEY_FIELDS)
    return heavy_keys(items, KEY_FIELDS, HEAVY_SHARE).select("field_name", "key_value")


def p3_key_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "rss_items").select(*KEY_FIELDS, "record_id", "rss_pubdate_utc")
    out = per_key_summary(items, KEY_FIELDS, "record_id", "rss_pubdate_utc")
    return out.selectExpr(
        "field_name", "key_value", "items", "stories",
        "unix_micros(first_at) AS first_us", "unix_micros(last_at) AS last_us",
    )


QUERIES = {"p3_found": p3_found, "p3_key_summary": p3_key_summary}

_KEYS = """
WITH k AS (
  SELECT 'search_string' AS field_name, search_string AS key_value, record_id, rss_pubdate_utc FROM rss_items
  UNION ALL
  SELECT 'source_domain', source_domain, record_id, rss_pubdate_utc FROM rss_items
), k2 AS (SELECT * FROM k WHERE key_value IS NOT NULL AND trim(key_value) <> '')
"""

ORACLE = {
    "p3_found": _KEYS
    + """SELECT field_name, key_value FROM k2 GROUP BY 1, 2
HAVING count(*) >= 0.04 * (SELECT count(*) FROM rss_items)""",
    "p3_key_summary": _KEYS
    + """SELECT field_name, key_value, count(*)::BIGINT AS items, count(DISTINCT record_id)::BIGINT AS stories,
  epoch_us(min(rss_pubdate_utc))::BIGINT AS first_us, epoch_us(max(rss_pubdate_utc))::BIGINT AS last_us
FROM k2 GROUP BY 1, 2""",
}
