"""Filtering by domain blocklists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions.urls import extract_domain, host_suffixes


def blocked_domains(listed: DataFrame, domain: str = "domain", flag: str = "is_news_outlet") -> DataFrame:
    """Distinct domains whose flag is "no" in any spelling; links and www. are reduced to their host."""
    host = extract_domain(F.col(domain))
    return listed.where(F.lower(F.trim(flag)) == "no").select(host.alias("blocked")).where("blocked <> ''").distinct()


def blocked_hosts(hosts: DataFrame, blocked: DataFrame, host: str) -> DataFrame:
    """Distinct hosts that are blocked themselves or by a parent domain, found by an equi-join on all suffixes."""
    each = hosts.select(F.col(host).alias("host")).where("host <> ''").distinct()
    suffixes = each.select("host", F.explode(host_suffixes(F.col("host"))).alias("blocked"))
    return suffixes.join(blocked, "blocked", "left_semi").select("host").distinct()


def without_blocked(df: DataFrame, host: str, blocked: DataFrame) -> DataFrame:
    """Rows whose host is not blocked; rows without a host are kept. Only distinct hosts are matched."""
    hit = blocked_hosts(df, blocked, host).withColumnRenamed("host", host)
    return df.join(hit, host, "left_anti").select(*df.columns)
