"""All queries of this subpackage by name, with the DuckDB statements that check them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

NAMES = ["history", "site_lines", "tokens", "packing", "lookalikes", "residue", "languages", "main_content", "near_duplicates"]


def _modules():
    return [importlib.import_module(f"presswork.llm.{n}") for n in NAMES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out |= m.ORACLE
    return out
