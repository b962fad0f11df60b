"""Report aggregates over any table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def null_rates(df: DataFrame) -> DataFrame:
    """(column_name, null_rate) of every column, from one aggregation."""
    rates = df.agg(*[F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(c) for c in df.columns])
    return rates.unpivot([], df.columns, "column_name", "null_rate")


def value_share(df: DataFrame, col: str) -> DataFrame:
    """(value, n, share) with the missing group kept."""
    per = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("t"))
    return per.crossJoin(F.broadcast(total)).select("value", "n", F.round(100 * F.col("n") / F.col("t"), 4).alias("share"))


def length_describe(df: DataFrame, col: str) -> DataFrame:
    n = F.length(col)
    return df.where(F.col(col).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 4).alias("mean"), F.round(F.stddev_samp(n), 4).alias("std"), F.min(n).cast("bigint").alias("least"),
        *[F.round(F.percentile(n, F.lit(q)), 4).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)], F.max(n).cast("bigint").alias("most"),
    )


def top_values(df: DataFrame, cols: list[str], top: int) -> DataFrame:
    """The most frequent non-missing values over several columns."""
    long = df.select(F.explode(F.array(*cols)).alias("value")).where("value IS NOT NULL AND trim(value) <> ''")
    return long.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value").limit(top)


def last_per_group(df: DataFrame, group: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def sessionize(df: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """Adds session_no (from 1): a new session begins after a gap. Rows are ordered within one key's task."""
    w = Window.partitionBy(key).orderBy(at)
    new = (F.unix_timestamp(at) - F.unix_timestamp(F.lag(at).over(w)) > gap_seconds).cast("int")
    return df.withColumn("__new", F.coalesce(new, F.lit(1))).withColumn("session_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("__new")
