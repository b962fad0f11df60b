"""Per-key results over keys of any skew, by map-side combining.

Every aggregate here is algebraic, so each input partition first folds its rows into one bounded state per key
(Spark's hash aggregate, which falls back to sorting and spilling when its table is full) and only those partial
states are shuffled. A key that holds a third of the rows arrives at its final task as one state per input partition.
Distinct counts are made algebraic by a first grouping on (key, value), which spreads a hot key over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_missing(c: Column) -> Column:
    """NULL, empty and blank strings are missing."""
    return c.isNull() | (F.trim(c) == "")


def long_keys(df: DataFrame, fields: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per record and non-missing key field: (field_name, key_value, kept columns); values exactly as stored."""
    entries = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("key_value")) for f in fields])
    cols = [F.col(k) for k in keep or []]
    out = df.select(F.explode(entries).alias("__k"), *cols)
    return out.select("__k.field_name", "__k.key_value", *(keep or [])).where(~is_missing(F.col("key_value")))


def key_shares(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field_name, key_value, items, total): rows of each key and of the whole table.

    The total counts every row of df, also those whose keys are missing; it comes from the same scan of partial counts.
    An empty table gives no rows. Repeated rows count as often as they occur.
    """
    entries = F.array(
        F.struct(F.lit("").alias("field_name"), F.lit("").alias("key_value")),
        *[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("key_value")) for f in fields],
    )
    counts = (
        df.select(F.explode(entries).alias("k"))
        .select("k.*")
        .where((F.col("field_name") == "") | ~is_missing(F.col("key_value")))
        .groupBy("field_name", "key_value")
        .agg(F.count(F.lit(1)).alias("items"))
    )
    total = counts.where("field_name = ''").select(F.col("items").alias("total"))
    # the total is one row by construction, so this is a broadcast of 8 bytes
    return counts.where("field_name <> ''").join(F.broadcast(total))


def heavy_keys(df: DataFrame, fields: list[str], share: float) -> DataFrame:
    """Keys that hold at least `share` of all rows; at most len(fields)/share rows come out. Ties with the bound count."""
    return key_shares(df, fields).where(F.col("items") >= F.col("total") * F.lit(share))


def per_key_summary(df: DataFrame, fields: list[str], story: str, at: str) -> DataFrame:
    """Items, distinct stories, first and last timestamp of each key, with no task bound to a hot key.

    Step 1 groups by (key, story) with partial states; step 2 groups those by key, again with partial states. NULL
    stories count as items but not as stories; NULL timestamps are ignored; a key without any has NULL bounds.
    """
    per_story = (
        long_keys(df, fields, [story, at])
        .groupBy("field_name", "key_value", story)
        .agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    )
    return per_story.groupBy("field_name", "key_value").agg(
        F.sum("n").cast("bigint").alias("items"),
        F.count(story).cast("bigint").alias("stories"),
        F.min("lo").alias("first_at"),
        F.max("hi").alias("last_at"),
    )
