"""Date windows and the adaptive ladder that splits windows with too many entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LADDER = [30, 14, 7, 3, 1]
THRESHOLD = 100
COARSE_YEARS = 5


def ladder_levels(levels: list[int] | str | None = None) -> list[int]:
    """Distinct positive window sizes, falling, ending in 1."""
    if levels is None or levels == "":
        levels = LADDER
    if isinstance(levels, str):
        levels = [int(x) for x in levels.split(",") if x.strip()]
    out = sorted({max(1, int(x)) for x in levels}, reverse=True)
    if not out:
        raise ValueError("the ladder needs at least one positive number of days")
    return out if out[-1] == 1 else [*out, 1]


def window_days(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(1), F.datediff(end, start) + 1)


def fixed_windows(df: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """One row per closed window of `days` days between start and end; the last one may be shorter."""
    step = F.sequence(F.col(start), F.col(end), F.expr(f"interval {days} days"))
    out = df.withColumn("window_start", F.explode(step))
    return out.withColumn("window_end", F.least(F.col(end), F.date_add("window_start", days - 1)))


def coarse_windows(df: DataFrame, start: str, end: str, years: int = COARSE_YEARS) -> DataFrame:
    """Windows of n years; the one that would reach the year of the end takes all that is left."""
    n = max(1, years)
    edges = F.transform(F.sequence(F.lit(0), F.floor((F.year(end) - F.year(start)) / n).cast("int") + 1), lambda i: F.add_months(F.col(start), i * (12 * n)))
    starts = F.filter(edges, lambda x: (x == F.col(start)) | ((F.year(x) < F.year(F.col(end))) & (x <= F.col(end))))
    out = df.withColumn("__s", starts).select("*", F.posexplode("__s").alias("__i", "window_start"))
    nxt = F.try_element_at("__s", F.col("__i") + 2)
    return out.withColumn("window_end", F.when(nxt.isNull(), F.col(end)).otherwise(F.date_add(nxt, -1))).drop("__s", "__i")


def next_level(days: Column, levels: list[int]) -> Column:
    """Largest level below the days, NULL at the bottom."""
    out = F.lit(None).cast("int")
    for level in sorted(levels):
        out = F.when(days > level, level).otherwise(out)
    return out


def stage_label(days: Column, levels: list[int]) -> Column:
    """Name of the smallest level that holds the days; longer windows are coarse."""
    out = F.lit("coarse")
    for level in sorted(levels, reverse=True):
        out = F.when(days <= level, f"{level}_day").otherwise(out)
    return out


def role_stage(role: Column, days: Column, levels: list[int] | None = None, years: int = COARSE_YEARS) -> Column:
    """Stage of a planned window by its role, or by the smallest level that holds its days (the largest if none does)."""
    steps = ladder_levels(levels)
    r, n = F.coalesce(F.nullif(F.trim(role), F.lit("")), F.lit("species_scan")), F.greatest(F.coalesce(days, F.lit(1)), F.lit(1))
    return F.when(r == "species_scan", "whole_period").when(r == "coarse_period", f"{max(1, years)}_year").otherwise(stage_label(F.least(n, F.lit(steps[0])), steps))


def stage_rank(stage: Column, levels: list[int] | None = None, years: int = COARSE_YEARS) -> Column:
    """Place of a stage in the order of work, unknown ones last."""
    order = ["whole_period", f"{max(1, years)}_year", *[f"{n}_day" for n in ladder_levels(levels)]]
    return F.coalesce(*[F.when(stage == name, i) for i, name in enumerate(order)], F.lit(len(order)))


def scan_summary(manifest: DataFrame, threshold: int = THRESHOLD, levels: list[int] | None = None, years: int = COARSE_YEARS) -> DataFrame:
    """The manifest with stage_label, stage_rank, entry_count, threshold_bucket and next_action.

    Entries fall back to those that caused a split, then to 0 where the status says empty; else they are unknown.
    """
    as_int = lambda c: F.expr(f"try_cast({c} AS bigint)")
    n = F.coalesce(as_int("entry_count"), as_int("split_trigger_entries"), F.when(F.col("status") == "empty", 0))
    role = F.coalesce(F.nullif(F.trim("window_role"), F.lit("")), F.lit("species_scan"))
    # fixed values: names of buckets and of what to do next
    bucket = F.when(n.isNull(), "unknown").when(n >= threshold, "at_or_above_threshold").otherwise("below_threshold")
    action = (
        F.when(F.col("status").isin("success", "empty"), "scrape_now")
        .when((F.col("status") == "split") & (role == "species_scan"), "split_into_coarse_periods")
        .when(F.col("status") == "split", "split_into_smaller_windows")
        .when(F.col("status").isin("throttled", "failed"), "retry_needed")
        .otherwise("pending")
    )
    stage = role_stage(F.col("window_role"), as_int("window_days").cast("int"), levels, years)
    out = manifest.withColumn("stage_label", stage).withColumn("stage_rank", stage_rank(F.col("stage_label"), levels, years))
    return out.withColumns({"threshold_bucket": bucket, "next_action": action, "entry_count": n})


def marked_runs(rows: DataFrame, key: str, order: list[str], start: Column, end: Column, warning: Column) -> DataFrame:
    """(key, run_no, started, ended, warnings): runs that a start marker opens and the next end marker closes; rows before
    the first start and after an end belong to no run, a start within an open run begins another. Unfinished runs are left
    out. One log is one key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumn("__start", start).withColumn("__end", end).withColumn("__warn", warning)
    run = run.withColumn("run_no", F.sum(F.coalesce("__start", F.lit(False)).cast("int")).over(w)).where("run_no > 0")
    own = Window.partitionBy(key, "run_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.coalesce(F.col("__end"), F.lit(False)).cast("int")
    run = run.withColumn("__closed", F.sum(ends).over(own) - ends).where("__closed = 0")
    g = run.groupBy(key, "run_no").agg(F.min(order[0]).alias("started"), F.min(F.when(F.col("__end"), F.col(order[0]))).alias("ended"), F.sum(F.coalesce("__warn", F.lit(False)).cast("int")).cast("bigint").alias("warnings"))
    return g.where("ended IS NOT NULL").withColumn("run_no", F.col("run_no").cast("bigint"))


def split_ladder(
    facts: DataFrame, key: str, day: str, start: str, end: str, threshold: int = THRESHOLD, levels: list[int] | None = None, years: int = COARSE_YEARS
) -> DataFrame:
    """(key, window_start, window_end, entries, status, saturated): leaves of the ladder for each key.

    A window with `threshold` entries or more is split into the coarse windows, then into those of the next level; a
    child equal to its parent is not split again, single days stay whole. Facts are counted once per (key, day) and summed
    up over the days of the period, one array of a number per day for each key; the entries of any window are the
    difference of two of them. So the whole ladder is one expression over a key's row, without a join or a scan per level.
    """
    spark: SparkSession = facts.sparkSession
    levels = ladder_levels(levels)
    first, last = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    per_day = facts.where(F.col(day).between(first, last)).groupBy(key, day).agg(F.count(F.lit(1)).alias("n"))
    # a key without an entry in the period keeps its one empty window; a row per day of the period
    dense = facts.select(key).distinct().select(key, F.explode(F.sequence(first, last)).alias(day)).join(per_day, [key, day], "left")
    up_to = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(key).orderBy(day))
    sums = dense.select(key, F.struct(day, up_to.alias("c")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    sums = sums.select(key, F.array_insert(F.transform("x", lambda x: x["c"]), 1, F.lit(0).cast("bigint")).alias("sums"))

    def entries(w: Column) -> Column:
        return F.element_at("sums", F.datediff(w["e"], first) + 2) - F.element_at("sums", F.datediff(w["s"], first) + 1)

    def split(w: Column, children: Column) -> Column:
        return F.when((entries(w) >= threshold) & (F.datediff(w["e"], w["s"]) > 0), children).otherwise(F.array(w))

    def of_size(w: Column, size: int) -> Column:
        starts = F.sequence(w["s"], w["e"], F.expr(f"interval {size} days"))
        return F.transform(starts, lambda x: F.struct(x.alias("s"), F.least(w["e"], F.date_add(x, size - 1)).alias("e")))

    whole = spark.range(1).select(first.alias("a"), last.alias("b"))
    # a few windows of several years
    periods = [(r.window_start, r.window_end) for r in coarse_windows(whole, "a", "b", years).orderBy("window_start").collect()]
    coarse = F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("e")) for a, b in periods])
    out = sums.withColumn("w", F.array(F.struct(first.alias("s"), last.alias("e"))))
    out = out.withColumn("w", F.flatten(F.transform("w", lambda w: split(w, coarse))))
    for size in levels:
        out = out.withColumn("w", F.flatten(F.transform("w", lambda w: split(w, of_size(w, size)))))  # noqa: B023
    leaves = out.select(key, F.inline(F.transform("w", lambda w: F.struct(w["s"].alias("window_start"), w["e"].alias("window_end"), entries(w).alias("entries")))))
    status = F.when(F.col("entries") == 0, "empty").otherwise("success")
    return leaves.withColumn("status", status).withColumn("saturated", (F.col("entries") >= threshold))
