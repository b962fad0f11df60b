"""Resumable state: manifests, snapshots, registries and request batches, all as joins of written snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions.text import normalize_ws, slugify
from presswork.operators.windows import window_days
from presswork.session import written

#: Columns that name a planned request.
MANIFEST_KEYS = ["pathogen_domain", "language_code", "locale_id", "request_lang", "request_country", "request_accept_language", "search_string", "window_start", "window_end", "window_role"]


def cross_manifest(*parts: DataFrame) -> DataFrame:
    """Every combination of small planning tables (search strings, locales, windows); the result is what is planned, so
    its size is the product by definition."""
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def cache_path(dataset: Column, locale: Column, slug: Column, start: Column, end: Column, extension: str = "json") -> Column:
    """Where the answer to a request lies: the same for the same request."""
    name = F.concat(dataset, F.lit("_"), start, F.lit("_"), end, F.lit(f".{extension}"))
    return F.concat_ws("/", F.lit("data/raw/rss"), dataset, locale, slug, name)


def new_manifest(domain: str, language: str, strings: DataFrame, locales: DataFrame, windows: DataFrame, role: str = "base") -> DataFrame:
    """Pending rows of every search string, locale (id, lang, country, accept_language) and window."""
    spec = locales.selectExpr("id AS locale_id", "lang AS request_lang", "country AS request_country", "accept_language AS request_accept_language")
    m = cross_manifest(strings.select("search_string"), spec, windows.select("window_start", "window_end"))
    dataset = F.lit(f"{domain}_{language}")
    days = window_days(F.to_date("window_start"), F.to_date("window_end")).cast("string")
    empty = {c: F.lit("") for c in ("parent_window_start", "parent_window_end", "split_trigger_entries", "entry_count", "http_status", "last_attempt_at", "next_eligible_attempt_at", "error_summary")}
    m = m.withColumns({"pathogen_domain": F.lit(domain), "language_code": F.lit(language), "query_slug": slugify(F.col("search_string")), "window_days": days, "window_role": F.lit(role), "status": F.lit("pending")})
    m = m.withColumns({"attempts": F.lit("0"), "elapsed_request_seconds": F.lit("0"), **empty})
    return m.withColumn("cached_path", cache_path(dataset, F.col("locale_id"), F.col("query_slug"), F.col("window_start"), F.col("window_end")))


def load_manifest(default: DataFrame, existing: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A stored manifest brought up to the plan: its rows, missing values filled from the planned row of their key, then
    the planned rows it lacks. Rows without a role are base windows if planned, else children.

    If not one stored row is planned, the manifest is of another way of scanning and the plan replaces it.
    """
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    if not existing.isEmpty() and not default.isEmpty() and existing.alias("e").join(default.alias("p"), same, "left_semi").isEmpty():
        return default.select(*keys, *values)
    filled = [F.coalesce(F.nullif(F.trim(f"e.{v}"), F.lit("")), F.col(f"p.{v}")).alias(v) for v in values]
    planned = F.when(F.col("p.__planned"), "base").otherwise("hierarchical_child")
    role = [F.coalesce(F.nullif(F.trim("e.window_role"), F.lit("")), planned).alias(k) if k == "window_role" else F.col(f"e.{k}") for k in keys]
    stored = existing.alias("e").join(default.withColumn("__planned", F.lit(True)).alias("p"), same, "left").select(*role, *filled)
    absent = default.alias("p").join(existing.alias("e"), same, "left_anti").select(*keys, *values)
    return stored.unionByName(absent)


def valid_success(status: Column, full_text: Column, content_hash: Column, words: Column, least: int = 120) -> Column:
    """A stored article that need not be fetched again."""
    n = F.coalesce(words.cast("string").try_cast("double"), F.lit(0.0))
    return (F.lower(normalize_ws(status)) == "success") & (normalize_ws(full_text) != "") & (normalize_ws(content_hash) != "") & (n >= least)


def select_rows(rows: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Rows whose column has one of the wanted values, all rows if none are named; a name that no row has is an error."""
    if not wanted:
        return rows
    out = rows.where(F.col(column).isin(list(wanted)))
    known = {r[0] for r in out.select(column).distinct().collect()}
    if set(wanted) - known:
        raise ValueError(f"no row has {column} {sorted(set(wanted) - known)}")
    return out


def merge_manifest(default: DataFrame, existing: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of either table by key; values of the existing row win where they are not missing."""
    e = existing.select(*keys, *[F.nullif(F.trim(c), F.lit("")).alias(f"__{c}") for c in values]).dropDuplicates(keys)
    joined = default.dropDuplicates(keys).join(e, keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(f"__{c}", c).alias(c) for c in values])


def resume_state(rows: DataFrame, previous: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows with the values their key had in the previous snapshot, empty where it is new."""
    prev = previous.select(key, *[F.col(c).alias(f"__{c}") for c in values])
    return rows.join(prev, key, "left").select(*rows.columns, *[F.coalesce(f"__{c}", F.lit("")).alias(c) for c in values])


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done."""
    return rows.join(done.select(key).distinct(), key, "left_anti").select(*rows.columns)


def upsert_registry(old: DataFrame, new: DataFrame, key: str = "canonical_url") -> DataFrame:
    """One row per key: first_seen of the old row, last_seen and source of the new one, original_url old before new,
    content_hash new before old."""
    o = old.select(key, *[F.col(c).alias(f"o_{c}") for c in ("first_seen", "last_seen", "original_url", "source", "content_hash")])
    n = new.select(key, *[F.col(c).alias(f"n_{c}") for c in ("first_seen", "last_seen", "original_url", "source", "content_hash")])
    return o.join(n, key, "full_outer").select(
        key, F.coalesce("o_first_seen", "n_first_seen").alias("first_seen"), F.coalesce("n_last_seen", "o_last_seen").alias("last_seen"),
        F.coalesce("o_original_url", "n_original_url").alias("original_url"), F.coalesce("n_source", "o_source").alias("source"),
        F.coalesce("n_content_hash", "o_content_hash").alias("content_hash"),
    )


def _in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows range partitioned and sorted, with their partition (__p) and place (__i); written, since a second plan of
    the same ranges would draw other bounds and number other rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(rows.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "in-order")


def global_rank(df: DataFrame, order: list[Column], to: str = "rn") -> DataFrame:
    """Position from 1 in a total order without a one-task window: rows are range partitioned and sorted, then shifted by
    the sizes of the partitions before (one number per partition)."""
    parts = _in_order(df, order)
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__min"))
    shift = sizes.select("__p", "__min", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__shift"))
    # a row per partition
    out = parts.join(F.broadcast(shift), "__p")
    return out.withColumn(to, (F.col("__i") - F.col("__min") + F.col("__shift") + 1).cast("bigint")).drop("__p", "__i", "__min", "__shift")


def running_total(df: DataFrame, group: str, order: list[Column], value: Column, to: str) -> DataFrame:
    """Adds the running sum of a value within each group, in a total order, without a task per group.

    Rows are range partitioned by (group, order), so a group with a third of the rows spans many partitions; each part is
    summed by itself and shifted by the totals of the group's parts before, of which there are as many as partitions.
    """
    key = F.struct(F.col(group).isNull(), F.col(group))
    parts = _in_order(df.withColumn("__v", value), [F.col(group), *order]).withColumn("__g", key)
    local = F.sum("__v").over(Window.partitionBy("__g", "__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = parts.groupBy("__g", "__p").agg(F.sum("__v").alias("__t"))
    before = F.sum("__t").over(Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    shift = totals.select(F.to_json("__g").alias("__k"), "__p", F.coalesce(before, F.lit(0)).alias("__shift"))
    out = parts.withColumn(to, local).withColumn("__k", F.to_json("__g")).join(shift, ["__k", "__p"])
    return out.withColumn(to, F.col(to) + F.col("__shift")).drop("__k", "__p", "__i", "__g", "__v", "__shift")


def chunk_by_count(rows: DataFrame, group: str, order: list[Column], size: int) -> DataFrame:
    """Adds rn and chunk_no (from 0): at most `size` rows of a group in a chunk."""
    ranked = running_total(rows, group, order, F.lit(1), "rn").withColumn("rn", F.col("rn").cast("bigint"))
    return ranked.withColumn("chunk_no", F.floor((F.col("rn") - 1) / size).cast("bigint"))


def chunk_name(stem: Column, number: Column, first: int = 1) -> Column:
    """Name of a batch: stem, mark and its number from `first` on, with at least four digits."""
    n = (number + first).cast("string")
    return F.concat(stem, F.lit("_headline_batch_"), F.lpad(n, F.greatest(F.lit(4), F.length(n)), F.lit("0")))


def chunk_greedy(rows: DataFrame, group: str, order: str, sizes: list[tuple[str, int]], count_cap: int) -> DataFrame:
    """Adds chunk_no: rows in order, a new chunk begins when the row would break the count cap or a size's cap.

    The rule is a resetting scan: where a chunk begins depends on all rows before. A group is folded in order, as a stream
    of Arrow batches whose state is one counter per cap; no group is ever held in memory, but one task scans it.
    """
    import pandas as pd

    names = [s for s, _ in sizes]
    caps = [c for _, c in sizes]
    kinds = dict(rows.dtypes)
    slim = rows.select(group, order, *names).repartition(group).sortWithinPartitions(group, order)

    def scan(batches):
        current, chunk, n, sums = None, 0, 0, [0] * len(caps)
        for pdf in batches:
            out = []
            for g, _, *vals in pdf.itertuples(index=False):
                if g != current:
                    current, chunk, n, sums = g, 0, 0, [0] * len(caps)
                if n and (n + 1 > count_cap or any(s + v > c for s, v, c in zip(sums, vals, caps))):
                    chunk, n, sums = chunk + 1, 0, [0] * len(caps)
                n += 1
                sums = [s + v for s, v in zip(sums, vals)]
                out.append(chunk)
            yield pd.DataFrame({group: pdf[group], order: pdf[order], "chunk_no": out})

    return slim.mapInPandas(scan, f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, chunk_no bigint")


def take_under_cap(rows: DataFrame, group: str, order: list[Column], size: str, cap: int) -> DataFrame:
    """Rows of each group, in order, until the running sum first passes the cap."""
    return running_total(rows, group, order, F.col(size), "running").where(F.col("running") <= cap)
