"""Keep-first rules: ordered cascades, first per key, case-insensitive first, and the greedy fold over several keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.operators.skew import is_missing
from presswork.session import written


def first_per_key(df: DataFrame, key: Column, order: list[Column], keep_missing: bool = True) -> DataFrame:
    """Rows that are first of their key in the given total order; rows without a key are all kept (or all dropped).

    The window's group limit runs before the shuffle too, so a key that holds a third of the rows arrives as one row per
    input partition.
    """
    keyed = df.withColumn("__key", key)
    ranked = keyed.where(F.col("__key").isNotNull()).withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy(*order)))
    firsts = ranked.where("__n = 1").drop("__n", "__key")
    return firsts.unionByName(keyed.where(F.col("__key").isNull()).drop("__key")) if keep_missing else firsts


def cascade_flags(df: DataFrame, id_col: str, passes: list[tuple[str, Column]], order: list[Column]) -> DataFrame:
    """(id, dropped_by) of every row: the pass that drops it, NULL for kept rows. Each pass keeps the first row per key
    among the survivors of the one before, so a row dropped early shadows nothing later; missing keys never match; order
    is rising, missing values last. Counts per value of dropped_by conserve the input.

    The table is read once, into written rows of id, keys and order. A pass folds them to the first id of each key by
    partial aggregates, so a key on a third of the rows is no task's burden, and joins those ids back by id, which is
    unique; only ids of dropped rows are written.
    """
    names = [name for name, _ in passes]
    rank = F.struct(*[x for c in order for x in (c.isNull(), c)], F.col(id_col))
    base = written(df.select(F.col(id_col).alias("id"), *[k.alias(f"k{i}") for i, (_, k) in enumerate(passes)], rank.alias("rank")), "cascade")
    live, gone = base, None
    for i, name in enumerate(names):
        have = live.where(F.col(f"k{i}").isNotNull())
        firsts = have.groupBy(f"k{i}").agg(F.min("rank").alias("rank")).select(F.col(f"rank.{id_col}").alias("id"))
        dropped = written(have.select("id").join(firsts, "id", "left_anti").withColumn("dropped_by", F.lit(name)), "dropped")
        gone = dropped if gone is None else gone.unionByName(dropped)
        live = live.join(dropped.select("id"), "id", "left_anti")
    return base.select("id").join(gone, "id", "left") if gone is not None else base.select("id", F.lit(None).cast("string").alias("dropped_by"))


def cascade(df: DataFrame, id_col: str, passes: list[tuple[str, Column]], order: list[Column]) -> DataFrame:
    """The rows of df that cascade_flags keeps."""
    kept = cascade_flags(df, id_col, passes, order).where("dropped_by IS NULL").select(F.col("id").alias(id_col))
    return df.join(kept, id_col, "left_semi")


def cascade_metrics(flags: DataFrame, passes: list[str]) -> DataFrame:
    """(metric, value): rows before each pass and rows kept, from one count over the flags."""
    n = flags.groupBy("dropped_by").agg(F.count(F.lit(1)).alias("n"))
    later = lambda names: F.coalesce(F.sum(F.when(F.col("dropped_by").isNull() | F.col("dropped_by").isin(names), F.col("n"))), F.lit(0)).cast("bigint")
    values = [F.struct(F.lit(f"before_{p}").alias("metric"), later(passes[i:]).alias("value")) for i, p in enumerate(passes)]
    return n.agg(F.array(*values, F.struct(F.lit("kept_rows").alias("metric"), later([]).alias("value"))).alias("m")).select(F.inline("m"))


def first_ignoring_case(df: DataFrame, col: str, order: list[Column]) -> DataFrame:
    """Rows with the first spelling of each value of a column, missing values left out."""
    c = F.col(col)
    return first_per_key(df.where(~is_missing(c)), F.lower(F.trim(c)), order, keep_missing=False)


def greedy_fold(rows: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """(id, kept) of the sequential rule "keep a row unless it shares a key with a kept row before it", in order of id.

    Done in rounds instead of one by one: a row that is first among the undecided for all its keys is kept, undecided
    rows that share a key with it are dropped. Each round decides at least the first row of every connected group; the
    number of rounds is the longest chain of alternating decisions. Rows without keys are kept. Decisions are written to
    the shared folder after each round.
    """
    tagged = F.array_compact(F.array(*[F.when(~is_missing(F.col(k)), F.concat(F.lit(f"{kind}:"), F.col(k))) for k, kind in zip(keys, _kinds(keys))]))
    base = rows.select(F.col(id_col).alias("id"), F.array_distinct(tagged).alias("ks"))
    open_keys = written(base.select("id", F.explode("ks").alias("k")), "fold-open")
    kept = []
    while True:
        firsts = open_keys.groupBy("k").agg(F.min("id").alias("first"))
        now = open_keys.join(firsts, "k").groupBy("id").agg(F.min((F.col("id") == F.col("first")).cast("int")).alias("ok")).where("ok = 1").select("id")
        now = written(now, "fold-kept")
        if not now.take(1):
            break
        kept.append(now)
        hit = open_keys.join(now, "id", "left_semi").select("k").distinct()
        out = open_keys.join(hit, "k", "left_semi").select("id").distinct()
        open_keys = written(open_keys.join(out, "id", "left_anti"), "fold-open")
    free = base.where(F.size("ks") == 0).select("id")
    for k in kept:
        free = free.unionByName(k)
    return base.select("id").join(free.withColumn("__k", F.lit(True)), "id", "left").select("id", F.coalesce("__k", F.lit(False)).alias("kept"))


def _kinds(keys: list[str]) -> list[str]:
    # URL columns share one space of keys, hashes have their own
    return ["hash" if "hash" in k else "url" for k in keys]
