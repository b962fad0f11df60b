"""Deterministic samples: the same rows on every engine and every run, because order comes from a hash of key and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_number(c: Column) -> Column:
    """First 32 bits of the MD5 as a number."""
    return F.conv(F.left(F.md5(c), F.lit(8)), 16, 10).cast("bigint")


def simple_sample(df: DataFrame, key: str, n: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(n rows, the rest). The sample is the top n by hash, which each task cuts before anything is sent."""
    picked = df.orderBy(hash_order(F.col(key), seed), F.col(key)).limit(n)
    return picked, df.join(picked.select(key), key, "left_anti").select(*df.columns)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum; the window's group limit cuts each stratum to n rows per task before the shuffle."""
    w = Window.partitionBy(stratum).orderBy(hash_order(F.col(key), seed), F.col(key))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def bootstrap(df_ids: DataFrame, rn: str, total: int, batches: int, draws: int, seed: str) -> DataFrame:
    """(batch_id, draw, rn): draws with replacement of row numbers 1..total, joined to the ids that have them."""
    spark = df_ids.sparkSession
    grid = spark.range(batches * draws).select((F.col("id") / draws).cast("bigint").alias("batch_id"), (F.col("id") % draws).alias("draw"))
    at = F.pmod(hash_number(F.concat_ws(":", F.lit(seed), "batch_id", "draw")), F.lit(total)) + 1
    return grid.withColumn(rn, at).join(df_ids, rn)


def discovery_samples(samples: DataFrame, batch: str, item: str, n: int, runs: int, seed: str) -> DataFrame:
    """(batch, run, place, item): of each batch's distinct items the first n by hash, in another order for each run."""
    own = stratified_sample(samples.select(batch, item).distinct(), batch, item, n, f"{seed}:take")
    each = own.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    w = Window.partitionBy(batch, "run").orderBy(hash_order(F.concat_ws("/", F.col(batch), F.col("run"), F.col(item)), seed), F.col(item))
    return each.select(batch, "run", F.row_number().over(w).alias("place"), item)


def overlap_means(overlap: DataFrame) -> DataFrame:
    """(batch, mean): mean share of each batch over the others; batch NULL has the mean over pairs with left below right."""
    per = overlap.groupBy(F.col("l").alias("batch")).agg(F.round(F.avg("share"), 4).alias("mean"))
    return per.unionByName(overlap.where("l < r").agg(F.round(F.avg("share"), 4).alias("mean")).select(F.lit(None).cast(dict(overlap.dtypes)["l"]).alias("batch"), "mean"))


def batch_overlap(samples: DataFrame, batch: str, item: str) -> DataFrame:
    """(left, right, share): share of the left batch's distinct items that the right batch has, from each item's batches."""
    own = samples.select(batch, item).distinct()
    sizes = own.groupBy(F.col(batch).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    sets = own.groupBy(item).agg(F.collect_list(batch).alias("bs"))
    pairs = sets.select(F.explode("bs").alias("l"), "bs").select("l", F.explode("bs").alias("r")).where("l <> r").groupBy("l", "r").agg(F.count(F.lit(1)).alias("k"))
    return pairs.join(F.broadcast(sizes), "l").select("l", "r", F.round(F.col("k") / F.col("n"), 6).alias("share"))
