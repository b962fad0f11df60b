"""Overlap of variants (locales, sources, samples) that return sets of articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def memberships(df: DataFrame, group: list[str], variant: str, article: str) -> DataFrame:
    """(group, article, variants): the sorted variants of each article; their number is bounded by the variants."""
    return df.groupBy(*group, article).agg(F.array_sort(F.collect_set(variant)).alias("variants"))


def membership_patterns(df: DataFrame, group: list[str], variant: str, article: str) -> DataFrame:
    m = memberships(df, group, variant, article)
    return m.groupBy(*group, F.array_join("variants", " + ").alias("pattern"), F.size("variants").cast("bigint").alias("variant_count")).agg(F.count(F.lit(1)).alias("article_count"))


def pairwise(df: DataFrame, group: list[str], variant: str, article: str) -> DataFrame:
    """(group, variant_a, variant_b, sizes, shared, union, jaccard, overlap) of all pairs of a group's variants.

    Shared articles are counted from each article's own variants, never by joining articles with each other.
    """
    m = memberships(df, group, variant, article).withColumn("__one", F.explode("variants"))
    sizes = m.groupBy(*group, F.col("__one").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    both = m.select(*group, F.col("__one").alias("variant_a"), F.explode("variants").alias("variant_b")).where("variant_a < variant_b")
    shared = both.groupBy(*group, "variant_a", "variant_b").agg(F.count(F.lit(1)).alias("shared"))
    a, b = sizes.withColumnsRenamed({"v": "variant_a", "n": "na"}), sizes.withColumnsRenamed({"v": "variant_b", "n": "nb"})
    pairs = a.join(b, group).where("variant_a < variant_b").join(shared, [*group, "variant_a", "variant_b"], "left").na.fill(0, ["shared"])
    union = F.col("na") + F.col("nb") - F.col("shared")
    return pairs.select(
        *group, "variant_a", "variant_b", F.col("na").alias("articles_a"), F.col("nb").alias("articles_b"), F.col("shared").alias("shared_articles"),
        union.alias("union_articles"), F.round(F.col("shared") / union, 6).alias("jaccard"), F.round(F.col("shared") / F.least("na", "nb"), 6).alias("overlap_coefficient"),
    )


def jaccard_summary(df: DataFrame, group: list[str], variant: str, article: str) -> DataFrame:
    """(group, variants, mean, most, least): Jaccard of a group's pairs of variants; pairs of variants without articles are
    equal, a group with one variant has none."""
    p = pairwise(df, group, variant, article)
    j = F.when(F.col("union_articles") == 0, 1.0).otherwise(F.col("shared_articles") / F.col("union_articles"))
    have = df.groupBy(*group).agg(F.countDistinct(variant).alias("variants"))
    s = p.groupBy(*group).agg(F.round(F.avg(j), 6).alias("mean_jaccard"), F.round(F.max(j), 6).alias("max_jaccard"), F.round(F.min(j), 6).alias("min_jaccard"))
    return have.join(s, group, "left")


def summary(df: DataFrame, group: list[str], variant: str, article: str) -> DataFrame:
    """Per group: variants, mentions, union, shares, exclusive and shared articles, the best single variant (ties to the
    first in order) and what the others add to it."""
    m = memberships(df, group, variant, article)
    per_article = m.groupBy(*group).agg(
        F.count(F.lit(1)).alias("union_articles"), F.sum(F.size("variants")).alias("sum_variant_articles"),
        F.sum((F.size("variants") == 1).cast("int")).alias("exclusive_articles"), F.sum((F.size("variants") >= 2).cast("int")).alias("shared_any_articles"),
    )
    sizes = m.select(*group, F.explode("variants").alias("v")).groupBy(*group, "v").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy(*group).agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("best_single_variant"), F.max("n").alias("best_single_articles"), F.count(F.lit(1)).alias("variants"))
    all_of = m.join(best.select(*group, "variants").withColumnRenamed("variants", "__k"), group).where(F.size("variants") == F.col("__k")).groupBy(*group).agg(F.count(F.lit(1)).alias("shared_all_articles"))
    j = per_article.join(best, group).join(all_of, group, "left").na.fill(0, ["shared_all_articles"])
    dup = F.col("sum_variant_articles") - F.col("union_articles")
    return j.select(
        *group, F.col("variants").cast("bigint").alias("variants"), F.col("sum_variant_articles").cast("bigint").alias("sum_variant_articles"), "union_articles", dup.cast("bigint").alias("duplicate_mentions"),
        F.round(dup / F.col("sum_variant_articles"), 6).alias("duplicate_share"), "shared_all_articles", F.col("shared_any_articles").cast("bigint").alias("shared_any_articles"),
        F.col("exclusive_articles").cast("bigint").alias("exclusive_articles"), "best_single_variant", "best_single_articles",
        (F.col("union_articles") - F.col("best_single_articles")).alias("incremental_articles"),
    )
