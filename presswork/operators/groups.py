"""Category groups: building them from labelled rows, leader clustering, support and coverage."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.functions.text import dedupe_ordered, normalise_key, split_terms
from presswork.operators.skew import is_missing


def text_similarity(name_a: str, text_a: str, name_b: str, text_b: str, least: float = 0.0) -> float:
    """0.45 x likeness of names + 0.35 x Jaccard of their words + 0.20 x likeness of texts; 0 if that is below `least`
    whatever the texts are."""
    ratio = lambda a, b: SequenceMatcher(None, a.lower(), b.lower()).ratio()
    a, b = set(name_a.lower().split()), set(name_b.lower().split())
    jaccard = len(a & b) / len(a | b) if a | b else 0.0
    named = 0.45 * ratio(name_a, name_b) + 0.35 * jaccard
    return named + 0.20 * ratio(text_a, text_b) if named + 0.20 >= least else 0.0


@F.pandas_udf(T.DoubleType())
def pair_similarity(name_a: pd.Series, text_a: pd.Series, name_b: pd.Series, text_b: pd.Series) -> pd.Series:
    return pd.Series([round(text_similarity(*(x or "" for x in r)), 6) for r in zip(name_a, text_a, name_b, text_b)], dtype=float)


def build_groups(rows: DataFrame, by: list[str], label: str, article: str, example: str, cause: str, top: int = 25, longest: int = 500) -> DataFrame:
    """Per group the `top` labels by distinct articles, then name without regard to case, with definition and evidence.

    The definition is the first two examples and the first cause in order of the articles, each text once, cut at
    `longest` characters; the evidence is the first three examples. Only these few are kept of a label, by windows whose
    group limit cuts each task's rows before the shuffle, so a label on a tenth of the rows is no task's burden.
    """
    real = rows.where(~is_missing(F.col(label)))
    keys = [*by, label]

    def firsts(column: str, n: int, to: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(article, column)
        few = real.where(~is_missing(F.col(column)) & (F.col(column) != "N/A")).select(*keys, article, column).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
        texts = F.transform(F.array_sort(F.collect_list(F.struct("__n", column))), lambda x: x[column])
        return few.groupBy(*keys).agg(texts.alias(to))

    g = real.groupBy(*keys).agg(F.countDistinct(article).alias("articles"))
    g = g.join(firsts(example, 3, "__e"), keys, "left").join(firsts(cause, 1, "__c"), keys, "left")
    none = F.array().cast("array<string>")
    said = F.array_distinct(F.concat(F.slice(F.coalesce("__e", none), 1, 2), F.coalesce("__c", none)))
    g = g.select(*keys, "articles", F.left(F.array_join(said, " | "), F.lit(longest)).alias("definition"), F.array_distinct(F.coalesce("__e", none)).alias("evidence"))
    w = Window.partitionBy(*by).orderBy(F.col("articles").desc(), F.lower(label), label)
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def assigned(rows: DataFrame, label: str, categories: DataFrame, name: str, other: str = "N/A") -> DataFrame:
    """The rows of an apply run: labels that are one of the allowed categories without regard to case take its spelling,
    all others are `other`. Categories are a list of at most a few hundred."""
    known = categories.select(F.lower(F.trim(name)).alias("__k"), F.col(name).alias("__name")).dropDuplicates(["__k"])
    j = rows.withColumn("__k", F.lower(F.trim(label))).join(known, "__k", "left")
    return j.withColumn(label, F.coalesce("__name", F.lit(other))).drop("__k", "__name")


def by_rule_table(rows: DataFrame, id_col: str, column: str, rules: DataFrame, default: str) -> DataFrame:
    """(id, outcome): of each row the outcome of the first rule (rule_order, word, outcome) whose word its text holds.
    Rules are a table of at most a few hundred; each row meets them once, and only hits are folded."""
    t = rows.select(F.col(id_col), F.lower(F.col(column)).alias("__t"))
    r = F.broadcast(rules.select("rule_order", F.lower("word").alias("__w"), "outcome"))
    hits = t.join(r, F.col("__t").contains(F.col("__w"))).groupBy(id_col).agg(F.min_by("outcome", "rule_order").alias("outcome"))
    return rows.select(id_col).join(hits, id_col, "left").select(id_col, F.coalesce("outcome", F.lit(default)).alias("outcome"))


def shortest_label(rows: DataFrame, label: str) -> DataFrame:
    """One spelling per label without regard to case: the shortest, then the first in order."""
    return rows.where(F.trim(label) != "").groupBy(F.lower(F.trim(label)).alias("label_key")).agg(F.min_by(label, F.struct(F.length(label), label)).alias("label"))


def leader_clusters(groups: DataFrame, by: str, name: str, text: str, order: list[str], least: float = 0.58) -> DataFrame:
    """Adds cluster_id (from 1) and leader: in order, each group joins the cluster whose leader it is most similar to, if
    that is at least `least`, else it leads a new one. Order-dependent, so it is folded per `by` value; groups are bounded
    by their number per run (25) times the runs of a batch."""
    kinds = dict(groups.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        leaders: list[tuple[str, str]] = []
        ids, heads = [], []
        done = pdf.sort_values(order).copy()
        for n, t in done[[name, text]].fillna("").itertuples(index=False):
            scores = [text_similarity(n, t, ln, lt, least) for ln, lt in leaders]
            at = max(range(len(scores)), key=scores.__getitem__, default=None)
            if at is None or scores[at] < least:
                leaders.append((n, t))
                at = len(leaders) - 1
            ids.append(at + 1)
            heads.append(leaders[at][0])
        done["cluster_id"], done["leader"] = ids, heads
        return done

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in groups.columns)
    return groups.groupBy(by).applyInPandas(fold, f"{schema}, cluster_id int, leader string")


def cluster_summary(clusters: DataFrame, by: str, name: str, text: str, order: list[str]) -> DataFrame:
    """(by, cluster_id, name, definition, members): a cluster's most frequent name (the first in order of those) and its
    longest definition (likewise)."""
    place = F.struct(*order)
    names = clusters.groupBy(by, "cluster_id", name).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    best = names.groupBy(by, "cluster_id").agg(F.min_by(name, F.struct(-F.col("n"), F.col("first"))).alias("name"), F.sum("n").alias("members"))
    longest = clusters.groupBy(by, "cluster_id").agg(F.min_by(text, F.struct(-F.length(F.coalesce(F.col(text), F.lit(""))), place)).alias("definition"))
    return best.join(longest, [by, "cluster_id"]).select(by, "cluster_id", "name", "definition", "members")


def adjudicate(members: DataFrame, by: str, cluster: str, run: str, article: str, alpha: float = 0.5, least: float = 0.6, top: int = 25) -> DataFrame:
    """(by, cluster, support, coverage, score, consensus, kept) of a batch's clusters.

    Support is the share of the batch's runs, coverage the share of its articles; both totals come from the data. Clusters
    with at least the least support are the consensus; of them the `top` by score, support and name are kept.
    """
    totals = members.groupBy(by).agg(F.countDistinct(run).alias("runs"), F.countDistinct(article).alias("articles"))
    g = members.groupBy(by, cluster).agg(F.countDistinct(run).alias("r"), F.countDistinct(article).alias("a")).join(F.broadcast(totals), by)
    support, coverage = F.col("r") / F.col("runs"), F.col("a") / F.col("articles")
    g = g.select(by, cluster, F.round(support, 4).alias("support"), F.round(coverage, 4).alias("coverage"), F.round(alpha * support + (1 - alpha) * coverage, 4).alias("score"))
    g = g.withColumn("consensus", F.col("support") >= least)
    w = Window.partitionBy(by, "consensus").orderBy(F.col("score").desc(), F.col("support").desc(), F.lower(cluster), F.col(cluster))
    return g.withColumn("kept", F.col("consensus") & (F.row_number().over(w) <= top))


def adjudication_metrics(judged: DataFrame, members: DataFrame, by: str, cluster: str, run: str) -> DataFrame:
    """Per batch: clusters, consensus and kept ones, the share of a run's groups that merging took away, the share of the
    consensus that the limit took, and the share of clusters with consensus."""
    groups = members.select(by, run, cluster).distinct().groupBy(by).agg(F.count(F.lit(1)).alias("run_groups"))
    n = judged.groupBy(by).agg(F.count(F.lit(1)).alias("clusters"), F.sum(F.col("consensus").cast("int")).alias("agreed"), F.sum(F.col("kept").cast("int")).alias("retained"))
    j = n.join(groups, by)
    return j.select(
        by, "clusters", F.col("agreed").cast("bigint").alias("agreed"), F.col("retained").cast("bigint").alias("retained"), F.round((F.col("run_groups") - F.col("clusters")) / F.col("run_groups"), 4).alias("merge_rate"),
        F.round(F.when(F.col("agreed") > 0, 1 - F.col("retained") / F.col("agreed")).otherwise(0.0), 4).alias("truncation_loss"), F.round(F.col("agreed") / F.col("clusters"), 4).alias("consensus_rate"),
    )


def merged_names(rows: DataFrame, name: str, other: list[str], disease: str) -> DataFrame:
    """(name, other columns, disease), one row per name and disease without regard to case.

    Rows of a name without a disease give their other columns to all of its rows with one, or become one row if there are
    none. Of two diseases of a name that differ only in what stands behind them in brackets the longer stays, with the
    other columns of both. Lists are merged in order, each entry once.
    """
    key = lambda c: normalise_key(F.col(c))
    base = rows.withColumn("__k", key(name)).withColumn("__d", key(disease)).withColumn("__i", F.struct(F.col(name), F.col(disease), *other))
    lists = lambda c, when: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(F.col("__i"), split_terms(F.col(c)).alias("t"))))), lambda x: x["t"]))
    bare = base.where(F.col("__d") == "").groupBy("__k").agg(F.min(name).alias("__name"), *[lists(c, F.lit(True)).alias(f"__x_{c}") for c in other])
    own = base.where(F.col("__d") != "").groupBy("__k", "__d").agg(F.min(name).alias(name), F.min(disease).alias(disease), *[lists(c, F.lit(True)).alias(c) for c in other])
    none = F.array().cast("array<string>")
    j = own.join(bare, "__k", "left").select("__k", name, *[dedupe_ordered(F.concat(c, F.coalesce(f"__x_{c}", none))).alias(c) for c in other], disease)
    alone = bare.join(own.select("__k").distinct(), "__k", "left_anti").select("__k", F.col("__name").alias(name), *[dedupe_ordered(F.col(f"__x_{c}")).alias(c) for c in other], F.lit("").alias(disease))
    # twins meet by their name without brackets; few rows share it
    all_rows = j.unionByName(alone).withColumn("__b", F.trim(F.regexp_replace(normalise_key(F.col(disease)), r"\s*\(.*?\)\s*$", "")))
    first = F.struct(-F.length(disease), F.col(disease))
    twins = all_rows.groupBy("__k", "__b").agg(
        F.min_by(name, first).alias(name), *[F.transform(F.array_sort(F.collect_list(F.struct(first.alias("o"), F.col(c).alias("t")))), lambda x: x["t"]).alias(c) for c in other], F.min_by(disease, first).alias(disease)
    )
    return twins.select(name, *[F.array_join(dedupe_ordered(F.flatten(c)), ", ").alias(c) for c in other], disease)


def hit_score(label: Column, description: Column, alias: Column, matched: Column, match_type: Column, query: Column, kind_pattern: str) -> Column:
    """Score of a lookup's hit: 10 for an equal label, 8 for an equal match, 6 for an equal alias, 2 where label and query
    hold one another, 2 or 1 for a match on the label or an alias, 3 for a description of the right kind."""
    l, a, m, q = (normalise_key(c) for c in (label, alias, matched, query))
    points = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    return (
        points(l == q, 10) + points(m == q, 8) + points(a == q, 6) + points((l != "") & (q != "") & (l.contains(q) | q.contains(l)), 2)
        + points(match_type == "label", 2) + points(match_type == "alias", 1) + points(normalise_key(description).rlike(kind_pattern), 3)
    )


def best_hit(hits: DataFrame, by: str, score: str, match_type: str, hit: str, least: int = 3) -> DataFrame:
    """(by, hit, score): the best hit of each query, matches on the label before others, then the first; none below the
    least score."""
    top = F.min_by(F.struct(hit, score), F.struct(-F.col(score), (F.col(match_type) != "label").cast("int"), F.col(hit)))
    return hits.groupBy(by).agg(top.alias("b")).select(by, f"b.{hit}", f"b.{score}").where(F.col(score) >= least)
