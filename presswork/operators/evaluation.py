"""Ensembles of labelling models: pooling, calibration, tuning, and agreement between raters.

Votes are kept long: one row per (item, model). Every result is an aggregate of counts, so no step depends on how many
votes an item or a label has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions.text import dedupe_ordered


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)).cast("double")


def pooled(votes: DataFrame, item: str = "item", threshold: float = 0.75, min_agreement: float = 0.0) -> DataFrame:
    """(item, probability, agreement, supporters, relevant) of votes (item, alias, weight, p, vote).

    Models without positive weight are left out, unless no model of the item has any; then all count the same.
    """
    some = F.max(F.when(F.col("weight") > 0, 1).otherwise(0))
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(0.0))
    has = votes.groupBy(item).agg(
        some.alias("any"), F.sum(w).alias("sw"), F.sum(w * F.col("p")).alias("swp"), F.avg("p").alias("ap"),
        F.sum(F.when(F.col("weight") > 0, F.col("vote").cast("int"))).alias("wv"), F.sum(F.when(F.col("weight") > 0, 1)).alias("wn"),
        F.sum(F.col("vote").cast("int")).alias("av"), F.count(F.lit(1)).alias("an"),
        F.array_sort(F.collect_list(F.when(F.col("vote") & (F.col("weight") > 0), F.col("alias")))).alias("ws"),
        F.array_sort(F.collect_list(F.when(F.col("vote"), F.col("alias")))).alias("s"),
    )
    anyw = F.col("any") == 1
    prob = F.when(anyw, F.col("swp") / F.col("sw")).otherwise(F.col("ap"))
    agree = F.when(anyw, F.col("wv") / F.col("wn")).otherwise(F.col("av") / F.col("an"))
    out = has.select(item, prob.alias("probability"), agree.alias("agreement"), F.array_join(F.when(anyw, F.col("ws")).otherwise(F.col("s")), ",").alias("supporters"))
    return out.withColumn("relevant", (F.col("probability") >= threshold - 1e-12) & (F.col("agreement") >= min_agreement - 1e-12))


def confusion(df: DataFrame, predicted: Column, truth: Column, by: list[str] | None = None) -> DataFrame:
    """Counts and rates per group; rates with an empty denominator are 0."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    counts = df.groupBy(*(by or [])).agg(one(predicted & truth).alias("tp"), one(predicted & ~truth).alias("fp"), one(~predicted & ~truth).alias("tn"), one(~predicted & truth).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    spec = ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    return counts.select(
        *(by or []), "tp", "fp", "tn", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"),
        F.round(ratio(2 * p * r, p + r), 4).alias("f1"), F.round((r + spec) / 2, 4).alias("balanced_accuracy"),
        F.round(ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")), 4).alias("accuracy"),
    )


def brier(df: DataFrame, p: Column, y: Column, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.round(F.avg(F.pow(p - y, F.lit(2.0))), 6).alias("brier"))


def calibration_bins(df: DataFrame, p: Column, y: Column, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """(bin, n, mean_p, mean_y) of equal-width bins; the top bin holds 1."""
    b = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("bigint")
    return df.groupBy(*(by or []), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def expected_calibration_error(df: DataFrame, p: Column, y: Column, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    b = calibration_bins(df, p, y, bins, by)
    return b.groupBy(*(by or [])).agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n"), 6).alias("ece"))


def average_precision(df: DataFrame, score: str, truth: Column, by: list[str] | None = None) -> DataFrame:
    """Area under the steps of precision over recall, counted only where recall rises; NULL without a true row.

    Thresholds are the scores to six digits, 1 and 0; a row counts from the largest threshold on that its own score
    reaches. Precision and recall are rounded to four digits first. Rows are folded to one per threshold, at most 10^6 + 1
    of a group whatever its size, and the running sums run over those.
    """
    by = by or []
    p = F.col(score)
    reached = F.floor(p * 1e6).cast("bigint")
    rows = df.select(*by, F.round(p * 1e6).cast("bigint").alias("at"), reached.alias("r"), truth.cast("int").alias("y"))
    counts = rows.groupBy(*by, F.col("r").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), F.lit(0).alias("is_t"))
    none = [F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("pos"), F.lit(1).alias("is_t")]
    marks = rows.select(*by, "at").distinct().select(*by, "at", *none)
    ends = rows.select(*by).distinct().select(*by, F.explode(F.expr("array(0L, 1000000L)")).alias("at"), *none)
    per = counts.unionByName(marks).unionByName(ends).groupBy(*by, "at").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.max("is_t").alias("is_t"))
    w = Window.partitionBy(*by).orderBy(F.col("at").desc())
    cum = per.select(*by, "at", "is_t", F.sum("n").over(w).alias("cn"), F.sum("pos").over(w).alias("cp"), F.sum("pos").over(Window.partitionBy(*by)).alias("all")).where("is_t = 1")
    steps = cum.select(*by, "at", "all", F.round(ratio(F.col("cp"), F.col("cn")), 4).alias("p"), F.round(ratio(F.col("cp"), F.col("all")), 4).alias("r"))
    steps = steps.withColumn("rise", F.col("r") - F.coalesce(F.lag("r").over(w), F.lit(0.0)))
    return steps.groupBy(*by).agg(F.round(F.when(F.max("all") > 0, F.sum(F.col("p") * F.col("rise"))), 4).alias("auprc"))


def normalized_weights(rows: DataFrame, by: list[str], weight: str) -> DataFrame:
    """Weights as shares of their group's positive sum, to six digits; negative and missing ones are 0, and where none is
    positive all are equal."""
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    own = Window.partitionBy(*by)
    total = F.sum(w).over(own)
    return rows.withColumn(weight, F.when(total > 0, F.round(w / total, 6)).otherwise(F.lit(1.0) / F.count(F.lit(1)).over(own)))


def consolidated_evidence(votes: DataFrame, item: str, relevant: str) -> DataFrame:
    """(item, evidence): spans of all supporters in the order of their names if the item is relevant, else those of the
    model with the most weight, then confidence; each span once without regard to case. votes: (item, alias, weight, p,
    vote, spans, relevant)."""
    best = F.max(F.struct("weight", "p", F.struct("spans").alias("s")))
    lists = F.array_sort(F.collect_list(F.when(F.col("vote"), F.struct("alias", "spans"))))
    g = votes.groupBy(item).agg(best.alias("b"), lists.alias("l"), F.max(relevant).alias("r"))
    spans = F.when(F.col("r"), F.flatten(F.transform("l", lambda x: x["spans"]))).otherwise(F.col("b.s.spans"))
    return g.select(item, dedupe_ordered(F.coalesce(spans, F.array().cast("array<string>"))).alias("evidence"))


def missing_votes(votes: DataFrame, item: str = "item", label: str = "label") -> DataFrame:
    """(missing, items): how many items lack how many labels."""
    per = votes.groupBy(item).agg(F.sum(F.when(F.col(label).isNull() | (F.trim(label) == ""), 1).otherwise(0)).cast("bigint").alias("missing"))
    return per.groupBy("missing").agg(F.count(F.lit(1)).alias("items"))


def weight_grid(models: list[str], step: float = 0.25) -> list[dict[str, float]]:
    """All weightings of up to four models in multiples of the step that sum to 1."""
    parts = round(1 / step)

    def compose(left: int, k: int):
        if k == 1:
            yield (left,)
            return
        for i in range(left + 1):
            for rest in compose(left - i, k - 1):
                yield (i, *rest)

    return [dict(zip(models, (round(x * step, 6) for x in c))) for c in compose(parts, len(models))]


def tune(votes: DataFrame, labels: DataFrame, item: str, grid: list[dict[str, float]], thresholds: list[float], agreements: list[float], floor: float = 0.85, objective: str = "f1") -> DataFrame:
    """The best candidate (weights, threshold, agreement) of a bounded grid by recall floor, then the objective (f1 or
    precision), F1, recall, threshold, agreement; the first one wins ties.

    Votes are folded to one row per item before the grid is joined; all candidates are evaluated in one aggregation.
    """
    spark = votes.sparkSession
    models = sorted(grid[0])
    wide = votes.groupBy(item).agg(*[F.max(F.when(F.col("alias") == m, F.col("p"))).alias(f"p_{m}") for m in models], *[F.max(F.when(F.col("alias") == m, F.col("vote").cast("int"))).alias(f"v_{m}") for m in models])
    rows = wide.join(labels, item)
    cands = [(i, *[float(g[m]) for m in models], float(t), float(a)) for i, (g, t, a) in enumerate((g, t, a) for g in grid for t in thresholds for a in agreements)]
    grid_df = spark.createDataFrame(cands, "candidate long, " + ", ".join(f"w_{m} double" for m in models) + ", threshold double, agreement double")
    prob = sum(F.col(f"w_{m}") * F.col(f"p_{m}") for m in models)
    used = sum(F.when(F.col(f"w_{m}") > 0, 1).otherwise(0) for m in models)
    votes_for = sum(F.when(F.col(f"w_{m}") > 0, F.col(f"v_{m}")).otherwise(0) for m in models)
    scored = rows.crossJoin(F.broadcast(grid_df)).withColumn("hit", (F.round(prob, 9) >= F.col("threshold")) & (F.round(votes_for / used, 9) >= F.col("agreement")))
    m = confusion(scored, F.col("hit"), F.col("truth"), ["candidate", "threshold", "agreement"])
    best = F.max_by(F.struct("candidate", "threshold", "agreement", "precision", "recall", "f1"), F.struct((F.col("recall") >= floor).cast("int"), F.col(objective).alias("o"), "f1", "recall", "threshold", "agreement", -F.col("candidate")))
    return m.agg(best.alias("b")).select("b.*")


def majority(votes: DataFrame, item: str = "item", label: str = "label") -> DataFrame:
    """(item, label, share): most frequent label, ties to the first in alphabet; missing labels do not vote; items with a
    single vote have no share."""
    counts = votes.where(F.col(label).isNotNull() & (F.trim(label) != "")).groupBy(item, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(label, F.struct(-F.col("n"), label))
    return counts.groupBy(item).agg(best.alias("label"), F.when(F.sum("n") > 1, F.round(F.max("n") / F.sum("n"), 6)).alias("share"))


def coincidences(votes: DataFrame, item: str = "item", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """(by, c, k, o): coincidences of labels over items with two ratings or more, from label counts per item."""
    by = by or []
    n = votes.where(F.col(label).isNotNull()).groupBy(*by, item, F.col(label).alias("c")).agg(F.count(F.lit(1)).alias("nc"))
    m = n.groupBy(*by, item).agg(F.sum("nc").alias("m"), F.collect_list(F.struct("c", "nc")).alias("cs")).where("m >= 2")
    # a struct per distinct label: their number is bounded by the label set
    a = m.select(*by, "m", "cs", F.explode("cs").alias("x")).select(*by, "m", "x", F.explode("cs").alias("y"))
    pairs = F.when(F.col("x.c") == F.col("y.c"), F.col("x.nc") * (F.col("x.nc") - 1)).otherwise(F.col("x.nc") * F.col("y.nc"))
    return a.groupBy(*by, F.col("x.c").alias("c"), F.col("y.c").alias("k")).agg(F.sum(pairs / (F.col("m") - 1)).alias("o"))


def krippendorff_alpha(votes: DataFrame, item: str = "item", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Nominal alpha with missing values; NULL where nothing varies."""
    by = by or []
    o = coincidences(votes, item, label, by)
    nc = o.groupBy(*by, "c").agg(F.sum("o").alias("n_c"))
    tot = nc.groupBy(*by).agg(F.sum("n_c").alias("n"), F.sum(F.col("n_c") * F.col("n_c")).alias("sq"))
    off = o.groupBy(*by).agg(F.sum(F.when(F.col("c") != F.col("k"), F.col("o")).otherwise(0.0)).alias("d"))
    j = off.join(tot, by) if by else off.crossJoin(tot)
    return j.select(*by, F.round(1 - (F.col("n") - 1) * F.col("d") / F.nullif(F.col("n") * F.col("n") - F.col("sq"), F.lit(0)), 6).alias("alpha"))


def ordinal_alpha(votes: DataFrame, levels: list[str], item: str = "item", label: str = "label") -> DataFrame:
    """Alpha of labels in rank order: two labels differ by the ratings between them, half of their own included. The
    coincidence table has at most levels x levels rows."""
    rank = F.coalesce(*[F.when(F.col(label) == x, i) for i, x in enumerate(levels)])
    o = coincidences(votes.select(item, rank.alias(label)), item, label)
    nc = o.groupBy("c").agg(F.sum("o").alias("n"))
    up_to = F.sum("n").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = nc.select("c", "n", up_to.alias("up"))
    l, r = ranked.selectExpr("c AS a", "n AS na", "up AS ua"), ranked.selectExpr("c AS b", "n AS nb", "up AS ub")
    # a row per pair of levels
    pairs = l.crossJoin(r).withColumn("dist", F.pow(F.abs(F.col("ub") - F.col("ua")) + F.when(F.col("b") > F.col("a"), F.col("na")).otherwise(F.col("nb")) - (F.col("na") + F.col("nb")) / 2, F.lit(2.0)))
    seen = pairs.join(o, (F.col("a") == F.col("c")) & (F.col("b") == F.col("k")), "left")
    sums = seen.agg(F.sum(F.coalesce("o", F.lit(0.0)) * F.col("dist")).alias("d"), F.sum(F.col("na") * F.col("nb") * F.col("dist")).alias("e")).crossJoin(nc.agg(F.sum("n").alias("n")))
    return sums.select(F.round(1 - (F.col("n") - 1) * F.col("d") / F.nullif(F.col("e"), F.lit(0.0)), 6).alias("alpha"))


def alpha_interval(votes: DataFrame, item: str = "item", label: str = "label", resamples: int = 2000, seed: int = 42, low: float = 2.5, high: float = 97.5) -> DataFrame:
    """(alpha, low, high, resamples): nominal alpha with percentile bounds from resamples of the items with replacement.

    Alpha depends on an item only through how often it got each label. Items are folded to these patterns, whose number is
    bounded by the label set and the raters, not by the items; a resample is then a multinomial draw over the patterns'
    counts, which has the same distribution as drawing the items one by one. Percentiles are linear.
    """
    import numpy as np

    counts = votes.where(F.col(label).isNotNull()).groupBy(item, label).agg(F.count(F.lit(1)).alias("n"))
    own = counts.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), "n"))).alias("pattern"))
    per = votes.select(item).distinct().join(own, item, "left").groupBy("pattern").agg(F.count(F.lit(1)).alias("items")).collect()
    labels = sorted({x["l"] for r in per for x in r["pattern"] or []})
    spark = votes.sparkSession
    schema = "alpha double, low double, high double, resamples int"
    if not labels:
        return spark.createDataFrame([(None, None, None, resamples)], schema)
    per.sort(key=lambda r: str(r["pattern"]))
    table = np.zeros((len(per), len(labels)))
    for i, r in enumerate(per):
        for x in r["pattern"] or []:
            table[i, labels.index(x["l"])] = x["n"]
    items = np.array([r["items"] for r in per], dtype=np.int64)
    m = table.sum(axis=1)
    used = m >= 2
    # coincidences of each pattern: on the diagonal n (n - 1), beside it n n', over m - 1
    share = np.einsum("pc,pk->pck", table, table) - np.einsum("pc,ck->pck", table, np.eye(len(labels)))
    share = np.where(used[:, None, None], share / np.maximum(m - 1, 1)[:, None, None], 0.0)

    def alphas(weights: np.ndarray) -> np.ndarray:
        o = np.tensordot(weights.astype(float), share, axes=1)
        nc = o.sum(axis=2)
        n = nc.sum(axis=1)
        off = n - np.einsum("bcc->b", o)
        expected = n * n - (nc * nc).sum(axis=1)
        return np.where(expected > 0, 1 - (n - 1) * off / np.where(expected > 0, expected, 1), np.nan)

    draws = np.random.default_rng(seed).multinomial(items.sum(), items / items.sum(), size=resamples)
    got = alphas(draws)
    got = got[~np.isnan(got)]
    bounds = [None if not len(got) else round(float(np.percentile(got, q)), 6) for q in (low, high)]
    own_alpha = float(alphas(items[None, :])[0])
    return spark.createDataFrame([(None if own_alpha != own_alpha else round(own_alpha, 6), *bounds, resamples)], schema)


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kappa of two raters from their contingency counts."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = t.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    pa, pb = t.groupBy("a").agg(F.sum("n").alias("na")), t.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = pa.join(pb, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("e"))
    po, pe = F.col("same") / F.col("t"), F.col("e") / (F.col("t") * F.col("t"))
    return total.crossJoin(chance).select(F.round((po - pe) / F.nullif(1 - pe, F.lit(0)), 6).alias("kappa"))


def pairwise_agreement(votes: DataFrame, item: str = "item", label: str = "label") -> DataFrame:
    """Full agreement share, mean pairwise agreement and disagreement rate over items, from label counts per item."""
    n = votes.groupBy(item, label).agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy(item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"), F.count(F.lit(1)).alias("kinds")).where("m >= 2")
    return per.agg(
        F.round(F.avg((F.col("kinds") == 1).cast("int")), 6).alias("full_agreement"),
        F.round(F.sum("same") / F.sum(F.col("m") * (F.col("m") - 1)), 6).alias("pairwise_agreement"),
        F.round(1 - F.avg((F.col("kinds") == 1).cast("int")), 6).alias("disagreement_rate"),
    )
