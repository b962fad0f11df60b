"""Queries over ensembles, agreement, overlap, resampling, groups, topics and reports.

Model votes and ratings, which no table holds, come from hashes of document ids, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.functions import text
from presswork.operators import evaluation as ev
from presswork.operators import groups, overlap, reports, resample, state, topics
from presswork.operators.resample import hash_number
from presswork.session import read_table

MODELS = ["m1", "m2", "m3"]
WEIGHTS = {"m1": 0.5, "m2": 0.3, "m3": 0.2}


def _docs(spark, d):
    return read_table(spark, d, "documents").select(F.col("doc_id").alias("item"))


def _votes(spark, d):
    h = hash_number(F.concat_ws(":", "item", "alias"))
    v = _docs(spark, d).select("item", F.explode(F.array(*[F.struct(F.lit(m).alias("alias"), F.lit(w).alias("weight")) for m, w in WEIGHTS.items()])).alias("m"))
    v = v.select("item", "m.alias", "m.weight").withColumn("h", F.pmod(h, F.lit(1000)))
    return v.select("item", "alias", "weight", (F.col("h") / 1000).alias("p"), (F.col("h") >= 500).alias("vote"))


def _labels(spark, d):
    return _docs(spark, d).select("item", (F.pmod(hash_number(F.concat(F.col("item").cast("string"), F.lit(":t"))), F.lit(2)) == 0).alias("truth"))


def _ratings(spark, d):
    r = _docs(spark, d).select("item", F.explode(F.array(*[F.lit(f"r{i}") for i in range(1, 5)])).alias("rater"))
    h = hash_number(F.concat_ws(":", "item", "rater"))
    return r.select("item", "rater", F.when(F.pmod(h, F.lit(11)) != 0, F.element_at(F.array(F.lit("no"), F.lit("yes"), F.lit("unsure")), (F.pmod(h, F.lit(3)) + 1).cast("int"))).alias("label"))


def _pooled(spark, d):
    return ev.pooled(_votes(spark, d), "item", 0.5, 0.34)


def ensemble_vote(spark, d):
    return _pooled(spark, d).select("item", F.round("probability", 4).alias("probability"), F.round("agreement", 4).alias("agreement"), "supporters", "relevant")


def confusion_metrics(spark, d):
    return ev.confusion(_pooled(spark, d).join(_labels(spark, d), "item"), F.col("relevant"), F.col("truth"))


def per_run_metrics(spark, d):
    return ev.confusion(_votes(spark, d).join(_labels(spark, d), "item"), F.col("vote"), F.col("truth"), ["alias"])


def _scored(spark, d):
    return _votes(spark, d).join(_labels(spark, d), "item")


def brier(spark, d):
    return ev.brier(_scored(spark, d), F.col("p"), F.col("truth").cast("double"), ["alias"])


def ece(spark, d):
    return ev.expected_calibration_error(_scored(spark, d), F.col("p"), F.col("truth").cast("double"), 10, ["alias"])


def auprc(spark, d):
    return ev.average_precision(_scored(spark, d), "p", F.col("truth"), ["alias"])


def model_validation(spark, d):
    """Per model: confusion counts and rates, calibration and the rows they rest on."""
    s = _scored(spark, d)
    m = ev.confusion(s, F.col("vote"), F.col("truth"), ["alias"])
    n = s.groupBy("alias").agg(F.count(F.lit(1)).alias("scored"))
    return m.join(brier(spark, d), "alias").join(ece(spark, d), "alias").join(n, "alias").select("alias", "precision", "recall", "f1", "brier", "ece", "scored")


def threshold_tuning(spark, d):
    grid = ev.weight_grid(MODELS, 0.5)
    return ev.tune(_votes(spark, d), _labels(spark, d), "item", grid, [0.4, 0.5, 0.6], [0.34, 0.67]).select("candidate", "threshold", "agreement", "precision", "recall", "f1")


def threshold_tuning_full(spark, d):
    """The reference's whole grid, 225 candidates; threshold_tuning keeps the 36 that its SQL names."""
    grid = ev.weight_grid(MODELS, 0.25)
    return ev.tune(_votes(spark, d), _labels(spark, d), "item", grid, [0.65, 0.7, 0.75, 0.8, 0.85], [0.34, 0.67, 1.0]).select("candidate", "threshold", "agreement", "precision", "recall", "f1")


def model_run_summary(spark, d):
    return _votes(spark, d).groupBy("alias").agg(F.min("item").alias("first_item"), F.sum(F.col("vote").cast("int")).cast("bigint").alias("positive"), F.round(F.avg("p"), 6).alias("mean_p"))


def agreement_summary(spark, d):
    return ev.pairwise_agreement(_votes(spark, d).withColumn("label", F.col("vote").cast("string")))


def majority_vote(spark, d):
    return ev.majority(_ratings(spark, d)).select("item", "label", F.coalesce("share", F.lit(-1.0)).alias("share"))


def label_counts(spark, d):
    return _ratings(spark, d).groupBy("rater", F.coalesce("label", F.lit("missing")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def krippendorff_alpha(spark, d):
    return ev.krippendorff_alpha(_ratings(spark, d))


def _numbered(spark, d):
    """(item, rn) of all documents and their number."""
    docs = _docs(spark, d)
    return state.global_rank(docs, [F.col("item")]), docs.count()


def alpha_bootstrap(spark, d):
    """Alpha of 5 resamples of as many items as there are: percentile bounds come from these."""
    ids, n = _numbered(spark, d)
    s = resample.bootstrap(ids, "rn", n, 5, n, "alpha").select("batch_id", F.concat_ws(":", "draw", "rn").alias("unit"), "item")
    return ev.krippendorff_alpha(s.join(_ratings(spark, d), "item").select("batch_id", F.col("unit").alias("item"), "label"), by=["batch_id"])


def cohen_kappa(spark, d):
    r = _ratings(spark, d)
    wide = r.groupBy("item").agg(F.max(F.when(F.col("rater") == "r1", F.col("label"))).alias("a"), F.max(F.when(F.col("rater") == "r2", F.col("label"))).alias("b"))
    return ev.cohen_kappa(wide, "a", "b")


def _variants(spark, d):
    e = read_table(spark, d, "events")
    return e.select(F.weekofyear("ts").cast("bigint").alias("week"), F.col("event_type").alias("variant"), F.col("user_id").alias("article"))


def overlap_pairwise(spark, d):
    return overlap.pairwise(_variants(spark, d), ["week"], "variant", "article")


def overlap_summary(spark, d):
    return overlap.summary(_variants(spark, d), ["week"], "variant", "article")


def membership_patterns(spark, d):
    return overlap.membership_patterns(_variants(spark, d), ["week"], "variant", "article")


def jaccard_matrix(spark, d):
    p = overlap.pairwise(_variants(spark, d).withColumn("week", F.lit(0)), ["week"], "variant", "article")
    kinds = ["click", "error", "purchase", "signup", "view"]
    return p.groupBy("variant_a").pivot("variant_b", kinds).agg(F.first("jaccard")).na.fill(-1.0).select("variant_a", *kinds)


def variant_counts(spark, d):
    v = _variants(spark, d)
    grid = v.select("week").distinct().crossJoin(v.select("variant").distinct())
    n = v.groupBy("week", "variant").agg(F.countDistinct("article").alias("articles"))
    return grid.join(n, ["week", "variant"], "left").select("week", "variant", F.coalesce("articles", F.lit(0)).alias("articles"))


def peak_weeks(spark, d):
    return reports.last_per_group(variant_counts(spark, d), ["variant"], [F.col("articles").desc(), F.col("week")])


def sample_split(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey")
    a, b = resample.simple_sample(c, "c_custkey", 100, "s1")
    return a.withColumn("part", F.lit("sample")).unionByName(b.withColumn("part", F.lit("rest")))


def stratified_sample(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return resample.stratified_sample(c, "c_mktsegment", "c_custkey", 5, "s2")


def bootstrap_samples(spark, d):
    ids, n = _numbered(spark, d)
    return resample.bootstrap(ids, "rn", n, 4, n, "b").select("batch_id", "draw", "item")


def batch_overlap(spark, d):
    return resample.batch_overlap(bootstrap_samples(spark, d), "batch_id", "item")


def _categories(spark, d):
    r = read_table(spark, d, "rss_items")
    return r.select(
        "item_id", F.col("pathogen_domain").alias("batch"), F.col("batch_no").alias("run"), F.col("search_string").alias("label"), F.col("rss_title").alias("example"), F.col("source_hint").alias("cause")
    ).where("label IS NOT NULL AND trim(label) <> ''")


def _run_groups(spark, d):
    return groups.build_groups(_categories(spark, d), ["batch", "run"], "label", "item_id", "example", "cause")


def build_groups(spark, d):
    g = groups.build_groups(_categories(spark, d), ["batch"], "label", "item_id", "example", "cause")
    return g.select("batch", "label", "articles", "definition", text.serialize(F.col("evidence")).alias("evidence"), F.col("rank").cast("bigint").alias("rank"))


def shortest_label(spark, d):
    return groups.shortest_label(_categories(spark, d), "label")


def harmonize_groups(spark, d):
    """Groups of all runs of a batch, merged where their names and definitions are alike."""
    g = _run_groups(spark, d).select("batch", "run", "rank", "label", "definition")
    c = groups.leader_clusters(g, "batch", "label", "definition", ["run", "rank"])
    return groups.cluster_summary(c, "batch", "label", "definition", ["run", "rank"])


def adjudicate(spark, d):
    """Labels without regard to case as clusters of each batch's runs."""
    c = _categories(spark, d).withColumn("label", F.lower(F.trim("label")))
    return groups.adjudicate(c, "batch", "label", "run", "item_id").select("batch", "label", "support", "coverage", "score", "consensus", "kept")


def adjudication_metrics(spark, d):
    c = _categories(spark, d).withColumn("label", F.lower(F.trim("label")))
    return groups.adjudication_metrics(groups.adjudicate(c, "batch", "label", "run", "item_id"), c, "batch", "label", "run")


def pair_similarity(spark, d):
    s = read_table(spark, d, "search_strings").where("trim(search_string) <> '' AND trim(search_string_fr) <> ''")
    return s.select("search_string", groups.pair_similarity("search_string", "search_string_en", "search_string_fr", "search_string_es").alias("similarity"))


def ngram_counts(spark, d):
    return _ngrams(read_table(spark, d, "documents").select("lang", "text").where("lang IN ('en', 'fr')"))


def ngram_counts_all(spark, d):
    """Of all labels, missing ones as their own group; ngram_counts keeps the two that its SQL names."""
    lang = F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("(missing)"))
    return _ngrams(read_table(spark, d, "documents").select(lang.alias("lang"), "text"))


def _ngrams(docs):
    docs = docs.select("lang", topics.content_words(F.col("text")).alias("w"))
    t = docs.select("lang", F.explode(topics.ngrams(F.col("w"), 2)).alias("term"))
    return t.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("tf")).where("tf >= 20")


def _ctfidf(spark, d):
    docs = read_table(spark, d, "documents").select("genre", "doc_id", "text").where("text IS NOT NULL")
    return topics.class_tf_idf(topics.term_counts(docs, "genre", "doc_id", "text", 1, 5), "genre")


def ctfidf(spark, d):
    return _ctfidf(spark, d).select("genre", "term", F.col("tf").cast("bigint").alias("tf"), F.round("weight", 4).alias("weight"))


def topic_keywords(spark, d):
    return topics.topic_keywords(_ctfidf(spark, d), "genre")


def mmr_keywords(spark, d):
    return topics.mmr_keywords(_ctfidf(spark, d), "genre")


def topic_summary(spark, d):
    return topics.topic_summary(read_table(spark, d, "embeddings").select((F.col("label") - 1).alias("topic")), "topic")


def kmeans_topics(spark, d):
    e = read_table(spark, d, "embeddings")
    return topics.kmeans_topics(e.select("vec_id", "embedding"), "embedding", e.count()).select("vec_id", "topic")


def projection_2d(spark, d):
    return topics.projection_2d(read_table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def null_rates(spark, d):
    return reports.null_rates(read_table(spark, d, "rss_items"))


def value_share(spark, d):
    return reports.value_share(read_table(spark, d, "rss_items"), "rss_language").select(F.coalesce("value", F.lit("(missing)")).alias("value"), "n", "share")


def length_describe(spark, d):
    return reports.length_describe(read_table(spark, d, "documents"), "text")


def top_errors(spark, d):
    return reports.top_values(read_table(spark, d, "fulltext"), ["resolution_error", "error_reason", "resolution_method"], 15)


def hotspots(spark, d):
    m = read_table(spark, d, "manifest").withColumn("entries", F.coalesce(F.expr("try_cast(entry_count AS bigint)"), F.lit(0)))
    return m.groupBy("search_string", "locale_id").agg(F.sum("entries").alias("entries"), F.count(F.lit(1)).alias("windows")).orderBy(F.col("entries").desc(), "search_string", "locale_id").limit(20)


def scan_overview(spark, d):
    m = read_table(spark, d, "manifest")
    one = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).cast("bigint").alias(s)
    return m.agg(F.countDistinct("pathogen_domain", "language_code").alias("datasets"), F.countDistinct("locale_id").alias("locales"), *[one(s) for s in ("success", "empty", "split", "failed", "throttled", "pending")])


def stage_summary(spark, d):
    m = read_table(spark, d, "manifest").withColumn("entries", F.expr("try_cast(entry_count AS bigint)"))
    g = m.groupBy("pathogen_domain", "language_code", "window_role").agg(F.count(F.lit(1)).alias("windows"), F.countDistinct("search_string").alias("strings"), F.sum("entries").alias("entries"), F.median("entries").alias("median"), F.max("entries").alias("most"))
    return g.na.fill(-1).select("pathogen_domain", "language_code", "window_role", "windows", "strings", "entries", F.round("median", 2).alias("median"), "most")


def status_breakdown(spark, d):
    return read_table(spark, d, "manifest").groupBy("status", F.coalesce("http_status", F.lit("")).alias("http_status")).agg(F.count(F.lit(1)).alias("n"))


def deepest_stage(spark, d):
    m = read_table(spark, d, "manifest").withColumn("days", F.expr("try_cast(window_days AS int)")).where("days IS NOT NULL")
    deepest = m.groupBy("search_string", "locale_id").agg(F.min("days").alias("days"))
    return deepest.groupBy("days").agg(F.count(F.lit(1)).alias("pairs"))


def log_sessionize(spark, d):
    e = read_table(spark, d, "events").select("user_id", "event_id", "ts")
    s = reports.sessionize(e, "user_id", "ts", 3600)
    return s.groupBy("user_id").agg(F.max("session_no").alias("sessions"), F.count(F.lit(1)).alias("events"))


QUERIES = {
    f.__name__: f
    for f in (
        ensemble_vote, confusion_metrics, per_run_metrics, brier, ece, auprc, threshold_tuning, threshold_tuning_full, model_run_summary, agreement_summary, majority_vote,
        label_counts, krippendorff_alpha, alpha_bootstrap, cohen_kappa, overlap_pairwise, overlap_summary, membership_patterns, jaccard_matrix,
        variant_counts, peak_weeks, sample_split, stratified_sample, bootstrap_samples, batch_overlap, build_groups, shortest_label, harmonize_groups,
        adjudicate, adjudication_metrics, model_validation, pair_similarity, ngram_counts, ngram_counts_all, ctfidf, topic_keywords, mmr_keywords, topic_summary, kmeans_topics, projection_2d, null_rates,
        value_share, length_describe, top_errors, hotspots, scan_overview, stage_summary, status_breakdown, deepest_stage, log_sessionize,
    )
}

_H = "('0x' || left(md5({x}), 8))::BIGINT"
_V = f"""WITH m(alias, weight) AS (VALUES ('m1', 0.5::DOUBLE), ('m2', 0.3::DOUBLE), ('m3', 0.2::DOUBLE)),
v AS (SELECT doc_id AS item, alias, weight, {_H.format(x="doc_id || ':' || alias")} % 1000 AS h FROM documents CROSS JOIN m),
votes AS (SELECT item, alias, weight, h / 1000.0::DOUBLE AS p, h >= 500 AS vote FROM v),
labels AS (SELECT doc_id AS item, {_H.format(x="doc_id || ':t'")} % 2 = 0 AS truth FROM documents),
pooled AS (SELECT item, sum(weight * p) / sum(weight) AS probability, avg(vote::INT) AS agreement, coalesce(string_agg(alias, ',' ORDER BY alias) FILTER (vote), '') AS supporters FROM votes GROUP BY 1),
pr AS (SELECT *, probability >= 0.5 - 1e-12 AND agreement >= 0.34 - 1e-12 AS relevant FROM pooled),
sc AS (SELECT * FROM votes JOIN labels USING (item))
"""
_R = f"""WITH q AS (SELECT doc_id AS item, rater, {_H.format(x="doc_id || ':' || rater")} AS h FROM documents CROSS JOIN (VALUES ('r1'), ('r2'), ('r3'), ('r4')) t(rater)),
ratings AS (SELECT item, rater, CASE WHEN h % 11 <> 0 THEN ['no', 'yes', 'unsure'][h % 3 + 1] END AS label FROM q)
"""


def _conf(src: str, pred: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    g = f" GROUP BY {by}" if by else ""
    return f""", k AS (SELECT {b}count(*) FILTER ({pred} AND truth) AS tp, count(*) FILTER ({pred} AND NOT truth) AS fp, count(*) FILTER (NOT {pred} AND NOT truth) AS tn, count(*) FILTER (NOT {pred} AND truth) AS fn FROM {src}{g}),
z AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(tn / nullif(tn + fp, 0), 0) AS s FROM k)
SELECT {b}tp, fp, tn, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1, round((r + s) / 2, 4) AS balanced_accuracy, round((tp + tn) / (tp + fp + tn + fn), 4) AS accuracy FROM z"""


_ALPHA = """, n AS (SELECT {b} item, label AS c, count(*) AS nc FROM {src} WHERE label IS NOT NULL GROUP BY ALL), m AS (SELECT {b} item, sum(nc) AS m FROM n GROUP BY ALL HAVING sum(nc) >= 2),
o AS (SELECT {a} a.c, b.c AS k, sum((CASE WHEN a.c = b.c THEN a.nc * (a.nc - 1) ELSE a.nc * b.nc END) / (m - 1)) AS o FROM n a JOIN n b USING ({b} item) JOIN m USING ({b} item) GROUP BY ALL),
nc AS (SELECT {b} c, sum(o) AS n FROM o GROUP BY ALL), t AS (SELECT {b} sum(n) AS n, sum(n * n) AS sq FROM nc GROUP BY ALL), f AS (SELECT {b} sum(CASE WHEN c <> k THEN o ELSE 0 END) AS d FROM o GROUP BY ALL)
SELECT {b} round(1 - (n - 1) * d / nullif(n * n - sq, 0), 6) AS alpha FROM f {j}"""
_VAR = "WITH v AS (SELECT week(ts)::BIGINT AS week, event_type AS variant, user_id AS article FROM events), u AS (SELECT DISTINCT * FROM v)\n"
_PAIR = """, s AS (SELECT week, variant, count(*) AS n FROM u GROUP BY 1, 2),
x AS (SELECT a.week, a.variant AS va, b.variant AS vb, count(*) AS k FROM u a JOIN u b ON a.week = b.week AND a.article = b.article AND a.variant < b.variant GROUP BY 1, 2, 3),
pw AS (SELECT a.week, a.variant AS variant_a, b.variant AS variant_b, a.n AS articles_a, b.n AS articles_b, coalesce(k, 0)::BIGINT AS shared_articles FROM s a JOIN s b ON a.week = b.week AND a.variant < b.variant
  LEFT JOIN x ON x.week = a.week AND va = a.variant AND vb = b.variant),
pj AS (SELECT *, (articles_a + articles_b - shared_articles)::BIGINT AS union_articles, round(shared_articles / (articles_a + articles_b - shared_articles), 6) AS jaccard, round(shared_articles / least(articles_a, articles_b), 6) AS overlap_coefficient FROM pw)
"""
_BOOT = f"""(WITH rd AS (SELECT doc_id AS item, row_number() OVER (ORDER BY doc_id) AS rn FROM documents), n AS (SELECT count(*) AS n FROM documents),
  s AS (SELECT b AS batch_id, rn - 1 AS draw, {_H.format(x="'{seed}:' || b || ':' || (rn - 1)")} % n + 1 AS pick FROM rd CROSS JOIN range({{batches}}) t(b) CROSS JOIN n)
  SELECT batch_id, draw, item, pick AS rn FROM s JOIN rd ON pick = rd.rn)"""
_B4 = _BOOT.replace("{seed}", "b").replace("{batches}", "4")
_B5 = _BOOT.replace("{seed}", "alpha").replace("{batches}", "5")
_CAT = "WITH c AS (SELECT item_id, pathogen_domain AS batch, batch_no AS run, search_string AS label, nullif(trim(rss_title, ' '), '') AS t0, rss_title AS example, nullif(trim(source_hint, ' '), '') AS c0, source_hint AS cause FROM rss_items WHERE trim(search_string, ' ') <> '')\n"
_ADJ = _CAT + """, b AS (SELECT batch, count(DISTINCT run) AS runs, count(DISTINCT item_id) AS arts FROM c GROUP BY 1), z AS (SELECT batch, lower(trim(label, ' ')) AS label, count(DISTINCT run) / any_value(runs) AS s, count(DISTINCT item_id) / any_value(arts) AS v FROM c JOIN b USING (batch) GROUP BY 1, 2),
y AS (SELECT batch, label, round(s, 4) AS support, round(v, 4) AS coverage, round(0.5 * s + 0.5 * v, 4) AS score, round(s, 4) >= 0.6 AS consensus FROM z),
j AS (SELECT *, consensus AND row_number() OVER (PARTITION BY batch, consensus ORDER BY score DESC, support DESC, label) <= 25 AS kept FROM y)
"""
_STOP = "[" + ", ".join(f"'{w}'" for w in topics.STOP_WORDS) + "]"
_WORDS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{2,}}'), lambda x: NOT list_contains({_STOP}, x))"
_CT = f"""WITH w AS (SELECT genre, doc_id, unnest({_WORDS}) AS term FROM documents WHERE text IS NOT NULL),
keep AS (SELECT term FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5), c AS (SELECT genre, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM keep) GROUP BY 1, 2),
pt AS (SELECT genre, sum(tf) AS n FROM c GROUP BY 1), a AS (SELECT sum(n) / count(*) AS a FROM pt), f AS (SELECT term, sum(tf) AS f FROM c GROUP BY 1),
ct AS (SELECT genre, term, tf, sqrt(tf / n) * ln(1 + greatest(a - f + 0.5, 0.0) / (f + 0.5)) AS weight FROM c JOIN f USING (term) JOIN pt USING (genre) CROSS JOIN a)
"""
_M = "WITH m AS (SELECT *, try_cast(entry_count AS BIGINT) AS entries, try_cast(window_days AS INTEGER) AS days FROM manifest)\n"

ORACLE = {
    "ensemble_vote": _V + "SELECT item, round(probability, 4) AS probability, round(agreement, 4) AS agreement, supporters, relevant FROM pr",
    "confusion_metrics": _V + _conf("(SELECT * FROM pr JOIN labels USING (item))", "relevant"),
    "per_run_metrics": _V + _conf("(SELECT * FROM votes JOIN labels USING (item))", "vote", "alias"),
    "brier": _V + "SELECT alias, round(avg(pow(p - truth::INT, 2)), 6) AS brier FROM sc GROUP BY 1",
    "ece": _V + ", b AS (SELECT alias, least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS mp, avg(truth::INT) AS my FROM sc GROUP BY 1, 2) SELECT alias, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM b GROUP BY 1",
    "auprc": _V + """, t AS (SELECT DISTINCT alias, round(p, 6) AS t FROM sc UNION SELECT DISTINCT alias, 0.0 FROM sc UNION SELECT DISTINCT alias, 1.0 FROM sc),
c AS (SELECT t.alias, t, count(*) FILTER (p >= t) AS n, count(*) FILTER (p >= t AND truth) AS tp, count(*) FILTER (truth) AS pos FROM t JOIN sc ON sc.alias = t.alias GROUP BY 1, 2),
x AS (SELECT alias, t, pos, round(coalesce(tp / nullif(n, 0), 0), 4) AS pr, round(tp / pos, 4) AS r FROM c), y AS (SELECT alias, pr, r, r - coalesce(lag(r) OVER (PARTITION BY alias ORDER BY t DESC), 0) AS up FROM x)
SELECT alias, round(sum(pr * up) FILTER (up > 0), 4) AS auprc FROM y GROUP BY 1""",
    "model_validation": "WITH m AS (" + _V + _conf("(SELECT * FROM votes JOIN labels USING (item))", "vote", "alias") + "), q AS (" + _V
    + """, b AS (SELECT alias, least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS mp, avg(truth::INT) AS my FROM sc GROUP BY 1, 2), e AS (SELECT alias, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM b GROUP BY 1)
SELECT alias, round(avg(pow(p - truth::INT, 2)), 6) AS brier, any_value(ece) AS ece, count(*)::BIGINT AS scored FROM sc JOIN e USING (alias) GROUP BY 1) SELECT alias, precision, recall, f1, brier, ece, scored FROM m JOIN q USING (alias)""",
    "threshold_tuning": _V + """, wide AS (SELECT item, max(p) FILTER (alias = 'm1') AS p1, max(p) FILTER (alias = 'm2') AS p2, max(p) FILTER (alias = 'm3') AS p3,
  max(vote::INT) FILTER (alias = 'm1') AS v1, max(vote::INT) FILTER (alias = 'm2') AS v2, max(vote::INT) FILTER (alias = 'm3') AS v3 FROM votes GROUP BY 1),
ws(i, w1, w2, w3) AS (VALUES (0, 0.0, 0.0, 1.0), (1, 0.0, 0.5, 0.5), (2, 0.0, 1.0, 0.0), (3, 0.5, 0.0, 0.5), (4, 0.5, 0.5, 0.0), (5, 1.0, 0.0, 0.0)),
ts(j, threshold) AS (VALUES (0, 0.4), (1, 0.5), (2, 0.6)), ag(l, agreement) AS (VALUES (0, 0.34), (1, 0.67)),
g AS (SELECT (i * 6 + j * 2 + l)::BIGINT AS candidate, * FROM ws, ts, ag),
e AS (SELECT candidate, threshold::DOUBLE AS threshold, agreement::DOUBLE AS agreement, truth, round(w1::DOUBLE * p1 + w2::DOUBLE * p2 + w3::DOUBLE * p3, 9) >= threshold::DOUBLE AND
  round(((w1 > 0)::INT * v1 + (w2 > 0)::INT * v2 + (w3 > 0)::INT * v3) / ((w1 > 0)::INT + (w2 > 0)::INT + (w3 > 0)::INT), 9) >= agreement::DOUBLE AS hit FROM wide JOIN labels USING (item) CROSS JOIN g)
""" + _conf("e", "hit", "candidate, threshold, agreement").replace("SELECT candidate, threshold, agreement, tp,", ", fin AS (SELECT candidate, threshold, agreement, tp,")
    + ") SELECT candidate, threshold, agreement, precision, recall, f1 FROM fin ORDER BY (recall >= 0.85) DESC, f1 DESC, recall DESC, threshold DESC, agreement DESC, candidate LIMIT 1",
    "model_run_summary": _V + "SELECT alias, min(item) AS first_item, sum(vote::INT)::BIGINT AS positive, round(avg(p), 6) AS mean_p FROM votes GROUP BY 1",
    "agreement_summary": _V + """, n AS (SELECT item, vote, count(*) AS n FROM votes GROUP BY 1, 2), k AS (SELECT item, sum(n) AS m, sum(n * (n - 1)) AS same, count(*) AS kinds FROM n GROUP BY 1)
SELECT round(avg((kinds = 1)::INT), 6) AS full_agreement, round(sum(same) / sum(m * (m - 1)), 6) AS pairwise_agreement, round(1 - avg((kinds = 1)::INT), 6) AS disagreement_rate FROM k""",
    "majority_vote": _R + """, n AS (SELECT item, label, count(*) AS n FROM ratings WHERE label IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, label) AS rn, sum(n) OVER (PARTITION BY item) AS t FROM n)
SELECT item, label, CASE WHEN t > 1 THEN round(n / t, 6) ELSE -1.0 END AS share FROM k WHERE rn = 1""",
    "label_counts": _R + "SELECT rater, coalesce(label, 'missing') AS label, count(*)::BIGINT AS n FROM ratings GROUP BY 1, 2",
    "krippendorff_alpha": _R + _ALPHA.format(b="", a="", src="ratings", j="CROSS JOIN t"),
    "alpha_bootstrap": _R + f", bs AS (SELECT batch_id, draw || ':' || z.rn AS item, label FROM {_B5} z JOIN ratings ON z.item = ratings.item)" + _ALPHA.format(b="batch_id,", a="batch_id,", src="bs", j="JOIN t USING (batch_id)"),
    "cohen_kappa": _R + """, w AS (SELECT item, max(label) FILTER (rater = 'r1') AS a, max(label) FILTER (rater = 'r2') AS b FROM ratings GROUP BY 1), p AS (SELECT * FROM w WHERE a IS NOT NULL AND b IS NOT NULL),
e AS (SELECT sum(x.n * y.n) AS e FROM (SELECT a, count(*) AS n FROM p GROUP BY 1) x JOIN (SELECT b, count(*) AS n FROM p GROUP BY 1) y ON a = b), s AS (SELECT count(*) AS t, count(*) FILTER (a = b) AS same FROM p)
SELECT round((same / t - e / (t * t)) / (1 - e / (t * t)), 6) AS kappa FROM s CROSS JOIN e""",
    "overlap_pairwise": _VAR + _PAIR + "SELECT week, variant_a, variant_b, articles_a, articles_b, shared_articles, union_articles, jaccard, overlap_coefficient FROM pj",
    "overlap_summary": _VAR + """, s AS (SELECT week, variant, count(*) AS n FROM u GROUP BY 1, 2), m AS (SELECT week, article, count(*) AS k FROM u GROUP BY 1, 2),
b AS (SELECT week, first(variant ORDER BY n DESC, variant) AS best_single_variant, max(n) AS best_single_articles, count(*) AS variants, sum(n) AS sm FROM s GROUP BY 1)
SELECT week, variants::BIGINT AS variants, sm::BIGINT AS sum_variant_articles, un AS union_articles, (sm - un)::BIGINT AS duplicate_mentions, round((sm - un) / sm, 6) AS duplicate_share, al AS shared_all_articles, sa AS shared_any_articles,
  ex AS exclusive_articles, best_single_variant, best_single_articles, (un - best_single_articles)::BIGINT AS incremental_articles
FROM (SELECT week, count(*) AS un, count(*) FILTER (k = 1) AS ex, count(*) FILTER (k >= 2) AS sa, count(*) FILTER (k = variants) AS al FROM m JOIN b USING (week) GROUP BY 1) JOIN b USING (week)""",
    "membership_patterns": _VAR + ", m AS (SELECT week, article, string_agg(variant, ' + ' ORDER BY variant) AS pattern, count(*) AS k FROM u GROUP BY 1, 2) SELECT week, pattern, k::BIGINT AS variant_count, count(*)::BIGINT AS article_count FROM m GROUP BY 1, 2, 3",
    "jaccard_matrix": _VAR.replace("week(ts)::BIGINT", "0::BIGINT") + _PAIR + "SELECT variant_a, " + ", ".join(f"coalesce(max(jaccard) FILTER (variant_b = '{k}'), -1.0) AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM pj GROUP BY 1",
    "variant_counts": _VAR + "SELECT w.week, x.variant, coalesce(n, 0)::BIGINT AS articles FROM (SELECT DISTINCT week FROM v) w CROSS JOIN (SELECT DISTINCT variant FROM v) x LEFT JOIN (SELECT week, variant, count(*) AS n FROM u GROUP BY 1, 2) n ON n.week = w.week AND n.variant = x.variant",
    "peak_weeks": _VAR + ", n AS (SELECT week, variant, count(*) AS articles FROM u GROUP BY 1, 2) SELECT week, variant, articles FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY articles DESC, week) AS rn FROM n) WHERE rn = 1",
    "sample_split": "SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY md5('s1:' || c_custkey), c_custkey) <= 100 THEN 'sample' ELSE 'rest' END AS part FROM customer",
    "stratified_sample": "SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('s2:' || c_custkey), c_custkey) AS rn FROM customer) WHERE rn <= 5",
    "bootstrap_samples": f"SELECT batch_id, draw, item FROM {_B4}",
    "batch_overlap": f"""WITH s AS (SELECT DISTINCT batch_id AS b, item FROM {_B4}), n AS (SELECT b, count(*) AS n FROM s GROUP BY 1)
SELECT x.b AS l, y.b AS r, round(count(*) / any_value(n), 6) AS share FROM s x JOIN s y ON x.item = y.item AND x.b <> y.b JOIN n ON n.b = x.b GROUP BY 1, 2""",
    "build_groups": _CAT + """, g AS (SELECT batch, label, count(DISTINCT item_id) AS articles, (list(example ORDER BY item_id) FILTER (t0 IS NOT NULL AND example <> 'N/A'))[1:3] AS e, (list(cause ORDER BY item_id) FILTER (c0 IS NOT NULL AND cause <> 'N/A'))[1:1] AS f FROM c GROUP BY 1, 2),
h AS (SELECT *, coalesce(e[1:2], []) || coalesce(f, []) AS d, coalesce(e, []) AS e3 FROM g)
SELECT batch, label, articles, left(array_to_string(list_filter(d, lambda x, i: list_position(d, x) = i), ' | '), 500) AS definition, array_to_string(list_filter(e3, lambda x, i: list_position(e3, x) = i), ' | ') AS evidence, rank
FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY articles DESC, lower(label), label)::BIGINT AS rank FROM h) WHERE rank <= 25""",
    "shortest_label": _CAT + "SELECT lower(trim(label)) AS label_key, first(label ORDER BY length(label), label) AS label FROM c GROUP BY 1",
    "adjudicate": _ADJ + "SELECT batch, label, support, coverage, score, consensus, kept FROM j",
    "adjudication_metrics": _ADJ + """, g AS (SELECT batch, count(*) AS n FROM (SELECT DISTINCT batch, run, lower(trim(label, ' ')) AS label FROM c) GROUP BY 1)
SELECT batch, count(*)::BIGINT AS clusters, count(*) FILTER (consensus)::BIGINT AS agreed, count(*) FILTER (kept)::BIGINT AS retained, round((any_value(n) - count(*)) / any_value(n), 4) AS merge_rate,
round(CASE WHEN count(*) FILTER (consensus) > 0 THEN 1 - count(*) FILTER (kept) / count(*) FILTER (consensus) ELSE 0.0 END, 4)::DOUBLE AS truncation_loss, round(count(*) FILTER (consensus) / count(*), 4) AS consensus_rate FROM j JOIN g USING (batch) GROUP BY 1""",
    "ngram_counts": f"""WITH w AS (SELECT lang, {_WORDS} AS w FROM documents WHERE lang IN ('en', 'fr')),
t AS (SELECT lang, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM w) SELECT lang, term, count(*)::BIGINT AS tf FROM t GROUP BY 1, 2 HAVING count(*) >= 20""",
    "ctfidf": _CT + "SELECT genre, term, tf::BIGINT AS tf, round(weight, 4) AS weight FROM ct",
    "topic_keywords": _CT + "SELECT genre, string_agg(term, ', ' ORDER BY rn) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY round(weight, 9) DESC, term) AS rn FROM ct) WHERE rn <= 6 GROUP BY 1",
    "topic_summary": """WITH p AS (SELECT label - 1 AS topic, count(*) AS n FROM embeddings GROUP BY 1) SELECT sum(n)::BIGINT AS documents, count(*) FILTER (topic <> -1)::BIGINT AS topics, coalesce(sum(n) FILTER (topic = -1), 0)::BIGINT AS outliers,
  round(max(n) FILTER (topic <> -1) / sum(n) FILTER (topic <> -1), 6) AS largest_share FROM p""",
    "null_rates": "UNPIVOT (SELECT round(avg((COLUMNS(*) IS NULL)::INT), 6) FROM rss_items) ON COLUMNS(*) INTO NAME column_name VALUE null_rate",
    "value_share": "SELECT coalesce(rss_language, '(missing)') AS value, count(*)::BIGINT AS n, round(100 * count(*) / (SELECT count(*) FROM rss_items), 4) AS share FROM rss_items GROUP BY 1",
    "length_describe": """SELECT count(*)::BIGINT AS n, round(avg(l), 4) AS mean, round(stddev_samp(l), 4) AS std, min(l)::BIGINT AS least, round(quantile_cont(l, 0.25), 4)::DOUBLE AS q25, round(quantile_cont(l, 0.5), 4)::DOUBLE AS q50, round(quantile_cont(l, 0.75), 4)::DOUBLE AS q75, max(l)::BIGINT AS most
FROM (SELECT length(text) AS l FROM documents WHERE text IS NOT NULL)""",
    "top_errors": "SELECT value, count(*)::BIGINT AS n FROM (SELECT unnest([resolution_error, error_reason, resolution_method]) AS value FROM fulltext) WHERE trim(value) <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 15",
    "hotspots": _M + "SELECT search_string, locale_id, sum(coalesce(entries, 0))::BIGINT AS entries, count(*)::BIGINT AS windows FROM m GROUP BY 1, 2 ORDER BY entries DESC, search_string, locale_id LIMIT 20",
    "scan_overview": "SELECT count(DISTINCT (pathogen_domain, language_code))::BIGINT AS datasets, count(DISTINCT locale_id)::BIGINT AS locales, " + ", ".join(f"count(*) FILTER (status = '{s}')::BIGINT AS {s}" for s in ("success", "empty", "split", "failed", "throttled", "pending")) + " FROM manifest",
    "stage_summary": _M + """SELECT pathogen_domain, language_code, window_role, count(*)::BIGINT AS windows, count(DISTINCT search_string)::BIGINT AS strings, coalesce(sum(entries), -1)::BIGINT AS entries, round(coalesce(median(entries), -1), 2)::DOUBLE AS median, coalesce(max(entries), -1)::BIGINT AS most FROM m GROUP BY 1, 2, 3""",
    "status_breakdown": "SELECT status, coalesce(http_status, '') AS http_status, count(*)::BIGINT AS n FROM manifest GROUP BY 1, 2",
    "deepest_stage": _M + "SELECT days, count(*)::BIGINT AS pairs FROM (SELECT search_string, locale_id, min(days) AS days FROM m WHERE days IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "log_sessionize": """WITH g AS (SELECT user_id, CASE WHEN epoch(ts)::BIGINT IS NULL THEN 0 WHEN floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) <= 3600 THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, sum(s)::BIGINT AS sessions, count(*)::BIGINT AS events FROM g GROUP BY 1""",
}
