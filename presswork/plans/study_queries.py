"""Queries over votes, overlaps, samples, groups and topics that need more than one aggregate."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.functions import text
from presswork.functions.text import normalize_ws
from presswork.operators import evaluation as ev
from presswork.operators import groups, overlap, reports, resample, topics, windows
from presswork.plans.analysis_queries import _B4, _R, _V, _VAR, _PAIR, _categories, _ctfidf, _pooled, _ratings, _variants, _votes, bootstrap_samples, variant_counts
from presswork.plans.analysis_queries import ORACLE as _ANALYSIS
from presswork.session import read_table


def normalized_weights(spark, d):
    s = read_table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").cast("double").alias("weight"))
    return ev.normalized_weights(s, ["s_nationkey"], "weight").select("s_suppkey", F.round("weight", 6).alias("weight"))


def evidence_consolidated(spark, d):
    """Spans of all supporters of relevant documents, of the heaviest model for the others."""
    v = _votes(spark, d).withColumn("spans", F.array(F.concat(F.lit("S"), F.pmod("item", F.lit(3))), F.concat(F.when(F.col("alias") == "m2", "s").otherwise("T"), F.pmod("item", F.lit(3)))))
    rel = _pooled(spark, d).select("item", "relevant")
    return ev.consolidated_evidence(v.join(rel, "item"), "item", "relevant").select("item", text.serialize(F.col("evidence")).alias("evidence"))


def alpha_ordinal(spark, d):
    return ev.ordinal_alpha(_ratings(spark, d), ["no", "unsure", "yes"])


def alpha_interval(spark, d):
    """Alpha of all ratings with 95 % bounds from 2,000 resamples."""
    return ev.alpha_interval(_ratings(spark, d))


def missing_votes(spark, d):
    return ev.missing_votes(_ratings(spark, d))


def model_runs(spark, d):
    """Per model: the first named version, votes for and against, mean probability, errors."""
    v = _votes(spark, d)
    version = F.when(F.col("p") >= 0.5, F.concat(F.col("alias"), F.lit("-v"), F.pmod("item", F.lit(4))))
    error = F.when(F.pmod("item", F.lit(17)) == 0, "timeout")
    g = v.groupBy("alias").agg(
        F.min_by(version, F.when(version.isNotNull(), F.col("item"))).alias("model_id"), F.sum(F.col("vote").cast("int")).cast("bigint").alias("relevant_true"),
        F.sum((~F.col("vote")).cast("int")).cast("bigint").alias("relevant_false"), F.round(F.avg("p"), 4).alias("avg_probability"), F.count(error).alias("error_rows"),
    )
    return g


def overlap_jaccard(spark, d):
    return overlap.jaccard_summary(_variants(spark, d), ["week"], "variant", "article")


def overlap_two_grains(spark, d):
    """The overlap summary by week and over all weeks."""
    v = _variants(spark, d)
    by_week = overlap.summary(v, ["week"], "variant", "article").withColumn("grain", F.lit("week"))
    whole = overlap.summary(v.withColumn("week", F.lit(-1).cast("bigint")), ["week"], "variant", "article").withColumn("grain", F.lit("all"))
    cols = ["grain", "week", "variants", "union_articles", "duplicate_share", "exclusive_articles", "best_single_variant", "incremental_articles"]
    return by_week.unionByName(whole).select(*cols)


def peak_weeks_top(spark, d):
    """The three weeks with most articles of each variant."""
    from pyspark.sql import Window

    w = Window.partitionBy("variant").orderBy(F.col("articles").desc(), F.col("week"))
    return variant_counts(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("variant", "week", "articles", F.col("rank").cast("bigint").alias("rank"))


def deepest_stage_last(spark, d):
    """Stage of the last window of each string and locale in the order of work, counted."""
    m = read_table(spark, d, "manifest").withColumn("days", F.expr("try_cast(window_days AS int)")).where("days IS NOT NULL")
    m = m.withColumn("rank", windows.stage_rank(windows.role_stage(F.col("window_role"), F.col("days"))))
    last = reports.last_per_group(m, ["search_string", "locale_id"], [F.col(c).desc() for c in ("rank", "window_start", "window_end", "days")])
    return last.groupBy("rank").agg(F.count(F.lit(1)).alias("pairs"))


def discovery_samples(spark, d):
    """Of each bootstrap batch's distinct items a subsample, in the order of each run."""
    return resample.discovery_samples(bootstrap_samples(spark, d), "batch_id", "item", 60, 3, "d").select("batch_id", "run", F.col("place").cast("bigint").alias("place"), "item")


def batch_overlap_means(spark, d):
    from presswork.plans.analysis_queries import batch_overlap

    return resample.overlap_means(batch_overlap(spark, d)).select(F.coalesce("batch", F.lit(-1)).alias("batch"), "mean")


def _impacts(spark, d):
    """Impacts of each item: what was observed (title) and its cause (description), missing where blank."""
    r = read_table(spark, d, "rss_items")
    na = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("N/A"))
    observed, cause = na("rss_title"), na("rss_description_text")
    # fixed values: the characters that do not count when two texts are compared
    canon = lambda c: F.regexp_replace(F.lower(c), r"[\s\"“”‘’'`~.,;:!?()\[\]{}<>-]+", " ")
    same = (F.trim(canon(observed)) != "") & (F.trim(canon(observed)) == F.trim(canon(cause)))
    return r.select("item_id", observed.alias("observed"), F.when(same, "N/A").otherwise(cause).alias("cause"))


def impact_causes(spark, d):
    """Impacts whose cause merely repeats what was observed have none."""
    i = _impacts(spark, d)
    return i.groupBy((F.col("observed") == "N/A").alias("no_observation"), (F.col("cause") == "N/A").alias("no_cause")).agg(F.count(F.lit(1)).alias("n"))


def impacts_with_base(spark, d):
    """Base rows with their impacts, one row at least for each, beside the language of the row."""
    base = read_table(spark, d, "rss_items").select("item_id", "language_code")
    i = _impacts(spark, d).where("observed <> 'N/A'")
    j = base.join(i, "item_id", "left").select("language_code", F.coalesce("observed", F.lit("N/A")).alias("observed"))
    return j.groupBy("language_code").agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("observed") == "N/A").cast("int")).cast("bigint").alias("without"))


def collapse_examples(spark, d):
    """Locales asked for per language beside one example of each, the least window."""
    m = read_table(spark, d, "manifest")
    g = m.groupBy("language_code").agg(F.countDistinct("locale_id").alias("requested"))
    e = m.groupBy("language_code").agg(F.min_by("locale_id", F.struct("window_start", "search_string", "locale_id")).alias("example"))
    return g.join(e, "language_code", "left")


def experiment_grid(spark, d):
    """Topics, variants and years of an experiment: the product by design."""
    topics_df = read_table(spark, d, "search_strings").where("trim(search_string) <> ''").select(F.trim("search_string").alias("topic")).distinct()
    loc = read_table(spark, d, "locales").select("id", "lang")
    years = spark.range(2018, 2026).select(F.col("id").alias("year"))
    return topics_df.crossJoin(loc).crossJoin(years).groupBy("id", "year").agg(F.count(F.lit(1)).alias("requests"), F.min("topic").alias("first_topic"))


def global_assignment(spark, d):
    """Items under the global category of their batch and label: the first spelling of the label over all batches."""
    c = _categories(spark, d).select("batch", "label", "item_id")
    names = c.groupBy(F.lower(F.trim("label")).alias("k")).agg(F.min("label").alias("category"))
    mapping = c.select("batch", "label", F.lower(F.trim("label")).alias("k")).distinct().join(names, "k").select("batch", "label", "category")
    return c.groupBy("batch", "label").agg(F.count(F.lit(1)).alias("n")).join(mapping, ["batch", "label"], "left").groupBy("batch", "category").agg(F.sum("n").alias("items"))


def taxonomy_summary(spark, d):
    """How stable the labels are over the batches: labels by the share of batches that have them, and the share of items
    under labels of at least 0.6."""
    c = _categories(spark, d).select("item_id", F.col("run").alias("batch"), F.lower(F.trim("label")).alias("label"))
    total = c.agg(F.countDistinct("batch").alias("b"))
    items = read_table(spark, d, "rss_items").agg(F.count(F.lit(1)).alias("all"))
    per = c.groupBy("label").agg(F.countDistinct("batch").alias("bs"), F.countDistinct("item_id").alias("n")).crossJoin(F.broadcast(total)).withColumn("p", F.col("bs") / F.col("b"))
    at = lambda t: F.sum((F.col("p") >= t).cast("int")).cast("bigint")
    s = per.agg(F.count(F.lit(1)).alias("labels"), at(0.5).alias("at_half"), at(0.7).alias("at_seven"), at(0.9).alias("at_nine"), F.sum(F.when(F.col("p") >= 0.6, F.col("n")).otherwise(0)).alias("covered"))
    return s.crossJoin(items).select("labels", "at_half", "at_seven", "at_nine", F.round(F.col("covered") / F.col("all"), 4).alias("global_coverage"))


def pathogen_merge(spark, d):
    """Names with their kinds and containers, one row per name and disease: rows without one are absorbed, twins merged."""
    p = read_table(spark, d, "part")
    disease = F.when(F.pmod("p_partkey", F.lit(4)) == 0, "").when(F.pmod("p_partkey", F.lit(4)) == 1, F.concat("p_type", F.lit(" (old)"))).otherwise(F.col("p_type"))
    rows = p.select(F.col("p_brand").alias("name"), F.split("p_name", " ")[0].alias("subtypes"), F.concat_ws("; ", F.lit("size"), F.col("p_size").cast("string")).alias("aka"), disease.alias("disease"))
    return groups.merged_names(rows, "name", ["subtypes", "aka"], "disease")


def _hits(spark, d):
    """Hits of a lookup: each title word of the terms with the terms that hold it."""
    s = read_table(spark, d, "search_strings").where("trim(search_string) <> ''").select(F.trim("search_string").alias("term"), F.coalesce("search_string_fr", F.lit("")).alias("alias"), F.coalesce("search_string_en", F.lit("")).alias("english")).distinct()
    q = read_table(spark, d, "rss_items").where("trim(search_string) <> ''").select(F.lower(normalize_ws(F.col("search_string"))).alias("query")).distinct()
    words = lambda c: F.explode(text.token_set(c)).alias("w")
    # terms and queries are both short lists of names
    pairs = q.select("query", words(F.col("query"))).join(s.select("term", "alias", "english", words(F.col("term"))), "w").select("query", "term", "alias", "english").distinct()
    kind = F.when(F.length("term") % 2 == 0, "label").otherwise("alias")
    score = groups.hit_score(F.col("term"), F.col("english"), F.col("alias"), F.col("english"), kind, F.col("query"), "fever|virus|pox")
    return pairs.select("query", "term", kind.alias("match_type"), score.cast("bigint").alias("score"))


def lookup_hits(spark, d):
    return _hits(spark, d).select("query", "term", "match_type", "score")


def hit_score(spark, d):
    return groups.best_hit(_hits(spark, d), "query", "score", "match_type", "term")


def enriched_terms(spark, d):
    """Terms of each row in four languages and the search string of each, and of all together."""
    s = read_table(spark, d, "search_strings").where("trim(search_string) <> ''")
    langs = ["en", "fr", "es", "pt"]
    terms = {x: text.dedupe_ordered(F.filter(F.array(normalize_ws(F.col(f"search_string_{x}")), normalize_ws(F.col("search_string"))), lambda v: v != "")) for x in langs}
    row = s.select(F.trim("search_string").alias("name"), *[v.alias(k) for k, v in terms.items()])
    every = text.dedupe_ordered(F.concat(*langs))
    return row.select("name", *[text.search_string(F.col(x)).alias(f"search_{x}") for x in langs], text.search_string(every).alias("search_all")).distinct()


def assigned_categories(spark, d):
    """Items under the categories that discovery kept; labels outside them are N/A."""
    c = _categories(spark, d)
    kept = groups.build_groups(c, ["batch"], "label", "item_id", "example", "cause", 10).select("label").distinct()
    least = kept.groupBy(F.lower(F.trim("label")).alias("k")).agg(F.min("label").alias("label")).select("label")
    out = groups.assigned(c.select("item_id", "label"), "label", least, "label")
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("items"))


def rule_table(spark, d):
    """Profiles by a table of rules, the first that fits."""
    rules = spark.createDataFrame([(1, "econ", "cheap"), (2, "o", "with o"), (3, "small", "size")], "rule_order int, word string, outcome string")
    return groups.by_rule_table(read_table(spark, d, "part"), "p_partkey", "p_type", rules, "other")


def first_token_rules(spark, d):
    """Kinds by the first word of a name."""
    p = read_table(spark, d, "part")
    kind = text.first_rule(F.split(F.col("p_name"), " ")[0], [("red", "warm"), ("blue", "cold"), ("small", "size"), ("large", "size")], "other", True)
    return p.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def model_inputs(spark, d):
    """Inputs of a model: title and text cut at 500 characters."""
    f = read_table(spark, d, "fulltext").select("article_id", text.model_input(F.col("rss_title"), F.col("full_text"), 500).alias("i"))
    return f.select("article_id", F.col("i.title").alias("title"), F.md5("i.text").alias("text_hash"), F.length("i.text").alias("chars"))


def relevant_outlets(spark, d):
    """Rows that a column of any of the known names calls relevant."""
    from presswork.sources.readers import relevance_mask

    r = read_table(spark, d, "domains_removed").withColumnRenamed("is_news_outlet", "is_relevant")
    return r.where(relevance_mask(r)).agg(F.count(F.lit(1)).alias("n"))


def subtype_names(spark, d):
    p = read_table(spark, d, "part")
    return p.select("p_partkey", text.with_subtype(F.col("p_name"), F.col("p_type")).alias("name"))


def document_topics(spark, d):
    """Documents with the topic of their genre, its keywords and whether they are outliers."""
    docs = read_table(spark, d, "documents").select("doc_id", "genre")
    kw = topics.topic_keywords(_ctfidf(spark, d), "genre")
    numbered = docs.withColumn("topic", F.coalesce(*[F.when(F.col("genre") == g, i) for i, g in enumerate(("article", "brief", "digest", "report", "sitrep"))], F.lit(-1)))
    words = kw.withColumn("topic", F.coalesce(*[F.when(F.col("genre") == g, i) for i, g in enumerate(("article", "brief", "digest", "report", "sitrep"))])).where("topic IS NOT NULL").select("topic", "keywords")
    return topics.document_topics(numbered, "topic", words).select("doc_id", "topic", "topic_keywords", "is_outlier")


def bisecting_topics(spark, d):
    e = read_table(spark, d, "embeddings")
    return topics.clustered(e.select("vec_id", "embedding"), "embedding", e.count(), "bisecting", 10, 5).select("vec_id", "topic")


def silhouette(spark, d):
    """Mean silhouette of the k-means topics."""
    e = read_table(spark, d, "embeddings")
    v = topics.clustered(e.select("vec_id", "embedding"), "embedding", e.count())
    return spark.createDataFrame([(topics.silhouette(v, "embedding"),)], "silhouette double")


def components_5(spark, d):
    """The first five principal components, as input of a clustering."""
    e = read_table(spark, d, "embeddings")
    return topics.reduced(e.select("vec_id", "embedding"), "embedding", 5, "c").select("vec_id", *[F.round(F.col("c")[i], 6).alias(f"c{i}") for i in range(5)])


QUERIES = {
    f.__name__: f
    for f in (
        normalized_weights, evidence_consolidated, alpha_ordinal, alpha_interval, missing_votes, model_runs, overlap_jaccard, overlap_two_grains, peak_weeks_top, deepest_stage_last,
        discovery_samples, batch_overlap_means, impact_causes, impacts_with_base, collapse_examples, experiment_grid, global_assignment, taxonomy_summary, pathogen_merge, lookup_hits,
        hit_score, enriched_terms, assigned_categories, rule_table, first_token_rules, model_inputs, relevant_outlets, subtype_names, document_topics, bisecting_topics, silhouette, components_5,
    )
}

_WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"


def _nws(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{_WS}', ' ', 'g'))"


_CANON = r"""trim(regexp_replace(lower({c}), '[\s"“”‘’''`~.,;:!?()\[\]{{}}<>-]+', ' ', 'g'))"""
_IMP = f"""WITH i AS (SELECT item_id, language_code, coalesce(nullif(trim(rss_title, ' '), ''), 'N/A') AS o, coalesce(nullif(trim(rss_description_text, ' '), ''), 'N/A') AS c0 FROM rss_items),
j AS (SELECT item_id, language_code, o, CASE WHEN {_CANON.format(c='o')} <> '' AND {_CANON.format(c='o')} = {_CANON.format(c='c0')} THEN 'N/A' ELSE c0 END AS c FROM i)
"""
_LC = "WITH c AS (SELECT item_id, pathogen_domain AS batch, batch_no AS run, search_string AS label FROM rss_items WHERE trim(search_string, ' ') <> '')\n"
_HIT = f"""WITH s AS (SELECT DISTINCT trim(search_string, ' ') AS term, coalesce(search_string_fr, '') AS alias, coalesce(search_string_en, '') AS english FROM search_strings WHERE trim(search_string, ' ') <> ''),
q AS (SELECT DISTINCT lower({_nws('search_string')}) AS query FROM rss_items WHERE trim(search_string, ' ') <> ''),
sw AS (SELECT term, alias, english, unnest(list_distinct(regexp_extract_all(lower(term), '[a-z0-9]+'))) AS w FROM s), qw AS (SELECT query, unnest(list_distinct(regexp_extract_all(query, '[a-z0-9]+'))) AS w FROM q),
p AS (SELECT DISTINCT query, term, lower({_nws('term')}) AS l, lower({_nws('alias')}) AS a, lower({_nws('english')}) AS m, CASE WHEN length(term) % 2 = 0 THEN 'label' ELSE 'alias' END AS match_type FROM qw JOIN sw USING (w)),
h AS (SELECT query, term, match_type, ((l = query)::INT * 10 + (m = query)::INT * 8 + (a = query)::INT * 6 + (l <> '' AND query <> '' AND (contains(l, query) OR contains(query, l)))::INT * 2 + CASE match_type WHEN 'label' THEN 2 ELSE 1 END + regexp_matches(m, 'fever|virus|pox')::INT * 3)::BIGINT AS score FROM p)
"""
_TERMS = "list_filter([{a}, {b}], lambda x: x <> '')"
_LIST = {x: _TERMS.format(a=_nws(f"search_string_{x}"), b=_nws("search_string")) for x in ("en", "fr", "es", "pt")}
_DIST = "list_filter({l}, lambda x, i: NOT list_contains(list_transform({l}[1:i-1], lambda y: lower(y)), lower(x)))"
_OR = """coalesce(array_to_string(list_transform({l}, lambda x: '"' || replace(x, '"', '') || '"'), ' OR '), '')"""

ORACLE = {
    "normalized_weights": """WITH w AS (SELECT s_suppkey, s_nationkey, greatest(s_acctbal, 0)::DOUBLE AS w FROM supplier), t AS (SELECT *, sum(w) OVER (PARTITION BY s_nationkey) AS t, count(*) OVER (PARTITION BY s_nationkey) AS n FROM w)
SELECT s_suppkey, round(CASE WHEN t > 0 THEN round(w / t, 6) ELSE 1.0 / n END, 6)::DOUBLE AS weight FROM t""",
    "evidence_consolidated": _V + """, x AS (SELECT item, alias, vote, item % 3 AS k FROM votes), g AS (SELECT item, any_value(k) AS k, bool_or(vote AND alias = 'm2') AS b, bool_or(vote AND alias <> 'm2') AS t, any_value(relevant) AS r FROM x JOIN (SELECT item, relevant FROM pr) USING (item) GROUP BY 1)
SELECT item, CASE WHEN NOT r THEN 'S' || k || ' | T' || k WHEN t THEN 'S' || k || ' | T' || k WHEN b THEN 'S' || k ELSE '' END AS evidence FROM g""",
    "alpha_ordinal": _R + """, q2 AS (SELECT item, CASE label WHEN 'no' THEN 0 WHEN 'unsure' THEN 1 WHEN 'yes' THEN 2 END AS c FROM ratings), n AS (SELECT item, c, count(*) AS nc FROM q2 WHERE c IS NOT NULL GROUP BY 1, 2), m AS (SELECT item, sum(nc) AS m FROM n GROUP BY 1 HAVING sum(nc) >= 2),
o AS (SELECT a.c, b.c AS k, sum((CASE WHEN a.c = b.c THEN a.nc * (a.nc - 1) ELSE a.nc * b.nc END) / (m - 1)) AS o FROM n a JOIN n b USING (item) JOIN m USING (item) GROUP BY 1, 2), t AS (SELECT c, sum(o) AS n FROM o GROUP BY 1),
dist AS (SELECT x.c, y.c AS k, x.n AS nx, y.n AS ny, pow((SELECT sum(z.n) FROM t z WHERE z.c BETWEEN least(x.c, y.c) AND greatest(x.c, y.c)) - (x.n + y.n) / 2, 2) AS d FROM t x CROSS JOIN t y)
SELECT round(1 - ((SELECT sum(n) FROM t) - 1) * sum(coalesce(o, 0) * d) / sum(nx * ny * d), 6) AS alpha FROM dist LEFT JOIN o USING (c, k)""",
    "missing_votes": _R + "SELECT missing, count(*)::BIGINT AS items FROM (SELECT item, (count(*) FILTER (label IS NULL))::BIGINT AS missing FROM ratings GROUP BY 1) GROUP BY 1",
    "model_runs": _V + "SELECT alias, first(alias || '-v' || (item % 4) ORDER BY item) FILTER (p >= 0.5) AS model_id, (count(*) FILTER (vote))::BIGINT AS relevant_true, (count(*) FILTER (NOT vote))::BIGINT AS relevant_false, round(avg(p), 4) AS avg_probability, (count(*) FILTER (item % 17 = 0))::BIGINT AS error_rows FROM votes GROUP BY 1",
    "overlap_jaccard": _VAR + _PAIR + """, jj AS (SELECT week, shared_articles / union_articles AS j FROM pj), n AS (SELECT week, count(DISTINCT variant)::BIGINT AS variants FROM u GROUP BY 1)
SELECT week, any_value(variants) AS variants, round(avg(j), 6) AS mean_jaccard, round(max(j), 6) AS max_jaccard, round(min(j), 6) AS min_jaccard FROM n LEFT JOIN jj USING (week) GROUP BY 1""",
    "overlap_two_grains": "SELECT 'week' AS grain, week, variants, union_articles, duplicate_share, exclusive_articles, best_single_variant, incremental_articles FROM (" + _ANALYSIS["overlap_summary"]
    + ") UNION ALL SELECT 'all', week, variants, union_articles, duplicate_share, exclusive_articles, best_single_variant, incremental_articles FROM (" + _ANALYSIS["overlap_summary"].replace("week(ts)::BIGINT", "(-1)::BIGINT") + ")",
    "peak_weeks_top": "SELECT variant, week, articles, rank FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY articles DESC, week)::BIGINT AS rank FROM (" + _ANALYSIS["variant_counts"] + ")) WHERE rank <= 3",
    "deepest_stage_last": """WITH m AS (SELECT *, try_cast(window_days AS INTEGER) AS days FROM manifest), r AS (SELECT *, CASE coalesce(nullif(trim(window_role), ''), 'species_scan') WHEN 'species_scan' THEN 0 WHEN 'coarse_period' THEN 1 ELSE (CASE WHEN days <= 1 THEN 6 WHEN days <= 3 THEN 5 WHEN days <= 7 THEN 4 WHEN days <= 14 THEN 3 ELSE 2 END) END AS rank FROM m WHERE days IS NOT NULL),
l AS (SELECT rank, row_number() OVER (PARTITION BY search_string, locale_id ORDER BY rank DESC, window_start DESC, window_end DESC, days DESC) AS n FROM r) SELECT rank, count(*)::BIGINT AS pairs FROM l WHERE n = 1 GROUP BY 1""",
    "discovery_samples": f"""WITH s AS (SELECT DISTINCT batch_id, item FROM {_B4}), t AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY md5('d:take:' || item), item) AS n FROM s)
SELECT batch_id, run::INTEGER AS run, row_number() OVER (PARTITION BY batch_id, run ORDER BY md5('d:' || batch_id || '/' || run || '/' || item), item)::BIGINT AS place, item FROM t CROSS JOIN range(1, 4) r(run) WHERE n <= 60""",
    "batch_overlap_means": "WITH o AS (" + _ANALYSIS["batch_overlap"] + ") SELECT l AS batch, round(avg(share), 4) AS mean FROM o GROUP BY 1 UNION ALL SELECT -1, round(avg(share), 4) FROM o WHERE l < r",
    "impact_causes": _IMP + "SELECT o = 'N/A' AS no_observation, c = 'N/A' AS no_cause, count(*)::BIGINT AS n FROM j GROUP BY 1, 2",
    "impacts_with_base": _IMP + """SELECT language_code, count(*)::BIGINT AS "rows", (count(*) FILTER (o = 'N/A'))::BIGINT AS "without" FROM j GROUP BY 1""",
    "collapse_examples": "SELECT language_code, count(DISTINCT locale_id)::BIGINT AS requested, first(locale_id ORDER BY window_start NULLS FIRST, search_string NULLS FIRST, locale_id NULLS FIRST) AS example FROM manifest GROUP BY 1",
    "experiment_grid": "SELECT id, y::BIGINT AS year, count(*)::BIGINT AS requests, min(topic) AS first_topic FROM (SELECT DISTINCT trim(search_string, ' ') AS topic FROM search_strings WHERE trim(search_string, ' ') <> '') CROSS JOIN locales CROSS JOIN range(2018, 2026) t(y) GROUP BY 1, 2",
    "global_assignment": _LC + ", k AS (SELECT lower(trim(label, ' ')) AS k, min(label) AS category FROM c GROUP BY 1) SELECT batch, category, count(*)::BIGINT AS items FROM c JOIN k ON k = lower(trim(label, ' ')) GROUP BY 1, 2",
    "taxonomy_summary": _LC + """, b AS (SELECT count(DISTINCT run) AS b FROM c), g AS (SELECT lower(trim(label, ' ')) AS label, count(DISTINCT run) / any_value(b) AS p, count(DISTINCT item_id) AS n FROM c CROSS JOIN b GROUP BY 1)
SELECT count(*)::BIGINT AS labels, (count(*) FILTER (p >= 0.5))::BIGINT AS at_half, (count(*) FILTER (p >= 0.7))::BIGINT AS at_seven, (count(*) FILTER (p >= 0.9))::BIGINT AS at_nine, round(coalesce(sum(n) FILTER (p >= 0.6), 0) / (SELECT count(*) FROM rss_items), 4) AS global_coverage FROM g""",
    "lookup_hits": _HIT + "SELECT query, term, match_type, score FROM h",
    "hit_score": _HIT + "SELECT query, term, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, match_type <> 'label', term) AS n FROM h) WHERE n = 1 AND score >= 3",
    "enriched_terms": "WITH t AS (SELECT trim(search_string, ' ') AS name, " + ", ".join(f"{_DIST.format(l=v)} AS {k}" for k, v in _LIST.items()) + " FROM search_strings WHERE trim(search_string, ' ') <> ''), a AS (SELECT *, en || fr || es || pt AS l FROM t) SELECT DISTINCT name, "
    + ", ".join(f"{_OR.format(l=k)} AS search_{k}" for k in _LIST) + ", " + _OR.format(l=_DIST.format(l="l")) + " AS search_all FROM a",
    "assigned_categories": _LC + """, n AS (SELECT batch, label, count(DISTINCT item_id) AS a FROM c GROUP BY 1, 2), k AS (SELECT DISTINCT label FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY a DESC, lower(label), label) AS r FROM n) WHERE r <= 10),
m AS (SELECT lower(trim(label, ' ')) AS k, min(label) AS name FROM k GROUP BY 1) SELECT coalesce(name, 'N/A') AS label, count(*)::BIGINT AS items FROM c LEFT JOIN m ON k = lower(trim(label, ' ')) GROUP BY 1""",
    "rule_table": "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'econ') THEN 'cheap' WHEN contains(lower(p_type), 'o') THEN 'with o' WHEN contains(lower(p_type), 'small') THEN 'size' ELSE 'other' END AS outcome FROM part",
    "first_token_rules": "SELECT CASE string_split(p_name, ' ')[1] WHEN 'red' THEN 'warm' WHEN 'blue' THEN 'cold' WHEN 'small' THEN 'size' WHEN 'large' THEN 'size' ELSE 'other' END AS kind, count(*)::BIGINT AS n FROM part GROUP BY 1",
    "model_inputs": f"SELECT article_id, {_nws('rss_title')} AS title, md5(left({_nws('full_text')}, 500)) AS text_hash, length(left({_nws('full_text')}, 500))::INTEGER AS chars FROM fulltext",
    "relevant_outlets": "SELECT count(*)::BIGINT AS n FROM domains_removed WHERE lower(trim(is_news_outlet)) IN ('1', 'true', 'yes', 'y', 'relevant')",
    "subtype_names": "SELECT p_partkey, CASE WHEN contains(lower(p_name), lower(p_type)) THEN p_name ELSE p_name || ' ' || p_type END AS name FROM part",
    "document_topics": "WITH k AS (" + _ANALYSIS["topic_keywords"] + """) SELECT doc_id, CASE d.genre WHEN 'article' THEN 0 WHEN 'brief' THEN 1 WHEN 'digest' THEN 2 WHEN 'report' THEN 3 WHEN 'sitrep' THEN 4 ELSE -1 END AS topic,
CASE WHEN d.genre IN ('article', 'brief', 'digest', 'report', 'sitrep') THEN coalesce(keywords, '') ELSE 'outlier' END AS topic_keywords, coalesce(d.genre NOT IN ('article', 'brief', 'digest', 'report', 'sitrep'), true) AS is_outlier FROM documents d LEFT JOIN k ON k.genre = d.genre""",
}
