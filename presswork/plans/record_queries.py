"""Queries over records of model runs, impacts, registries, locale variants, rule tables and the whole feed pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.functions import html, text
from presswork.functions.urls import extract_domain
from presswork.operators import blocklist, dedupe, evaluation, reports, windows
from presswork.plans.analysis_queries import _V, _labels, _variants, _votes
from presswork.plans.analysis_queries import ORACLE as _ANALYSIS
from presswork.plans.table_queries import _CASCADE, _cascade_parts
from presswork.session import read_table
from presswork.sources.readers import batch_results as read_batch_results


def scan_events(spark, d):
    e = read_table(spark, d, "events")
    return e.where("event_type = 'purchase' AND value > 100").select("event_id", "user_id", "value")


def labels_reference(spark, d):
    r = read_table(spark, d, "domains_removed")
    flag = text.to_bool(F.col("is_news_outlet"))
    keyed = r.select(extract_domain(F.col("domain")).alias("host"), flag.cast("int").alias("news"), "domain").where("news IS NOT NULL AND host <> ''")
    return dedupe.first_per_key(keyed, F.col("host"), [F.col("domain")], keep_missing=False).select("host", "news")


def labels_join(spark, d):
    r = read_table(spark, d, "rss_items").select(extract_domain(F.col("source_domain")).alias("host"))
    # counts per host before the join: it then has one row per host
    return r.groupBy("host").agg(F.count(F.lit(1)).alias("items")).join(labels_reference(spark, d), "host")


def serialize_arrays(spark, d):
    f = read_table(spark, d, "fulltext").where("domain IS NOT NULL")
    return f.groupBy("domain").agg(text.serialize(F.array_sort(F.collect_set("article_language"))).alias("languages"))


def extractive_summary(spark, d):
    return summaries(read_table(spark, d, "documents"))


def summaries(documents, budget=6000):
    """The three best sentences of each document in their order; a sentence scores by keywords, punctuation and length.

    The first sentence that would exceed the budget of characters ends the summary; if it is the first of all, the summary
    is the beginning of the text.
    """
    t = documents.where("text IS NOT NULL").select("doc_id", F.split(text.normalize_ws(F.col("text")), r"(?<=[.!?]) ").alias("s"))
    one = t.select("doc_id", F.posexplode("s").alias("pos", "sentence")).where("sentence <> ''")
    kw = F.regexp_count(F.lower("sentence"), F.lit("samples|deaths|virus|outbreak|market"))
    score = 2 * kw + 0.15 * F.regexp_count("sentence", F.lit("[,;:]")) + F.least(F.length("sentence"), F.lit(260)) / 260
    ranked = reports.Window.partitionBy("doc_id").orderBy(F.round(F.col("score"), 9).desc(), "pos")
    best = one.withColumn("score", score).withColumn("n", F.row_number().over(ranked)).where("n <= 3")
    run = F.sum(F.length("sentence") + 1).over(reports.Window.partitionBy("doc_id").orderBy("pos"))
    fits = F.when(run <= budget, F.struct("pos", "sentence"))
    out = best.withColumn("fits", fits).groupBy("doc_id").agg(F.array_sort(F.collect_list("fits")).alias("f"))
    whole = F.array_join(F.transform("f", lambda x: x["sentence"]), " ")
    cut = out.where(F.size("f") == 0).select("doc_id").join(documents, "doc_id").select("doc_id", F.left("text", F.lit(budget)).alias("summary"))
    return out.where(F.size("f") > 0).select("doc_id", whole.alias("summary")).unionByName(cut)


def rss_pipeline(spark, d):
    """Items not blocked, first of their story, per dataset and month: blocklist, three-pass dedupe, report."""
    blocked = blocklist.blocked_domains(read_table(spark, d, "domains_removed"))
    cols = ["item_id", "dataset_key", "source_domain", "rss_pubdate_utc", "date_window_start", "date_window_end", "retrieved_at", "google_news_redirect_url", "guid", "rss_title"]
    items = read_table(spark, d, "rss_items").select(*cols).withColumn("host", extract_domain(F.col("source_domain")))
    passes, order = _cascade_parts()
    kept = dedupe.cascade(blocklist.without_blocked(items, "host", blocked), "item_id", passes, order)
    return kept.groupBy("dataset_key").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("host").alias("hosts"))


def enqueued_tokens(spark, d):
    t = read_table(spark, d, "documents").select("source", text.prompt_tokens(F.col("text")).alias("tokens"))
    return t.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("requests"))


def batch_result_normalize(spark, d):
    e = read_table(spark, d, "events")
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"custom_id": "'), "event_id", F.lit('", "response": {"status_code": 500, "body": {}}}'))).otherwise(
        F.concat(F.lit('{"custom_id": "'), "event_id", F.lit('", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": "'), "event_type", F.lit('"}}]}}}')))
    return read_batch_results(e.select(line.alias("value")))


def backoff_schedule(spark, d):
    return spark.range(1, 9).select(F.col("id").alias("attempt"), F.least(F.lit(300.0), 5 * F.pow(F.lit(2.0), F.col("id") - 1)).alias("seconds"))


def retry_pending(spark, d):
    m = read_table(spark, d, "manifest").where(F.col("status").isin("failed", "throttled"))
    m = m.select("search_string", "locale_id", "window_start", "status", F.coalesce("next_eligible_attempt_at", F.lit("")).alias("next_at"))
    return m.orderBy("next_at", "search_string", "locale_id", "window_start", "status").limit(200)


def evidence_merge(spark, d):
    """Names of all supporting models' evidence, in model order, each kept once without regard to case."""
    v = _votes(spark, d).where("vote").select("item", "alias", F.element_at(F.array(F.lit("Alpha"), F.lit("alpha"), F.lit("Beta")), F.right("alias", F.lit(1)).cast("int")).alias("span"))
    g = v.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("alias", "span"))).alias("l"))
    return g.select("item", text.serialize(text.dedupe_ordered(F.transform("l", lambda x: x["span"]))).alias("evidence"))


def ensemble_gain(spark, d):
    lab = _labels(spark, d)
    single = evaluation.confusion(_votes(spark, d).join(lab, "item"), F.col("vote"), F.col("truth"), ["alias"]).agg(F.max("f1").alias("best_single"))
    pooled = evaluation.confusion(evaluation.pooled(_votes(spark, d), "item", 0.5, 0.34).join(lab, "item"), F.col("relevant"), F.col("truth")).select("f1")
    return pooled.crossJoin(single).select(F.col("f1").alias("ensemble_f1"), "best_single", F.round(F.col("f1") - F.col("best_single"), 4).alias("gain"))


def agreement_rate(spark, d):
    from presswork.plans.analysis_queries import _ratings

    m = evaluation.majority(_ratings(spark, d))
    return m.where("share IS NOT NULL").groupBy("share").agg(F.count(F.lit(1)).alias("items"))


def resolution_summary(spark, d):
    e = read_table(spark, d, "events")
    return e.groupBy("event_type").agg(F.countDistinct(F.to_date("ts")).alias("days"), F.round(F.sum("value"), 2).alias("total"), F.sum(F.when(F.col("value") > 100, 1).otherwise(0)).cast("bigint").alias("large"))


def overlap_grains(spark, d):
    """Distinct articles by week and variant, by week, and in all, from one pass over grouping sets."""
    v = _variants(spark, d)
    v.createOrReplaceTempView("presswork_variants")
    return spark.sql("""SELECT coalesce(week, -1) AS week, coalesce(variant, '(all)') AS variant, count(DISTINCT article) AS articles
        FROM presswork_variants GROUP BY GROUPING SETS ((week, variant), (week), ())""")


def keep_signal(spark, d):
    from presswork.operators.overlap import memberships

    m = memberships(_variants(spark, d), ["week"], "variant", "article")
    one = m.where(F.size("variants") == 1).groupBy(F.col("variants")[0].alias("variant")).agg(F.count(F.lit(1)).alias("alone"))
    al = m.select(F.explode("variants").alias("variant")).groupBy("variant").agg(F.count(F.lit(1)).alias("n"))
    pct = F.round(100 * F.coalesce("alone", F.lit(0)) / F.col("n"), 2)
    return al.join(one, "variant", "left").select("variant", "n", pct.alias("exclusive_pct"), F.when(pct >= 25, "high").when(pct >= 10, "moderate").otherwise("low").alias("signal"))


def collapse_summary(spark, d):
    m = read_table(spark, d, "manifest")
    g = m.groupBy("language_code").agg(F.countDistinct("locale_id").alias("requested"), F.countDistinct("request_lang").alias("resolved"), F.array_join(F.array_sort(F.collect_set("locale_id")), ", ").alias("members"))
    return g.select("language_code", "requested", "resolved", "members")


def flatten_impacts(spark, d):
    """One row per listed impact of an article; articles without any keep one row with N/A."""
    f = read_table(spark, d, "fulltext").select("article_id", text.split_terms(F.col("authors")).alias("impacts"))
    rows = f.select("article_id", F.explode_outer("impacts").alias("impact"))
    return rows.select("article_id", F.coalesce("impact", F.lit("N/A")).alias("impact"))


def assignment_summary(spark, d):
    rows = flatten_impacts(spark, d)
    real = F.col("impact") != "N/A"
    n = F.countDistinct("article_id")
    return rows.agg(n.alias("articles"), F.round(F.countDistinct(F.when(real, F.col("article_id"))) / n, 6).alias("coverage"), F.round(F.sum(F.when(real, 1).otherwise(0)) / n, 6).alias("per_article"))


def global_taxonomy(spark, d):
    """Labels by the share of batches that have them, and whether that share is robust."""
    r = read_table(spark, d, "rss_items").where("trim(search_string) <> ''").select(F.lower(F.trim("search_string")).alias("label"), "batch_no").distinct()
    total = r.agg(F.countDistinct("batch_no").alias("b"))
    g = r.groupBy("label").agg(F.count(F.lit(1)).alias("batches")).crossJoin(F.broadcast(total))
    return g.select("label", "batches", F.round(F.col("batches") / F.col("b"), 6).alias("probability"), (F.col("batches") / F.col("b") >= 0.6).alias("robust"))


def global_mapping(spark, d):
    r = read_table(spark, d, "rss_items").where("trim(search_string) <> ''").select("batch_no", F.col("search_string").alias("name"))
    per = r.groupBy("batch_no", "name").agg(F.count(F.lit(1)).alias("n"))
    names = dedupe.first_ignoring_case(per.select("name").distinct(), "name", [F.col("name")]).select(F.lower(F.trim("name")).alias("k"), F.col("name").alias("category"))
    return per.withColumn("k", F.lower(F.trim("name"))).join(names, "k").groupBy("category").agg(F.sum("n").alias("items"), F.countDistinct("batch_no").alias("batches"))


def merge_parts(spark, d):
    p = read_table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("types"))
    return p.select("p_brand", text.serialize(text.dedupe_ordered(F.transform("types", lambda x: F.split(x, " ")[0])), ", ").alias("kinds"))


#: A rule table: first matching word decides.
RULES = [("steel", "metal"), ("brass", "metal"), ("tin", "metal"), ("copper", "metal"), ("promo", "offer"), ("small", "size"), ("large", "size")]


def rule_cascade(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", F.lower("p_type").alias("t"))
    return p.select("p_partkey", text.first_rule(F.col("t"), RULES, "other").alias("profile"))


def page_text(spark, d):
    """Main text by container density, of pages put together from feed descriptions."""
    r = read_table(spark, d, "rss_items").where("rss_description IS NOT NULL")
    page = F.concat(F.lit("<html><body><nav><a href='/'>Home</a></nav><article><p>"), F.col("rss_description"), F.lit("</p></article></body></html>"))
    return r.select("item_id", html.page_fields(page, F.col("source_url")).alias("f")).select("item_id", F.col("f.text").alias("body"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_events, labels_reference, labels_join, serialize_arrays, extractive_summary, rss_pipeline, enqueued_tokens,
        batch_result_normalize, backoff_schedule, retry_pending, evidence_merge, ensemble_gain, agreement_rate, resolution_summary, overlap_grains,
        keep_signal, collapse_summary, flatten_impacts, assignment_summary, global_taxonomy, global_mapping, merge_parts, rule_cascade, page_text,
    )
}

_NWS = r"trim(regexp_replace(coalesce({c}, ''), '[\s\x0B\x1C-\x1F\x85\p{{Z}}]+', ' ', 'g'))"
_PARTS = "list_filter(list_transform(string_split_regex(coalesce(authors, ''), '[;,|]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"
_IMPACTS = f"""WITH p AS (SELECT article_id, {_PARTS} AS l FROM fulltext), u AS (SELECT article_id, list_filter(l, lambda x, i: NOT list_contains(list_transform(l[1:i-1], lambda y: lower(y)), lower(x))) AS l FROM p),
im AS (SELECT article_id, unnest(CASE WHEN len(l) = 0 THEN ['N/A'] ELSE l END) AS impact FROM u)
"""
_REF = """WITH hh AS (SELECT regexp_replace(regexp_replace(lower(regexp_extract(trim(domain), '^(?:[A-Za-z]+://)?([^/?#:]*)', 1)), '^www\\.', ''), '\\.+$', '') AS host,
  CASE WHEN lower(trim(is_news_outlet)) IN ('true', '1', 'yes', 'y') THEN 1 WHEN lower(trim(is_news_outlet)) IN ('false', '0', 'no', 'n') THEN 0 END AS news, domain FROM domains_removed),
ref AS (SELECT host, first(news ORDER BY domain) AS news FROM hh WHERE news IS NOT NULL AND host <> '' GROUP BY 1)
"""
_E1 = _ANALYSIS["per_run_metrics"]
_E2 = _ANALYSIS["confusion_metrics"]

ORACLE = {
    "scan_events": "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 100",
    "labels_reference": _REF + "SELECT host, news FROM ref",
    "labels_join": _REF + ", r AS (SELECT regexp_replace(lower(trim(coalesce(source_domain, ''))), '^www\\.', '') AS host FROM rss_items) SELECT host, count(*)::BIGINT AS items, any_value(news) AS news FROM r JOIN ref USING (host) GROUP BY 1",
    "serialize_arrays": "SELECT domain, coalesce(array_to_string(list_sort(list(DISTINCT article_language) FILTER (article_language IS NOT NULL)), ' | '), '') AS languages FROM fulltext WHERE domain IS NOT NULL GROUP BY 1",
    "rss_pipeline": _CASCADE.replace("FROM rss_items)", """FROM rss_items WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT h FROM (SELECT regexp_replace(regexp_replace(lower(regexp_extract(trim(domain), '^(?:[A-Za-z]+://)?([^/?#:]*)', 1)), '^www\\.', ''), '\\.+$', '') AS h
  FROM domains_removed WHERE lower(trim(is_news_outlet)) = 'no') WHERE h <> '') WHERE regexp_replace(lower(trim(coalesce(source_domain, ''))), '^www\\.', '') = h OR ends_with(regexp_replace(lower(trim(coalesce(source_domain, ''))), '^www\\.', ''), '.' || h)))""", 1)
    + "SELECT dataset_key, count(*)::BIGINT AS items, count(DISTINCT regexp_replace(lower(trim(coalesce(source_domain, ''))), '^www\\.', ''))::BIGINT AS hosts FROM e2 GROUP BY 1",
    "enqueued_tokens": "SELECT source, sum(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, length(text) // 4) END)::BIGINT AS tokens, count(*)::BIGINT AS requests FROM documents GROUP BY 1",
    "batch_result_normalize": """SELECT event_id::VARCHAR AS custom_id, event_id % 5 <> 0 AS success, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS raw_text, CASE WHEN event_id % 5 = 0 THEN 'http_500' ELSE '' END AS error FROM events""",
    "backoff_schedule": "SELECT i::BIGINT AS attempt, least(300.0, 5 * pow(2, i - 1))::DOUBLE AS seconds FROM range(1, 9) t(i)",
    "retry_pending": """SELECT search_string, locale_id, window_start, status, coalesce(next_eligible_attempt_at, '') AS next_at FROM manifest WHERE status IN ('failed', 'throttled')
ORDER BY next_at, search_string NULLS FIRST, locale_id NULLS FIRST, window_start NULLS FIRST, status LIMIT 200""",
    "evidence_merge": _V + """, e AS (SELECT item, bool_or(alias IN ('m1', 'm2')) AS a, bool_or(alias = 'm1') AS a1, bool_or(alias = 'm3') AS b FROM votes WHERE vote GROUP BY 1)
SELECT item, concat_ws(' | ', CASE WHEN a THEN (CASE WHEN a1 THEN 'Alpha' ELSE 'alpha' END) END, CASE WHEN b THEN 'Beta' END) AS evidence FROM e""",
    "ensemble_gain": "WITH s AS (" + _E1 + "), p AS (" + _E2 + ") SELECT p.f1 AS ensemble_f1, (SELECT max(f1) FROM s) AS best_single, round(p.f1 - (SELECT max(f1) FROM s), 4) AS gain FROM p",
    "agreement_rate": "WITH m AS (" + _ANALYSIS["majority_vote"] + ") SELECT share, count(*)::BIGINT AS items FROM m WHERE share >= 0 GROUP BY 1",
    "resolution_summary": "SELECT event_type, count(DISTINCT ts::DATE)::BIGINT AS days, round(sum(value), 2) AS total, count(*) FILTER (value > 100)::BIGINT AS large FROM events GROUP BY 1",
    "overlap_grains": """WITH v AS (SELECT week(ts)::BIGINT AS week, event_type AS variant, user_id AS article FROM events)
SELECT coalesce(week, -1) AS week, coalesce(variant, '(all)') AS variant, count(DISTINCT article)::BIGINT AS articles FROM v GROUP BY GROUPING SETS ((week, variant), (week), ())""",
    "keep_signal": """WITH u AS (SELECT DISTINCT week(ts) AS week, event_type AS variant, user_id AS article FROM events), m AS (SELECT *, count(*) OVER (PARTITION BY week, article) AS k FROM u),
z AS (SELECT variant, count(*)::BIGINT AS n, round(100 * count(*) FILTER (k = 1) / count(*), 2) AS exclusive_pct FROM m GROUP BY 1) SELECT *, CASE WHEN exclusive_pct >= 25 THEN 'high' WHEN exclusive_pct >= 10 THEN 'moderate' ELSE 'low' END AS signal FROM z""",
    "collapse_summary": "SELECT language_code, count(DISTINCT locale_id)::BIGINT AS requested, count(DISTINCT request_lang)::BIGINT AS resolved, array_to_string(list_sort(list(DISTINCT locale_id)), ', ') AS members FROM manifest GROUP BY 1",
    "flatten_impacts": _IMPACTS + "SELECT article_id, impact FROM im",
    "assignment_summary": _IMPACTS + "SELECT count(DISTINCT article_id)::BIGINT AS articles, round(count(DISTINCT article_id) FILTER (impact <> 'N/A') / count(DISTINCT article_id), 6) AS coverage, round(count(*) FILTER (impact <> 'N/A') / count(DISTINCT article_id), 6) AS per_article FROM im",
    "global_taxonomy": """WITH r AS (SELECT DISTINCT lower(trim(search_string, ' ')) AS label, batch_no FROM rss_items WHERE trim(search_string, ' ') <> ''), b AS (SELECT count(DISTINCT batch_no) AS b FROM r)
SELECT label, count(*)::BIGINT AS batches, round(count(*) / any_value(b), 6) AS probability, count(*) / any_value(b) >= 0.6 AS robust FROM r CROSS JOIN b GROUP BY 1""",
    "global_mapping": """WITH r AS (SELECT batch_no, search_string AS name, lower(trim(search_string, ' ')) AS k FROM rss_items WHERE trim(search_string, ' ') <> ''), c AS (SELECT k, min(name) AS category FROM r GROUP BY 1)
SELECT category, count(*)::BIGINT AS items, count(DISTINCT batch_no)::BIGINT AS batches FROM r JOIN c USING (k) GROUP BY 1""",
    "merge_parts": """WITH t AS (SELECT p_brand, list_transform(list_sort(list(DISTINCT p_type)), lambda x: string_split(x, ' ')[1]) AS l FROM part GROUP BY 1)
SELECT p_brand, array_to_string(list_filter(l, lambda x, i: NOT list_contains(list_transform(l[1:i-1], lambda y: lower(y)), lower(x))), ', ') AS kinds FROM t""",
    "rule_cascade": "SELECT p_partkey, CASE " + " ".join(f"WHEN lower(p_type) LIKE '%{w}%' THEN '{k}'" for w, k in RULES) + " ELSE 'other' END AS profile FROM part",
}
