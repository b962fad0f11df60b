"""Queries over keep-first rules, blocklists, windows, manifests and state snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.functions.text import title_key
from presswork.functions.urls import extract_domain
from presswork.operators import blocklist, dedupe, state, windows
from presswork.session import read_table

_ORDER = ["date_window_start", "date_window_end", "retrieved_at", "google_news_redirect_url", "guid", "rss_title"]


def _cascade_parts():
    order = [F.col(c) for c in _ORDER]
    stamp = F.date_format("rss_pubdate_utc", "yyyy-MM-dd HH:mm:ss")
    passes = [
        ("redirect_url", F.nullif(F.col("google_news_redirect_url"), F.lit(""))),
        ("guid", F.nullif(F.col("guid"), F.lit(""))),
        ("title_pubdate", F.when(F.col("rss_pubdate_utc").isNotNull(), F.concat(title_key(F.col("rss_title")), F.lit("||"), stamp))),
    ]
    return passes, order


def dedupe_cascade(spark, d):
    passes, order = _cascade_parts()
    flags = dedupe.cascade_flags(read_table(spark, d, "rss_items"), "item_id", passes, order)
    return flags.where("dropped_by IS NULL").select(F.col("id").alias("item_id"))


def dedupe_metrics(spark, d):
    passes, order = _cascade_parts()
    return dedupe.cascade_metrics(dedupe.cascade_flags(read_table(spark, d, "rss_items"), "item_id", passes, order), [name for name, _ in passes])


def dedupe_first(spark, d):
    r = read_table(spark, d, "rss_items").select("item_id", "google_news_redirect_url")
    return dedupe.first_per_key(r, F.nullif(F.trim("google_news_redirect_url"), F.lit("")), [F.col("item_id")]).select("item_id")


def dedupe_ci(spark, d):
    s = read_table(spark, d, "search_strings").select("search_string")
    return dedupe.first_ignoring_case(s, "search_string", [F.col("search_string")]).select(F.lower(F.trim("search_string")).alias("search_key"), "search_string")


def fulltext_fold(spark, d):
    f = read_table(spark, d, "fulltext").select("article_id", "canonical_url", "final_url", "content_hash")
    return dedupe.greedy_fold(f, "article_id", ["canonical_url", "final_url", "content_hash"]).where("kept").select(F.col("id").alias("article_id"))


def dup_rate(spark, d):
    t = read_table(spark, d, "documents").groupBy("text").agg(F.count(F.lit(1)).alias("n")).where("text IS NOT NULL")
    return t.agg(F.round(1 - F.count(F.lit(1)) / F.sum("n"), 6).alias("duplicate_rate"))


def domain_blocklist(spark, d):
    blocked = blocklist.blocked_domains(read_table(spark, d, "domains_removed"))
    r = read_table(spark, d, "rss_items").select("item_id", extract_domain(F.col("source_domain")).alias("host"))
    return blocklist.without_blocked(r, "host", blocked)


def domain_blocklist_metrics(spark, d):
    blocked = blocklist.blocked_domains(read_table(spark, d, "domains_removed"))
    r = read_table(spark, d, "rss_items").select(extract_domain(F.col("source_domain")).alias("host"))
    hit = blocklist.blocked_hosts(r, blocked, "host").withColumn("b", F.lit(1))
    # counts per host first: the join then has one row per host, however popular
    per = r.groupBy("host").agg(F.count(F.lit(1)).alias("n")).join(hit, "host", "left")
    return per.agg(F.sum("n").alias("input_rows"), F.sum(F.when(F.col("b") == 1, F.col("n")).otherwise(0)).alias("removed_rows"), F.sum(F.when(F.col("b").isNull(), F.col("n")).otherwise(0)).alias("kept_rows"))


def fetch_outcome(spark, d):
    p = read_table(spark, d, "page_texts")
    n = F.size(F.filter(F.split(F.trim(F.coalesce("full_text", F.lit(""))), r"\s+"), lambda x: x != ""))
    out = (
        F.when(F.col("status") >= 400, F.concat(F.lit("http_"), F.col("status").cast("string")))
        .when(~F.lower(F.coalesce("content_type", F.lit(""))).contains("html"), "non_html")
        .when(n == 0, "empty_text")
        .when(n < 120, "too_short")
        .otherwise("success")
    )
    return p.select("page_id", out.alias("outcome"))


def date_windows(spark, d):
    o = read_table(spark, d, "orders").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return windows.fixed_windows(o, "a", "b", 30).select(F.col("window_start").cast("string"), F.col("window_end").cast("string"), windows.window_days(F.col("window_start"), F.col("window_end")).cast("bigint").alias("days"))


def coarse_windows(spark, d):
    base = spark.createDataFrame([("2005-01-01", "2025-12-31"), ("2005-06-15", "2024-02-29"), ("2020-01-01", "2021-05-05")], "s string, e string")
    base = base.select("s", "e", F.to_date("s").alias("a"), F.to_date("e").alias("b"))
    return windows.coarse_windows(base, "a", "b", 5).select("s", "e", F.col("window_start").cast("string"), F.col("window_end").cast("string"))


def _leaves(spark, d):
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    o = read_table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    return windows.split_ladder(o.join(c, "o_custkey").select("segment", "day"), "segment", "day", "1995-01-01", "2001-12-31")


def window_ladder(spark, d):
    leaves = _leaves(spark, d)
    days = windows.window_days(F.col("window_start"), F.col("window_end"))
    return leaves.select("segment", F.col("window_start").cast("string"), F.col("window_end").cast("string"), "entries", "status", "saturated", windows.stage_label(days, windows.LADDER).alias("stage"))


def window_ladder_totals(spark, d):
    """Entries of the leaves per segment: the ladder tiles the period, so nothing is lost or counted twice."""
    return _leaves(spark, d).groupBy("segment").agg(F.sum("entries").alias("entries"), F.sum(F.datediff("window_end", "window_start") + 1).cast("bigint").alias("days"))


def stage_label(spark, d):
    m = read_table(spark, d, "manifest").select(F.expr("try_cast(window_days AS int)").alias("days")).where("days IS NOT NULL").distinct()
    return m.select("days", windows.stage_label(F.col("days"), windows.LADDER).alias("stage"), F.coalesce(windows.next_level(F.col("days"), windows.LADDER), F.lit(0)).alias("next_days"))


def manifest_init(spark, d):
    s = read_table(spark, d, "search_strings").where("trim(search_string) <> ''").select("search_string").distinct()
    loc = read_table(spark, d, "locales").select("id", "lang")
    return state.cross_manifest(s, loc).groupBy("id", "lang").agg(F.count(F.lit(1)).alias("requests"))


_MKEYS = ["pathogen_domain", "language_code", "locale_id", "search_string", "window_start", "window_end"]


def manifest_merge(spark, d):
    m = read_table(spark, d, "manifest")
    existing = m.groupBy(*_MKEYS).agg(F.max("status").alias("status"), F.max("attempts").alias("attempts"))
    default = m.where("window_role = 'coarse'").select(*_MKEYS).distinct().withColumn("status", F.lit("pending")).withColumn("attempts", F.lit("0"))
    return state.merge_manifest(default, existing, _MKEYS, ["status", "attempts"]).groupBy("status", "attempts").agg(F.count(F.lit(1)).alias("n"))


def state_resume(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey")
    prev = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("label"))
    return state.resume_state(c, prev, "c_custkey", ["label"])


def pending_antijoin(spark, d):
    done = read_table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return state.pending(read_table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


def registry_upsert(spark, d):
    f = read_table(spark, d, "fulltext").where("canonical_url IS NOT NULL AND trim(canonical_url) <> ''")
    one = f.groupBy("canonical_url", F.pmod("article_id", F.lit(2)).alias("half")).agg(
        F.min("article_id").alias("first_seen"), F.max("article_id").alias("last_seen"), F.min("final_url").alias("original_url"),
        F.min("domain").alias("source"), F.min("content_hash").alias("content_hash"))
    return state.upsert_registry(one.where("half = 0").drop("half"), one.where("half = 1").drop("half"))


def registry_counts(spark, d):
    f = read_table(spark, d, "fulltext")
    return f.groupBy(F.coalesce("domain", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def chunk_by_count(spark, d):
    c = read_table(spark, d, "customer").select("c_mktsegment", "c_custkey")
    out = state.chunk_by_count(c, "c_mktsegment", [F.col("c_custkey")], 100)
    return out.groupBy("c_mktsegment", "chunk_no").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first_key"))


def chunk_greedy(spark, d):
    t = read_table(spark, d, "documents").select(F.coalesce("lang", F.lit("")).alias("lang"), "doc_id", F.coalesce("n_chars", F.lit(0)).cast("bigint").alias("chars"))
    out = state.chunk_greedy(t, "lang", "doc_id", [("chars", 20000)], 25)
    return out.groupBy("lang", "chunk_no").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def submit_caps(spark, d):
    t = read_table(spark, d, "documents").select(F.coalesce("lang", F.lit("")).alias("lang"), "doc_id", F.coalesce("n_chars", F.lit(0)).cast("bigint").alias("chars"))
    return state.take_under_cap(t, "lang", [F.col("doc_id")], "chars", 50000).select("lang", "doc_id", "running")


def retry_eligibility(spark, d):
    m = read_table(spark, d, "manifest")
    tries = F.coalesce(F.expr("try_cast(attempts AS int)"), F.lit(0))
    ok = F.col("status").isin("failed", "throttled", "pending") & (tries < 3)
    wait = F.least(F.lit(300.0), 30 * F.pow(F.lit(2.0), F.greatest(tries - 1, F.lit(0))))
    return m.groupBy("status", ok.alias("eligible"), wait.alias("backoff_s")).agg(F.count(F.lit(1)).alias("n"))


def union_sources(spark, d):
    c = read_table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("c").alias("kind"))
    s = read_table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("s").alias("kind"))
    return c.unionByName(s, allowMissingColumns=True)


def artifacts_outer(spark, d):
    n = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    c = read_table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    s = read_table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return n.join(c, "k", "full_outer").join(s, "k", "full_outer").select("k", "n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


def fallback_lookup(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size")
    by_name = p.where("p_size > 25").groupBy(F.lower("p_name").alias("k")).agg(F.min("p_type").alias("a"))
    by_first = p.groupBy(F.lower(F.split("p_name", " ")[0]).alias("k2")).agg(F.min("p_type").alias("b"))
    j = p.join(by_name, F.lower("p_name") == F.col("k"), "left").join(by_first, F.lower(F.split("p_name", " ")[0]) == F.col("k2"), "left")
    return j.select("p_partkey", F.coalesce("a", "b", F.lit("unknown")).alias("profile"))


QUERIES = {
    f.__name__: f
    for f in (
        dedupe_cascade, dedupe_metrics, dedupe_first, dedupe_ci, fulltext_fold, dup_rate, domain_blocklist, domain_blocklist_metrics, fetch_outcome,
        date_windows, coarse_windows, window_ladder, window_ladder_totals, stage_label, manifest_init, manifest_merge, state_resume, pending_antijoin,
        registry_upsert, registry_counts, chunk_by_count, chunk_greedy, submit_caps, retry_eligibility, union_sources, artifacts_outer, fallback_lookup,
    )
}

_SORT = "ORDER BY date_window_start NULLS LAST, date_window_end NULLS LAST, retrieved_at NULLS LAST, google_news_redirect_url NULLS LAST, guid NULLS LAST, rss_title NULLS LAST, item_id"
_CASCADE = f"""WITH a AS (SELECT *, nullif(google_news_redirect_url, '') AS k1, nullif(guid, '') AS k2,
  CASE WHEN rss_pubdate_utc IS NOT NULL THEN trim(regexp_replace(lower(coalesce(rss_title, '')), '[^0-9a-z]+', ' ', 'g')) || '||' || strftime(rss_pubdate_utc AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') END AS k3 FROM rss_items),
b AS (SELECT *, row_number() OVER (PARTITION BY k1 {_SORT}) AS n1 FROM a), b2 AS (SELECT * FROM b WHERE k1 IS NULL OR n1 = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY k2 {_SORT}) AS n2 FROM b2), c2 AS (SELECT * FROM c WHERE k2 IS NULL OR n2 = 1),
e AS (SELECT *, row_number() OVER (PARTITION BY k3 {_SORT}) AS n3 FROM c2), e2 AS (SELECT * FROM e WHERE k3 IS NULL OR n3 = 1)
"""
_HOSTS = """WITH bl AS (SELECT DISTINCT h FROM (SELECT regexp_replace(regexp_replace(lower(regexp_extract(trim(domain), '^(?:[A-Za-z]+://)?([^/?#:]*)', 1)), '^www\\.', ''), '\\.+$', '') AS h
  FROM domains_removed WHERE lower(trim(is_news_outlet)) = 'no') WHERE h <> ''),
r AS (SELECT item_id, regexp_replace(lower(trim(coalesce(source_domain, ''))), '^www\\.', '') AS host FROM rss_items)
"""
_LADDER = """WITH RECURSIVE f AS (SELECT c_mktsegment AS segment, o_orderdate::DATE AS day FROM orders JOIN customer ON o_custkey = c_custkey),
days AS (SELECT segment, day, count(*) AS n FROM f WHERE day BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' GROUP BY 1, 2),
w AS (
  SELECT DISTINCT segment, DATE '1995-01-01' AS s, DATE '2001-12-31' AS e, 0 AS lv FROM f
  UNION ALL
  SELECT segment, cs, CASE WHEN lv = 0 THEN (CASE WHEN cs = DATE '1995-01-01' THEN DATE '1999-12-31' ELSE e END) ELSE least(e, cs + (sz - 1)::INTEGER)::DATE END, lv + 1 FROM (
    SELECT segment, s, e, lv, sz, unnest(generate_series(s, e, CASE WHEN lv = 0 THEN to_years(5) ELSE to_days(sz) END))::DATE AS cs FROM (
      SELECT w.segment, s, e, lv, CASE lv WHEN 1 THEN 30 WHEN 2 THEN 14 WHEN 3 THEN 7 WHEN 4 THEN 3 ELSE 1 END AS sz
      FROM w WHERE lv < 6 AND e > s AND (SELECT coalesce(sum(n), 0) FROM days WHERE days.segment = w.segment AND day BETWEEN w.s AND w.e) >= 100)))
, c AS (SELECT w.*, (SELECT coalesce(sum(n), 0) FROM days WHERE days.segment = w.segment AND day BETWEEN w.s AND w.e) AS entries FROM w)
, leaf AS (SELECT segment, s AS window_start, e AS window_end, entries::BIGINT AS entries, CASE WHEN entries = 0 THEN 'empty' ELSE 'success' END AS status, entries >= 100 AS saturated,
  CASE WHEN e - s + 1 <= 1 THEN '1_day' WHEN e - s + 1 <= 3 THEN '3_day' WHEN e - s + 1 <= 7 THEN '7_day' WHEN e - s + 1 <= 14 THEN '14_day' WHEN e - s + 1 <= 30 THEN '30_day' ELSE 'coarse' END AS stage
  FROM c WHERE entries < 100 OR e = s OR lv = 6)
"""

ORACLE = {
    "dedupe_cascade": _CASCADE + "SELECT item_id FROM e2",
    "dedupe_metrics": _CASCADE + """SELECT 'before_redirect_url' AS metric, count(*)::BIGINT AS value FROM a UNION ALL SELECT 'before_guid', count(*) FROM b2
UNION ALL SELECT 'before_title_pubdate', count(*) FROM c2 UNION ALL SELECT 'kept_rows', count(*) FROM e2""",
    "dedupe_first": """SELECT min(item_id) AS item_id FROM rss_items WHERE trim(google_news_redirect_url, ' ') <> '' GROUP BY trim(google_news_redirect_url, ' ')
UNION ALL SELECT item_id FROM rss_items WHERE google_news_redirect_url IS NULL OR trim(google_news_redirect_url, ' ') = ''""",
    "dedupe_ci": "SELECT lower(trim(search_string)) AS search_key, min(search_string) AS search_string FROM search_strings WHERE trim(search_string) <> '' GROUP BY 1",
    "dup_rate": "SELECT round(1 - count(DISTINCT text) / count(text), 6) AS duplicate_rate FROM documents",
    "domain_blocklist": _HOSTS + "SELECT item_id, host FROM r WHERE NOT EXISTS (SELECT 1 FROM bl WHERE host = h OR ends_with(host, '.' || h))",
    "domain_blocklist_metrics": _HOSTS + """, x AS (SELECT host, EXISTS (SELECT 1 FROM bl WHERE host = h OR ends_with(host, '.' || h)) AS b FROM r)
SELECT count(*)::BIGINT AS input_rows, count(*) FILTER (b)::BIGINT AS removed_rows, count(*) FILTER (NOT b)::BIGINT AS kept_rows FROM x""",
    "fetch_outcome": r"""WITH t AS (SELECT *, len(list_filter(string_split_regex(coalesce(full_text, ''), '[\s\x0B]+'), lambda x: x <> '')) AS n FROM page_texts)
SELECT page_id, CASE WHEN status >= 400 THEN 'http_' || status WHEN lower(coalesce(content_type, '')) NOT LIKE '%html%' THEN 'non_html' WHEN n = 0 THEN 'empty_text' WHEN n < 120 THEN 'too_short' ELSE 'success' END AS outcome FROM t""",
    "date_windows": """WITH b AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders), s AS (SELECT b, unnest(generate_series(a, b, INTERVAL 30 DAY))::DATE AS s FROM b)
SELECT s::VARCHAR AS window_start, least(b, s + 29)::DATE::VARCHAR AS window_end, (least(b, s + 29) - s + 1)::BIGINT AS days FROM s""",
    "coarse_windows": """SELECT s, e, w AS window_start, x AS window_end FROM (VALUES
('2005-01-01', '2025-12-31', '2005-01-01', '2009-12-31'), ('2005-01-01', '2025-12-31', '2010-01-01', '2014-12-31'), ('2005-01-01', '2025-12-31', '2015-01-01', '2019-12-31'), ('2005-01-01', '2025-12-31', '2020-01-01', '2025-12-31'),
('2005-06-15', '2024-02-29', '2005-06-15', '2010-06-14'), ('2005-06-15', '2024-02-29', '2010-06-15', '2015-06-14'), ('2005-06-15', '2024-02-29', '2015-06-15', '2020-06-14'), ('2005-06-15', '2024-02-29', '2020-06-15', '2024-02-29'),
('2020-01-01', '2021-05-05', '2020-01-01', '2021-05-05')) t(s, e, w, x)""",
    "window_ladder": _LADDER + "SELECT segment, window_start::VARCHAR AS window_start, window_end::VARCHAR AS window_end, entries, status, saturated, stage FROM leaf",
    "window_ladder_totals": "SELECT c_mktsegment AS segment, count(*)::BIGINT AS entries, (DATE '2001-12-31' - DATE '1995-01-01' + 1)::BIGINT AS days FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "stage_label": """WITH m AS (SELECT DISTINCT try_cast(window_days AS INTEGER) AS days FROM manifest)
SELECT days, CASE WHEN days <= 1 THEN '1_day' WHEN days <= 3 THEN '3_day' WHEN days <= 7 THEN '7_day' WHEN days <= 14 THEN '14_day' WHEN days <= 30 THEN '30_day' ELSE 'coarse' END AS stage,
  CASE WHEN days > 30 THEN 30 WHEN days > 14 THEN 14 WHEN days > 7 THEN 7 WHEN days > 3 THEN 3 WHEN days > 1 THEN 1 ELSE 0 END AS next_days FROM m WHERE days IS NOT NULL""",
    "manifest_init": "SELECT id, lang, count(*)::BIGINT AS requests FROM (SELECT DISTINCT search_string FROM search_strings WHERE trim(search_string) <> '') CROSS JOIN locales GROUP BY 1, 2",
    "manifest_merge": """WITH ex AS (SELECT pathogen_domain, language_code, locale_id, search_string, window_start, window_end, max(status) AS s, max(attempts) AS a FROM manifest GROUP BY ALL),
df AS (SELECT DISTINCT pathogen_domain, language_code, locale_id, search_string, window_start, window_end, 1 AS d FROM manifest WHERE window_role = 'coarse')
SELECT coalesce(nullif(trim(s), ''), CASE WHEN d = 1 THEN 'pending' END) AS status, coalesce(nullif(trim(a), ''), CASE WHEN d = 1 THEN '0' END) AS attempts, count(*)::BIGINT AS n
FROM ex LEFT JOIN df USING (pathogen_domain, language_code, locale_id, search_string, window_start, window_end) GROUP BY 1, 2""",
    "state_resume": "SELECT c_custkey, coalesce(l, '') AS label FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS l FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "pending_antijoin": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
    "registry_upsert": """WITH g AS (SELECT canonical_url, article_id % 2 AS half, min(article_id) AS f, max(article_id) AS l, min(final_url) AS o, min(domain) AS s, min(content_hash) AS h FROM fulltext WHERE trim(canonical_url) <> '' GROUP BY 1, 2),
a AS (SELECT * FROM g WHERE half = 0), b AS (SELECT * FROM g WHERE half = 1)
SELECT coalesce(a.canonical_url, b.canonical_url) AS canonical_url, coalesce(a.f, b.f) AS first_seen, coalesce(b.l, a.l) AS last_seen, coalesce(a.o, b.o) AS original_url, coalesce(b.s, a.s) AS source, coalesce(b.h, a.h) AS content_hash
FROM a FULL JOIN b ON a.canonical_url = b.canonical_url""",
    "registry_counts": "SELECT coalesce(domain, 'unknown') AS source, count(*)::BIGINT AS n FROM fulltext GROUP BY 1",
    "chunk_by_count": "SELECT c_mktsegment, ((rn - 1) // 100)::BIGINT AS chunk_no, count(*)::BIGINT AS n, min(c_custkey) AS first_key FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer) GROUP BY 1, 2",
    "submit_caps": """SELECT lang, doc_id, running::BIGINT AS running FROM (SELECT coalesce(lang, '') AS lang, doc_id, sum(coalesce(n_chars, 0)) OVER (PARTITION BY coalesce(lang, '') ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running <= 50000""",
    "retry_eligibility": """WITH m AS (SELECT status, coalesce(try_cast(attempts AS INTEGER), 0) AS a FROM manifest)
SELECT status, status IN ('failed', 'throttled', 'pending') AND a < 3 AS eligible, least(300.0, 30 * pow(2, greatest(a - 1, 0)))::DOUBLE AS backoff_s, count(*)::BIGINT AS n FROM m GROUP BY 1, 2, 3""",
    "union_sources": "SELECT c_name AS name, c_acctbal AS balance, 'c' AS kind FROM customer UNION ALL SELECT s_name, NULL, 's' FROM supplier",
    "artifacts_outer": """SELECT n_nationkey AS k, n_name, coalesce(c, 0)::BIGINT AS customers, coalesce(s, 0)::BIGINT AS suppliers FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""",
    "fallback_lookup": """WITH a AS (SELECT lower(p_name) AS k, min(p_type) AS a FROM part WHERE p_size > 25 GROUP BY 1), b AS (SELECT lower(string_split(p_name, ' ')[1]) AS k2, min(p_type) AS b FROM part GROUP BY 1)
SELECT p_partkey, coalesce(a, b, 'unknown') AS profile FROM part LEFT JOIN a ON lower(p_name) = k LEFT JOIN b ON lower(string_split(p_name, ' ')[1]) = k2""",
}
