"""Queries over scalar functions of texts, URLs and model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions import html, model_output, text, urls
from presswork.session import read_table

# The same white space class in the dialect of the checking engine.
_WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"


def _nws(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{_WS}', ' ', 'g'))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def normalize_ws(spark, d):
    return _docs(spark, d).select("doc_id", text.normalize_ws(F.col("text")).alias("clean"))


def content_hash(spark, d):
    return _docs(spark, d).select("doc_id", text.content_hash(F.col("text")).alias("hash"))


def slugify(spark, d):
    return read_table(spark, d, "rss_items").select("item_id", text.slugify(F.col("rss_title")).alias("slug"))


def title_key(spark, d):
    return read_table(spark, d, "rss_items").select("item_id", text.title_key(F.col("rss_title")).alias("key"))


def prompt_tokens(spark, d):
    return _docs(spark, d).select("doc_id", text.prompt_tokens(F.col("text")).alias("tokens"))


def truncate_text(spark, d):
    return _docs(spark, d).select("doc_id", text.truncate_text(F.col("text"), 280).alias("short"))


def model_text(spark, d):
    f = read_table(spark, d, "fulltext")
    m = text.model_text(F.col("page_title"), F.col("full_text"))
    return f.select("article_id", m.alias("model_text")).withColumn("model_words", text.word_count(F.col("model_text")))


def token_set(spark, d):
    return read_table(spark, d, "rss_items").select("item_id", F.array_join(text.token_set(F.col("rss_title")), " ").alias("tokens"))


def min_words(spark, d):
    f = read_table(spark, d, "fulltext").select("article_id", text.word_count(F.col("full_text")).alias("words"))
    return f.where("words >= 120")


def first_token(spark, d):
    return read_table(spark, d, "fulltext").select("article_id", text.first_of_list(F.col("authors")).alias("first_author"))


def split_dedupe_terms(spark, d):
    f = read_table(spark, d, "fulltext")
    return f.select("article_id", text.serialize(text.split_terms(F.col("authors"))).alias("authors"))


def search_string(spark, d):
    s = read_table(spark, d, "search_strings")
    terms = text.dedupe_ordered(F.filter(F.transform(F.array(*[F.col(f"search_string_{x}") for x in ("en", "fr", "es", "pt")]), text.normalize_ws), lambda x: x != ""))
    return s.select("search_string", text.search_string(terms).alias("query"))


def language_terms(spark, d):
    s = read_table(spark, d, "search_strings")
    base = F.nullif(F.trim("search_string_en"), F.lit(""))
    cols = [F.coalesce(F.nullif(F.trim(f"search_string_{x}"), F.lit("")), base, F.lit("")).alias(x) for x in ("en", "fr", "es", "pt")]
    return s.select("search_string", *cols)


def normalise_key(spark, d):
    return read_table(spark, d, "rss_items").select("item_id", text.normalise_key(F.col("rss_title")).alias("key"))


def rfc822_parse(spark, d):
    r = read_table(spark, d, "rss_items")
    return r.select("item_id", F.coalesce(F.unix_seconds(text.rfc822_utc(F.col("rss_pubdate"))), F.lit(-1)).alias("at_s"))


def coalesce_names(spark, d):
    r = read_table(spark, d, "rss_items")
    return r.select("item_id", F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("source_domain", "source_url", "source_hint")], F.lit("")).alias("source"))


def extract_domain(spark, d):
    r = read_table(spark, d, "rss_items")
    return r.select("item_id", urls.extract_domain(F.col("google_news_redirect_url")).alias("host"), urls.extract_domain(F.col("source_url")).alias("source_host"))


def canonicalize_url(spark, d):
    # distinct URLs are rewritten once and mapped back by the caller
    u = read_table(spark, d, "rss_items").select(F.col("google_news_redirect_url").alias("url")).where("url IS NOT NULL").distinct()
    return urls.with_canonical_url(u, "url", "canonical_url")


def wrapper_id(spark, d):
    return read_table(spark, d, "rss_items").select("item_id", urls.wrapper_id(F.col("google_news_redirect_url")).alias("wrapper"))


def url_params(spark, d):
    r = read_table(spark, d, "rss_items")
    return r.select("item_id", *[urls.url_param(F.col("google_rss_url"), p).alias(p) for p in ("q", "hl", "gl")])


def article_key(spark, d):
    r = read_table(spark, d, "rss_items")
    return r.select("item_id", urls.article_key(F.col("guid"), F.col("google_news_redirect_url"), F.col("rss_title"), F.col("rss_pubdate"), F.col("source_domain")).alias("article_key"))


def throttle_flag(spark, d):
    p = read_table(spark, d, "page_texts")
    return p.select("page_id", html.throttled(F.col("status"), F.col("final_url"), F.col("full_text")).alias("throttled"))


def consent_flag(spark, d):
    p = read_table(spark, d, "page_texts")
    t = F.lower(F.coalesce("full_text", F.lit("")))
    return p.select("page_id", (t.contains("cookies") & t.contains("policy")).alias("consent"))


def regexp_count_tags(spark, d):
    r = read_table(spark, d, "rss_items")
    return r.select("item_id", F.regexp_count(F.coalesce("rss_description", F.lit("")), F.lit("<a ")).cast("bigint").alias("links"))


def html_to_text(spark, d):
    r = read_table(spark, d, "rss_items")
    return r.select("item_id", html.html_to_text("rss_description").alias("plain"))


def page_metadata(spark, d):
    r = read_table(spark, d, "rss_items").where("rss_description IS NOT NULL")
    page = F.concat(F.lit("<html lang='"), F.col("language_code"), F.lit("'><head><title>"), F.col("source_hint"), F.lit("</title></head><body>"), F.col("rss_description"), F.lit("</body></html>"))
    f = html.page_fields(page, F.col("source_url"))
    return r.select("item_id", f.alias("f")).select("item_id", "f.page_title", "f.language", "f.canonical_url")


def parse_llm_json(spark, d):
    e = read_table(spark, d, "events")
    label = F.element_at(F.array(F.lit("relevant"), F.lit("irrelevant"), F.lit("unsure"), F.lit("maybe")), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    raw = F.when(F.pmod("event_id", F.lit(7)) == 0, F.lit("")).when(F.pmod("event_id", F.lit(11)) == 0, F.lit("{broken")).otherwise(
        F.concat(F.lit('Answer: {"label": "'), label, F.lit('", "confidence": '), (F.col("event_id") % 13 / 10).cast("string"), F.lit(', "rationale": "r"} end')))
    a = model_output.strict_answer(raw)
    return e.select("event_id", a.alias("a")).select("event_id", "a.label", "a.confidence", "a.rationale", "a.error")


def label_action(spark, d):
    a = parse_llm_json(spark, d)
    return a.groupBy(text.label_action(F.col("label")).alias("action")).agg(F.count(F.lit(1)).alias("n"))


def explode_props(spark, d):
    e = read_table(spark, d, "events")
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


def pair_counts(spark, d):
    """Words of titles that occur in most titles, as sorted text."""
    r = read_table(spark, d, "rss_items").select(F.explode(text.token_set(F.col("rss_title"))).alias("word"))
    return r.groupBy("word").agg(F.count(F.lit(1)).alias("titles")).where("titles >= 10")


QUERIES = {
    f.__name__: f
    for f in (
        normalize_ws, content_hash, slugify, title_key, prompt_tokens, truncate_text, model_text, token_set, min_words, first_token, split_dedupe_terms,
        search_string, language_terms, normalise_key, rfc822_parse, coalesce_names, extract_domain, canonicalize_url, wrapper_id, url_params, article_key,
        throttle_flag, consent_flag, regexp_count_tags, html_to_text, page_metadata, parse_llm_json, label_action, explode_props,
    )
} | {"word_titles": pair_counts}

_TITLE = "coalesce(rss_title, '')"
_SLUG = "trim(regexp_replace(lower(trim(" + _TITLE + ")), '[^0-9a-z]+', '_', 'g'), '_')"
_TOK = "list_sort(list_distinct(regexp_extract_all(lower(" + _TITLE + "), '[a-z0-9]+')))"
_HOST = r"""regexp_replace(trim(lower(CASE WHEN {t} NOT LIKE '%://%' AND {t} LIKE '%.%' AND {t} NOT LIKE '%/%' THEN {t}
  ELSE regexp_extract({t}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1) END), '.'), '^www\.', '')"""
_TERMS = "list_filter(list_transform(string_split_regex(coalesce(authors, ''), '[;,|]'), lambda x: " + _nws("x") + "), lambda x: x <> '')"
_FIRSTS = "list_filter({l}, lambda x, i: NOT list_contains(list_transform({l}[1:i-1], lambda y: lower(y)), lower(x)))"
_LABEL = "['relevant','irrelevant','unsure','maybe'][event_id % 4 + 1]"
_ANSWERS = f"""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'empty_response' WHEN event_id % 11 = 0 THEN 'invalid_json'
  WHEN event_id % 4 = 3 THEN 'invalid_label' END AS error, {_LABEL} AS l, (event_id % 13) / 10.0 AS c FROM events"""

ORACLE = {
    "normalize_ws": f"SELECT doc_id, {_nws('text')} AS clean FROM documents",
    "content_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents",
    "slugify": f"""SELECT item_id, CASE WHEN length(s) <= 72 THEN s ELSE left(s, 61) || '_' || left(sha256({_TITLE}), 10) END AS slug
FROM (SELECT item_id, rss_title, CASE WHEN {_SLUG} = '' THEN 'item' ELSE {_SLUG} END AS s FROM rss_items)""",
    "title_key": f"SELECT item_id, trim(regexp_replace(lower({_TITLE}), '[^0-9a-z]+', ' ', 'g')) AS key FROM rss_items",
    "prompt_tokens": "SELECT doc_id, (CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, length(text) // 4) END)::BIGINT AS tokens FROM documents",
    "truncate_text": f"SELECT doc_id, left({_nws('text')}, 280) AS short FROM documents",
    "model_text": f"""SELECT article_id, m AS model_text, len(list_filter(string_split({_nws('m')}, ' '), lambda x: x <> ''))::BIGINT AS model_words FROM (
  SELECT article_id, CASE WHEN t <> '' AND b <> '' THEN t || chr(10) || chr(10) || b WHEN t <> '' THEN t ELSE b END AS m FROM (
    SELECT article_id, {_nws('page_title')} AS t,
      array_to_string(list_filter(string_split({_nws('full_text')}, ' '), lambda x: x <> '')[1:900], ' ') AS b FROM fulltext))""",
    "token_set": f"SELECT item_id, array_to_string({_TOK}, ' ') AS tokens FROM rss_items",
    "min_words": f"""SELECT * FROM (SELECT article_id, len(list_filter(string_split({_nws('full_text')}, ' '), lambda x: x <> ''))::BIGINT AS words FROM fulltext) WHERE words >= 120""",
    "first_token": "SELECT article_id, trim(string_split_regex(coalesce(authors, ''), '[;,|/]')[1]) AS first_author FROM fulltext",
    "split_dedupe_terms": f"SELECT article_id, array_to_string({_FIRSTS.format(l=_TERMS)}, ' | ') AS authors FROM fulltext",
    "search_string": f"""WITH t AS (SELECT search_string, list_filter(list_transform([search_string_en, search_string_fr, search_string_es, search_string_pt], lambda x: {_nws('x')}), lambda x: x <> '') AS l FROM search_strings)
SELECT search_string, array_to_string(list_transform({_FIRSTS.format(l='l')}, lambda x: '"' || replace(x, '"', '') || '"'), ' OR ') AS query FROM t""",
    "language_terms": "SELECT search_string, "
    + ", ".join(f"coalesce(nullif(trim(search_string_{x}), ''), nullif(trim(search_string_en), ''), '') AS {x}" for x in ("en", "fr", "es", "pt"))
    + " FROM search_strings",
    "normalise_key": f"""SELECT item_id, lower({_nws("translate(rss_title, '‘’‛′“”«»', '''''''''\"\"\"\"')")}) AS key FROM rss_items""",
    "rfc822_parse": r"""WITH t AS (SELECT item_id, regexp_replace(trim(coalesce(rss_pubdate, '')), '^[A-Za-z]{3},\s*', '') AS t FROM rss_items)
SELECT item_id, coalesce(epoch(try_strptime(t, '%-d %b %Y %H:%M:%S %z')), epoch(try_strptime(regexp_replace(t, ' (GMT|UTC)$', ' +0000'), '%-d %b %Y %H:%M:%S %z')), -1)::BIGINT AS at_s FROM t""",
    "coalesce_names": "SELECT item_id, coalesce(nullif(trim(source_domain), ''), nullif(trim(source_url), ''), nullif(trim(source_hint), ''), '') AS source FROM rss_items",
    "extract_domain": f"""WITH n AS (SELECT item_id, {_nws('google_news_redirect_url')} AS g, {_nws('source_url')} AS s FROM rss_items)
SELECT item_id, {_HOST.format(t='g')} AS host, {_HOST.format(t='s')} AS source_host FROM n""",
    "canonicalize_url": rf"""WITH u AS (SELECT DISTINCT google_news_redirect_url AS url, {_nws('google_news_redirect_url')} AS t FROM rss_items WHERE google_news_redirect_url IS NOT NULL),
p AS (SELECT url, lower(regexp_extract(t, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(t, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host,
  regexp_extract(t, '^[A-Za-z]+://[^/?#:]*:([0-9]+)', 1) AS port, regexp_extract(t, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(t, '\?([^#]*)', 1) AS query FROM u),
q AS (SELECT *, regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') AS pa,
  list_sort(list_filter(list_transform(string_split(query, '&'), lambda x: url_encode(url_decode(regexp_extract(x, '^([^=]*)', 1))) || '=' || url_encode(url_decode(regexp_extract(x, '^[^=]*=(.*)$', 1)))),
    lambda x: x <> '=' AND NOT regexp_matches(x, '^(?i)(utm_[^=]*|gclid|fbclid|ref|spm|cmpid)='))) AS ps FROM p)
SELECT url, CASE WHEN scheme IN ('http', 'https') AND host <> '' THEN scheme || '://' || host ||
  (CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END) ||
  (CASE WHEN pa = '' THEN '/' ELSE pa END) || (CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END) END AS canonical_url FROM q""",
    "wrapper_id": "SELECT item_id, regexp_extract(coalesce(google_news_redirect_url, ''), '/(?:rss/+)?articles/([^/?#]+)', 1) AS wrapper FROM rss_items",
    "url_params": "SELECT item_id, " + ", ".join(f"regexp_extract(coalesce(google_rss_url, ''), '[?&]{p}=([^&#]*)', 1) AS {p}" for p in ("q", "hl", "gl")) + " FROM rss_items",
    "article_key": """SELECT item_id, sha256(coalesce(nullif(trim(guid, ' '), ''), nullif(trim(google_news_redirect_url, ' '), ''),
  coalesce(rss_title, '') || '||' || coalesce(rss_pubdate, '') || '||' || coalesce(source_domain, ''))) AS article_key FROM rss_items""",
    "throttle_flag": r"""SELECT page_id, (coalesce(status IN (429, 503), false) OR regexp_matches(coalesce(final_url, '') || chr(10) || left(coalesce(full_text, ''), 4000),
  '(?i)<title>\s*sorry|unusual traffic from your computer network|our systems have detected unusual traffic|/sorry/|to continue, please type the characters below|detected unusual traffic|captcha')) AS throttled FROM page_texts""",
    "consent_flag": "SELECT page_id, (lower(coalesce(full_text, '')) LIKE '%cookies%' AND lower(coalesce(full_text, '')) LIKE '%policy%') AS consent FROM page_texts",
    "regexp_count_tags": "SELECT item_id, len(regexp_extract_all(coalesce(rss_description, ''), '<a '))::BIGINT AS links FROM rss_items",
    "parse_llm_json": f"""SELECT event_id, CASE WHEN error IS NULL THEN l END AS label, CASE WHEN error IS NULL THEN least(c, 1.0)::DOUBLE END AS confidence,
  CASE WHEN error IS NULL THEN 'r' END AS rationale, error FROM ({_ANSWERS})""",
    "label_action": f"""SELECT CASE WHEN error IS NULL AND l = 'relevant' THEN 'keep' WHEN error IS NULL AND l = 'irrelevant' THEN 'drop' ELSE 'review' END AS action, count(*)::BIGINT AS n FROM ({_ANSWERS}) GROUP BY 1""",
    "explode_props": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "word_titles": f"SELECT word, count(*)::BIGINT AS titles FROM (SELECT unnest({_TOK}) AS word FROM rss_items) GROUP BY 1 HAVING count(*) >= 10",
}
