"""Queries over feed addresses, links, manifests, requests to models and the state of their batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.functions import links, text
from presswork.functions.text import normalize_ws
from presswork.operators import answers, dedupe, state, windows
from presswork.plans.analysis_queries import MODELS, _V, _votes
from presswork.plans.table_queries import _CASCADE, _cascade_parts
from presswork.session import read_table
from presswork.sources.readers import preferred_column


def _strings(spark, d):
    return read_table(spark, d, "search_strings").where("trim(search_string) <> ''").select(F.trim("search_string").alias("search_string")).distinct()


def feed_urls(spark, d):
    """Addresses of the first coarse window for every search string and locale."""
    loc = read_table(spark, d, "locales").select("id", "lang", "country")
    one = state.cross_manifest(_strings(spark, d), loc)
    url = links.search_feed_url(F.concat(F.lit('"'), "search_string", F.lit('"')), F.to_date(F.lit("2005-01-01")), F.to_date(F.lit("2009-12-31")), F.col("lang"), F.col("country"))
    return one.select("search_string", "id", url.alias("url"))


def daily_feed_urls(spark, d):
    """One address per day of a long period and locale, as a daily scan asks for."""
    loc = read_table(spark, d, "locales").select("id", "lang", "country")
    days = loc.select("*", F.explode(F.sequence(F.to_date(F.lit("2010-01-01")), F.to_date(F.lit("2025-12-31")))).alias("day"))
    return days.select("id", F.col("day").cast("string"), links.search_feed_url(F.lit("pest outbreak"), F.col("day"), F.col("day"), F.col("lang"), F.col("country")).alias("url"))


def country_feed_urls(spark, d):
    """One address per country code, each once."""
    codes = read_table(spark, d, "locales").groupBy("country").agg(F.min("lang").alias("lang"))
    none = F.lit(None).cast("date")
    return codes.select("country", links.search_feed_url(F.lit("pest outbreak"), none, none, F.col("lang"), F.col("country")).alias("url"))


def distinct_links(spark, d):
    """Items with the first of each link, by the first link column that the table has; items without one are left out."""
    r = read_table(spark, d, "rss_items")
    link = preferred_column(r, ["link", "item_link", "google_news_redirect_url", "source_url"])
    slim = r.select("item_id", F.nullif(F.trim(link), F.lit("")).alias("link"))
    return dedupe.first_per_key(slim, F.col("link"), [F.col("item_id")], keep_missing=False).select("item_id")


def variant_requests(spark, d):
    """Country and header of a request for every language variant, beside the others of its language."""
    v = read_table(spark, d, "locales").select("id", F.split("id", "_")[0].alias("lang"), F.concat_ws("-", F.split("id", "_")[0], F.upper(F.split("id", "_")[1])).alias("variant"))
    # a fixed table of locales: the variants of a language are a few
    all_of = v.groupBy("lang").agg(F.array_sort(F.collect_set("variant")).alias("variants"))
    j = v.join(all_of, "lang")
    return j.select("id", links.variant_country(F.col("variant")).alias("country"), links.accept_language(F.col("lang"), F.col("variant"), F.col("variants")).alias("accept_language"))


def response_locales(spark, d):
    """Locale that each feed address of the items asks for."""
    u = read_table(spark, d, "rss_items").select(links.response_locale(F.col("google_rss_url")).alias("r"))
    return u.groupBy(F.col("r.hl").alias("hl"), F.col("r.gl").alias("gl"), F.col("r.ceid").alias("ceid")).agg(F.count(F.lit(1)).alias("n"))


def link_resolution(spark, d):
    """Where each item's link leads, and how that is known; this data has no online answers."""
    r = read_table(spark, d, "rss_items").select("item_id", F.coalesce("google_news_redirect_url", F.lit("")).alias("u"))
    none = F.lit(None).cast("string")
    return r.select("item_id", links.resolved_link(F.col("u"), none, none).alias("r")).groupBy("r.method").agg(F.count(F.lit(1)).alias("n"))


def url_fallback(spark, d):
    """The first address an article has, from the best source to the last."""
    f = read_table(spark, d, "fulltext")
    pick = links.first_filled(canonical_url=F.col("canonical_url"), final_url=F.col("final_url"), google_news_redirect_url=F.col("google_news_redirect_url"))
    return f.select("article_id", pick.alias("p")).select("article_id", F.col("p.value").alias("url"), F.col("p.chosen").alias("chosen"))


def iso_instants(spark, d):
    """Lenient reading of publication dates."""
    f = read_table(spark, d, "fulltext")
    return f.select("article_id", F.coalesce(F.unix_seconds(links.lenient_instant(F.col("published_at"))), F.lit(-1)).alias("published_s"))


def consent_pages(spark, d):
    return read_table(spark, d, "page_texts").groupBy(links.consent_page(F.col("final_url"), F.col("full_text")).alias("consent")).agg(F.count(F.lit(1)).alias("n"))


def cached_fetches(spark, d):
    """Each record's page from the fetches that are there: the latest one; records without one are still to fetch."""
    r = read_table(spark, d, "fulltext").select("record_id").distinct()
    p = read_table(spark, d, "page_texts").select("record_id", "page_id", "status", "fetched_at")
    last = p.groupBy("record_id").agg(F.max_by("status", F.struct("fetched_at", "page_id")).alias("status"))
    j = r.join(last.withColumn("had", F.lit(True)), "record_id", "left")
    out = F.when(F.col("had").isNull(), "not_fetched").when(F.col("status") >= 400, "failed").otherwise("fetched")
    return j.groupBy(out.alias("fetch_status")).agg(F.count(F.lit(1)).alias("records"))


def problem_hosts(spark, d):
    """Items whose address is on none of the hosts that spoil a run."""
    r = read_table(spark, d, "rss_items")
    bad = r"(?i)gazette\.example|courier\.example|heraldo"
    return r.where(~F.coalesce(F.col("source_url"), F.lit("")).rlike(bad)).select("item_id")


def manifest_rows(spark, d):
    """New manifest rows of every search string, locale and window, with slug, days and the path of their answer."""
    loc = read_table(spark, d, "locales")
    w = spark.createDataFrame([("2020-01-01", "2020-01-30"), ("2020-01-31", "2020-02-29")], "window_start string, window_end string")
    m = state.new_manifest("human", "en", _strings(spark, d), loc, w)
    return m.select("locale_id", "query_slug", "window_start", "window_days", "window_role", "status", "cached_path")


def manifest_load(spark, d):
    """A stored manifest with what its rows lack, and the planned rows it does not have."""
    m = read_table(spark, d, "manifest").where("locale_id IN ('en_us', 'fr_fr')")
    keys = state.MANIFEST_KEYS
    default = m.where("window_role = 'coarse'").groupBy(*keys).agg(F.lit("pending").alias("status"), F.lit("0").alias("attempts"))
    extra = default.withColumn("window_end", F.lit("2030-01-01"))
    out = state.load_manifest(default.unionByName(extra).distinct(), m.groupBy(*keys).agg(F.max("status").alias("status"), F.max("attempts").alias("attempts")), keys, ["status", "attempts"])
    return out.groupBy("locale_id", "window_role", "status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("try_cast(attempts AS bigint)")).alias("attempts"))


def manifest_order(spark, d):
    """Position of each manifest row in the order of work: coarse windows first, then by locale, string and window."""
    m = read_table(spark, d, "manifest").select("locale_id", "search_string", "window_start", "window_end", "window_role", F.expr("try_cast(window_days AS int)").alias("days"))
    rank = windows.stage_rank(windows.role_stage(F.col("window_role"), F.col("days")))
    m = m.withColumn("stage_rank", rank)
    order = [F.col(c) for c in ("stage_rank", "locale_id", "search_string", "window_start", "window_end", "window_role", "days")]
    return state.global_rank(m, order).select("rn", "stage_rank", "locale_id", "search_string", "window_start")


def scan_summary(spark, d):
    """The summary of every manifest row: entries by fallback, bucket by the threshold, what to do next, stage."""
    m = read_table(spark, d, "manifest")
    return windows.scan_summary(m).select("locale_id", "search_string", "window_start", "stage_label", "stage_rank", F.coalesce("entry_count", F.lit(-1)).alias("entry_count"), "threshold_bucket", "next_action")


def completed_windows(spark, d):
    return read_table(spark, d, "manifest").where(F.col("status").isin("success", "empty")).groupBy("pathogen_domain", "locale_id").agg(F.count(F.lit(1)).alias("windows"))


def leaf_metrics(spark, d):
    """Items of completed windows whose answer is there, through the cascade; windows without an answer are counted."""
    done = read_table(spark, d, "manifest").where(F.col("status").isin("success", "empty"))
    paths = done.where("trim(cached_path) <> ''").select("cached_path").distinct()
    items = read_table(spark, d, "rss_items").join(paths, "cached_path", "left_semi")
    passes, order = _cascade_parts()
    m = dedupe.cascade_metrics(dedupe.cascade_flags(items, "item_id", passes, order), [n for n, _ in passes])
    missing = done.where("cached_path IS NULL OR trim(cached_path) = ''").agg(F.lit("missing_cache").alias("metric"), F.count(F.lit(1)).alias("value"))
    return m.unionByName(missing)


def log_runs(spark, d):
    """Runs of a log by their markers: a start opens a run, its end closes it; what lies outside belongs to none."""
    e = read_table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    runs = windows.marked_runs(e, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "purchase", F.col("event_type") == "error")
    return runs.select("user_id", "run_no", F.unix_seconds(F.col("started").cast("timestamp")).alias("started_s"), F.unix_seconds(F.col("ended").cast("timestamp")).alias("ended_s"), "warnings")


_TEMPLATE = "Judge this item.\nDomain: {domain}\nSearch: {search}\nHeadline: {title}\nSummary: {summary}\nSource: {source}\n"


def _item_prompt():
    return answers.prompt(_TEMPLATE, domain=F.col("pathogen_domain"), search=F.col("search_string"), title=F.col("rss_title"), summary=F.col("rss_description_text"), source=F.col("source_hint"))


def headline_prompts(spark, d):
    return read_table(spark, d, "rss_items").select("item_id", F.md5(_item_prompt()).alias("prompt_hash"), text.prompt_tokens(_item_prompt()).alias("tokens"))


def request_bodies(spark, d):
    """Request lines for titles in the layout of chat completions."""
    r = read_table(spark, d, "rss_items")
    body = answers.request_body("chat", F.concat(F.lit("r"), "item_id"), F.lit("Be strict."), F.translate(normalize_ws(F.col("rss_title")), '"\\', "''"), "labeller-1", 200)
    return r.select("item_id", body.alias("line"))


def request_bodies_other(spark, d):
    """The same in the other layout."""
    r = read_table(spark, d, "rss_items")
    body = answers.request_body("messages", F.concat(F.lit("r"), "item_id"), F.lit("Be strict."), F.translate(normalize_ws(F.col("rss_title")), '"\\', "''"), "labeller-2", 200, 0.5)
    return r.select("item_id", body.alias("line"))


def pending_rows(spark, d):
    """Articles without a final action whose state is not active."""
    f = read_table(spark, d, "fulltext")
    batch_state = F.element_at(F.array(F.lit("in_progress"), F.lit("completed"), F.lit(""), F.lit("ended"), F.lit("canceling")), (F.pmod("article_id", F.lit(5)) + 1).cast("int"))
    return f.where(answers.needs_submission(F.when(F.pmod("article_id", F.lit(3)) == 0, F.col("final_action")), batch_state)).select("article_id")


def batch_hydrate(spark, d):
    """State of articles after the results of their batches, joined on batch and custom id."""
    f = read_table(spark, d, "fulltext").select("article_id")
    st = f.select(F.concat(F.lit("a"), "article_id").alias("custom_id"), F.concat(F.lit("b"), F.pmod("article_id", F.lit(4))).alias("batch_id"), F.lit("").alias("headline_label"))
    batches = spark.createDataFrame([("b0", "ended"), ("b1", "in_progress"), ("b2", "failed")], "batch_id string, status string")
    raw = F.when(F.pmod("article_id", F.lit(5)) == 0, '{"label": "maybe"}').otherwise('{"label": "Relevant", "confidence": 0.75}')
    ok = F.pmod("article_id", F.lit(7)) != 0
    res = f.where("article_id % 3 <> 0").select(
        F.concat(F.lit("b"), F.pmod("article_id", F.lit(4))).alias("batch_id"), F.concat(F.lit("a"), "article_id").alias("custom_id"), ok.alias("success"), raw.alias("raw_text"), F.lit("http  500").alias("error"))
    out = answers.hydrate(st, batches, res)
    return out.groupBy("batch_id", "headline_label", "headline_parse_error", "classification_error", "batch_state").agg(F.count(F.lit(1)).alias("n"))


def batch_names(spark, d):
    """Request batches with their sequential names."""
    r = read_table(spark, d, "rss_items").select("dataset_key", "item_id")
    c = state.chunk_by_count(r, "dataset_key", [F.col("item_id")], 250)
    return c.groupBy(state.chunk_name(F.col("dataset_key"), F.col("chunk_no")).alias("batch_name")).agg(F.count(F.lit(1)).alias("requests"), F.min("item_id").alias("first_item"))


def active_tokens(spark, d):
    """Prompt tokens of the batches under way, per source."""
    t = read_table(spark, d, "documents").select("doc_id", "source", text.prompt_tokens(F.col("text")).alias("tokens"))
    st = answers.batch_status(F.element_at(F.array(F.lit("in_progress"), F.lit("ended"), F.lit("validating")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")))
    return t.where(st.isin(answers.ACTIVE)).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("requests"))


def batch_rows_fitted(spark, d):
    """Answers cut or filled to the rows that each request expects."""
    p = read_table(spark, d, "part")
    sizes = p.select("p_brand", "p_size").distinct().groupBy("p_brand").agg(F.array_sort(F.collect_list("p_size")).alias("s"))
    got = sizes.select("p_brand", F.posexplode("s").alias("pos", "value")).select("p_brand", (F.col("pos") + 1).alias("row_no"), "value")
    out = answers.fit_rows(sizes.select("p_brand", F.lit(40).alias("expected")), got, "p_brand", "expected", "value")
    return out.select("p_brand", F.col("row_no").cast("bigint").alias("row_no"), F.coalesce(F.col("value").cast("bigint"), F.lit(-1)).alias("value"))


def degenerate_batches(spark, d):
    r = read_table(spark, d, "rss_items").select("dataset_key", "item_id", "source_hint", "guid")
    c = state.chunk_by_count(r, "dataset_key", [F.col("item_id")], 250).withColumn("batch", F.concat_ws("-", "dataset_key", "chunk_no"))
    return answers.degenerate_tail(c, "batch", "rn", F.when(F.col("guid").isNull(), 0.0).otherwise(0.5), F.col("source_hint"), F.lit("Other"))


def clean_descriptions(spark, d):
    r = read_table(spark, d, "rss_items").select("item_id", answers.clean_description(F.col("rss_title")).alias("short"))
    return r


def probability_semantics(spark, d):
    """Probabilities of votes under the three meanings of their confidence."""
    v = _votes(spark, d)
    cols = [F.round(answers.relevance_probability(F.col("vote"), F.col("p"), s), 6).alias(s) for s in ("auto", "decision_confidence", "relevance_probability")]
    return v.select("item", "alias", *cols)


def quality_gate(spark, d):
    """Reasons for which rationales are refused; they are put together from the items' titles."""
    r = read_table(spark, d, "rss_items")
    rationale = F.concat(
        F.when(F.pmod("item_id", F.lit(9)) != 0, F.concat(F.lit("["), "pathogen_domain", F.lit("] "))).otherwise(""), F.coalesce("rss_title", F.lit("")),
        F.when(F.pmod("item_id", F.lit(7)) != 0, F.concat(F.lit("; linkage: "), F.coalesce("search_string", F.lit("")))).otherwise(""))
    spans = F.when(F.col("source_hint").isNotNull(), F.array("source_hint"))
    reason = answers.rationale_reason(rationale, F.pmod("item_id", F.lit(2)) == 0, spans, ["peste", "fever", "virus", "gripe"])
    return r.select("item_id", reason.alias("reason"))


def complete_rows(spark, d):
    """Documents whose row is complete over all models."""
    v = _votes(spark, d)
    wide = v.groupBy("item").agg(*[F.max(F.when((F.col("alias") == m) & (F.col("p") >= 0.1), F.col("vote").cast("string"))).alias(m) for m in MODELS])
    errors = [F.when(F.pmod("item", F.lit(4)) == 0, F.lit("timeout")) for _ in MODELS]
    done = answers.complete_row(F.when(F.pmod("item", F.lit(11)) != 0, F.lit("relevant")), [F.col(m) for m in MODELS], errors)
    return wide.where(done).select("item")


def distinct_votes(spark, d):
    """How many different answers each document got, a missing one counting as one."""
    v = _votes(spark, d)
    wide = v.groupBy("item").agg(*[F.max(F.when((F.col("alias") == m) & (F.col("p") >= 0.1), F.col("vote").cast("string"))).alias(m) for m in MODELS])
    return wide.select(F.size(F.array_distinct(F.array(*MODELS))).alias("answers")).groupBy("answers").agg(F.count(F.lit(1)).alias("items"))


def rows_as_json(spark, d):
    n = read_table(spark, d, "nation")
    return n.select("n_nationkey", F.to_json(F.struct("n_name", "n_regionkey", F.struct(F.col("n_nationkey").alias("key")).alias("nested"))).alias("doc"))


def kept_headlines(spark, d):
    """Articles whose label is kept, valid successes among them, and those ready for a topic model."""
    f = read_table(spark, d, "fulltext")
    valid = state.valid_success(F.col("fetch_status"), F.col("full_text"), F.col("content_hash"), F.col("word_count"))
    ready = text.model_ready(F.col("full_text"), F.col("word_count"))
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).cast("bigint")
    keep = F.col("final_action") == "keep"
    return f.agg(one(keep).alias("kept"), one(keep & valid).alias("kept_valid"), one(valid).alias("valid"), one(ready).alias("ready"))


def sorted_outlets(spark, d):
    """Positions of outlets in the final alphabetical order."""
    r = read_table(spark, d, "domains_removed").select(F.lower(F.trim("domain")).alias("domain")).where("domain <> ''").distinct()
    return state.global_rank(r, [F.col("domain")]).select("rn", "domain")


def topic_subset(spark, d):
    return state.select_rows(_strings(spark, d), "search_string", [r[0] for r in _strings(spark, d).orderBy("search_string").limit(3).collect()])


QUERIES = {
    f.__name__: f
    for f in (
        feed_urls, daily_feed_urls, country_feed_urls, distinct_links, variant_requests, response_locales, link_resolution, url_fallback, iso_instants, consent_pages, cached_fetches,
        problem_hosts, manifest_rows, manifest_load, manifest_order, scan_summary, completed_windows, leaf_metrics, log_runs, headline_prompts, request_bodies, request_bodies_other,
        pending_rows, batch_hydrate, batch_names, active_tokens, batch_rows_fitted, degenerate_batches, clean_descriptions, probability_semantics, quality_gate, complete_rows,
        distinct_votes, rows_as_json, kept_headlines, sorted_outlets, topic_subset,
    )
}

_WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"


def _nws(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{_WS}', ' ', 'g'))"


_S = "(SELECT DISTINCT trim(search_string, ' ') AS search_string FROM search_strings WHERE trim(search_string, ' ') <> '')"
_ENC = "replace(url_encode({x}), '%20', '+')"
_LOC = "'&ceid=' || country || ':' || lang || '&hl=' || lang || '&gl=' || country"
_BASE = f"'{links.FEED_BASE}/search?q='"
_SLUG = "CASE WHEN s0 = '' THEN 'item' ELSE s0 END"
_ROLE = "coalesce(nullif(trim(window_role), ''), 'species_scan')"
_STAGE = f"CASE {_ROLE} WHEN 'species_scan' THEN 'whole_period' WHEN 'coarse_period' THEN '5_year' ELSE (CASE WHEN days <= 1 THEN '1_day' WHEN days <= 3 THEN '3_day' WHEN days <= 7 THEN '7_day' WHEN days <= 14 THEN '14_day' ELSE '30_day' END) END"
_RANK = f"CASE {_ROLE} WHEN 'species_scan' THEN 0 WHEN 'coarse_period' THEN 1 ELSE (CASE WHEN days <= 1 THEN 6 WHEN days <= 3 THEN 5 WHEN days <= 7 THEN 4 WHEN days <= 14 THEN 3 ELSE 2 END) END"
_PROMPT = "'Judge this item.' || chr(10) || 'Domain: ' || {d} || chr(10) || 'Search: ' || {s} || chr(10) || 'Headline: ' || {t} || chr(10) || 'Summary: ' || {m} || chr(10) || 'Source: ' || {h} || chr(10)".format(
    **{k: f"coalesce(nullif({_nws(c)}, ''), '[missing]')" for k, c in {"d": "pathogen_domain", "s": "search_string", "t": "rss_title", "m": "rss_description_text", "h": "source_hint"}.items()}
)
_USER = f"translate({_nws('rss_title')}, '\"\\', '''''')"
_WIDE = ", w AS (SELECT item, " + ", ".join(f"max(vote::VARCHAR) FILTER (alias = '{m}' AND p >= 0.1) AS {m}" for m in MODELS) + " FROM votes GROUP BY 1)"

ORACLE = {
    "feed_urls": f"""SELECT search_string, id, {_BASE} || {_ENC.format(x="'\"' || search_string || '\" after:2005-01-01 before:2010-01-01'")} || {_LOC} AS url FROM {_S} CROSS JOIN locales""",
    "daily_feed_urls": f"""SELECT id, day::VARCHAR AS day, {_BASE} || {_ENC.format(x="'pest outbreak after:' || day || ' before:' || (day + 1)")} || {_LOC} AS url
FROM (SELECT *, unnest(generate_series(DATE '2010-01-01', DATE '2025-12-31', INTERVAL 1 DAY))::DATE AS day FROM locales)""",
    "country_feed_urls": f"SELECT country, {_BASE} || 'pest+outbreak' || {_LOC} AS url FROM (SELECT country, min(lang) AS lang FROM locales GROUP BY 1)",
    "distinct_links": "SELECT min(item_id) AS item_id FROM rss_items WHERE trim(google_news_redirect_url, ' ') <> '' GROUP BY trim(google_news_redirect_url, ' ')",
    "variant_requests": """WITH v AS (SELECT id, string_split(id, '_')[1] AS lang, string_split(id, '_')[1] || '-' || upper(string_split(id, '_')[2]) AS variant FROM locales),
o AS (SELECT a.id, a.lang, a.variant, b.variant AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.variant) AS n FROM v a JOIN (SELECT DISTINCT lang, variant FROM v) b ON a.lang = b.lang AND a.variant <> b.variant),
s AS (SELECT id, string_agg(other || ';q=' || printf('%.1f', greatest(0.4, 1.0 - 0.1 * n)), ',' ORDER BY n) AS others FROM o GROUP BY 1)
SELECT v.id, upper(string_split(v.id, '_')[2]) AS country, variant || coalesce(',' || others, '') || CASE WHEN lang <> 'en' THEN ',en;q=0.3' ELSE '' END AS accept_language FROM v LEFT JOIN s ON s.id = v.id""",
    "response_locales": """SELECT url_decode(coalesce(regexp_extract(u, '[?&]hl=([^&#]*)', 1), '')) AS hl, url_decode(coalesce(regexp_extract(u, '[?&]gl=([^&#]*)', 1), '')) AS gl, url_decode(coalesce(regexp_extract(u, '[?&]ceid=([^&#]*)', 1), '')) AS ceid,
  count(*)::BIGINT AS n FROM (SELECT trim(coalesce(google_rss_url, '')) AS u FROM rss_items) GROUP BY 1, 2, 3""",
    "link_resolution": "SELECT 'not_wrapper' AS method, count(*)::BIGINT AS n FROM rss_items WHERE NOT regexp_matches(coalesce(google_news_redirect_url, ''), '^(?i)https?://([^/?#]*\\.)?news\\.google\\.')",
    "url_fallback": """SELECT article_id, trim(coalesce(nullif(trim(canonical_url), ''), nullif(trim(final_url), ''), nullif(trim(google_news_redirect_url), ''))) AS url,
CASE WHEN trim(canonical_url) <> '' THEN 'canonical_url' WHEN trim(final_url) <> '' THEN 'final_url' WHEN trim(google_news_redirect_url) <> '' THEN 'google_news_redirect_url' END AS chosen FROM fulltext""",
    "iso_instants": r"""SELECT article_id, coalesce(CASE WHEN regexp_matches(trim(published_at), '^\d{4}-\d\d-\d\d([T ].*)?$') THEN epoch(try_cast(CASE WHEN regexp_matches(trim(published_at), '[T ].*(Z|[+-]\d\d(:?\d\d)?)$') THEN trim(published_at) ELSE trim(published_at) || ' +00:00' END AS TIMESTAMPTZ))::BIGINT END, -1) AS published_s FROM fulltext""",
    "consent_pages": """SELECT contains(lower(coalesce(final_url, '')), 'consent.google.com') OR contains(lower(coalesce(full_text, '')), 'before you continue to google') OR
(contains(lower(coalesce(full_text, '')), 'g.co/privacytools') AND contains(lower(full_text), 'cookies and data') AND contains(lower(full_text), 'accept all') AND contains(lower(full_text), 'reject all')) AS consent, count(*)::BIGINT AS n FROM page_texts GROUP BY 1""",
    "cached_fetches": """WITH l AS (SELECT record_id, last(status ORDER BY fetched_at, page_id) AS status FROM page_texts GROUP BY 1), r AS (SELECT DISTINCT record_id FROM fulltext)
SELECT CASE WHEN l.record_id IS NULL THEN 'not_fetched' WHEN status >= 400 THEN 'failed' ELSE 'fetched' END AS fetch_status, count(*)::BIGINT AS records FROM r LEFT JOIN l ON r.record_id = l.record_id GROUP BY 1""",
    "problem_hosts": "SELECT item_id FROM rss_items WHERE source_url IS NULL OR (source_url NOT ILIKE '%gazette.example%' AND source_url NOT ILIKE '%courier.example%' AND source_url NOT ILIKE '%heraldo%')",
    "manifest_rows": f"""WITH w(window_start, window_end, window_days) AS (VALUES ('2020-01-01', '2020-01-30', '30'), ('2020-01-31', '2020-02-29', '30')),
s AS (SELECT search_string, trim(regexp_replace(lower(search_string), '[^0-9a-z]+', '_', 'g'), '_') AS s0 FROM {_S}),
q AS (SELECT CASE WHEN length({_SLUG}) <= 72 THEN {_SLUG} ELSE left(s0, 61) || '_' || left(sha256(search_string), 10) END AS query_slug FROM s)
SELECT id AS locale_id, query_slug, window_start, window_days, 'base' AS window_role, 'pending' AS status, 'data/raw/rss/human_en/' || id || '/' || query_slug || '/human_en_' || window_start || '_' || window_end || '.json' AS cached_path FROM q, locales, w""",
    "manifest_load": """WITH m AS (SELECT * FROM manifest WHERE locale_id IN ('en_us', 'fr_fr')),
ex AS (SELECT pathogen_domain, language_code, locale_id, request_lang, request_country, request_accept_language, search_string, window_start, window_end, window_role, max(status) AS status, max(attempts) AS attempts FROM m GROUP BY ALL),
co AS (SELECT DISTINCT pathogen_domain, language_code, locale_id, request_lang, request_country, request_accept_language, search_string, '2030-01-01' AS window_end, window_start, window_role FROM m WHERE window_role = 'coarse'),
u AS (SELECT locale_id, window_role, coalesce(nullif(trim(status), ''), CASE WHEN window_role = 'coarse' THEN 'pending' END) AS status, coalesce(nullif(trim(attempts), ''), CASE WHEN window_role = 'coarse' THEN '0' END) AS attempts FROM ex
  UNION ALL SELECT locale_id, window_role, 'pending', '0' FROM co)
SELECT locale_id, coalesce(nullif(trim(window_role), ''), 'hierarchical_child') AS window_role, status, count(*)::BIGINT AS n, sum(try_cast(attempts AS BIGINT))::BIGINT AS attempts FROM u GROUP BY 1, 2, 3""",
    "manifest_order": f"""WITH m AS (SELECT *, try_cast(window_days AS INTEGER) AS d0, coalesce(try_cast(window_days AS INTEGER), 0) AS days FROM manifest)
SELECT row_number() OVER (ORDER BY {_RANK}, locale_id NULLS FIRST, search_string NULLS FIRST, window_start NULLS FIRST, window_end NULLS FIRST, window_role NULLS FIRST, d0 NULLS FIRST)::BIGINT AS rn, {_RANK} AS stage_rank, locale_id, search_string, window_start FROM m""",
    "scan_summary": f"""WITH m AS (SELECT *, coalesce(try_cast(window_days AS INTEGER), 0) AS days, coalesce(try_cast(entry_count AS BIGINT), try_cast(split_trigger_entries AS BIGINT), CASE WHEN status = 'empty' THEN 0 END) AS n, coalesce(nullif(trim(window_role), ''), 'species_scan') AS r FROM manifest)
SELECT locale_id, search_string, window_start, {_STAGE} AS stage_label, {_RANK} AS stage_rank, coalesce(n, -1) AS entry_count,
CASE WHEN n IS NULL THEN 'unknown' WHEN n >= 100 THEN 'at_or_above_threshold' ELSE 'below_threshold' END AS threshold_bucket,
CASE WHEN status IN ('success', 'empty') THEN 'scrape_now' WHEN status = 'split' AND r = 'species_scan' THEN 'split_into_coarse_periods' WHEN status = 'split' THEN 'split_into_smaller_windows' WHEN status IN ('throttled', 'failed') THEN 'retry_needed' ELSE 'pending' END AS next_action FROM m""",
    "completed_windows": "SELECT pathogen_domain, locale_id, count(*)::BIGINT AS windows FROM manifest WHERE status IN ('success', 'empty') GROUP BY 1, 2",
    "leaf_metrics": _CASCADE.replace("FROM rss_items)", "FROM rss_items WHERE cached_path IN (SELECT cached_path FROM manifest WHERE status IN ('success', 'empty') AND trim(cached_path) <> ''))", 1)
    + """SELECT 'before_redirect_url' AS metric, count(*)::BIGINT AS value FROM a UNION ALL SELECT 'before_guid', count(*) FROM b2 UNION ALL SELECT 'before_title_pubdate', count(*) FROM c2 UNION ALL SELECT 'kept_rows', count(*) FROM e2
UNION ALL SELECT 'missing_cache', count(*) FROM manifest WHERE status IN ('success', 'empty') AND (cached_path IS NULL OR trim(cached_path) = '')""",
    "log_runs": """WITH e AS (SELECT *, sum((event_type = 'signup')::INT) OVER w AS run FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - (event_type = 'purchase')::INT AS closed FROM e WHERE run > 0)
SELECT user_id, run::BIGINT AS run_no, floor(epoch(min(ts)))::BIGINT AS started_s, floor(epoch(min(ts) FILTER (event_type = 'purchase')))::BIGINT AS ended_s, (count(*) FILTER (event_type = 'error'))::BIGINT AS warnings FROM f WHERE closed = 0
GROUP BY 1, 2 HAVING bool_or(event_type = 'purchase')""",
    "headline_prompts": f"WITH p AS (SELECT item_id, {_PROMPT} AS p FROM rss_items) SELECT item_id, md5(p) AS prompt_hash, greatest(1, length(p) // 4)::BIGINT AS tokens FROM p",
    "request_bodies": f"""SELECT item_id, '{{"custom_id":"r' || item_id || '","method":"POST","url":"/v1/chat/completions","body":{{"model":"labeller-1","response_format":{{"type":"json_object"}},"messages":[{{"role":"system","content":"Be strict."}},{{"role":"user","content":"'
|| {_USER} || '"}}],"max_tokens":200,"temperature":0.0}}}}' AS line FROM rss_items""",
    "request_bodies_other": f"""SELECT item_id, '{{"custom_id":"r' || item_id || '","params":{{"model":"labeller-2","max_tokens":200,"system":"Be strict.","messages":[{{"role":"user","content":"' || {_USER} || '"}}],"temperature":0.5}}}}' AS line FROM rss_items""",
    "pending_rows": "SELECT article_id FROM fulltext WHERE NOT (article_id % 3 = 0 AND coalesce(trim(final_action), '') <> '') AND article_id % 5 <> 0",
    "batch_hydrate": """WITH s AS (SELECT article_id AS a, article_id % 4 AS b, article_id % 3 <> 0 AS has, article_id % 7 <> 0 AS ok, article_id % 5 = 0 AS bad FROM fulltext)
SELECT 'b' || b AS batch_id, CASE WHEN b = 0 AND has AND ok THEN (CASE WHEN bad THEN 'unsure' ELSE 'relevant' END) ELSE '' END AS headline_label, CASE WHEN b = 0 AND has AND ok THEN (CASE WHEN bad THEN 'invalid_label' ELSE '' END) END AS headline_parse_error,
CASE WHEN b = 0 AND has AND NOT ok THEN 'http 500' WHEN b = 2 THEN 'batch_failed' ELSE '' END AS classification_error,
CASE WHEN b = 0 AND has THEN (CASE WHEN ok THEN 'hydrated' ELSE 'error' END) WHEN b = 1 THEN 'in_progress' WHEN b = 2 THEN 'failed' ELSE '' END AS batch_state, count(*)::BIGINT AS n FROM s GROUP BY 1, 2, 3, 4, 5""",
    "batch_names": "SELECT dataset_key || '_headline_batch_' || lpad(((rn - 1) // 250 + 1)::VARCHAR, 4, '0') AS batch_name, count(*)::BIGINT AS requests, min(item_id) AS first_item FROM (SELECT *, row_number() OVER (PARTITION BY dataset_key ORDER BY item_id) AS rn FROM rss_items) GROUP BY 1",
    "active_tokens": "SELECT source, sum(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, length(text) // 4) END)::BIGINT AS tokens, count(*)::BIGINT AS requests FROM documents WHERE doc_id % 3 <> 1 GROUP BY 1",
    "batch_rows_fitted": """WITH g AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS n FROM (SELECT DISTINCT p_brand, p_size FROM part)), b AS (SELECT DISTINCT p_brand FROM part)
SELECT b.p_brand, i::BIGINT AS row_no, coalesce(p_size, -1)::BIGINT AS value FROM b CROSS JOIN range(1, 41) t(i) LEFT JOIN g ON g.p_brand = b.p_brand AND g.n = i""",
    "degenerate_batches": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY dataset_key ORDER BY item_id) AS rn FROM rss_items), c AS (SELECT *, dataset_key || '-' || ((rn - 1) // 250) AS batch FROM r),
t AS (SELECT *, max(rn) OVER (PARTITION BY batch) - rn AS back FROM c)
SELECT batch, avg((guid IS NULL)::INT) >= 0.2 OR avg((coalesce(trim(source_hint), '') = '')::INT) >= 0.2 AS degenerate FROM t WHERE back < 100 GROUP BY 1""",
    "clean_descriptions": f"SELECT item_id, array_to_string(list_filter(string_split({_nws('replace(rss_title, chr(44), chr(45))')}, ' '), lambda x: x <> '')[1:5], ' ') AS short FROM rss_items",
    "probability_semantics": _V + "SELECT item, alias, round(CASE WHEN (vote AND p < 0.5) OR (NOT vote AND p > 0.5) THEN 1.0 - p ELSE p END, 6) AS auto, round(CASE WHEN vote THEN p ELSE 1.0 - p END, 6) AS decision_confidence, p AS relevance_probability FROM votes",
    "quality_gate": r"""WITH r AS (SELECT item_id, source_hint, trim((CASE WHEN item_id % 9 <> 0 THEN '[' || pathogen_domain || '] ' ELSE '' END) || coalesce(rss_title, '') || (CASE WHEN item_id % 7 <> 0 THEN '; linkage: ' || coalesce(search_string, '') ELSE '' END)) AS t FROM rss_items),
n AS (SELECT *, len(regexp_extract_all(t, '[\p{L}\p{N}_](?:[\p{L}\p{N}_''-]*[\p{L}\p{N}_])?')) AS n FROM r)
SELECT item_id, CASE WHEN n < 12 THEN 'rationale_too_short:' || n || '<12' WHEN n > 24 THEN 'rationale_too_long:' || n || '>24' WHEN NOT (contains(t, '[') AND contains(t, ']')) THEN 'rationale_missing_domain_label'
WHEN NOT contains(lower(t), 'linkage:') THEN 'rationale_missing_linkage_tag' WHEN NOT regexp_matches(lower(t), 'peste|fever|virus|gripe') THEN 'rationale_missing_target_reference' WHEN item_id % 2 = 0 AND source_hint IS NULL THEN 'relevant_missing_evidence_span' ELSE '' END AS reason FROM n""",
    "complete_rows": _V + _WIDE + " SELECT item FROM w WHERE item % 11 <> 0 AND (item % 4 = 0 OR (m1 IS NOT NULL AND m2 IS NOT NULL AND m3 IS NOT NULL))",
    "distinct_votes": _V + _WIDE + " SELECT len(list_distinct([coalesce(m1, '?'), coalesce(m2, '?'), coalesce(m3, '?')]))::INTEGER AS answers, count(*)::BIGINT AS items FROM w GROUP BY 1",
    "rows_as_json": """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || ',"nested":{"key":' || n_nationkey || '}}' AS doc FROM nation""",
    "kept_headlines": """WITH f AS (SELECT *, lower(trim(fetch_status)) = 'success' AND trim(full_text) <> '' AND trim(content_hash) <> '' AND coalesce(word_count, 0) >= 120 AS v, trim(full_text) <> '' AND coalesce(word_count, 0) >= 120 AS r FROM fulltext)
SELECT count(*) FILTER (final_action = 'keep')::BIGINT AS kept, count(*) FILTER (final_action = 'keep' AND v)::BIGINT AS kept_valid, count(*) FILTER (v)::BIGINT AS valid, count(*) FILTER (r)::BIGINT AS ready FROM f""",
    "sorted_outlets": "SELECT row_number() OVER (ORDER BY domain)::BIGINT AS rn, domain FROM (SELECT DISTINCT lower(trim(domain)) AS domain FROM domains_removed WHERE trim(domain) <> '')",
    "topic_subset": f"SELECT search_string FROM {_S} ORDER BY 1 LIMIT 3",
}
