"""Column lists of the stages, as Spark schemas. Names and order are fixed values: they must equal what users hold."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DateType(), "t": T.TimestampType(), "i": T.IntegerType()}
    fields = []
    for part in spec.split():
        name, _, kind = part.partition(":")
        fields.append(T.StructField(name, kinds[kind or "s"]))
    return T.StructType(fields)


RSS_ITEMS = _struct(
    "record_id dataset_key pathogen_domain language_code request_locale_id request_lang request_country search_string date_window_start:d date_window_end:d "
    "rss_language rss_title rss_pubdate rss_pubdate_utc:t rss_description rss_description_text google_rss_url google_news_redirect_url guid source_hint "
    "source_url source_domain feed_channel_title feed_last_build_date retrieved_at:t cached_path"
)
MANIFEST = _struct(
    "pathogen_domain language_code locale_id request_lang request_country request_accept_language search_string query_slug window_start window_end window_days "
    "window_role parent_window_start parent_window_end split_trigger_entries entry_count status attempts elapsed_request_seconds http_status cached_path "
    "last_attempt_at next_eligible_attempt_at error_summary"
)
FULLTEXT = _struct(
    "record_id dataset_key pathogen_domain language_code search_string google_news_redirect_url rss_title source_hint final_action final_url canonical_url domain "
    "page_title published_at authors full_text word_count:i article_language extraction_method fetch_status error_reason resolution_method resolution_error "
    "content_hash fetched_at:t"
)
#: One cached feed answer: request scalars, the feed's own fields and its entries.
PAYLOAD = T.StructType([
    *_struct("dataset_key pathogen_domain language_code request_locale_id request_lang request_country search_string window_start window_end retrieved_at feed_url").fields,
    T.StructField("feed", _struct("language title updated")),
    T.StructField("entries", T.ArrayType(T.StructType([
        *_struct("title published summary").fields, T.StructField("summary_detail", _struct("value")), *_struct("link id").fields,
        T.StructField("source", _struct("title href")),
    ]))),
])
