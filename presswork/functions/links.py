"""Feed addresses, locale rules, and where an aggregator's link leads, without a network."""

from __future__ import annotations

import base64
import binascii
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.functions.text import normalize_ws
from presswork.functions.urls import url_param, wrapper_id

# fixed values: the public search feed, and countries of languages and of variants that name none
FEED_BASE = "https://news.google.com/rss"
LANGUAGE_COUNTRY = {"en": "US", "fr": "FR", "es": "ES", "pt": "BR"}
VARIANT_COUNTRY = {"es-419": "MX"}
# fixed values: bytes around the address inside an article id
HEAD, LONG_HEAD, TAIL = b"\x08\x13", b"\x08\x13\x22", b"\xd2\x01\x00"


def search_feed_url(query: Column, first: Column, last: Column, lang: Column, country: Column, base: str = FEED_BASE) -> Column:
    """Address of a search over the closed days first..last; the feed's upper bound is exclusive, so it is one day later.
    NULL days leave their bound out."""
    bounds = F.concat(
        F.coalesce(F.concat(F.lit(" after:"), F.date_format(first, "yyyy-MM-dd")), F.lit("")),
        F.coalesce(F.concat(F.lit(" before:"), F.date_format(F.date_add(last, 1), "yyyy-MM-dd")), F.lit("")),
    )
    where = F.concat(F.lit("&ceid="), country, F.lit(":"), lang, F.lit("&hl="), lang, F.lit("&gl="), country)
    return F.concat(F.lit(f"{base}/search?q="), F.url_encode(F.concat(query, bounds)), where)


def variant_country(variant: Column) -> Column:
    """Country of a language variant: that of a special variant, its two-letter ending, or the language's own."""
    v = normalize_ws(variant)
    own = F.regexp_extract(v, r"-([A-Za-z]{2})$", 1)
    pick = lambda c, table: F.coalesce(*[F.when(c == k, x) for k, x in table.items()])
    return F.coalesce(pick(v, VARIANT_COUNTRY), F.nullif(F.upper(own), F.lit("")), pick(F.lower(F.split(v, "-")[0]), LANGUAGE_COUNTRY))


def accept_language(lang: Column, variant: Column, variants: Column) -> Column:
    """The header that asks for a variant first, then for the others with falling weights of at least 0.4, then for English."""
    ordered = F.array_distinct(F.filter(F.transform(F.concat(F.array(variant), variants), normalize_ws), lambda x: x != ""))
    weight = lambda i: F.format_number(F.greatest(F.lit(0.4), 1.0 - 0.1 * i), 1)
    parts = F.transform(ordered, lambda x, i: F.when(i == 0, x).otherwise(F.concat(x, F.lit(";q="), weight(i))))
    return F.concat(F.array_join(parts, ","), F.when(lang != "en", ",en;q=0.3").otherwise(""))


def response_locale(url: Column) -> Column:
    """struct(hl, gl, ceid) of an address a server answered under; empty where absent."""
    get = lambda n: F.coalesce(F.try_url_decode(url_param(normalize_ws(url), n)), F.lit(""))
    return F.struct(get("hl").alias("hl"), get("gl").alias("gl"), get("ceid").alias("ceid"))


def decode_article_id(article_id: str | None) -> str | None:
    """The publisher's address that an article id carries in itself, None if it carries none.

    The id is url-safe Base64 of a small message: marks, the length of the address in 7-bit groups, the address. If the
    length does not lead to an address, the first one found among the bytes counts.
    """
    if not article_id:
        return None
    try:
        data = base64.b64decode(article_id.translate({45: 43, 95: 47}) + "=" * (-len(article_id) % 4))
    except (binascii.Error, ValueError):
        return None
    for head in (LONG_HEAD, HEAD):
        if data.startswith(head):
            data = data.removeprefix(head)
            break
    data = data.removesuffix(TAIL)
    groups = next((i for i, b in enumerate(data[:10]) if b < 128), None)
    if groups is not None:
        size = sum((b & 127) << (7 * i) for i, b in enumerate(data[: groups + 1]))
        inside = data[groups + 1 : groups + 1 + size]
        text = inside.decode("utf-8", "ignore").strip()
        if len(inside) == size and re.match("https?://", text, re.I):
            return text
    found = re.search(r"https?://[^\s\"'<>\\]+", data.decode("utf-8", "ignore"), re.I)
    return found.group().strip() if found else None


@F.pandas_udf(T.StringType())
def decoded_article_id(ids: pd.Series) -> pd.Series:
    return ids.map(lambda x: decode_article_id(x) if isinstance(x, str) else None)


def resolved_link(url: Column, online: Column, online_error: Column) -> Column:
    """struct(url, method, error): the address itself if it is no aggregator's link, else what its id carries, else what an
    injected lookup found, else the link with the lookup's error."""
    key = F.when(url.rlike(r"(?i)^https?://(?:[^/?#]*\.)?news\.google\.[^/?#]*/"), F.nullif(wrapper_id(url), F.lit("")))
    inside = F.when(key.isNotNull(), decoded_article_id(key))
    return (
        F.when(key.isNull(), F.struct(url.alias("url"), F.lit("not_wrapper").alias("method"), F.lit("").alias("error")))
        .when(inside.isNotNull(), F.struct(inside.alias("url"), F.lit("decoded_offline").alias("method"), F.lit("").alias("error")))
        .when(online.isNotNull(), F.struct(online.alias("url"), F.lit("decoded_online").alias("method"), F.lit("").alias("error")))
        .otherwise(F.struct(url.alias("url"), F.lit("decode_failed").alias("method"), F.coalesce(online_error, F.lit("")).alias("error")))
    )


def first_filled(**columns: Column) -> Column:
    """struct(value, chosen): the first column with a non-blank value, in the order given, and its name; NULLs if none."""
    out = F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("chosen"))
    for name, c in reversed(columns.items()):
        out = F.when(normalize_ws(c) != "", F.struct(F.trim(c).alias("value"), F.lit(name).alias("chosen"))).otherwise(out)
    return out


def consent_page(url: Column, body: Column) -> Column:
    """A page that asks for consent instead of showing what was asked for: by its address, its heading, or all four of its
    standing phrases."""
    u, b = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    # fixed values: the page's host and texts
    phrases = ["g.co/privacytools", "cookies and data", "accept all", "reject all"]
    every = F.lit(True)
    for p in phrases:
        every = every & b.contains(p)
    return u.contains("consent.google.com") | b.contains("before you continue to google") | every


def lenient_instant(c: Column) -> Column:
    """Instant of an ISO date or date-time with or without zone (UTC where there is none), NULL for anything else."""
    t = F.trim(c)
    iso = t.rlike(r"^\d{4}-\d\d-\d\d(?:[T ]\d\d(?::\d\d(?::\d\d(?:\.\d+)?)?)?(?:Z|[+-]\d\d(?::?\d\d)?)?)?$")
    return F.when(iso, F.try_to_timestamp(t))
