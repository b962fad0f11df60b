"""URL functions as column expressions.

The built-in URL parser refuses URLs with blanks or underscores, so hosts and paths are cut by regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions.text import normalize_ws

# fixed values: parameters that only track readers
TRACKING_PARAMS = [
    "gclid", "fbclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "vero_conv", "vero_id", "yclid", "gbraid", "wbraid", "mkt_tok",
    "cmpid", "spm", "ref", "ref_src", "sourceid",
]
_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?"


def extract_domain(c: Column) -> Column:
    """Host of a URL or bare host name in lower case without www. and outer dots; empty if there is none."""
    t = normalize_ws(c)
    bare = (~t.contains("://")) & t.contains(".") & (~t.contains("/"))
    host = F.lower(F.when(bare, t).otherwise(F.regexp_extract(t, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    return F.regexp_replace(F.regexp_replace(host, r"^\.+|\.+$", ""), r"^www\.", "")


def with_canonical_url(df: DataFrame, col: str, to: str) -> DataFrame:
    """Adds the canonical URL: http(s) only, lower-case host, no default port, fragment, user or trailing slash, single
    slashes, parameters without tracking ones, sorted and encoded once. NULL where the text is no such URL."""
    t = normalize_ws(F.col(col))
    raw = F.when(t.startswith("//"), F.concat(F.lit("https:"), t)).when(F.lower(t).startswith("www."), F.concat(F.lit("https://"), t)).otherwise(t)
    df = df.withColumn("__u", raw)
    part = {k: F.regexp_extract("__u", _PARTS, i) for i, k in enumerate(("scheme", "host", "port", "path", "query"), 1)}
    df = df.select("*", *[(F.lower(v) if k in ("scheme", "host") else v).alias(f"__{k}") for k, v in part.items()])
    path = F.regexp_replace(F.regexp_replace("__path", "/{2,}", "/"), "/$", "")
    path = F.when(path == "", "/").otherwise(path)
    pairs = F.transform(F.filter(F.split("__query", "&"), lambda x: x != ""), _name_value)
    kept = F.filter(pairs, lambda p: ~(F.lower(p["k"]).startswith("utm_") | F.lower(p["k"]).isin(TRACKING_PARAMS)))
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    standard = (F.col("__port") == "") | ((F.col("__scheme") == "http") & (F.col("__port") == "80")) | ((F.col("__scheme") == "https") & (F.col("__port") == "443"))
    port = F.when(standard, "").otherwise(F.concat(F.lit(":"), "__port"))
    df = df.withColumn("__q", query).withColumn("__rest", F.concat(F.lit("://"), "__host", port, path))
    url = F.concat("__scheme", "__rest", F.when(F.col("__q") != "", F.concat(F.lit("?"), "__q")).otherwise(""))
    url = F.when(F.col("__scheme").isin("http", "https") & (F.col("__host") != ""), url)
    return df.withColumn(to, url).drop("__u", "__scheme", "__host", "__port", "__path", "__query", "__q", "__rest")


def _name_value(x: Column) -> Column:
    name, value = F.regexp_extract(x, "^([^=]*)", 1), F.regexp_extract(x, "^[^=]*=(.*)$", 1)
    return F.struct(F.coalesce(F.try_url_decode(name), name).alias("k"), F.coalesce(F.try_url_decode(value), value).alias("v"))


def wrapper_id(c: Column) -> Column:
    """Article id of an aggregator's link, empty for other links."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"/(?:rss/+)?articles/([^/?#]+)", 1)


def url_param(c: Column, name: str) -> Column:
    """Value of one query parameter, empty if absent."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), rf"[?&]{name}=([^&#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """A host and all its parent domains: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def article_key(guid: Column, url: Column, title: Column, date: Column, source: Column) -> Column:
    """Hash that identifies an article: of the first non-blank of guid and URL, else of title, date and source."""
    given = F.coalesce(F.nullif(F.trim(guid), F.lit("")), F.nullif(F.trim(url), F.lit("")))
    rest = F.concat_ws("||", F.coalesce(title, F.lit("")), F.coalesce(date, F.lit("")), F.coalesce(source, F.lit("")))
    return F.sha2(F.coalesce(given, rest), 256)
