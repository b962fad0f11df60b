"""Sources: text tables of any encoding, parquet first, cached feed answers, workbooks, log lines, and an RSS source."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from presswork.functions.text import rfc822_utc
from presswork.functions.urls import extract_domain
from presswork.schemas import PAYLOAD, RSS_ITEMS


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def conform(df: DataFrame, schema: T.StructType, renames: dict[str, str] | None = None, default: str | None = None) -> DataFrame:
    """The schema's columns in order: legacy names are renamed, extra ones are dropped, missing columns hold the default
    (NULL if none is given)."""
    for old, new in (renames or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(default)).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1"), fill: str | None = None) -> DataFrame:
    """A CSV table with a header, all columns text unless a schema is given; a missing file is an empty table.

    The first encoding in which the file holds no replacement character is used; a byte order mark is dropped. With `fill`
    missing texts hold it, as in a table where the empty text stands for missing.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], schema or T.StructType())

    def read(enc: str) -> DataFrame:
        return spark.read.csv(path, header=True, multiLine=True, escape='"', encoding=enc, inferSchema=False)

    df = read(encodings[0])
    for enc in encodings[1:]:
        bad = df.select(F.exists(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).contains("\ufffd") for c in df.columns] or [F.lit(False)]), lambda x: x).alias("b")).where("b")
        if not bad.take(1):
            break
        df = read(enc)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    df = conform(df, schema) if schema else df
    return df if fill is None else df.na.fill(fill)


def worksheet_column(rows: list[list], row: int, column: int) -> list[str]:
    """Distinct names of a worksheet's column from a row on (both from 0), in their order; blank cells are left out."""
    cells = (" ".join(str(r[column]).split()) for r in rows[row:] if len(r) > column and r[column] is not None)
    return list(dict.fromkeys(x for x in cells if x))


def read_preferred(spark: SparkSession, stem: str, schema: T.StructType | None = None) -> DataFrame:
    """stem.parquet if it is there, else stem.csv."""
    if _exists(spark, f"{stem}.parquet"):
        df = spark.read.parquet(f"{stem}.parquet")
        return conform(df, schema) if schema else df
    return read_csv(spark, f"{stem}.csv", schema)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Cached feed answers (one JSON document per file), with the file's path."""
    return spark.read.schema(PAYLOAD).json(path, multiLine=True).withColumn("cached_path", F.col("_metadata.file_path"))


def payload_items(payloads: DataFrame) -> DataFrame:
    """One row of RSS_ITEMS per feed entry; answers without entries give none."""
    e = payloads.withColumn("e", F.explode("entries"))
    summary = F.coalesce(F.nullif(F.col("e.summary"), F.lit("")), F.col("e.summary_detail.value"), F.lit(""))
    plain = F.trim(F.regexp_replace(F.regexp_replace(summary, "<[^>]*>", " "), r"\s+", " "))
    at = rfc822_utc(F.col("e.published"))
    parts = [F.coalesce(c, F.lit("")) for c in (
        F.col("dataset_key"), F.col("request_locale_id"), F.col("search_string"), F.col("window_start"), F.col("window_end"), F.col("e.link"), F.col("e.id"), F.col("e.title"),
    )]
    rows = e.select(
        F.sha2(F.concat_ws("||", *parts), 256).alias("record_id"), "dataset_key", "pathogen_domain", "language_code", "request_locale_id", "request_lang",
        "request_country", "search_string", F.to_date("window_start").alias("date_window_start"), F.to_date("window_end").alias("date_window_end"),
        F.col("feed.language").alias("rss_language"), F.col("e.title").alias("rss_title"), F.col("e.published").alias("rss_pubdate"), at.alias("rss_pubdate_utc"),
        summary.alias("rss_description"), plain.alias("rss_description_text"), F.col("feed_url").alias("google_rss_url"), F.col("e.link").alias("google_news_redirect_url"),
        F.col("e.id").alias("guid"), F.col("e.source.title").alias("source_hint"), F.col("e.source.href").alias("source_url"),
        extract_domain(F.col("e.source.href")).alias("source_domain"), F.col("feed.title").alias("feed_channel_title"), F.col("feed.updated").alias("feed_last_build_date"),
        F.try_to_timestamp("retrieved_at").alias("retrieved_at"), "cached_path",
    )
    return conform(rows, RSS_ITEMS)


def read_workbook(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """A worksheet as text columns; workbooks are small files read on the driver."""
    import pandas as pd

    pdf = pd.read_excel(path, sheet_name=sheet, dtype=str)
    schema = T.StructType([T.StructField(str(c).strip(), T.StringType()) for c in pdf.columns])
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), schema)


def read_first_column(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """First comma-separated field of each line, without byte order mark, blank lines and the header's value."""
    v = F.trim(F.regexp_replace(F.split("value", ",", 2)[0], "^\ufeff", ""))
    own = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    df = spark.read.text(path).select(v.alias("value"), own[0].alias("__f"), own[1].alias("__b"), F.monotonically_increasing_id().alias("__n"))
    if header:
        # a file's first line is the first row of its first block
        first = df.where("__b = 0").groupBy("__f").agg(F.min("__n").alias("__n"))
        df = df.join(F.broadcast(first), ["__f", "__n"], "left_anti")
    return df.where("value <> ''").select("value")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(at, level, message) of log lines that begin with a timestamp."""
    line = r"^(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d)[,.\d]*\s*[|\-]?\s*(\w+)\s*[|:\-]\s*(.*)$"
    part = [F.regexp_extract("value", line, i) for i in (1, 2, 3)]
    return spark.read.text(path).select(F.try_to_timestamp(part[0]).alias("at"), part[1].alias("level"), part[2].alias("message")).where("at IS NOT NULL")


def preferred_column(df: DataFrame, names: list[str]) -> str | None:
    """The first of the names that the table has."""
    return next((n for n in names if n in df.columns), None)


def relevance_mask(df: DataFrame) -> Column:
    """Which rows are relevant, by the first column of those that say so; all rows if the table has none of them."""
    if "final_label" in df.columns:
        return F.coalesce(F.trim("final_label") == "relevant", F.lit(False))
    flag = preferred_column(df, ["RelevantYN", "relevant", "is_relevant"])
    if flag is None:
        return F.lit(True)
    return F.coalesce(F.lower(F.trim(F.col(flag).cast("string"))).isin("1", "true", "yes", "y", "relevant"), F.lit(False))


def feed_item_count(xml: Column) -> Column:
    """Number of items in the text of a feed."""
    return F.regexp_count(F.coalesce(xml, F.lit("")), F.lit(r"<item[\s>/]"))


def batch_results(df: DataFrame, raw: str = "value") -> DataFrame:
    """(custom_id, success, raw_text, error) of result lines of batch services in either of two layouts."""
    doc = F.try_parse_json(F.col(raw))
    get = lambda p: F.try_variant_get(doc, p, "string")
    status = F.try_variant_get(doc, "$.response.status_code", "int")
    text = F.coalesce(get("$.response.body.choices[0].message.content"), get("$.result.message.content[0].text"))
    kind = get("$.result.type")
    error = F.coalesce(get("$.error.message"), get("$.result.error.message"), F.when(status >= 400, F.concat(F.lit("http_"), status.cast("string"))), F.when(kind.isin("expired", "errored", "canceled"), kind))
    return df.select(get("$.custom_id").alias("custom_id"), (error.isNull() & text.isNotNull()).alias("success"), F.coalesce(text, F.lit("")).alias("raw_text"), F.coalesce(error, F.when(text.isNull(), F.lit("no_text")), F.lit("")).alias("error"))


ITEM_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "title", "link", "guid", "pubdate", "description", "source", "source_url", "error")])


def parse_feed(xml: str) -> Iterator[tuple]:
    """Items of an RSS document as (title, link, guid, pubdate, description, source, source_url)."""
    root = ElementTree.fromstring(re.sub(r"^\ufeff", "", xml.strip()))
    for item in root.iter("item"):
        get = lambda n: (item.findtext(n) or "").strip()  # noqa: E731, B023
        source = item.find("source")
        yield get("title"), get("link"), get("guid"), get("pubDate"), get("description"), (source.text or "").strip() if source is not None else "", source.get("url", "") if source is not None else ""


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class FeedReader(DataSourceReader):
    def __init__(self, urls: list[str], fetch: Callable[[str], str], per_task: int):
        self.urls, self.fetch, self.per_task = urls, fetch, per_task

    def partitions(self) -> list[_Urls]:
        return [_Urls(self.urls[i : i + self.per_task]) for i in range(0, len(self.urls), self.per_task)]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        for url in partition.urls:
            try:
                for item in parse_feed(self.fetch(url)):
                    yield (url, *item, None)
            except Exception as e:  # a feed that fails is a row with its error, not a failed job
                yield (url, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])


def read_file(path: str) -> str:
    """The fetcher for feeds that lie in files; live fetchers are passed to feed_source()."""
    with open(path.removeprefix("file://"), encoding="utf-8") as f:
        return f.read()


def feed_source(fetch: Callable[[str], str] = read_file, name: str = "feed") -> type[DataSource]:
    """A data source class to register: options `urls` (separated by blanks) and `perTask`. The fetcher is injected, so
    the engine itself never needs a network."""

    class FeedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> T.StructType:
            return ITEM_SCHEMA

        def reader(self, schema: T.StructType) -> FeedReader:
            return FeedReader(self.options.get("urls", "").split(), fetch, int(self.options.get("pertask", self.options.get("perTask", "20"))))

    return FeedSource


def infer_columns(df: DataFrame, rows: int = 300) -> dict[str, str | None]:
    """Which columns hold URL, title, description and date: by name, else by the share of values that look so.

    The content test reads at most `rows` rows; that is the rule itself, a guess of the layout.
    """
    names = {"url": ["url", "link", "canonical_url", "final_url"], "title": ["title", "headline"], "description": ["description", "summary", "snippet"], "date": ["date", "published", "pubdate", "published_at"]}
    out: dict[str, str | None] = {}
    for kind, known in names.items():
        low = {c.lower(): c for c in df.columns}
        out[kind] = next((low[k] for k in known if k in low), None) or next((c for c in df.columns if any(k in c.lower() for k in known)), None)
    missing = [k for k in ("url", "date") if out[k] is None]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if missing and texts:
        head = df.select(*texts).limit(rows)
        shares = head.agg(*[F.avg(F.col(c).rlike(r"^https?://").cast("int")).alias(f"u_{c}") for c in texts], *[F.avg(F.try_to_timestamp(c).isNotNull().cast("int")).alias(f"d_{c}") for c in texts]).first()
        for kind, mark in (("url", "u_"), ("date", "d_")):
            best = max(texts, key=lambda c: shares[f"{mark}{c}"] or 0)
            if kind in missing and (shares[f"{mark}{best}"] or 0) >= 0.2:
                out[kind] = best
    return out


