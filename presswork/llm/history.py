"""Problem 1: each new batch is checked against everything accepted before, without reading the history's records again.

The history is an append-only table of pivot distances: one row per distinct identity (a link or a guid in its one
canonical spelling), with that spelling, its 128-bit fingerprint and its distances to fixed pivots. It is partitioned by ranges
of those distances and never shuffled or rewritten: a batch is folded to one row per identity, sent to its ranges, only these
ranges of the history are read, pairs are pruned by the triangle inequality on all coordinates and verified by the true distance,
which is that of the fingerprints and of the identities themselves, and identities that are new are appended. An item is a repeat
if it did not bring every one of its identities first.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.pivots import cell_expr, cells, fingerprint, true_distance, with_pivot_table
from presswork.session import delete_path, new_path, read_table, setting, written

#: Identities that one bucket of the history is meant to hold, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 2_000_000, 12

#: By default a join's inputs must be partitioned by all of its keys, which sends the whole history through an exchange for
#: every batch. Cells are ranges of like size, so partitions by cell alone, as the history lies, are even.
BY_CELL = ("spark.sql.requireAllClusterKeysForCoPartition", "false")

# fixed values: query parameters that only track readers, and guids that stand for none
TRACKING = "utm_[^=]*|fbclid|gclid|dclid|msclkid|yclid|igshid|mc_cid|mc_eid|ref|ref_src|cmpid|ocid|xtor|_ga|spm"
PLACEHOLDER_GUIDS = ["", "0", "-", "--", "n/a", "na", "nan", "nil", "none", "null", "undefined", "unknown", "tbd", "?"]
NIL_UUID = "00000000-0000-0000-0000-000000000000"

_EDGE = r"[\s\p{Z}<>\"'\x{200B}\x{FEFF}]"


def _decoded(c: Column) -> Column:
    """Escapes resolved; a plus sign stays one, and a text with broken escapes stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def with_link_identity(df: DataFrame, col: str, to: str) -> DataFrame:
    """Adds the canonical text of a link, NULL if it is missing or has no host.

    'a:<id>' for the last path part after articles/ (case kept), else 'l:<host><path>?<parameters>' with lower-case host
    without www., one slash between path parts, escapes decoded, parameters sorted and tracking ones dropped. Each step
    is a projection of its own, so that no regular expression is evaluated twice.
    """
    u = F.regexp_replace(F.col(col), f"^{_EDGE}+|{_EDGE}+$", "")
    u = F.replace(F.replace(u, F.lit("&amp;"), F.lit("&")), F.lit("\\"), F.lit("/"))
    df = df.withColumn("__bare", F.regexp_replace(u, r"^(?i)(?:https?:)?/*|#.*$", ""))
    host = F.regexp_replace(F.lower(F.regexp_extract("__bare", r"^[^/?]*", 0)), r"^.*@|\.?(?::[0-9]*)?$", "")
    raw_path = F.regexp_extract("__bare", r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract("__bare", r"^[^?]*[?](.*)$", 1)
    df = df.select("*", F.regexp_replace(host, r"^www\.", "").alias("__host"), raw_path.alias("__raw"), query.alias("__query"))
    path = F.regexp_replace(F.regexp_replace(_decoded(F.col("__raw")), "/+", "/"), "/$", "")
    df = df.withColumn("__path", path).withColumn("__article", F.regexp_extract("__path", r"(?:^|/)articles/(?:.*/)?([^/]+)$", 1))
    params = F.transform(F.split("__query", "[&;]"), _decoded)
    params = F.filter(params, lambda x: (x != "") & ~x.rlike(f"^(?i)(?:{TRACKING})(?:=|$)"))
    key = (
        F.when(F.col("__host").isNull() | (F.col("__host") == ""), F.lit(None))
        .when(F.col("__article") != "", F.concat(F.lit("a:"), "__article"))
        .otherwise(F.concat(F.lit("l:"), "__host", "__path", F.lit("?"), F.array_join(F.array_sort(params), "&")))
    )
    return df.withColumn(to, key).drop("__bare", "__host", "__raw", "__query", "__path", "__article")


def guid_identity(col: str) -> Column:
    """Canonical text of a guid, NULL if it is missing or a placeholder; UUIDs lose case and wrapping."""
    t = F.regexp_replace(F.col(col), r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", "")
    uuid = F.lower(F.regexp_extract(t, r"^(?i)(?:urn:)?(?:uuid:)?[{(\[]?([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})[})\]]?$", 1))
    placeholder = F.lower(t).isin(PLACEHOLDER_GUIDS) | (uuid == NIL_UUID)
    return F.when(t.isNull() | placeholder, F.lit(None)).otherwise(F.concat(F.lit("g:"), F.when(uuid != "", uuid).otherwise(t)))


def identities(items: DataFrame, link: str = "google_news_redirect_url", guid: str = "guid", keep: tuple[str, ...] = ()) -> DataFrame:
    """(item_id, kept columns, n, key, h1, h2, v1, v2, cell), one row per item and identity it has, with the identity's
    text, fingerprint and pivot distances; n counts the item's identities (1 or 2).

    Items without any identity give no row: they match nothing and nothing matches them.
    """
    keyed = items.select("item_id", *keep, F.col(link).alias("__l"), F.col(guid).alias("__g"))
    keyed = with_link_identity(keyed, "__l", "__link")
    keys = F.array_compact(F.array("__link", guid_identity("__g")))
    h1, h2 = fingerprint(F.col("key"))
    rows = keyed.select("item_id", *keep, keys.alias("keys")).select("item_id", *keep, F.size("keys").alias("n"), F.explode("keys").alias("key"))
    rows = with_pivot_table(rows.select("item_id", *keep, "n", "key", h1.alias("h1"), h2.alias("h2")))
    return rows.withColumn("cell", F.expr(cell_expr()))


class PivotHistory:
    """The append-only identity table of everything accepted so far, in the shared folder.

    Rows lie in buckets of their range of pivot distances (`cell`), a folder per batch. Batches are given as rows of
    identities() and must be admitted in order of arrival. Empty batches append nothing. Repeated rows of one item_id
    count once. `buckets` is fixed when the table is made: about one for every BUCKET_ROWS identities it will hold.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = LEAST_BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.path = path or new_path(spark, "history")
        self.name = f"presswork_history_{uuid.uuid4().hex}"
        self.batches = 0

    def held(self, touched: list[int] | None = None) -> DataFrame | None:
        """Rows appended so far: item_id (the first bearer), key, h1, h2, v1, v2, cell, batch; of the touched cells only, if given."""
        if not self.batches:
            return None
        table = self.spark.table(self.name)
        return table if touched is None else table.where(F.col("cell").isin(touched))

    def admit(self, batch: DataFrame) -> DataFrame:
        """Check a batch against the history, append its new identities with the first item that bears them, and return
        (item_id) of its repeats: items of which at least one identity was there before.

        Within the batch identities are folded by partial aggregates, so one identity on a third of the rows reaches
        its task as one row per input partition. The history's buckets are scanned as they lie, without an exchange or a
        sort, past a hash table of the batch's share of the bucket; buckets without a cell of the batch are not opened.
        """
        with setting(self.spark, *BY_CELL):
            fresh = self._fresh(batch).withColumn("batch", F.lit(self.batches + 1))
            writer = fresh.write.partitionBy("batch").bucketBy(self.buckets, "cell").sortBy("cell", "v1")
            writer.option("path", self.path).mode("append").saveAsTable(self.name)
        self.batches += 1
        return written(self._repeats(batch, self.spark.table(self.name).where(F.col("batch") == self.batches)), "repeats")

    def _fresh(self, batch: DataFrame) -> DataFrame:
        """(h1, h2, item_id, v1, v2, cell, key) of the batch's identities that the history does not hold; see BY_CELL."""
        firsts = batch.groupBy("cell", "h1", "h2", "v1", "v2", "key").agg(F.min("item_id").alias("item_id")).repartition(self.buckets, "cell")
        held = self.held(self._touched(batch))
        if held is not None:
            # radius 0: coordinates may not differ, so the packed ones are keys of the join
            near = (F.col("o.cell") == F.col("n.cell")) & (F.col("o.v1") == F.col("n.v1")) & (F.col("o.v2") == F.col("n.v2"))
            same = near & (true_distance("o", "n", "key") == 0)
            known = held.alias("o").join(firsts.alias("n").hint("shuffle_hash"), same, "left_semi").select("cell", "h1", "h2", "key")
            firsts = firsts.join(known.hint("shuffle_hash"), ["cell", "h1", "h2", "key"], "left_anti")
        return firsts.select("h1", "h2", "item_id", "v1", "v2", "cell", "key")

    def _touched(self, batch: DataFrame) -> list[int] | None:
        """Ranges the batch falls into, None for all of them: at most as many numbers as there are ranges."""
        if not self.batches:
            return None
        rows = batch.select("cell").distinct().collect()
        return None if len(rows) >= cells() / 2 else sorted(r[0] for r in rows)

    @staticmethod
    def _repeats(batch: DataFrame, fresh: DataFrame) -> DataFrame:
        """An item is new only if it is the first bearer of all its n identities. The join is on item_id, unique on both
        sides, so no identity's popularity matters; the history is not needed."""
        brought = fresh.groupBy("item_id").agg(F.count(F.lit(1)).alias("fresh"))
        have = batch.groupBy("item_id").agg(F.max("n").alias("n"))
        return have.join(brought, "item_id", "left").where("coalesce(fresh, 0) < n").select("item_id")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_path(self.spark, self.path)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "rss_items")
    # the replay spells all batches' identities in one pass; each batch then meets the history on its own
    rows = written(identities(items, keep=("batch_no",)), "identities", partition_by=["batch_no"])
    history = PivotHistory(spark, buckets=max(LEAST_BUCKETS, -(-rows.count() // BUCKET_ROWS)))
    # one row per batch number: a list of batches, not of records
    batches = [r[0] for r in rows.select("batch_no").distinct().orderBy("batch_no").collect()]
    found = [history.admit(rows.where(F.col("batch_no").eqNullSafe(F.lit(b)))) for b in batches]
    return reduce(DataFrame.unionByName, found, items.select("item_id").where("false"))


QUERIES = {"p1_found": p1_found}
ORACLE = {
    "p1_found": r"""
WITH raw AS (
  SELECT item_id,
    regexp_replace(regexp_replace(google_news_redirect_url, '^[\s<>"'']+|[\s<>"'']+$', '', 'g'), '#.*$', '') AS u,
    trim(guid, E' \t\r\n') AS g FROM rss_items
), parts AS (
  SELECT item_id, g, regexp_replace(u, '^(?i)(https?:)?/*', '') AS b FROM raw
), cut AS (
  SELECT item_id, g,
    regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*', 0)), ':[0-9]*$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_replace(url_decode(replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '+', '%2B')), '/+', '/', 'g'), '/$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(b, '^[^?]*\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(?i)(utm_[^=]*|fbclid|gclid|ref|xtor)(=|$)'))) AS params FROM parts
), keys AS (
  SELECT item_id, CASE WHEN regexp_matches(path, '/articles/') THEN 'a:' || regexp_extract(path, '/articles/(?:.*/)?([^/]+)$', 1)
    ELSE 'l:' || host || path || '?' || array_to_string(params, '&') END AS k FROM cut WHERE host <> ''
  UNION ALL
  SELECT item_id, 'g:' || CASE WHEN regexp_matches(g, '^(?i)(urn:uuid:)?[{(]?[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}[})]?$')
    THEN lower(regexp_extract(g, '(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}', 0)) ELSE g END
  FROM cut WHERE g IS NOT NULL AND lower(g) NOT IN ('', '0', '-', 'n/a', 'none', 'null', 'undefined')
), firsts AS (SELECT k, min(item_id) AS first_id FROM keys GROUP BY k)
SELECT DISTINCT item_id FROM keys JOIN firsts USING (k) WHERE first_id < item_id""",
}
