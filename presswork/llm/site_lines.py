"""Problem 2: lines that a site repeats over and over are found from incremental per-source line counts and removed.

State are two append-only tables: articles per source, and articles per (source, line), a part for each partition that
came. A new partition appends its own counts as a delta; lines whose share crosses the threshold, upwards or downwards, are
found by summing the counts of the sources it touches with and without the delta, and only articles that hold such a line
are rebuilt. Articles are hashed once, into narrow rows that find the articles of a line without their texts. Lines are one
if they differ only in case, digits, white space, closing punctuation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.session import new_path, read_table, written

MIN_ARTICLES = 6
MIN_SHARE = 0.2
#: Partitions in which the queries take their table.
PARTITIONS = 3

_SPACE = r"[\s\p{Z}\x{1C}-\x{1F}\x{200B}\x{FEFF}]"


def line_key(line: Column) -> Column:
    """What all spellings of a line share: lower case, without digits, white space and closing punctuation or symbols.

    A line of nothing else (a rule, a page number) keeps the empty key, so all such lines are one.
    """
    return F.regexp_replace(F.regexp_replace(F.lower(line), rf"\p{{N}}|{_SPACE}", ""), r"[\p{P}\p{S}]+$", "")


def line_hashes(text: Column) -> Column:
    """Array with the 64-bit hash of each line's key, NULL for blank lines; positions are line numbers less one."""
    return F.transform(
        F.split(text, "\n", -1),
        lambda x: F.when(F.regexp_replace(x, _SPACE, "") != "", F.xxhash64(line_key(x))),
    )


def hashed(articles: DataFrame, id_col: str = "article_id", source: str = "domain", text: str = "full_text") -> DataFrame:
    """(article_id, domain, hashes) of articles with a source; rows without one are left out, NULL texts have no lines."""
    has_source = F.col(source).isNotNull() & (F.trim(source) != "")
    hashes = F.coalesce(line_hashes(F.col(text)), F.array().cast("array<bigint>"))
    return articles.where(has_source).select(F.col(id_col).alias("article_id"), F.col(source).alias("domain"), hashes.alias("hashes"))


def delta(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(domain, articles) and (domain, h, articles) of one partition; a line counts once in an article.

    Both are partial aggregates before the shuffle, so a source with a third of the articles costs no task more.
    """
    per_source = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("articles"))
    lines = rows.select("domain", F.explode(F.array_distinct(F.array_compact("hashes"))).alias("h"))
    return per_source, lines.groupBy("domain", "h").agg(F.count(F.lit(1)).alias("articles"))


class LineCounts:
    """The two count tables under one folder of the shared folder, and the lines over the threshold."""

    def __init__(self, spark: SparkSession, min_articles: int = MIN_ARTICLES, min_share: float = MIN_SHARE):
        self.spark, self.min_articles, self.min_share = spark, min_articles, min_share
        self.path = new_path(spark, "line-counts")
        self.deltas = 0
        #: (domain, h) over the threshold; at most 1/min_share times the mean number of lines per article for a source
        self.crossed: DataFrame | None = None
        #: (domain, h) that the last partition brought below the threshold
        self.fallen: DataFrame | None = None

    def _parts(self, table: str) -> DataFrame:
        """All deltas of a table, with `last` true for rows of the newest."""
        kind = "domain string, articles long" if table == "sources" else "domain string, h long, articles long"
        paths = [f"{self.path}/{table}-{k:06d}" for k in range(self.deltas)]
        newest = self.spark.read.schema(kind).parquet(paths[-1]).withColumn("last", F.lit(True))
        if len(paths) == 1:
            return newest
        return self.spark.read.schema(kind).parquet(*paths[:-1]).withColumn("last", F.lit(False)).unionByName(newest)

    def lines(self) -> DataFrame:
        """(domain, h, articles): the sums over all deltas."""
        return self._parts("lines").groupBy("domain", "h").agg(F.sum("articles").alias("articles"))

    def add(self, rows: DataFrame) -> DataFrame:
        """Append the delta of hashed() rows; returns the (domain, h) that crossed the threshold by it."""
        new_sources, new_lines = delta(rows)
        new_sources.write.parquet(f"{self.path}/sources-{self.deltas:06d}")
        new_lines.write.parquet(f"{self.path}/lines-{self.deltas:06d}")
        self.deltas += 1
        before = F.sum(F.when(F.col("last"), 0).otherwise(F.col("articles")))
        # a source that got no article keeps its lines as they are
        sums = self._parts("sources").groupBy("domain").agg(F.sum("articles").alias("all"), before.alias("all_before"), F.max("last").alias("touched"))
        sources = sums.where("touched").drop("touched")
        # every line of a touched source is kept and summed: any may cross, upwards by its own count, downwards by the source's
        counts = self._parts("lines").groupBy("domain", "h").agg(F.sum("articles").alias("n"), before.alias("n_before"))
        over = lambda n, total: (F.col(n) >= self.min_articles) & (F.col(n) >= F.col(total) * F.lit(self.min_share))
        judged = counts.where(F.col("n") >= self.min_articles).join(sources, "domain")
        judged = judged.select("domain", "h", over("n", "all").alias("now"), over("n_before", "all_before").alias("earlier"))
        judged = written(judged.where("now OR earlier"), "crossings")
        untouched = None if self.crossed is None else self.crossed.join(judged.where("earlier"), ["domain", "h"], "left_anti")
        now = judged.where("now").select("domain", "h")
        self.crossed = now if untouched is None else written(untouched.unionByName(now), "crossed")
        self.fallen = judged.where("earlier AND NOT now").select("domain", "h")
        return judged.where("now AND NOT earlier").select("domain", "h")

    def occurrences(self, rows: DataFrame, lines: DataFrame | None = None) -> DataFrame:
        """(article_id, line_no) of each occurrence of the given lines (those over the threshold) in the articles.

        The lines are a written table, so their size is known to the planner: it broadcasts them below its threshold
        and otherwise joins on (domain, h), where adaptive execution splits a hot line.
        """
        each = rows.select("article_id", "domain", F.posexplode("hashes").alias("pos", "h")).where("h IS NOT NULL")
        hit = each.join(self.crossed if lines is None else lines, ["domain", "h"], "left_semi")
        return hit.select("article_id", (F.col("pos") + 1).cast("int").alias("line_no"))

    def touched(self, rows: DataFrame, newly: DataFrame) -> DataFrame:
        """(article_id) of hashed() rows that hold a line which the last partition brought over or under the threshold."""
        return self.occurrences(rows, newly.unionByName(self.fallen)).select("article_id").distinct()

    def rebuild(self, articles: DataFrame, rows: DataFrame, id_col: str = "article_id", text: str = "full_text") -> DataFrame:
        """(article_id, text without all lines over the threshold) of the articles that `rows` has the hashes of."""
        drop = self.occurrences(rows).groupBy("article_id").agg(F.collect_set("line_no").alias("__drop"))
        parts = F.filter(F.split("__text", "\n", -1), lambda x, i: ~F.array_contains("__drop", i + 1))
        base = articles.select(F.col(id_col).alias("article_id"), F.col(text).alias("__text"))
        clean = F.when(F.col("__drop").isNull(), F.col("__text")).otherwise(F.array_join(parts, "\n"))
        return base.join(drop, "article_id", "left").select("article_id", clean.alias(text))


def cleaned(spark: SparkSession, articles: DataFrame, hashes: DataFrame, partitions: int) -> DataFrame:
    """(article_id, full_text) after the partitions have come one by one.

    Each partition appends its cleaned articles and those earlier ones that its crossings touch; of an article the version
    appended last counts. `hashes` has the hashed() rows of all articles with a source and their `part`.
    """
    counts = LineCounts(spark)
    versions: list[tuple[DataFrame, DataFrame | None]] = []
    for k in range(partitions):
        newly = counts.add(hashes.where(F.col("part") == k))
        own = articles.where(_part(partitions) == k)
        fresh = counts.rebuild(own, hashes.where(F.col("part") == k))
        again = None
        if k:
            again = written(counts.touched(hashes.where(F.col("part") < k), newly), "touched")
            rebuilt = counts.rebuild(articles.join(again, "article_id", "left_semi"), hashes.join(again, "article_id", "left_semi"))
            fresh = fresh.unionByName(rebuilt)
        versions.append((written(fresh, "cleaned"), again))
    out, later = None, None
    for version, again in reversed(versions):
        kept = version if later is None else version.join(later, "article_id", "left_anti")
        out = kept if out is None else out.unionByName(kept)
        if again is not None:
            later = again if later is None else later.unionByName(again)
    return out


def _part(partitions: int) -> Column:
    return F.pmod(F.xxhash64("article_id"), F.lit(partitions))


def _hashed_parts(articles: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """hashed() rows of all articles, written once, with the number of the partition each comes in."""
    return written(hashed(articles).withColumn("part", _part(partitions)), "line-hashes")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = _hashed_parts(read_table(spark, sf_dir, "fulltext").select("article_id", "domain", "full_text"))
    counts = LineCounts(spark)
    for k in range(PARTITIONS):
        counts.add(hashes.where(F.col("part") == k))
    return counts.occurrences(hashes)


def p2_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article without its site's lines; articles without a source or text come out as they are."""
    articles = read_table(spark, sf_dir, "fulltext").select("article_id", "domain", "full_text")
    return cleaned(spark, articles, _hashed_parts(articles), PARTITIONS).withColumnRenamed("full_text", "clean_text")


QUERIES = {"p2_found": p2_found, "p2_cleaned": p2_cleaned}
_KEYED = r"""
WITH l AS (
  SELECT article_id, domain, unnest(string_split(full_text, chr(10))) AS line,
    unnest(range(1, len(string_split(full_text, chr(10))) + 1)) AS line_no
  FROM fulltext WHERE domain IS NOT NULL AND trim(domain) <> ''
), k AS (
  SELECT *, regexp_replace(regexp_replace(lower(line), '[\p{N}\s\p{Z}]', '', 'g'), '[\p{P}\p{S}]+$', '') AS key
  FROM l WHERE regexp_replace(line, '[\s\p{Z}]', '', 'g') <> ''
), n AS (SELECT domain, count(*) AS n FROM fulltext WHERE domain IS NOT NULL GROUP BY 1
), hot AS (
  SELECT domain, key FROM k JOIN n USING (domain) GROUP BY domain, key, n
  HAVING count(DISTINCT article_id) >= 6 AND count(DISTINCT article_id) >= 0.2 * n
)
"""
ORACLE = {
    "p2_found": _KEYED + "SELECT article_id, line_no::INTEGER AS line_no FROM k JOIN hot USING (domain, key)",
    "p2_cleaned": _KEYED
    + """, cases AS (SELECT article_id, list(line_no) AS dropped FROM k JOIN hot USING (domain, key) GROUP BY 1)
SELECT f.article_id, CASE WHEN dropped IS NULL THEN full_text ELSE array_to_string(
  list_filter(string_split(full_text, chr(10)), lambda x, i: NOT list_contains(dropped, i)), chr(10)) END AS clean_text
FROM fulltext f LEFT JOIN cases USING (article_id)""",
}
