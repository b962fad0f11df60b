"""Problem 7: the main body of each page without the furniture of its site.

Pages are rendered to visible blocks (render.py; text that is rendered already has one block per line). The blocks are
put into a tree of banner, article and footer: the article begins at the page's own headline, which names what the last
part of the page's address names, and ends at its last paragraph or list. Inside it the visibility rules drop what sends
the reader elsewhere: teasers, headings of link lists, notices. Whether a short line is a subhead or such a heading, and
whether a sentence is a notice, is learned from the page's site: how many of its articles have the line, and what follows it.
Short lines are also judged by all sites that have them, as a site may have one too rarely to tell.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.render import render, source_lines
from presswork.session import read_table, written

#: A line is recurrent within a site if at least this share of the site's articles, and MIN_PAGES, have it; over all sites a
#: short line is if MIN_PAGES articles of MIN_SITES sites have it. None of this depends on the number of pages or sites.
SITE_SHARE, MIN_PAGES, MIN_SITES = 0.01, 3, 3
#: Share of a recurrent short line's occurrences that must be followed by a paragraph or list for it to be a subhead.
SUBHEAD_SHARE = 0.85
#: Words from which on a line with a sentence's end is prose; words of a subhead: of one that recurs, and of one that stands
#: nowhere else, between two blocks of the article. Longer lines that are no sentences are taken for teasers.
MIN_SENTENCE, MAX_SUBHEAD, MAX_OWN_SUBHEAD = 4, 8, 6

PROSE_END = ".?!…»\"”’'"
BULLETS = "-•*–▪·"
NUMBERS = r"\d+(?:[.,]\d+)*"
#: A sentence with two of these, on a page of any corpus, is a notice on data and consent.
CONSENT = r"(?i)\b(cookies?|traceurs|rastreadores)\b.*\b(policy|politique|pol[íi]tica|agree|acceptez|acepta|aceita)\b|\byour privacy\b|\bvotre vie privée\b|\bsu privacidad\b|\bsua privacidade\b"

#: A text is markup if it begins with a tag or ends an element; one that merely mentions a tag is not.
MARKUP = r"(?i)^\s*<(?:!doctype|!--|[a-z])|</(?:html|body|div|p|ul|ol|table|article|section|main)\s*>"

HEADLINE, PROSE, LIST, OTHER, BLANK = "h", "p", "l", "o", "b"


@functools.cache
def _pattern(text: str):
    import regex

    return regex.compile(text)


class PageTree:
    """Blocks of one page with their kinds."""

    def __init__(self, text: str, url: str | None):
        self.text, self.markup = text, "<" in text and bool(_pattern(MARKUP).search(text))
        self.shown = (render(text) if self.markup else text).split("\n")
        self.lines = [x.strip() for x in self.shown]
        numbers = _pattern(NUMBERS).sub
        self.keys = [numbers("0", x).lower() if x else x for x in self.lines]
        self.kinds = [self.kind(x) for x in self.lines]
        self.slug = self._slug(url)

    @staticmethod
    def _slug(url: str | None) -> list[str]:
        """Words of the last part of the address, lower case, without numbers and one-letter words."""
        path = _pattern(r"[?#].*$").sub("", (url or "").strip()).rstrip("/")
        path = _pattern(r"^(?:[a-zA-Z]+:)?//[^/]*").sub("", path)
        last = path.rsplit("/", 1)[-1].lower()
        return [w for w in _pattern(r"[^\p{L}]+").split(_pattern(r"\.\w{2,5}$").sub("", last)) if len(w) > 1]

    @staticmethod
    def kind(line: str) -> str:
        if not line:
            return BLANK
        words = line.split()
        if line[0] in BULLETS and len(words) > 1 and len(words[0]) == 1:
            return LIST
        if line[-1] in PROSE_END and len(words) >= MIN_SENTENCE:
            return PROSE
        return OTHER

    def content_after(self, i: int) -> bool:
        """The next block that is not blank is a paragraph or a list."""
        after = next((k for k in itertools.islice(self.kinds, i + 1, None) if k != BLANK), BLANK)
        return after in (PROSE, LIST)

    def observations(self) -> Iterator[tuple[str, int, int]]:
        """(key, is sentence, followed by content) of each distinct line that could recur."""
        seen = set()
        for i, (key, kind) in enumerate(zip(self.keys, self.kinds)):
            if kind in (PROSE, OTHER) and key not in seen and (kind == PROSE or len(key.split()) <= MAX_SUBHEAD):
                seen.add(key)
                yield key, int(kind == PROSE), int(self.content_after(i))

    def furniture(self, notices: set[int], subheads: set[int], recurrent: set[int]) -> list[int]:
        """Numbers (from 1) of the non-blank lines of the text that show nothing of the page's own article."""
        keep = self.article(notices, subheads, recurrent)
        if not self.markup:
            return [i + 1 for i, k in enumerate(self.kinds) if k != BLANK and i not in keep]
        sources = source_lines(self.text)
        kept = {n for i in keep for n in sources[i]}
        return [n for n, x in enumerate(self.text.split("\n"), 1) if x.strip() and n not in kept]

    def main_text(self, notices: set[int], subheads: set[int], recurrent: set[int]) -> str:
        """The shown lines of the page's own article."""
        keep = self.article(notices, subheads, recurrent)
        body = "\n".join(x for i, x in enumerate(self.shown) if i in keep or self.kinds[i] == BLANK)
        return re.sub("\n{3,}", "\n\n", body).strip("\n " if self.markup else " ")

    def article(self, notices: set[int], subheads: set[int], recurrent: set[int]) -> set[int]:
        """Places of the shown lines that are the page's own article."""
        n = len(self.lines)
        consent = _pattern(CONSENT)
        own = [k in (PROSE, LIST) and (not notices or _hash(key) not in notices) and not (k == PROSE and consent.search(x)) for k, key, x in zip(self.kinds, self.keys, self.lines)]
        body = [i for i in range(n) if own[i]]
        head = self._headline(body)
        if head is None and (self.slug or not body):
            # an address whose words no headline has: nothing but paragraphs can show an article
            body = [i for i in body if self.kinds[i] == PROSE]
        start = head if head is not None else (body[0] if body else n)
        body = [i for i in body if i >= start]
        end = body[-1] if body else start
        keep = set()
        if head is not None:
            keep.add(head)
        for i in body:
            keep.add(i)
        for i in range(start + 1, end):
            if self.kinds[i] != OTHER or i in keep:
                continue
            key = self.keys[i]
            h = _hash(key)
            if h in subheads:
                keep.add(i)
            elif h not in recurrent and len(key.split()) <= MAX_SUBHEAD and ":" not in key and self._between(i, own):
                keep.add(i)
        return keep

    def _between(self, i: int, own: list[bool]) -> bool:
        """A rare short line counts as subhead only with the article's own blocks directly before and after it."""
        before = next((j for j in range(i - 1, -1, -1) if self.kinds[j] != BLANK), None)
        after = next((j for j in range(i + 1, len(own)) if self.kinds[j] != BLANK), None)
        return before is not None and after is not None and own[before] and own[after] and len(self.keys[i].split()) <= MAX_OWN_SUBHEAD

    def _headline(self, body: list[int]) -> int | None:
        """The first line that is no sentence and has the words of the address in their order; without an address, the
        last longer line before the first paragraph that shares a name with the paragraphs."""
        if self.slug:
            want = " ".join(self.slug)
            for i, k in enumerate(self.kinds):
                if k not in (BLANK, LIST):
                    flat = " ".join(_pattern(r"[^\p{L}]+").split(self.lines[i].lower()))
                    if want in flat and (not body or i <= body[0]):
                        return i
            return None
        if not body:
            return None
        names = set(_pattern(r"\p{Lu}\p{L}+(?:-\p{L}+)+").findall(" ".join(self.lines[i] for i in body)))
        # a path or bar of links has marks between its parts
        plain = [i for i in range(body[0]) if self.kinds[i] == OTHER and not _pattern(r"\s[>»›/|·]\s").search(self.lines[i])]
        candidates = [i for i in plain if len(self.lines[i].split()) > MIN_SENTENCE]
        sharing = [i for i in candidates if any(x in self.lines[i] for x in names)]
        return sharing[-1] if sharing else candidates[-1] if candidates else None


def _hash(key: str) -> int:
    """64-bit hash of a line's key, signed as Spark has it."""
    import xxhash

    return int.from_bytes(xxhash.xxh64_digest(key), "big", signed=True)


def site(url: Column) -> Column:
    """Host of an address in lower case without "www.", NULL where there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"^(?:[a-zA-Z]+:)?//([^/?#]+)", 1)), r"^www\.", ""), F.lit(""))


def observed(pages: DataFrame, id_col: str, url: str, text: str) -> DataFrame:
    """(page, site, h, sentence, article, followed): the lines of each page that could recur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, at = [[], [], [], [], []], []
            for i, (u, t) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                if t:
                    tree = PageTree(t, u)
                    article = _hash(" ".join(tree.slug) or t)
                    for key, sentence, followed in tree.observations():
                        at.append(i)
                        for values, v in zip(out, (_hash(key), sentence, article, followed)):
                            values.append(v)
            rows = pa.array(at, pa.int64())
            columns = [b.column(0).take(rows), b.column(1).take(rows)] + [pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["page", "site", "h", "sentence", "article", "followed"])

    kind = dict(pages.dtypes)[id_col]
    rows = pages.select(F.col(id_col).alias("page"), site(F.col(url)).alias("site"), url, text)
    return rows.mapInArrow(run, f"page {kind}, site string, h long, sentence int, article long, followed int")


def _sums(each: DataFrame, by: list[str]) -> DataFrame:
    """A line counts once per article, that is per last part of the address, so that an article copied to a third of all
    pages makes none of its own sentences recurrent. `followed` counts the articles in which content follows the line."""
    once = each.groupBy(*by, "h", "sentence", "article").agg(F.max("followed").alias("followed"))
    return once.groupBy(*by, "h", "sentence").agg(F.count(F.lit(1)).alias("articles"), F.sum("followed").alias("followed")).where(F.col("articles") >= MIN_PAGES)


def wide_statistics(each: DataFrame) -> DataFrame:
    """(h, articles, followed): short lines that several sites have, by hash, over all their articles."""
    short = each.where("sentence = 0")
    sites = short.where("site IS NOT NULL").select("h", "site").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= MIN_SITES)
    return _sums(short, []).drop("sentence").join(sites, "h").drop("sites")


def site_statistics(each: DataFrame) -> DataFrame:
    """(site, h, sentence, articles, followed): recurrent lines of each site, over its own articles."""
    known = each.where("site IS NOT NULL")
    totals = known.select("site", "article").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("total"))
    return _sums(known, ["site"]).join(totals, "site").where(F.col("articles") >= F.col("total") * F.lit(SITE_SHARE)).drop("total")


def judged_lines(each: DataFrame) -> DataFrame:
    """(page, notices, subheads, recurrent): hashes of the recurrent lines of each page by what they are there.

    A short line is no subhead if its site or the sites together take it for another heading. The tables of recurrent lines
    have no small bound; they are joined by key, and a page gets its own few lines.
    """
    headed = F.col("followed") >= SUBHEAD_SHARE * F.col("articles")
    own = site_statistics(each).select("site", "h", "sentence", F.when(F.col("sentence") == 1, 0).when(headed, 1).otherwise(2).alias("own"))
    wide = wide_statistics(each).select("h", F.lit(0).alias("sentence"), F.when(headed, 1).otherwise(2).alias("wide"))
    rows = each.select("page", "site", "h", "sentence").join(own, ["site", "h", "sentence"], "left").join(wide, ["h", "sentence"], "left")
    rows = rows.select("page", "h", F.greatest("own", "wide").alias("kind")).where("kind IS NOT NULL")
    return rows.groupBy("page").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("h"))).alias(n) for k, n in enumerate(("notices", "subheads", "recurrent"))])


def _per_page(pages: DataFrame, id_col: str, url: str, text: str, of: Callable, column: str, arrow: pa.DataType) -> DataFrame:
    """(id, column): a row for each value that of(tree, notices, subheads, recurrent) gives; tree is None without text."""
    each = written(observed(pages, id_col, url, text), "observed")
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for key, u, t, *known in zip(*[c.to_pylist() for c in b.columns]):
                got = of(PageTree(t, u) if t else None, *(set(x or ()) for x in known))
                ids += [key] * len(got)
                out += got
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(out, arrow)], names=[id_col, column])

    slim = pages.select(F.col(id_col).alias("__id"), F.col(url).alias("__url"), F.col(text).alias("__text"))
    rows = slim.join(judged_lines(each), F.col("__id") == F.col("page"), "left").drop("page")
    return rows.mapInArrow(run, f"`{id_col}` {kind}, {column} {'int' if arrow == pa.int32() else 'string'}")


def furniture_lines(pages: DataFrame, id_col: str = "page_id", url: str = "final_url", text: str = "full_text") -> DataFrame:
    """(page_id, line_no): non-blank lines that are not headline, subhead, list or paragraph of the page's own article.

    NULL and empty texts have no lines. A page without an article is furniture throughout. On a page of markup a line of
    the text is furniture if no block of the article shows any of it.
    """
    return _per_page(pages, id_col, url, text, lambda tree, *known: tree.furniture(*known) if tree else [], "line_no", pa.int32())


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "final_url", text: str = "full_text") -> DataFrame:
    """(page_id, main_text): headline and article body of each page as they show; empty where a page has no article."""
    return _per_page(pages, id_col, url, text, lambda tree, *known: [tree.main_text(*known) if tree else ""], "main_text", pa.string())


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture_lines(read_table(spark, sf_dir, "page_texts").select("page_id", "final_url", "full_text"))


def p7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "page_texts").select("page_id", "final_url", "full_text"))


QUERIES = {"p7_found": p7_found, "p7_main_text": p7_main_text}
ORACLE: dict[str, str] = {}
