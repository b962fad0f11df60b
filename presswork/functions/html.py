"""HTML functions; page trees need a parser, so these are Arrow-batched Python functions over the standard library."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: structured-data types that mark an article
ARTICLE_TYPES = {"article", "newsarticle", "report", "analysisnewsarticle", "liveblogposting"}
# fixed values: elements without article text
SKIPPED = {"script", "style", "noscript", "nav", "footer", "aside", "iframe", "form", "button", "input", "svg", "canvas"}
# fixed values: parts of class or id names that mark boilerplate, and elements that no such name removes
BOILERPLATE_HINTS = ["cookie", "consent", "subscribe", "newsletter", "advert", "ads", "promo", "share", "social", "related", "recommended", "breadcrumb", "menu", "header", "footer", "sidebar"]
NEVER_BOILERPLATE = {"html", "body", "article", "main"}
#: Characters of a paragraph that counts for its container, of a paragraph where no container does, and of an article.
LONG_PARAGRAPH, SHORT_PARAGRAPH, LEAST_TEXT = 40, 30, 250


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        self.parts.append(" ")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def strip_tags(html: str | None) -> str:
    """All text of a fragment, white space collapsed."""
    if not html:
        return ""
    p = _Text()
    p.feed(html)
    p.close()
    return " ".join("".join(p.parts).split())


class _Page(HTMLParser):
    """Collects metadata, structured data and candidate containers in one pass."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    CLOSES_P = {"p", "div", "section", "article", "main", "aside", "nav", "header", "footer", "form", "ul", "ol", "dl", "table", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.lang = self.title = self.canonical = self.time = ""
        self.stack: list[dict] = []
        self.blocks: list[dict] = []
        self.ld: list[str] = []
        self.paragraphs: list[str] = []
        #: texts of all paragraphs, boilerplate or not, and whether an article holds them
        self.every: list[tuple[bool, str]] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang", "")
        elif tag == "meta":
            name = (a.get("property") or a.get("name") or a.get("itemprop") or "").lower()
            if name:
                self.meta.setdefault(name, a.get("content", ""))
        elif tag == "link" and "canonical" in a.get("rel", "").lower():
            self.canonical = self.canonical or a.get("href", "")
        elif tag == "time":
            self.time = self.time or a.get("datetime", "")
        if tag in self.VOID:
            return
        if tag in self.CLOSES_P and any(e["tag"] == "p" for e in self.stack):
            self.handle_endtag("p")  # a paragraph ends where the next block begins
        hint = f"{a.get('class', '')} {a.get('id', '')}".lower()
        parent_bad = bool(self.stack and self.stack[-1]["bad"])
        bad = parent_bad or tag in SKIPPED or (tag not in NEVER_BOILERPLATE and any(h in hint for h in BOILERPLATE_HINTS))
        inside = tag == "article" or bool(self.stack and self.stack[-1]["article"])
        self.stack.append({"tag": tag, "bad": bad, "article": inside, "type": a.get("type", ""), "text": [], "raw": [], "paras": [], "link": 0})

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i]["tag"] == tag), None)
        if at is None:
            return
        while len(self.stack) > at:
            self._pop()

    def _pop(self):
        e = self.stack.pop()
        text = " ".join("".join(e["text"]).split())
        if e["tag"] == "title" and not self.title:
            self.title = text
        elif e["tag"] == "script" and "ld+json" in e["type"]:
            self.ld.append("".join(e["text"]))
        if e["tag"] == "p":
            whole = " ".join("".join(e["raw"]).split())
            if whole:
                self.every.append((e["article"], whole))
            if not e["bad"] and text:
                self.paragraphs.append(text)
                e["paras"].append(text)
        if e["tag"] in ("article", "main", "section", "div") and not e["bad"]:
            self.blocks.append({**e, "text": text})
        if self.stack:
            up = self.stack[-1]
            if e["tag"] not in ("script", "style", "title"):
                up["raw"] += [" ", *e["raw"], " "]
                if not e["bad"]:
                    up["text"] += [" ", *e["text"], " "]
                    up["paras"] += e["paras"]
                    up["link"] += len(text) if e["tag"] == "a" else e["link"]

    def handle_data(self, data):
        if self.stack:
            self.stack[-1]["text"].append(data)
            self.stack[-1]["raw"].append(data)

    def finish(self):
        while self.stack:
            self._pop()


def _article_data(scripts: list[str]) -> dict:
    """The first article object of structured data: an object, a list, or inside any @graph."""

    def found(x):
        if isinstance(x, list):
            return next((y for y in map(found, x) if y), None)
        if isinstance(x, dict):
            kinds = x.get("@type")
            kinds = kinds if isinstance(kinds, list) else [kinds]
            if any(str(k).lower() in ARTICLE_TYPES for k in kinds):
                return x
            return found(x.get("@graph")) if "@graph" in x else None
        return None

    for s in scripts:
        try:
            hit = found(json.loads(s))
        except ValueError:
            continue
        if hit:
            return hit
    return {}


def _authors(data: dict, meta: dict[str, str]) -> list[str]:
    raw = data.get("author") or []
    raw = raw if isinstance(raw, list) else [raw]
    names = [str(x.get("name", "")) if isinstance(x, dict) else str(x) for x in raw]
    for key in ("author", "article:author"):
        names += meta.get(key, "").replace(";", "|").replace(",", "|").split("|")
    out: dict[str, str] = {}
    for n in (" ".join(x.split()) for x in names):
        if n:
            out.setdefault(n.lower(), n)
    return list(out.values())


def density_text(page: _Page, least: int = LEAST_TEXT) -> str:
    """Paragraphs of the container with the best score, of those with enough text; else all paragraphs that are not short.

    The score counts characters and number of paragraphs, their punctuation and their share of the container's text, less
    the share of links in it.
    """

    def scored(b: dict) -> tuple[float, str]:
        long = [p for p in b["paras"] if len(p) >= LONG_PARAGRAPH]
        text = "\n\n".join(long)
        size = max(1, len(b["text"]))
        marks = sum(text.count(x) for x in ".,;:!?")
        return len(text) + 120 * len(long) + 1.5 * marks + 400 * len(text) / size - 500 * b["link"] / size, text

    best = max((x for x in map(scored, page.blocks) if len(x[1]) >= least), key=lambda x: x[0], default=None)
    return " ".join((best[1] if best else "\n\n".join(p for p in page.paragraphs if len(p) >= SHORT_PARAGRAPH)).split())


def _parsed(html: str | None) -> _Page:
    p = _Page()
    p.feed(html or "")
    p.close()
    p.finish()
    return p


def article_paragraphs(html: str | None) -> str:
    """All paragraphs inside articles, or of the whole page if there is none, blank lines between them."""
    every = _parsed(html).every
    return "\n\n".join(t for inside, t in every if inside) or "\n\n".join(t for _, t in every)


def published_date(html: str | None) -> str:
    """Date of a page as it says: published time, date or pubdate of its head, first time element, structured data."""
    p = _parsed(html)
    data = _article_data(p.ld)
    chain = [p.meta.get("article:published_time"), p.meta.get("date"), p.meta.get("pubdate"), p.time, data.get("datePublished")]
    return next((str(x) for x in chain if x), "")


def extracted(html: str | None, fallbacks: dict[str, Callable[[str], str]] | None = None, least: int = LEAST_TEXT) -> tuple[str, str, str]:
    """(title, text, method): by density; where that is too short, the longest text of it and the fallbacks in order. A
    page that asks for consent has none. Fallbacks are functions of the page by name; paragraphs of articles by default."""
    low = (html or "").lower()
    if "before you continue to google" in low:
        return "blocked_interstitial", "", "interstitial_blocked"
    page = _parsed(html)
    title = page.meta.get("og:title") or page.meta.get("twitter:title") or page.title
    text, method = density_text(page, least), "density"
    if len(text) < least:
        for name, read in (fallbacks if fallbacks is not None else {"article_paragraphs": article_paragraphs}).items():
            other = " ".join(read(html or "").split())
            if len(other) > len(text):
                text, method = other, name
    return " ".join(title.split()), text, method


PAGE_FIELDS = T.StructType([
    T.StructField("canonical_url", T.StringType()), T.StructField("page_title", T.StringType()), T.StructField("published_at", T.StringType()),
    T.StructField("language", T.StringType()), T.StructField("authors", T.StringType()), T.StructField("text", T.StringType()),
])


def read_page(html: str | None, final_url: str | None = "") -> dict[str, str]:
    """Metadata and main text of a page, each by its chain of sources; empty strings where there is none."""
    p = _parsed(html)
    m, data = p.meta, _article_data(p.ld)
    first = lambda *xs: next((" ".join(str(x).split()) for x in xs if x and str(x).strip()), "")
    return {
        "canonical_url": first(m.get("og:url"), p.canonical, final_url),
        "page_title": first(m.get("og:title"), m.get("twitter:title"), data.get("headline"), p.title),
        "published_at": first(data.get("datePublished"), m.get("article:published_time"), m.get("datepublished"), m.get("pubdate"), m.get("date"), p.time),
        "language": first(p.lang, m.get("og:locale"), m.get("language")),
        "authors": " | ".join(_authors(data, m)),
        "text": density_text(p),
    }


def cards(html: str | None, item: str, title: str, kind: str, info: str, label: str, value: str, wanted: str) -> list[dict[str, str]]:
    """(title, url, kind, value) of each card of a list page; classes name the parts of a card, `wanted` the label whose
    value is taken. Cards without a title or an address are left out."""

    class Cards(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.out: list[dict] = []
            self.stack: list[tuple[str, list[str]]] = []
            self.label = ""

        def handle_starttag(self, tag, attrs):
            if tag in _Page.VOID:
                return
            a = dict(attrs)
            classes = (a.get("class") or "").split()
            self.stack.append((tag, classes))
            if item in classes:
                self.out.append({"title": "", "url": "", "kind": "", "value": ""})
            if info in classes:
                self.label = ""
            if self.out and tag == "a" and self.within(title) and not self.out[-1]["url"]:
                self.out[-1]["url"] = (a.get("href") or "").strip()

        def handle_endtag(self, tag):
            at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
            if at is not None:
                del self.stack[at:]

        def within(self, name: str) -> bool:
            return any(name in c for _, c in self.stack)

        def handle_data(self, data):
            if not self.out or not self.within(item):
                return
            card = self.out[-1]
            if self.within(label):
                self.label += data
            elif self.within(value) and " ".join(self.label.split()).lower() == wanted.lower():
                card["value"] += data
            elif self.within(title):
                card["title"] += data
            elif self.within(kind):
                card["kind"] += data

    p = Cards()
    p.feed(html or "")
    p.close()
    clean = [{k: " ".join(v.split()) for k, v in c.items()} for c in p.out]
    return [c for c in clean if c["title"] and c["url"]]


def top_group(kinds: list[str], groups: tuple[str, ...] = ("aquatic", "terrestrial")) -> str:
    """The first group that a kind begins with, unknown if none does."""
    return next((g for k in kinds for g in groups if " ".join(k.split()).lower().startswith(g)), "unknown")


@F.pandas_udf(T.StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(strip_tags)


@F.pandas_udf(PAGE_FIELDS)
def page_fields(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    rows = [read_page(h if isinstance(h, str) else None, u if isinstance(u, str) else "") for h, u in zip(html, url)]
    return pd.DataFrame(rows, columns=[f.name for f in PAGE_FIELDS])


# fixed values: texts of pages that refuse automated readers
THROTTLE_PATTERNS = [
    r"<title>\s*sorry", "unusual traffic from your computer network", "our systems have detected unusual traffic", "/sorry/",
    "to continue, please type the characters below", "detected unusual traffic", "captcha",
]


def throttled(status: Column, url: Column, body: Column) -> Column:
    """HTTP status 429 or 503, or a refusal in the URL or the first 4000 characters of the body (the rule's own limit)."""
    head = F.concat_ws("\n", F.coalesce(url, F.lit("")), F.left(F.coalesce(body, F.lit("")), F.lit(4000)))
    return F.coalesce(status.isin(429, 503), F.lit(False)) | head.rlike("(?i)" + "|".join(THROTTLE_PATTERNS))
