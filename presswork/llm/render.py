"""Layout-aware rendering: a tree of blocks from markup, and the visible text it shows.

The builder knows which tags imply the end of others (a paragraph ends where a block begins, a list item where the next
one does, a cell where its row ends) and which content is never visible (scripts, styles, hidden elements). The renderer
emits all visible text: one line per block, a blank line between paragraphs, list marks with their nesting, and tables
with aligned columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNSEEN = {"script", "style", "template", "head", "title", "noscript", "svg", "math", "object", "iframe", "canvas", "datalist", "audio", "video"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Blocks with space around them.
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "blockquote", "pre", "figure"}
#: A start tag of the key closes open elements of the values, up to the boundary named last.
IMPLIED_END: dict[str, tuple[set[str], set[str]]] = {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def hidden(self) -> bool:
        style = self.attrs.get("style", "").replace(" ", "").lower()
        return (
            self.tag in UNSEEN
            or "hidden" in self.attrs
            or self.attrs.get("aria-hidden") == "true"
            or "display:none" in style
            or "visibility:hidden" in style
            or (self.tag == "input" and self.attrs.get("type") == "hidden")
        )


class TreeBuilder(HTMLParser):
    """Builds the tree; end tags that fit nothing open are ignored, open elements end with their parent."""

    def __init__(self, marked: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.marked = marked
        self.root = Node("html")
        self.stack = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and len(self.stack) > 1 and tag == self.stack[1].tag:
            return
        if tag in BLOCKS and tag not in ("li", "dd", "dt", "td", "th", "tr"):
            self._close({"p"}, BLOCKS - {"p"})
        if tag in IMPLIED_END:
            self._close(*IMPLIED_END[tag])
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.marked:
            first = self.getpos()[0]
            data = "\n".join(re.sub(r"\S", lambda m: f"\ue000{first + k}\ue001{m[0]}", x, count=1) for k, x in enumerate(data.split("\n")))
        self.stack[-1].children.append(data)

    def _close(self, tags: set[str], boundary: set[str]) -> None:
        """End the outermost open element of `tags` that lies inside the innermost boundary."""
        cut = None
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                cut = i
            elif self.stack[i].tag in boundary:
                break
        if cut is not None:
            del self.stack[cut:]


def parse(html: str, marked: bool = False) -> Node:
    builder = TreeBuilder(marked)
    builder.feed(html)
    builder.close()
    return builder.root


class _Lines:
    def __init__(self) -> None:
        self.out: list[str] = []
        self.open = ""
        self.gap = False

    def text(self, s: str) -> None:
        if self.open and s and not self.open[-1].isspace() and not s[0].isspace():
            self.open += s
        else:
            self.open += s if self.open else s.lstrip()

    def line(self, mark: str = "") -> None:
        shown = " ".join(self.open.split())
        self.open = ""
        if shown:
            if self.gap and self.out:
                self.out.append("")
            self.gap = False
            self.out.append(mark + shown)

    def space(self) -> None:
        self.gap = True


def _flat(node: Node) -> str:
    parts = []
    for c in node.children:
        if isinstance(c, str):
            parts.append(c)
        elif not c.hidden():
            parts.append(" " if c.tag == "br" else _flat(c) if c.tag not in BLOCKS else f" {_flat(c)} ")
    return "".join(parts)


def _rows(node: Node) -> list[list[str]]:
    rows = []
    for c in node.children:
        if isinstance(c, Node) and not c.hidden():
            if c.tag == "tr":
                rows.append([" ".join(_flat(x).split()) for x in c.children if isinstance(x, Node) and x.tag in ("td", "th") and not x.hidden()])
            elif c.tag in ("thead", "tbody", "tfoot"):
                rows += _rows(c)
    return rows


def _emit(node: Node, to: _Lines, mark: str, depth: int) -> None:
    for c in node.children:
        if isinstance(c, str):
            to.text(c)
            continue
        if c.hidden():
            continue
        if c.tag == "br":
            to.line(mark)
            continue
        if c.tag not in BLOCKS:
            _emit(c, to, mark, depth)
            continue
        to.line(mark)
        if c.tag in SPACED and not (c.tag in ("ul", "ol") and depth):
            to.space()
        if c.tag == "table":
            rows = _rows(c)
            widths = [max((len(r[i]) for r in rows if i < len(r)), default=0) for i in range(max(map(len, rows), default=0))]
            for r in rows:
                to.text("\0".join(x.ljust(w) for x, w in zip(r, widths)))
                shown, to.open = to.open, ""
                if shown.strip("\0 "):
                    if to.gap and to.out:
                        to.out.append("")
                    to.gap = False
                    to.out.append(shown.replace("\0", "  ").rstrip())
        elif c.tag == "pre":
            for row in _flat(c).strip("\n").split("\n"):
                to.out.append(row)
        elif c.tag in ("ul", "ol"):
            n = 0
            for item in c.children:
                if isinstance(item, Node) and item.tag == "li" and not item.hidden():
                    n += 1
                    _emit(item, to, "  " * depth + (f"{n}. " if c.tag == "ol" else "- "), depth + 1)
                    to.line("  " * depth + (f"{n}. " if c.tag == "ol" else "- "))
        else:
            _emit(c, to, mark, depth)
            to.line(mark)
        if c.tag in SPACED and not (c.tag in ("ul", "ol") and depth):
            to.space()


def render(html: str) -> str:
    """Visible text of markup, one line per block."""
    to = _Lines()
    _emit(parse(html), to, "", 0)
    to.line()
    return "\n".join(to.out)


def source_lines(html: str) -> list[set[int]]:
    """Numbers (from 1) of the source lines that each line of render() shows."""
    to = _Lines()
    _emit(parse(html, marked=True), to, "", 0)
    to.line()
    return [{int(n) for n in re.findall("\ue000(\\d+)\ue001", x)} for x in to.out]
