"""Bar charts of small report tables as SVG text, one panel per facet; drawn on the driver from rows already counted."""

from __future__ import annotations

from xml.sax.saxutils import escape


def facet_bars(rows: list[tuple[str, str, float]], title: str = "", width: int = 640, bar: int = 16) -> str:
    """SVG of (facet, label, value) rows in their order; all panels share one scale, values below 0 have no bar."""
    facets: dict[str, list[tuple[str, float]]] = {}
    for facet, label, value in rows:
        facets.setdefault(facet, []).append((label, float(value or 0)))
    most = max((v for bars in facets.values() for _, v in bars), default=0.0) or 1.0
    left, room, y, out = 160, width - 260, 24, []
    if title:
        out.append(f'<text x="0" y="16" font-weight="bold">{escape(title)}</text>')
        y += 16
    for facet, bars in facets.items():
        out.append(f'<text x="0" y="{y}" font-weight="bold">{escape(facet)}</text>')
        for label, value in bars:
            y += bar + 4
            size = max(0.0, value) / most * room
            out.append(f'<text x="{left - 6}" y="{y}" text-anchor="end">{escape(label)}</text><rect x="{left}" y="{y - bar + 4}" width="{size:.1f}" height="{bar}"/><text x="{left + size + 6:.1f}" y="{y}">{value:g}</text>')
        y += bar + 16
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{y}" font-family="sans-serif" font-size="12">{"".join(out)}</svg>'
