"""Bar and pie charts of small results as SVG text, without a plotting library."""

from __future__ import annotations

import math
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Colours of bars and slices in turn.
COLOURS = ["#3b6ea5", "#c8553d", "#588157", "#e0a030", "#7a5195", "#2a9d8f", "#8d6e63", "#6c757d"]


def top(df: DataFrame, label: str, value: str, k: int) -> list[tuple[str, float]]:
    """The k rows of largest value (ties by label), a chart's whole data; null values come last and count as 0."""
    rows = df.select(F.col(label).cast("string").alias("l"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    return [(r.l if r.l is not None else "", r.v) for r in rows.orderBy(F.desc("v"), "l").limit(k).collect()]


def _svg(width: int, height: int, title: str, body: list[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12">'
    return "\n".join([head, f'<text x="10" y="20" font-size="15">{escape(title)}</text>', *body, "</svg>"])


def bar_chart(df: DataFrame, label: str, value: str, title: str, k: int = 15) -> str:
    """Horizontal bars, the largest first; no rows give a chart with its title only."""
    data = top(df, label, value, k)
    most = max((v for _, v in data), default=0.0) or 1.0
    body = []
    for i, (name, v) in enumerate(data):
        y = 40 + 24 * i
        width = max(v, 0.0) / most * 360
        body.append(f'<text x="190" y="{y + 13}" text-anchor="end">{escape(name)}</text><rect x="200" y="{y}" width="{width:.2f}" height="18" fill="{COLOURS[0]}"/><text x="{205 + width:.2f}" y="{y + 13}">{v:g}</text>')
    return _svg(640, 50 + 24 * len(data), title, body)


def pie_chart(df: DataFrame, label: str, value: str, title: str, k: int = 8) -> str:
    """Slices by share of the shown total, clockwise from the top; a lone slice is a circle."""
    data = [(name, v) for name, v in top(df, label, value, k) if v > 0]
    total = sum(v for _, v in data)
    body, at = [], 0.0
    for i, (name, v) in enumerate(data):
        colour, share = COLOURS[i % len(COLOURS)], v / total
        if len(data) == 1:
            body.append(f'<circle cx="150" cy="160" r="110" fill="{colour}"/>')
        else:
            ends = [(150 + 110 * math.sin(2 * math.pi * t), 160 - 110 * math.cos(2 * math.pi * t)) for t in (at, at + share)]
            body.append(f'<path d="M150 160 L{ends[0][0]:.2f} {ends[0][1]:.2f} A110 110 0 {int(share > 0.5)} 1 {ends[1][0]:.2f} {ends[1][1]:.2f} Z" fill="{colour}"/>')
        body.append(f'<rect x="290" y="{52 + 22 * i}" width="12" height="12" fill="{colour}"/><text x="310" y="{63 + 22 * i}">{escape(name)} {100 * share:.1f}%</text>')
        at += share
    return _svg(560, max(290, 60 + 22 * len(data)), title, body)


def save_figure(svg: str, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(svg, encoding="utf-8")
