"""A safe subset of Markdown as HTML, row by row in Arrow batches."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE = re.compile(r"(?i)^(?:https?:|mailto:|#|/|\.{0,2}/|[^:]*$)")


def inline(text: str) -> str:
    """Code, emphasis and links of a line; everything else is escaped, unsafe targets are dropped."""
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x00{len(kept) - 1}\x00"

    t = re.sub(r"`([^`]+)`", lambda m: keep(f"<code>{html.escape(m[1])}</code>"), text.replace("\x00", ""))
    t = re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", lambda m: keep(f'<a href="{html.escape(m[2])}">{html.escape(m[1])}</a>') if SAFE.match(m[2]) else m[1], t)
    t = html.escape(t)
    t = re.sub(r"\*\*(?=\S)(.+?)(?<=\S)\*\*", r"<strong>\1</strong>", t)
    t = re.sub(r"(?<![\w*])\*(?=\S)([^*]+?)(?<=\S)\*(?![\w*])", r"<em>\1</em>", t)
    return re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], t)


def render(text: str | None) -> str | None:
    """Headings, lists, quotes, tables, fenced code and paragraphs; null stays null."""
    if text is None:
        return None
    out, lines, i = [], text.replace("\r\n", "\n").split("\n"), 0
    while i < len(lines):
        x = lines[i]
        if x.startswith("```"):
            end = next((j for j in range(i + 1, len(lines)) if lines[j].startswith("```")), len(lines))
            out.append("<pre><code>" + html.escape("\n".join(lines[i + 1 : end])) + "</code></pre>")
            i = end + 1
        elif m := re.match(r"(#{1,6})\s+(.*)", x):
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
            i += 1
        elif re.match(r"\s*(?:[-*+]|\d+[.)])\s+", x):
            tag = "ol" if re.match(r"\s*\d", x) else "ul"
            items = []
            while i < len(lines) and (m := re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", lines[i])):
                items.append(f"<li>{inline(m[1])}</li>")
                i += 1
            out.append(f"<{tag}>{''.join(items)}</{tag}>")
        elif x.startswith(">"):
            quoted = []
            while i < len(lines) and lines[i].startswith(">"):
                quoted.append(lines[i].lstrip("> "))
                i += 1
            out.append(f"<blockquote>{inline(' '.join(quoted))}</blockquote>")
        elif "|" in x and i + 1 < len(lines) and re.match(r"\s*\|?\s*:?-{2,}", lines[i + 1]):
            cells = lambda r: [c.strip() for c in r.strip().strip("|").split("|")]
            rows = ["<tr>" + "".join(f"<th>{inline(c)}</th>" for c in cells(x)) + "</tr>"]
            i += 2
            while i < len(lines) and "|" in lines[i]:
                rows.append("<tr>" + "".join(f"<td>{inline(c)}</td>" for c in cells(lines[i])) + "</tr>")
                i += 1
            out.append("<table>" + "".join(rows) + "</table>")
        elif x.strip():
            para = []
            while i < len(lines) and lines[i].strip() and not re.match(r"```|#{1,6}\s|>|\s*(?:[-*+]|\d+[.)])\s", lines[i]):
                para.append(lines[i].strip())
                i += 1
            out.append(f"<p>{inline(' '.join(para))}</p>")
        else:
            i += 1
    return "\n".join(out)


def to_html(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(render, na_action="ignore").astype(object)

    return run(text)
