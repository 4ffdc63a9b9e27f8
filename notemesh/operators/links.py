"""Linking text to notes: weaving links, unlinked mentions, reading and rewriting wiki links, references in answers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemesh.plans import dealt, dealt_block

#: Titles and aliases of which a task has one automaton at a time.
SURFACE_BLOCK = 200_000

PROTECTED = re.compile(r"```.*?```|`[^`\n]*`|\[\[[^\]]*\]\]|\[[^\]]*\]\([^)]*\)", re.S)
WIKILINK = re.compile(r"\[\[([^\[\]|#\n]+)(#[^\[\]|\n]*)?(?:\|([^\[\]\n]*))?\]\]")


def normal(surface: str | None) -> str:
    return " ".join((surface or "").lower().split())


def weave(text: str, pattern: re.Pattern | None, index: dict[str, tuple[str, str]], once: bool = False) -> list[tuple[str, str | None]]:
    """(segment, doc_id or None): the text cut at the titles it mentions; code and links stay as they are; joined segments give the text again."""
    out: list[tuple[str, str | None]] = []
    linked: set[str] = set()

    def plain(a: int, b: int) -> None:
        if b > a:
            out.append((text[a:b], None))

    def inside(a: int, b: int) -> None:
        at = a
        for m in pattern.finditer(text, a, b) if pattern else ():
            doc = index[normal(m[0])][0]
            if once and doc in linked:
                continue
            linked.add(doc)
            plain(at, m.start())
            out.append((m[0], doc))
            at = m.end()
        plain(at, b)

    at = 0
    for guard in PROTECTED.finditer(text):
        inside(at, guard.start())
        plain(guard.start(), guard.end())
        at = guard.end()
    inside(at, len(text))
    return out


def surface_pattern(surfaces: list[str]) -> re.Pattern | None:
    """Longest surface first, bounded by ASCII letters and digits, blanks of any width."""
    ordered = sorted((s for s in surfaces if len(s) >= 2), key=lambda s: (-len(s), s))
    if not ordered:
        return None
    return re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(re.escape(s).replace(r"\ ", r"\s+") for s in ordered) + r")(?![A-Za-z0-9])", re.I)


def _even(text: str) -> tuple[str, np.ndarray]:
    """A text in lower case with white space of any width as one blank, and the place of each of its characters (and of its end) in the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    runs = [(m.start(), m.end()) for m in re.finditer(r"\s+", low)]
    keep = np.ones(len(low) + 1, bool)
    for a, b in runs:
        keep[a + 1 : b] = False
    return re.sub(r"\s+", " ", low), np.flatnonzero(keep)


def _ascii_word(c: str) -> bool:
    return c.isascii() and c.isalnum()


class Surfaces:
    """All surfaces of an index as one automaton; what they match is that of `surface_pattern`, though a text is read once however many there are."""

    def __init__(self, surfaces: list[str], targets: list[str]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for s, t in zip(surfaces, targets):
            if len(s) >= 2:
                self.machine.add_word(s, (len(s), t))
        self.any = len(self.machine) > 0
        if self.any:
            self.machine.make_automaton()

    def held(self, even: str) -> list[tuple[int, int, str]]:
        """(start, end, target) of the surfaces in an even text that don't begin or end inside a run of ASCII letters and digits."""
        if not self.any:
            return []
        out, last = [], len(even)
        for stop, (size, target) in self.machine.iter(even):
            a, b = stop - size + 1, stop + 1
            if (a == 0 or not _ascii_word(even[a - 1])) and (b == last or not _ascii_word(even[b])):
                out.append((a, b, target))
        return out


def woven_spans(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, str, str]]:
    """(nth, segment, target) of `weave` from the spans (start, end, target) that surfaces have in a text."""
    spans = sorted(found, key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, str, str]] = []
    nth = i = 0

    def inside(a: int, b: int) -> None:
        nonlocal nth, i
        at = a
        while i < len(spans) and spans[i][0] < b:
            start, end, target = spans[i]
            i += 1
            if start < at or end > b:
                continue
            nth += start > at
            out.append((nth, text[start:end], target))
            nth += 1
            at = end
        nth += b > at

    at = 0
    for guard in PROTECTED.finditer(text):
        inside(at, guard.start())
        nth += 1
        at = guard.end()
        while i < len(spans) and spans[i][0] < at:
            i += 1
    inside(at, len(text))
    return out


def woven_links(notes: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, nth, segment, target): links that weaving adds to notes (doc_id, body).

    `index` (surface, doc_id), one row a surface. Surfaces are dealt to blocks in the shared folder; a task has the automaton of one block at a
    time and reads its notes once for each, so no word that many titles begin with makes rows, and neither notes nor titles meet in pairs.
    """
    known = index.select("surface", "doc_id").where("surface RLIKE '[\\\\p{L}\\\\p{N}]'")
    blocks = max(1, -(-known.count() // SURFACE_BLOCK))
    path = dealt(known, "surfaces", "surface", blocks)

    def automaton(block: int) -> Surfaces:
        part = dealt_block(path, block, ["surface", "doc_id"])
        return Surfaces(*(part[c].to_pylist() for c in ("surface", "doc_id"))) if part is not None else Surfaces([], [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = automaton(0) if blocks == 1 else None
        for pdf in batches:
            docs, bodies = pdf["doc_id"].tolist(), pdf["body"].tolist()
            evens = [_even(b) for b in bodies]
            found: list[list[tuple[int, int, str]]] = [[] for _ in docs]
            for block in range(blocks):
                surfaces = one or automaton(block)
                for doc, (even, place), own in zip(docs, evens, found):
                    own += [(int(place[a]), int(place[b - 1]) + 1, t) for a, b, t in surfaces.held(even) if t != doc]
            rows = [(doc, *x) for doc, body, own in zip(docs, bodies, found) if own for x in woven_spans(body, own)]
            yield pd.DataFrame(rows, columns=["doc_id", "nth", "segment", "target"])

    # few notes are one file, though each may be long to read
    tasks = max(notes.sparkSession.sparkContext.defaultParallelism, int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = notes.where("doc_id IS NOT NULL AND body IS NOT NULL").select("doc_id", "body").repartition(tasks)
    return spread.mapInPandas(run, "doc_id string, nth int, segment string, target string")


def unlinked_mentions(notes: DataFrame, index: DataFrame) -> DataFrame:
    """(target, source, mentions): notes that name another note without a link to it."""
    return woven_links(notes, index).groupBy("target", F.col("doc_id").alias("source")).agg(F.count("*").alias("mentions"))


def parse_wikilinks(text: str) -> list[tuple[str, str | None, str, int, int]]:
    """(target, heading, display, start, end) of the wiki links of a text."""
    return [(m[1].strip(), m[2][1:].strip() if m[2] else None, (m[3] or m[1]).strip(), m.start(), m.end()) for m in WIKILINK.finditer(text) if m[1].strip()]


def rewrite_title(text: str, old: str, new: str) -> str:
    """Points links to `old` at `new`; headings and displays stay."""
    return WIKILINK.sub(lambda m: m[0] if normal(m[1]) != normal(old) else f"[[{new}{m[2] or ''}{'|' + m[3] if m[3] is not None else ''}]]", text)


REF = re.compile(r"\[(?:(?P<path>[^\[\]#\n]+\.(?:md|markdown|txt|csv|pdf))#(?P<seq>\d+)|#(?P<n>\d+))\]", re.I)


def parse_refs(answer: str) -> list[tuple[str | None, int, int, int]]:
    """(path or None, number, start, end) of the references [path.md#3] and [#2] of an answer, in order."""
    return [(m["path"], int(m["seq"] or m["n"]), m.start(), m.end()) for m in REF.finditer(answer)]


def resolve_refs(answer: str, known: set[str], order: list[str]) -> list[tuple[str | None, bool]]:
    """(chunk_id or None, resolved) of each reference: a path must be known, a number counts from 1 in `order`."""
    out: list[tuple[str | None, bool]] = []
    for path, n, _, _ in parse_refs(answer):
        chunk = f"{path}#{n}" if path in known else None if path else order[n - 1] if 0 < n <= len(order) else None
        out.append((chunk, chunk is not None))
    return out
