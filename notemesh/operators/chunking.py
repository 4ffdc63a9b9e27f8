"""Notes into chunks with offsets, headings, and the text that is embedded."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Separators from coarse to fine, chunk sizes by length of the text, and the embedder's window.
SEPARATORS = ("\n## ", "\n\n", "\n", ". ", " ")
LADDER = ((30_000, 60, 12), (150_000, 120, 20), (600_000, 220, 36), (None, 360, 56))
WINDOW, PREFIX = 512, 140


def words(text: str) -> int:
    return len(text.split())


def sizes_for(length: int) -> tuple[int, int]:
    """Chunk size and overlap, in tokens, for a text of so many characters."""
    return next((size, overlap) for most, size, overlap in LADDER if most is None or length <= most)


def _split(text: str, at: int, size: int, count: Callable[[str], int], depth: int = 0) -> list[tuple[int, int]]:
    """Spans of pieces of at most `size` tokens where a separator allows it; a separator stays with the piece before it."""
    if count(text) <= size or depth == len(SEPARATORS):
        return [(at, at + len(text))]
    sep, out, start = SEPARATORS[depth], [], 0
    while start < len(text):
        hit = text.find(sep, start)
        end = len(text) if hit < 0 else hit + len(sep)
        out += _split(text[start:end], at + start, size, count, depth + 1)
        start = end
    return out


def chunk(text: str | None, size: int | None = None, overlap: int | None = None, count: Callable[[str], int] = words) -> list[tuple[int, str, int, int, int]]:
    """(seq, text, tokens, start, end) of the chunks of a text.

    Segments are packed to `size` tokens; a chunk begins with the last segments
    of the one before, until they hold `overlap` tokens, but never all of them.
    The size is a target: a segment that can't be split may exceed it.
    """
    if not text or not text.strip():
        return []
    auto = sizes_for(len(text))
    size, overlap = size or auto[0], auto[1] if overlap is None else overlap
    if not 0 < size < WINDOW:
        raise ValueError(f"chunk size must be between 1 and {WINDOW - 1}")
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the chunk size")
    spans = [(a, b, count(text[a:b])) for a, b in _split(text, 0, size, count)]
    groups, now, total = [], [], 0
    for s in spans:
        if now and total + s[2] > size:
            groups.append(now)
            tail, kept = [], 0
            for t in reversed(now[1:]):
                if kept >= overlap:
                    break
                tail.insert(0, t)
                kept += t[2]
            now, total = tail if overlap > 0 else [], kept if overlap > 0 else 0
        now = [*now, s]
        total += s[2]
    if now:
        groups.append(now)
    out = []
    for g in groups:
        a, b = g[0][0], g[-1][1]
        out.append((len(out), text[a:b], count(text[a:b]), a, b))
    return out


def chunk_notes(notes: DataFrame, key: str = "doc_id", body: str = "body") -> DataFrame:
    """(doc_id, seq, text, tokens, char_start, char_end); null and blank bodies give no chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *c) for k, b in zip(pdf["k"], pdf["b"]) for c in chunk(b)]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "text", "tokens", "char_start", "char_end"])

    kind = notes.schema[key].dataType.simpleString()
    return notes.select(F.col(key).alias("k"), F.col(body).alias("b")).mapInPandas(run, f"doc_id {kind}, seq int, text string, tokens int, char_start int, char_end int")


_HEADING = re.compile(r"(?m)^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$")


def headings(notes: DataFrame) -> DataFrame:
    """(doc_id, at, level, heading) of ATX headings; `at` is the position of the first sign."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, m.start(), len(m[1]), m[2]) for d, b in zip(pdf["doc_id"], pdf["body"]) if b for m in _HEADING.finditer(b)]
            yield pd.DataFrame(rows, columns=["doc_id", "at", "level", "heading"])

    return notes.select("doc_id", "body").mapInPandas(run, "doc_id string, at int, level int, heading string")


def section_of(chunks: DataFrame, heads: DataFrame) -> DataFrame:
    """(chunk_id, heading): the last heading at or before each chunk's start, an as-of join.

    Both sides are stacked and sorted once per document, so no chunk meets all
    headings; chunks before the first heading have null.
    """
    left = chunks.select("doc_id", F.col("char_start").alias("at"), "chunk_id", F.lit(None).cast("string").alias("heading"), F.lit(1).alias("side"))
    right = heads.select("doc_id", "at", F.lit(None).cast("string").alias("chunk_id"), "heading", F.lit(0).alias("side"))
    upto = Window.partitionBy("doc_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn("heading", F.last("heading", ignorenulls=True).over(upto)).where("side = 1").select("chunk_id", "heading")


def embed_text(title: str | None, section: str | None, body: str) -> str:
    """A chunk's text as it is embedded: 'Title › Section' and the body without Markdown signs."""
    lines = []
    for x in body.split("\n"):
        if re.fullmatch(r"\s*\|?[\s:|-]+\|?\s*", x) and "-" in x:
            continue
        x = re.sub(r"^\s*(?:#{1,6}\s+|[-*+]\s+|>\s?|\d+[.)]\s+)", "", x)
        if x.strip().startswith("|") or x.count("|") >= 2:
            x = " · ".join(c.strip() for c in x.strip().strip("|").split("|"))
        lines.append(re.sub(r"[*_`~]+", "", x))
    head = " › ".join(p.strip()[:PREFIX].rstrip() for p in (title, section) if p and p.strip())
    return "\n".join(([head] if head else []) + ["\n".join(lines).strip()])


def embed_texts(title, section, text):
    """`embed_text` of three Columns, in Arrow batches."""

    @F.pandas_udf("string")
    def run(t: pd.Series, h: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([embed_text(a, b, c or "") for a, b, c in zip(t, h, x)], dtype=object)

    return run(title, section, text)


def hashed_vector(text: str, dim: int) -> np.ndarray:
    """A bag of words as a vector of length one; the stand-in for a model that isn't here."""
    v = np.zeros(dim, np.float32)
    found = re.findall(r"[^\W_]+", text.lower())
    if found:
        h = pd.util.hash_array(np.array(found, dtype=object))
        np.add.at(v, (h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0).astype(np.float32))
    n = np.linalg.norm(v)
    return v / n if n else v


def embed(chunks: DataFrame, dim: int = 96, embedder: Callable[[str, int], np.ndarray] = hashed_vector) -> DataFrame:
    """Adds `embedding` to chunks with a text column, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([embedder(t or "", dim).tolist() for t in texts])

    return chunks.withColumn("embedding", run("text"))
