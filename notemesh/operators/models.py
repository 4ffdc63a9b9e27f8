"""Seams for models: what they must offer, and reading what they return."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

TextGenerator = Callable[[str], str]
TokenCounter = Callable[[str], int]

# Clamps of an extraction and its batches.
MOST_ENTITIES, MOST_RELATIONS, SKIM, SEGMENTS, BATCH_DOCS = 20, 30, 1200, 2, 6
TYPES = ("person", "org", "project", "place", "concept", "event", "other")


class Embedder(Protocol):
    def __call__(self, text: str, dim: int): ...


def outer_object(raw: str) -> dict | None:
    """The outermost {…} of a noisy answer, if it is a JSON object."""
    a, b = raw.find("{"), raw.rfind("}")
    try:
        got = json.loads(raw[a : b + 1]) if 0 <= a < b else None
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def entity_type(value: object) -> str:
    first = value.lower().split()[:1] if isinstance(value, str) else []
    return first[0] if first and first[0] in TYPES else "other"


def relation_type(value: object) -> str:
    t = re.sub(r"[^\w]", "", re.sub(r"\s+", "_", value.strip().lower())) if isinstance(value, str) else ""
    return t or "related_to"


def read_extraction(raw: str | None) -> tuple[list[tuple[str, str]], list[tuple[str, str, str, float | None]]] | None:
    """(entities, relations) of a model's answer, clamped: names distinct without case, relations between named ends, confidence in [0, 1]."""
    got = outer_object(raw) if raw else None
    if got is None:
        return None
    names: dict[str, tuple[str, str]] = {}
    for e in got.get("entities") or []:
        name = " ".join(str(e.get("name") or "").split()) if isinstance(e, dict) else ""
        if name and name.lower() not in names and len(names) < MOST_ENTITIES:
            names[name.lower()] = (name, entity_type(e.get("type")))
    out: list[tuple[str, str, str, float | None]] = []
    for r in got.get("relations") or []:
        if not isinstance(r, dict):
            continue
        ends = [names.get(" ".join(str(r.get(k) or "").split()).lower()) for k in ("source", "target")]
        if None in ends or len(out) >= MOST_RELATIONS:
            continue
        c = r.get("confidence")
        row = (ends[0][0], ends[1][0], relation_type(r.get("type")), min(1.0, max(0.0, float(c))) if isinstance(c, (int, float)) else None)
        if row[:3] not in [o[:3] for o in out]:
            out.append(row)
    return list(names.values()), out


def segments(text: str, n: int = SKIM, most: int = SEGMENTS) -> list[str]:
    words = text.split()
    return [" ".join(words[i : i + n]) for i in range(0, len(words), n)][:most]


def plan_batches(sizes: list[int], budget: int, most: int = BATCH_DOCS) -> list[list[int]]:
    """Indices packed in order into batches of at most `most` items and `budget` tokens; a larger item goes alone."""
    out: list[list[int]] = []
    used = 0
    for i, s in enumerate(sizes):
        if not out or len(out[-1]) >= most or used + s > budget:
            out.append([])
            used = 0
        out[-1].append(i)
        used += s
    return out


def extract_with(notes: DataFrame, generate: TextGenerator, prompt: Callable[[str], str] = lambda t: t) -> DataFrame:
    """(doc_id, kind, name, other, type, confidence): entities and relations that a model finds in notes (doc_id, body); answers that can't be read give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, body in zip(pdf["doc_id"], pdf["body"]):
                for part in segments(body or ""):
                    got = read_extraction(generate(prompt(part)))
                    if got:
                        rows += [(doc, "entity", n, None, t, None) for n, t in got[0]] + [(doc, "relation", a, b, t, c) for a, b, t, c in got[1]]
            yield pd.DataFrame(list(dict.fromkeys(rows)), columns=["doc_id", "kind", "name", "other", "type", "confidence"])

    return notes.select("doc_id", "body").mapInPandas(run, "doc_id string, kind string, name string, other string, type string, confidence double")


def read_tags(raw: str | None) -> dict | None:
    """title, type, tags (at most six) and a summary of at most three sentences from a model's answer."""
    got = outer_object(raw) if raw else None
    if got is None:
        return None
    tags = [str(t).strip().lstrip("#").lower() for t in got.get("tags") or [] if str(t).strip()]
    sentences = re.findall(r"[^.!?]+[.!?]+|[^.!?]+$", str(got.get("summary") or "").strip())
    return {"title": str(got.get("title") or "").strip(), "type": str(got.get("type") or "").strip(), "tags": list(dict.fromkeys(tags))[:6], "summary": "".join(sentences[:3]).strip()}


def fill_frontmatter(old: dict[str, str], new: dict[str, str], overwrite: bool = False) -> dict[str, str]:
    """`old` with the keys of `new` that it lacks or has empty."""
    return old | {k: v for k, v in new.items() if v and (overwrite or not old.get(k))}


# --- states of ingestion ---------------------------------------------------------------------------------------------------

STATES = ("queued", "parsing", "chunked", "embedding", "indexing", "tagging", "indexed")


def next_state(state: str) -> str:
    if state not in STATES[:-1]:
        raise ValueError(f"{state!r} has no successor")
    return STATES[STATES.index(state) + 1]


def run_ingestion(doc: dict, stages: dict[str, Callable[[dict], None]], persist: Callable[[dict], None], cleanup: Callable[[dict], None] = lambda d: None) -> dict:
    """Takes a document from its state to indexed, storing each step; a stage that fails cleans up and leaves it failed."""
    while doc["state"] in STATES[:-1]:
        try:
            stages.get(doc["state"], lambda d: None)(doc)
        except Exception as why:  # noqa: BLE001 — a stage may fail in any way
            cleanup(doc)
            doc = {**doc, "state": "failed", "reason": str(why)}
            persist(doc)
            return doc
        doc = {**doc, "state": next_state(doc["state"])}
        persist(doc)
    return doc


def retry(doc: dict, cleanup: Callable[[dict], None] = lambda d: None) -> dict:
    if doc["state"] != "failed":
        return doc
    cleanup(doc)
    return {k: v for k, v in doc.items() if k != "reason"} | {"state": "queued"}


def expand_template(text: str, values: dict[str, str]) -> str:
    """{{key}} becomes its value; unknown keys stay."""
    return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: values.get(m[1], m[0]), text)
