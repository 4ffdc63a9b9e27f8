"""Prompts from retrieved chunks, and clean-up of what a model answers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DUPLICATE = 0.65
SYSTEM = "Answer from the numbered notes only. Cite them as [#n]. If they don't hold the answer, say so."


def word_set(text: str) -> set[str]:
    return {w for w in re.split(r"[^\w]|_", unicodedata.normalize("NFKC", text.lower())) if len(w) > 1}


def distinct_hits(hits: list[dict], threshold: float = DUPLICATE) -> list[dict]:
    """Drops hits whose words are those of a kept one, in order."""
    kept: list[tuple[dict, set[str]]] = []
    for h in hits:
        w = word_set(h["text"] or "")
        if not any(w and k and len(w & k) >= threshold * len(w | k) for _, k in kept):
            kept.append((h, w))
    return [h for h, _ in kept]


def block(hit: dict, n: int) -> str:
    page = f", p.{hit['page']}" if hit.get("page") is not None else ""
    return f"[#{n}] (source: {hit['doc_id']}{page})\n{hit['text']}"


def assemble(question: str, hits: list[dict], budget: int, count: Callable[[str], int] = lambda t: len(t.split())) -> tuple[str | None, list[str]]:
    """(user message or None without hits, chunk ids in order): blocks up to the first that exceeds the budget; a first one that does is cut."""
    used, blocks, order = 0, [], []
    for h in distinct_hits(hits):
        cost = count(block(h, len(blocks) + 1))
        if blocks and used + cost > budget:
            break
        if not blocks and cost > budget:
            words = (h["text"] or "").split()
            room = max(1, budget - count(block({**h, "text": ""}, 1)))
            h = {**h, "text": " ".join(words[:room]) + (" …" if len(words) > room else "")}
            cost = count(block(h, 1))
        used += cost
        blocks.append(block(h, len(blocks) + 1))
        order.append(h["chunk_id"])
    return ("Notes:\n" + "\n\n".join(blocks) + f"\n\nQuestion: {question}" if blocks else None), order


def messages(user: str, history: list[tuple[str, str]], system: str = SYSTEM) -> list[tuple[str, str]]:
    """(role, content) of a chat: the system's, the turns so far, and the new question."""
    return [("system", system), *(m for q, a in history for m in (("user", q), ("assistant", a))), ("user", user)]


REASON = "Start from the numbered notes and cite them as [#n]. You may add what you know, but say which part isn't from the notes."


def grounding_hint(absent: list[str]) -> str:
    """What a model is told about names that a question asks for and no note holds."""
    return f"These names are in none of the notes: {', '.join(repr(a) for a in absent)}. Say so; ascribe nothing to them from the notes, and don't take them for somebody else." if absent else ""


def language_directive(language: str | None) -> str:
    return f"Write the whole answer in {language}, whatever language the notes and the question are in; names and code stay." if language else ""


def system_prompt(mode: str = "grounded", language: str | None = None, absent: list[str] | None = None) -> str:
    """The system's message: the language first, then the mode's rules, then absent names."""
    if mode not in ("grounded", "reason"):
        raise ValueError(f"unknown mode {mode!r}")
    return "\n\n".join(x for x in (language_directive(language), REASON if mode == "reason" else SYSTEM, grounding_hint(absent or [])) if x)


def assemble_prompts(hits: DataFrame, questions: DataFrame, budget: int) -> DataFrame:
    """(query_id, prompt, chunk_ids) of hits (query_id, rank, chunk_id, doc_id, page, text) and questions (query_id, question)."""
    kind = hits.schema["query_id"].dataType.simpleString()

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "chunk_id"])
        rows = [{**r, "page": None if pd.isna(r["page"]) else int(r["page"])} for r in pdf.to_dict("records")]
        prompt, order = assemble(pdf["question"].iat[0], rows, budget)
        return pd.DataFrame({"query_id": [pdf["query_id"].iat[0]], "prompt": [prompt], "chunk_ids": [order]})

    rows = hits.select("query_id", "rank", "chunk_id", "doc_id", "page", "text").join(questions.select("query_id", "question"), "query_id")
    return rows.groupBy("query_id").applyInPandas(work, f"query_id {kind}, prompt string, chunk_ids array<string>")


def normalize_markers(text):
    """Near misses of [#n], as a Column."""
    return F.regexp_replace(text, r"\[[^\]\d#]*#\s*(\d+)\s*\]", "[#$1]")


def strip_echo(text: str) -> str:
    """An answer without an echoed scaffold: what follows the last 'Answer' line, less a leading question or notes line."""
    marks = list(re.finditer(r"(?im)^\s*#*\s*answer\s*:?[ \t]*\n?", text))
    t = text[marks[-1].end() :] if marks else text
    return re.sub(r"(?i)\A\s*(?:#+\s*)?(?:question|notes|context)\b[^\n]*\n?", "", t).strip()
