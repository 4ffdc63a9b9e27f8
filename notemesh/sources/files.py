"""Files into notes: intake of md, txt, csv and pdf files, vault archives, and note files with frontmatter."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemesh.functions import text as T

MAX_BYTES = 100 << 20


def intake(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """(path, type, status, reason, text) of files (path, length, content) as the binaryFile source gives them.

    Unsupported types are skipped; too large and undecodable files fail; pdf
    files pass without text, which a PDF reader may add.
    """
    kind = T.file_type(F.col("path"))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    status = F.when(kind.isNull(), "skipped").when(F.col("length") > most, "failed").when(kind == "pdf", "ok").when(~valid, "failed").otherwise("ok")
    reason = F.when(kind.isNull(), "unsupported").when(F.col("length") > most, "too_large").when((kind != "pdf") & ~valid, "not_utf8")
    text = F.when((status == "ok") & (kind != "pdf"), F.decode("content", "UTF-8"))
    return files.select("path", kind.alias("type"), status.alias("status"), reason.alias("reason"), text.alias("text"))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    return intake(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


def parse_csv(text: str, delimiter: str = ",") -> list[list[str]]:
    """Rows of a CSV text: a quote opens and closes anywhere, two quotes are one, carriage returns vanish, no row after the last newline."""
    text = text.removeprefix("﻿")
    rows, row, cell, quoted, i = [], [], [], False, 0
    while i < len(text):
        c = text[i]
        if c == '"':
            if quoted and text[i + 1 : i + 2] == '"':
                cell.append('"')
                i += 1
            else:
                quoted = not quoted
        elif c == delimiter and not quoted:
            row.append("".join(cell))
            cell = []
        elif c == "\n" and not quoted:
            rows.append([*row, "".join(cell)])
            row, cell = [], []
        elif c != "\r" or quoted:
            cell.append(c)
        i += 1
    if cell or row:
        rows.append([*row, "".join(cell)])
    return rows


def csv_markdown(rows: list[list[str]]) -> str:
    """A pipe table; short rows are filled up, pipes and newlines of cells are escaped."""
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(re.sub(r"\s*\n\s*", " ", c.replace("|", "\\|")).strip() for c in [*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


def csv_linear(text: str, delimiter: str = ",", heading: str = "## Dữ liệu theo dòng") -> str:
    """A CSV text as its table, followed by a line for each row that names every value's column."""
    rows = parse_csv(text, delimiter)
    table = csv_markdown(rows)
    # column names in words: signs and changes of case part them
    heads = [" ".join("".join(f" {c}" if c.isupper() and i and (h[i - 1].islower() or h[i - 1].isnumeric()) else c for i, c in enumerate(h)).replace("_", " ").replace("-", " ").split()) for h in (rows[0] if rows else [])]
    cell = lambda c: re.sub(r"\s*\n\s*", " ", c.replace("|", "\\|")).strip()
    pairs = [" · ".join(f"{h}: {cell(c)}" for h, c in zip(heads, r) if h and c.strip()) for r in rows[1:]]
    lines = [f"- {x}" for x in pairs if x]
    return f"{table}\n\n{heading}\n\n" + "\n".join(lines) if lines else table


def csv_notes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, markdown): CSV texts as notes that can be searched; null texts give null."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "markdown": pd.Series([None if t is None else csv_linear(t) for t in pdf["t"]], index=pdf.index, dtype=object)})

    return texts.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, markdown string").withColumnRenamed("k", key)


def csv_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nth, cells): the rows of CSV texts."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, i, r) for k, t in zip(pdf["k"], pdf["t"]) if t for i, r in enumerate(parse_csv(t))]
            yield pd.DataFrame(out, columns=["k", "nth", "cells"])

    return texts.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, nth int, cells array<string>").withColumnRenamed("k", key)


_FENCE = re.compile(r"\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)


def scalar(raw: str) -> str:
    """A value as it was meant: quotes of either kind are taken off with their escapes."""
    t = raw.strip()
    if len(t) >= 2 and t[0] == t[-1] == '"':
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], t[1:-1])
    return t[1:-1].replace("''", "'") if len(t) >= 2 and t[0] == t[-1] == "'" else t


def inline_list(raw: str) -> list[str]:
    """The values of [a, "b, c"]; commas in quotes part nothing."""
    return [scalar(m[0]) for m in re.finditer(r"""\s*(?:"(?:\\.|[^"\\])*"|'[^']*'|[^,"'])+""", raw.strip()[1:-1]) if m[0].strip()]


def parse_note(raw: str) -> tuple[dict[str, str], str]:
    """(frontmatter, body): scalars as text, lists joined with ', '."""
    m = _FENCE.match(raw)
    if not m:
        return {}, raw
    out: dict[str, str] = {}
    key = None
    for line in m[1].split("\n"):
        line = line.rstrip("\r")
        if item := re.match(r"\s+-\s+(.*)", line) or (re.match(r"-\s+(.*)", line) if key else None):
            if key:
                out[key] = ", ".join(x for x in (out[key], scalar(item[1])) if x)
        elif pair := re.match(r"([^:#\s][^:]*):\s*(.*)", line):
            key, value = pair[1].strip(), pair[2].strip()
            out[key] = ", ".join(inline_list(value)) if value.startswith("[") and value.endswith("]") else scalar(value)
    return out, raw[m.end() :].removeprefix("\n")


def serialize_note(frontmatter: dict[str, str], body: str) -> str:
    """A note file that `parse_note` reads back; values that would be read as something else are quoted."""
    if not frontmatter:
        return body
    plain = lambda v: v == v.strip() and v and not re.search(r"""[\n:#"'\[\]{}]|^[-?!&*|>%@`]""", v)
    shown = lambda v: v if plain(v) else '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    return "---\n" + "\n".join(f"{k}: {shown(v)}" for k, v in frontmatter.items()) + "\n---\n\n" + body


def vault_notes(entries: DataFrame) -> DataFrame:
    """(archive, doc_id, frontmatter, body): the notes among a vault's entries; bytes that aren't UTF-8 are replaced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read = [parse_note(bytes(c).decode("utf-8", "replace")) for c in pdf["content"]]
            yield pd.DataFrame({"archive": pdf["archive"], "doc_id": pdf["path"], "frontmatter": pd.Series([f for f, _ in read], index=pdf.index, dtype=object), "body": pd.Series([b for _, b in read], index=pdf.index, dtype=object)})

    return entries.where("kind = 'note' AND content IS NOT NULL").mapInPandas(run, "archive string, doc_id string, frontmatter map<string,string>, body string")


def vault_files(notes: DataFrame, chats: DataFrame | None = None) -> DataFrame:
    """(path, content): the files of a vault: notes (doc_id, frontmatter, body) with their frontmatter by key, and transcripts (conv_id, markdown)
    under chats/. One row a file, so that a large vault is written by many tasks; `vault_zip` packs one that fits one file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [serialize_note(dict(sorted((k, v or "") for k, v in dict(f).items())) if f is not None else {}, b or "") for f, b in zip(pdf["frontmatter"], pdf["body"])]
            yield pd.DataFrame({"path": pdf["doc_id"], "content": pd.Series(text, index=pdf.index, dtype=object)})

    out = notes.where("doc_id IS NOT NULL").select("doc_id", "frontmatter", "body").mapInPandas(run, "path string, content string")
    if chats is None:
        return out
    name = F.col("conv_id").cast("string")
    return out.unionByName(chats.select(F.concat(F.lit("chats/"), name, F.lit(".md")).alias("path"), F.concat(F.lit("---\ntype: chat\nid: "), name, F.lit("\n---\n\n"), F.col("markdown")).alias("content")))


def vault_entries(files: DataFrame) -> DataFrame:
    """(archive, path, kind, content) of vault archives (path, content): notes, originals and entries that are skipped because they're packed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for archive, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for e in z.infolist():
                        note = bool(re.search(r"(?i)\.(md|markdown)$", e.filename))
                        if e.is_dir() or (note and e.filename.startswith("chats/") and e.compress_type == zipfile.ZIP_STORED):
                            continue
                        if e.compress_type != zipfile.ZIP_STORED:
                            rows.append((archive, e.filename, "skipped", None))
                        else:
                            rows.append((archive, e.filename, "note" if note else "original", z.read(e)))
            yield pd.DataFrame(rows, columns=["archive", "path", "kind", "content"])

    return files.select("path", "content").mapInPandas(run, "archive string, path string, kind string, content binary")


def vault_zip(entries: list[tuple[str, bytes]]) -> bytes:
    """A stored, byte-stable archive of a vault small enough for one file: sorted paths, the date 1980-01-01."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for path, data in sorted(entries):
            z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()
