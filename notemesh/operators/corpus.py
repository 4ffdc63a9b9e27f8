"""Tags, folders, links and lookups over notes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemesh.functions import text as T


def note_tags(notes: DataFrame) -> DataFrame:
    """(doc_id, tag), distinct: frontmatter tags (split at commas and blanks) and inline #tags of notes (doc_id, body, frontmatter)."""
    listed = F.split(F.coalesce(F.element_at("frontmatter", F.lit("tags")), F.lit("")), r"[,\s]+")
    both = F.concat(F.transform(listed, T.norm_tag), F.transform(T.inline_tags(F.col("body")), T.norm_tag))
    return notes.select("doc_id", F.explode(F.array_distinct(both)).alias("tag")).where("tag IS NOT NULL")


def tag_index(notes: DataFrame) -> DataFrame:
    return note_tags(notes).distinct().groupBy("tag").agg(F.count("*").alias("notes"))


def folders(paths: DataFrame, col: str = "doc_id") -> DataFrame:
    """(folder, notes): every folder above a path, with the notes under it."""
    parts = F.split(F.col(col), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return paths.select(col).distinct().where(F.size(parts) > 1).select(col, F.explode(above).alias("folder")).groupBy("folder").agg(F.count("*").alias("notes"))


def file_tree(paths: DataFrame, col: str = "doc_id") -> DataFrame:
    """(path, parent, kind, name): folders and files as adjacency rows."""
    files = paths.select(F.col(col).alias("path")).distinct().withColumn("kind", F.lit("file"))
    dirs = folders(paths, col).select(F.col("folder").alias("path"), F.lit("folder").alias("kind"))
    return files.unionByName(dirs).select("path", T.folder_of(F.col("path")).alias("parent"), "kind", F.regexp_extract("path", "([^/]*)$", 1).alias("name"))


def title_index(notes: DataFrame) -> DataFrame:
    """(surface, doc_id): each normalised title or alias with the first note (by id) that bears it."""
    surfaces = notes.select("doc_id", F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("s")).select(T.clean_title(F.col("s")).alias("surface"), "doc_id").where("surface <> ''")
    return surfaces.groupBy("surface").agg(F.min("doc_id").alias("doc_id"))


def links(notes: DataFrame) -> DataFrame:
    """(doc_id, surface), one row a link of the body."""
    return notes.select("doc_id", F.explode(T.wikilink_targets(F.col("body"))).alias("t")).select("doc_id", T.clean_title(F.col("t")).alias("surface"))


def backlinks(notes: DataFrame, index: DataFrame) -> DataFrame:
    """(target, source, links): how often a note links to another by title or alias."""
    hit = links(notes).groupBy("doc_id", "surface").agg(F.count("*").alias("c")).join(index.withColumnRenamed("doc_id", "target"), "surface")
    return hit.where("doc_id <> target").groupBy("target", F.col("doc_id").alias("source")).agg(F.sum("c").alias("links"))


def fuzzy_score(query: str, target: str) -> float | None:
    """Subsequence score: 1 a letter, twice the streak, 3 at a word's start, less 0.01 a letter of the target; None if unmatched."""
    q, t = query.lower(), target.lower()
    score, at, streak = 0.0, 0, 0
    for i, c in enumerate(t):
        if at < len(q) and c == q[at]:
            streak += 1
            score += 1 + 2 * (streak - 1) + (3 if i == 0 or not t[i - 1].isalnum() else 0)
            at += 1
        else:
            streak = 0
    return score - 0.01 * len(t) if q and at == len(q) else None


def quick_switch(notes: DataFrame, query: str, most: int = 10) -> DataFrame:
    """The notes (doc_id, title) whose title or path fits a typed query best."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = [max((s for s in (fuzzy_score(query, t or ""), fuzzy_score(query, d)) if s is not None), default=None) for d, t in zip(pdf["doc_id"], pdf["title"])]
            yield pdf.assign(score=pd.Series(scores, dtype="float64")).dropna(subset=["score"])

    got = notes.select("doc_id", "title").distinct().mapInPandas(run, "doc_id string, title string, score double")
    return got.orderBy(F.desc("score"), F.length("title"), "title", "doc_id").limit(most)


def rank_titles(index: DataFrame, typed: str, most: int = 8) -> DataFrame:
    """(doc_id, surface, score): notes whose title or alias begins with (2) or holds (1) what is typed, the best surface of each."""
    t = typed.strip().lower()
    hit = index.where(F.contains("surface", F.lit(t))).withColumn("score", F.when(F.startswith("surface", F.lit(t)), 2).otherwise(1))
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.length("surface"), "surface")
    one = hit.withColumn("_k", F.row_number().over(best)).where("_k = 1")
    return one.select("doc_id", "surface", "score").orderBy(F.desc("score"), F.length("surface"), "surface", "doc_id").limit(most)


def first_free(paths: DataFrame, taken: DataFrame) -> DataFrame:
    """(doc_id, path): wanted paths (doc_id, path) made unique with -2, -3, … against each other and `taken` (path).

    The nth note (by id) that wants a path gets the nth number that is free for
    it; number 1 is the path itself. A number is taken if a file, or another
    note's wanted path, has its name. The free numbers come from a merge of both
    in one sorted pass, so no candidate is tried twice.
    """
    stem = lambda c: F.regexp_replace(c, r"\.md$", "")
    numbered = r"^(.*)-([2-9]|[1-9][0-9]+)$"
    files = taken.select("path").where("path IS NOT NULL").distinct()
    names = files.unionByName(paths.select("path").distinct()).distinct().select(stem(F.col("path")).alias("s"))
    by_number = names.where(F.col("s").rlike(numbered)).select(F.regexp_extract("s", numbered, 1).alias("stem"), F.regexp_extract("s", numbered, 2).cast("long").alias("t"))
    used = by_number.unionByName(files.select(stem(F.col("path")).alias("stem"), F.lit(1).cast("long").alias("t"))).distinct()
    order = Window.partitionBy("stem").orderBy("t")
    # the ith number taken stands before the nth free one if t - i < n
    steps = used.withColumn("v", F.col("t") - F.row_number().over(order)).select("stem", "v", F.lit(None).cast(paths.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).alias("side"))
    wanted = paths.select(stem(F.col("path")).alias("stem"), "doc_id").withColumn("v", F.row_number().over(Window.partitionBy("stem").orderBy("doc_id")).cast("long"))
    rows = steps.unionByName(wanted.select("stem", (F.col("v") - 1).alias("v"), "doc_id", F.lit(1).alias("side")))
    before = F.sum(1 - F.col("side")).over(Window.partitionBy("stem").orderBy("v", "side").rowsBetween(Window.unboundedPreceding, 0))
    n = (F.col("v") + 1 + F.coalesce("_b", F.lit(0))).cast("long")
    placed = rows.withColumn("_b", before).where("side = 1").withColumn("_i", n)
    return placed.select("doc_id", F.when(F.col("_i") == 1, F.concat("stem", F.lit(".md"))).otherwise(F.concat("stem", F.lit("-"), F.col("_i").cast("string"), F.lit(".md"))).alias("path"))


def scope_docs(notes: DataFrame, kind: str, value: str) -> DataFrame:
    """(doc_id) of the notes (doc_id, body, frontmatter) in a scope: a folder's prefix, or a tag."""
    if kind == "folder":
        return notes.select("doc_id").distinct().where(F.startswith("doc_id", F.lit(value)))
    return note_tags(notes).where(F.col("tag") == T.norm_tag(F.lit(value))).select("doc_id").distinct()


def in_scope(rows: DataFrame, docs: DataFrame | None) -> DataFrame:
    """The rows whose doc_id is in a scope; no scope keeps all."""
    return rows if docs is None else rows.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")


def scope_label(kind: str, value: str) -> str:
    return f"📁 {value}" if kind == "folder" else "#" + value.strip().removeprefix("#").lower()


def tag_notes(notes: DataFrame) -> DataFrame:
    """(tag, doc_ids): each tag with its notes, sorted, for tags of a bounded number of notes; `note_tags` has the rows."""
    return note_tags(notes).distinct().groupBy("tag").agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))


def edit_conflict(rows: DataFrame) -> DataFrame:
    """Adds `decision` from base, mine and theirs hashes: noop, save, reload or conflict."""
    mine, theirs = ~F.col("mine").eqNullSafe(F.col("base")), ~F.col("theirs").eqNullSafe(F.col("base"))
    same = F.col("mine").eqNullSafe(F.col("theirs"))
    return rows.withColumn("decision", F.when(same | (~mine & ~theirs), "noop").when(mine & ~theirs, "save").when(~mine & theirs, "reload").otherwise("conflict"))


def export_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, markdown): each conversation's turns (conv_id, turn, query, answer) as a transcript."""
    part = lambda role, c: F.concat(F.lit(f"**{role}:**\n\n"), F.coalesce(c, F.lit("")))
    rows = turns.select("conv_id", F.struct("turn", "turn_id", F.concat(part("user", F.col("query")), F.lit("\n\n---\n\n"), part("assistant", F.col("answer"))).alias("md")).alias("x"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda r: r["md"]), "\n\n---\n\n").alias("markdown"))
