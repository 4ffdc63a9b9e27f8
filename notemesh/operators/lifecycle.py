"""Notes through their life: creating, renaming, moving and removing them, as tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemesh.functions import text as T
from notemesh.operators import corpus


def created(drafts: DataFrame, taken: DataFrame, now: str) -> DataFrame:
    """Notes (doc_id, title, body, hash, created) of drafts (draft_id, folder, title, body) at free paths; a draft without title is left out."""
    good = drafts.where("title IS NOT NULL AND trim(title) <> ''")
    folder = F.regexp_replace(F.coalesce("folder", F.lit("")), "/+$", "")
    want = good.select(F.col("draft_id").alias("doc_id"), F.concat(F.when(folder == "", "notes").otherwise(folder), F.lit("/"), T.slug(F.col("title")), F.lit(".md")).alias("path"))
    paths = corpus.first_free(want, taken).withColumnRenamed("doc_id", "draft_id")
    return good.join(paths, "draft_id").select(F.col("path").alias("doc_id"), F.trim("title").alias("title"), "body", T.content_hash(F.col("body")).alias("hash"), F.lit(now).alias("created"))


def moved(notes: DataFrame, old: str, new: str) -> DataFrame:
    """(doc_id, path): the paths of notes under `old` after it became `new`, free among the others."""
    under = T.is_under(F.col("doc_id"), F.lit(old))
    want = notes.where(under).select("doc_id", F.concat(F.lit(new), F.expr(f"substring(doc_id, {len(old) + 1})")).alias("path"))
    return corpus.first_free(want, notes.where(~under).select(F.col("doc_id").alias("path")))


def renamed_links(notes: DataFrame, old: str, new: str) -> DataFrame:
    """(doc_id, body): notes with links to the title `old`, pointing at `new`; headings and displays stay."""
    quoted = r"\Q" + old.replace(r"\E", r"\E\\E\Q") + r"\E"
    pattern = rf"(?i)\[\[\s*{quoted}\s*(#[^\[\]|\n]*)?(\|[^\[\]\n]*)?\]\]"
    fresh = F.regexp_replace("body", pattern, "[[" + new.replace("\\", r"\\").replace("$", r"\$") + "$1$2]]")
    return notes.where(F.col("body").rlike(pattern)).select("doc_id", fresh.alias("body"))


def updated(notes: DataFrame, edits: DataFrame, now: str) -> DataFrame:
    """Notes (doc_id, title, body, frontmatter) after edits (doc_id, title, body): null keeps the old value, keys of the frontmatter stay,
    `updated` is set and the hash is that of the new body; notes without an edit are as they were, edits without a note are left out."""
    new = edits.groupBy("doc_id").agg(F.max(F.struct("title", "body")).alias("e"))
    rows = notes.join(new, "doc_id", "left")
    body = F.coalesce("e.body", "body")
    stamp = F.when(F.col("e").isNotNull(), F.map_from_arrays(F.array(F.lit("updated"), F.lit("hash")), F.array(F.lit(now), T.content_hash(body))))
    kept = F.map_filter(F.coalesce("frontmatter", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: F.col("e").isNull() | ~k.isin("updated", "hash"))
    return rows.select("doc_id", F.coalesce("e.title", "title").alias("title"), body.alias("body"), F.when(stamp.isNull(), F.col("frontmatter")).otherwise(F.map_concat(kept, stamp)).alias("frontmatter"))


def renamed(notes: DataFrame, doc_id: str, old: str, new: str) -> DataFrame:
    """Notes (doc_id, title, body) after one got another title: its own row, and every note that links to the old title."""
    own = notes.withColumn("title", F.when(F.col("doc_id") == doc_id, F.lit(new)).otherwise(F.col("title")))
    links = renamed_links(notes, old, new).withColumnRenamed("body", "_b")
    return own.join(links, "doc_id", "left").select("doc_id", "title", F.coalesce("_b", "body").alias("body"))


def iso_time(at):
    """The time of a timestamp Column, as hours and minutes."""
    return F.date_format(at, "HH:mm")


def entity_patterns(entities: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """(entity_id, label, surface, pattern): whole-word patterns for an entity's names, longest first, and for its neighbours' if relations are given."""
    own = entities.select(F.col("id").alias("entity_id"), "id", F.lit("entity").alias("kind"), "name", "aliases")
    all_ = own
    if relations is not None:
        near = relations.where("source_id <> target_id").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
        both = near.union(near.select("b", "a")).distinct()
        all_ = own.unionByName(both.join(entities, both["b"] == entities["id"]).select(F.col("a").alias("entity_id"), "id", F.lit("connected").alias("kind"), "name", "aliases"))
    forms = F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda s: F.trim(s)))
    rows = all_.select("entity_id", F.concat("kind", F.lit(": "), "name").alias("label"), F.explode(forms).alias("surface")).where("surface <> ''").distinct()
    escaped = F.regexp_replace("surface", r"([\\.*+?^${}()|\[\]])", r"\\$1")
    return rows.withColumn("pattern", F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), escaped, F.lit(r"(?![\p{L}\p{N}_])")))


def daily_path(day):
    """The path of a day's note, from a date or timestamp Column."""
    return F.concat(F.lit("notes/"), F.date_format(day, "yyyy-MM-dd"), F.lit(".md"))


def model_profiles(models: DataFrame, wanted: DataFrame) -> DataFrame:
    """(model, model_id, window_tokens): the profile of each wanted model name: the same id, else the longest that contains it or is in it.

    `models` is a small table; it travels as one array.
    """
    table = models.agg(F.collect_list(F.struct(F.length("model_id").alias("n"), F.lower("model_id").alias("model_id"), "window_tokens")).alias("m"))
    key = F.lower(F.trim("model"))
    fits = F.filter("m", lambda x: F.contains(key, x["model_id"]) | F.contains(x["model_id"], key))
    same = F.filter("m", lambda x: x["model_id"] == key)
    listed = table.first()["m"]
    m = F.array(*[F.struct(F.lit(x["n"]).alias("n"), F.lit(x["model_id"]).alias("model_id"), F.lit(x["window_tokens"]).alias("window_tokens")) for x in listed]) if listed else F.array().cast("array<struct<n:int,model_id:string,window_tokens:int>>")
    best = F.when(F.size(same) > 0, F.get(same, 0)).otherwise(F.get(F.sort_array(fits, asc=False), 0))
    return wanted.withColumn("m", m).select("model", best.alias("b")).select("model", F.col("b.model_id").alias("model_id"), F.col("b.window_tokens").alias("window_tokens"))
