"""Choosing, compiling, redacting and pricing context."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemesh.functions import text as T

# Thresholds of the selection.
FLOOR, DUPLICATE, PROMPT_DUPLICATE = 0.25, 0.8, 0.65
#: Models of a manifest; the table is broadcast.
MOST_MODELS = 1_000


_SIGNS = re.compile(r"[^\w\s]|_")


def shingles(text: str) -> set[str]:
    """Runs of three words, lower case, without signs; a shorter text is one run."""
    words = _SIGNS.sub(" ", text.lower()).split()
    return {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else ({" ".join(words)} if words else set())


def text_similarity(a: str, b: str) -> float:
    """Jaccard similarity of shingles; texts without words are alike if they are equal but for case and outer blanks."""
    return _similarity(a, shingles(a), b, shingles(b))


def _similarity(a: str, x: set[str], b: str, y: set[str]) -> float:
    if not x or not y:
        return float(a.strip().lower() == b.strip().lower())
    return len(x & y) / len(x | y)


def usefulness(candidates: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Adds `tier` (0 pinned, 1 by score, 2 linked through the graph) and `place` within the query; candidates of no tier drop out.

    Pinned ones are in order of document and seq, those of at least the floor by
    score, the linked rest by shared entities, then score; ties by document and seq.
    Of rows with one chunk_id the first of that order counts.
    """
    score, shared = F.coalesce("score", F.lit(0.0)), F.coalesce("shared_count", F.lit(0))
    tier = F.when(F.coalesce("pinned", F.lit(False)), 0).when(score >= floor, 1).when(F.coalesce("graph_connected", F.lit(False)), 2)
    rows = candidates.withColumn("tier", tier).where("tier IS NOT NULL")
    order = [F.col("tier"), F.when(F.col("tier") == 2, -shared), F.when(F.col("tier") > 0, -score), F.col("doc_id"), F.col("seq"), F.col("chunk_id")]
    one = rows.withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(*order))).where("_k = 1").drop("_k")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def _choose(budget: int, duplicate: float):
    """Walks a query's candidates in order; says of each whether it is kept, a duplicate or over the budget."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        used, fate = 0, []
        kept: list[tuple[str, set[str]]] = []
        at: set[tuple] = set()
        for tier, doc, seq, text, tokens in zip(pdf["tier"], pdf["doc_id"], pdf["seq"], pdf["text"].fillna(""), pdf["tokens"]):
            own = shingles(text)
            if (doc, seq) in at or any(_similarity(text, own, t, x) >= duplicate for t, x in kept):
                fate.append("duplicate")
            elif tier and used + tokens > budget:
                fate.append("budget")
            else:
                fate.append("kept")
                used += int(tokens)
                kept.append((text, own))
                at.add((doc, seq))
        return pdf.assign(fate=fate).sort_values(["doc_id", "seq", "place"])[["query_id", "chunk_id", "doc_id", "seq", "tokens", "tier", "fate"]]

    return work


def judged(candidates: DataFrame, budget: int, floor: float = FLOOR, duplicate: float = DUPLICATE) -> DataFrame:
    """(query_id, chunk_id, doc_id, seq, tokens, tier, fate) of a greedy choice under a token budget, per query.

    `candidates`: query_id, chunk_id, doc_id, seq, text, score, graph_connected,
    shared_count, pinned, tokens, any number a query. A near copy of a kept text, or the same place
    of a document again, is a `duplicate`; what exceeds the budget is over `budget`, and
    the walk goes on; pinned items ignore the budget. Ranks are made by a window;
    the walk itself depends on what was kept before, so a query is one group.
    """
    kind = candidates.schema["query_id"].dataType.simpleString()
    rows = usefulness(candidates, floor).select("query_id", "chunk_id", "doc_id", "seq", "text", F.coalesce("tokens", F.lit(0)).alias("tokens"), "tier", "place")
    return rows.groupBy("query_id").applyInPandas(_choose(budget, duplicate), f"query_id {kind}, chunk_id string, doc_id string, seq int, tokens int, tier int, fate string")


def select_context(candidates: DataFrame, budget: int, floor: float = FLOOR, duplicate: float = DUPLICATE) -> DataFrame:
    """(query_id, chunk_id, doc_id, seq, tokens) of the kept candidates, a query's rows in order of document and seq."""
    return judged(candidates, budget, floor, duplicate).where("fate = 'kept'").select("query_id", "chunk_id", "doc_id", "seq", "tokens")


def selection_counts(fates: DataFrame) -> DataFrame:
    """(query_id, kept, tokens, dropped_for_budget, dropped_as_duplicate) of `judged` rows; pinned duplicates count nowhere."""
    is_ = lambda f: F.when(F.col("fate") == f, 1).otherwise(0)
    return fates.groupBy("query_id").agg(F.sum(is_("kept")).alias("kept"), F.sum(is_("kept") * F.col("tokens")).alias("tokens"), F.sum(is_("budget")).alias("dropped_for_budget"), F.sum(F.when(F.col("tier") > 0, is_("duplicate")).otherwise(0)).alias("dropped_as_duplicate"))


def sources_from_hits(hits: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """(doc_id, seq, page, text, hash) for `compile_xml`: hits (chunk_id, doc_id, page, text), the seq from the chunk's id, 0 if it has none."""
    seq = F.coalesce(F.expr("try_cast(nullif(get(split(chunk_id, '#'), 1), '') AS int)"), F.lit(0))
    rows = hits.where("doc_id IS NOT NULL").select("doc_id", seq.alias("seq"), "page", "text")
    return rows.withColumn("hash", F.lit("")) if hashes is None else rows.join(hashes.select("doc_id", "hash"), "doc_id", "left").withColumn("hash", F.coalesce("hash", F.lit("")))


def sources_from_notes(notes: DataFrame) -> DataFrame:
    """(doc_id, seq, page, text, hash): each note (doc_id, body) as one chunk, with the hash of its body."""
    return notes.select("doc_id", F.lit(0).alias("seq"), F.lit(None).cast("int").alias("page"), F.col("body").alias("text"), T.content_hash(F.col("body")).alias("hash"))


def compile_xml(chunks: DataFrame, redact: list[str] | None = None, generated_by: str = "notemesh") -> DataFrame:
    """(doc_id, xml, tokens): one payload a document from chunks (doc_id, seq, page, text, hash).

    The first chunk of a seq counts; text is redacted, then escaped; the same
    rows in any order give the same bytes. Tokens are white-space tokens.
    """
    body = F.coalesce("text", F.lit(""))
    body = T.xml_text(T.redact(body, redact) if redact else body)
    page = F.when(F.col("page").isNull(), "").otherwise(F.concat(F.lit(' page="'), F.col("page").cast("string"), F.lit('"')))
    line = F.concat(F.lit('    <chunk seq="'), F.col("seq").cast("string"), F.lit('"'), page, F.lit(">"), body, F.lit("</chunk>"))
    one = chunks.where("doc_id IS NOT NULL AND seq IS NOT NULL").select("doc_id", "seq", line.alias("line")).groupBy("doc_id", "seq").agg(F.min("line").alias("line"))
    lines = one.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("l"))
    head = F.concat(F.lit(f'<context generated_by="{generated_by}" version="2.0">\n  <source path="'), T.xml_attr(F.col("doc_id")), F.lit('">\n'))
    xml = F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n  </source>\n</context>"))
    return lines.select("doc_id", xml.alias("xml")).withColumn("tokens", T.token_count(F.col("xml")))


def _models(listed: DataFrame):
    rows = listed.limit(MOST_MODELS + 1).collect()
    if len(rows) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    each = [F.struct(F.lit(r["model_id"]).alias("model_id"), F.lit(r["window_tokens"]).alias("window_tokens"), F.lit(r["price"]).cast("double").alias("price")) for r in sorted(rows, key=lambda r: (r["model_id"], r["window_tokens"]))]
    return F.array(*each) if each else F.array().cast("array<struct<model_id:string,window_tokens:int,price:double>>")


def manifest(compiled: DataFrame, models: DataFrame) -> DataFrame:
    """(doc_id, model_id, tokens, fits, over_by, utilization, cost) of compiled payloads (doc_id, tokens) for models (model_id, window_tokens, and price, for a million tokens, if known)."""
    price = "price" in models.columns
    listed = models.select("model_id", "window_tokens", *(["price"] if price else [F.lit(None).cast("double").alias("price")])).where("model_id IS NOT NULL AND window_tokens > 0").distinct()
    rows = compiled.select("doc_id", F.col("tokens").cast("long").alias("tokens")).withColumn("_m", _models(listed)).select("*", F.inline("_m")).drop("_m")
    over = F.greatest(F.col("tokens") - F.col("window_tokens"), F.lit(0)).cast("long")
    return rows.select("doc_id", "model_id", "tokens", (over == 0).alias("fits"), over.alias("over_by"), F.round(F.col("tokens") / F.col("window_tokens"), 3).alias("utilization"), F.round(F.col("tokens") / 1e6 * F.col("price"), 6).alias("cost"))


def audit_record(compiled: DataFrame, hashes: DataFrame, preview: DataFrame, model: str, at: str) -> DataFrame:
    """(doc_id, exported_at, target_model, tokens, hash, redactions): what left, as hashes and counts, never as text."""
    counts = preview.groupBy("doc_id", "label").agg(F.sum("matches").alias("n")).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat("label", F.lit("="), F.col("n").cast("string")))), ", ").alias("redactions"))
    rows = compiled.select("doc_id", F.col("tokens").cast("long").alias("tokens")).join(hashes.select("doc_id", "hash"), "doc_id", "left").join(counts, "doc_id", "left")
    return rows.select("doc_id", F.lit(at).alias("exported_at"), F.lit(model).alias("target_model"), "tokens", F.coalesce("hash", F.lit("")).alias("hash"), F.coalesce("redactions", F.lit("")).alias("redactions"))


def redaction_preview(texts: DataFrame, key: str, text: str, kinds: list[str]) -> DataFrame:
    """(key, label, matches, found): matches of each kind in the original text, with the distinct ones sorted."""
    rows = [F.struct(F.lit(f"pii: {k}").alias("label"), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(T.PII_PATTERNS[k]), F.lit(0)).alias("m")) for k in kinds]
    all_ = texts.select(key, F.explode(F.array(*rows)).alias("r")).where("size(r.m) > 0")
    return all_.select(key, F.col("r.label").alias("label"), F.size("r.m").alias("matches"), F.sort_array(F.array_distinct("r.m")).alias("found"))


def redaction_summary(preview: DataFrame) -> DataFrame:
    return preview.groupBy("label").agg(F.sum("matches").alias("matches"))


def cost_report(docs: DataFrame, models: DataFrame) -> DataFrame:
    """(doc_id, model_id, tokens, fits, utilization) of docs (doc_id, tokens) for each model (model_id, window_tokens), a small table."""
    listed = models.agg(F.sort_array(F.collect_set(F.struct("model_id", "window_tokens"))).alias("m")).first()["m"]
    each = F.array(*[F.struct(F.lit(m["model_id"]).alias("model_id"), F.lit(m["window_tokens"]).alias("w")) for m in listed]) if listed else F.array().cast("array<struct<model_id:string,w:int>>")
    rows = docs.select("doc_id", "tokens", F.inline(each))
    return rows.select("doc_id", "model_id", "tokens", (F.col("tokens") <= F.col("w")).alias("fits"), F.round(F.col("tokens") / F.col("w"), 3).alias("utilization"))


def citations(answers: DataFrame) -> DataFrame:
    """(turn_id, nth, ref, start, end): the numbers cited as [#n] in answers (turn_id, answer), in order, with their place in code points."""
    text = F.coalesce("answer", F.lit(""))
    mark = F.lit(r"\[#([0-9]+)\]")
    # pieces between the marks have a length each; the start of a mark is what stands before it
    found = answers.select("turn_id", F.regexp_extract_all(text, mark, F.lit(0)).alias("m"), F.transform(F.split(text, r"\[#[0-9]+\]"), F.length).alias("gap"))
    rows = found.select("turn_id", "m", "gap", F.posexplode(F.transform("m", F.length)).alias("at", "size"))
    before = F.aggregate(F.slice("gap", F.lit(1), F.col("at") + 1), F.lit(0), lambda s, x: s + x) + F.aggregate(F.slice(F.transform("m", F.length), F.lit(1), F.col("at")), F.lit(0), lambda s, x: s + x)
    ref = F.expr("try_cast(regexp_replace(get(m, at), '[^0-9]', '') AS int)")
    return rows.select("turn_id", (F.col("at") + 1).alias("nth"), ref.alias("ref"), before.alias("start"), (before + F.col("size")).alias("end"))


def resolve_citations(cited: DataFrame, sources: DataFrame) -> DataFrame:
    """(turn_id, nth, ref, start, end, chunk_id): citations joined to sources (turn_id, ref, chunk_id); the chunk is null for a number without source."""
    return cited.join(sources.select("turn_id", "ref", "chunk_id"), ["turn_id", "ref"], "left").select("turn_id", "nth", "ref", "start", "end", "chunk_id")


def citation_usage(resolved: DataFrame) -> DataFrame:
    """(turn_id, used, dropped): how many different chunks an answer cites, and how many of its marks name no source."""
    return resolved.groupBy("turn_id").agg(F.count_distinct("chunk_id").alias("used"), F.count(F.when(F.col("chunk_id").isNull(), 1)).alias("dropped"))


def split_reasoning(answer: str | None) -> tuple[str, str]:
    """(reasoning, answer): <think> blocks, an unclosed one included, apart from the rest."""
    if not answer:
        return "", answer or ""
    found = re.findall(r"<think>(.*?)(?:</think>|\Z)", answer, flags=re.S)
    return "\n".join(x.strip() for x in found), re.sub(r"<think>.*?(?:</think>|\Z)", "", answer, flags=re.S).strip()


def scores(selected: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, recall, precision, f1) of selected against gold (both query_id, doc_id); no gold is recall 1, nothing selected precision 0."""
    s, g = selected.select("query_id", "doc_id").distinct(), gold.select("query_id", "doc_id").distinct()
    both = s.join(g, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hit"))
    n = s.groupBy("query_id").agg(F.count("*").alias("n_sel")).join(g.groupBy("query_id").agg(F.count("*").alias("n_gold")), "query_id", "full").join(both, "query_id", "left").fillna(0, ["n_sel", "n_gold", "hit"])
    r = F.when(F.col("n_gold") == 0, 1.0).otherwise(F.col("hit") / F.col("n_gold"))
    p = F.when(F.col("n_sel") == 0, 0.0).otherwise(F.col("hit") / F.col("n_sel"))
    out = n.select("query_id", r.alias("recall"), p.alias("precision"))
    return out.withColumn("f1", F.when(F.col("recall") + F.col("precision") > 0, 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).otherwise(0.0))
