"""The selection bench: three ways to choose notes for a question, scored against gold sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemesh.operators.context import FLOOR, scores, select_context


# The notes of the published bench with their entities and similarities to both questions; its gold sets are a project's notes.
NOTES = (
    ("deals/atlas-status.md", "Atlas project status update: the rollout is on track for the current quarter overall.", ("Atlas",), 0.95, 0.0),
    ("deals/atlas-budget.md", "Atlas budget risk: Finance has not approved the spend yet, and that is the main risk.", ("Atlas", "Finance"), 0.9, 0.0),
    ("deals/atlas-champion.md", "Dana has been advocating internally for the initiative and steadily pushing it forward.", ("Atlas", "Dana"), 0.12, 0.0),
    ("deals/atlas-rival.md", "A competitor submitted a noticeably lower proposal for the very same scope of work.", ("Atlas", "Helix"), 0.12, 0.0),
    ("deals/orion-status.md", "Orion project status update: the design phase is complete and the build is starting now.", ("Orion",), 0.0, 0.95),
    ("deals/orion-budget.md", "Orion budget risk: Finance flagged the spend for review, which is the principal risk here.", ("Orion", "Finance"), 0.0, 0.9),
    ("deals/orion-owner.md", "Lee owns the effort and coordinates all of the cross team dependencies day to day.", ("Orion", "Lee"), 0.0, 0.12),
    ("deals/orion-rival.md", "A rival vendor is pursuing the same account with an aggressive discount on their bid.", ("Orion", "Helix"), 0.0, 0.12),
    ("ops/cadence.md", "Project status meetings are held every week to review progress against the plan together.", (), 0.2, 0.2),
    ("ops/standup.md", "The team runs a short daily standup to sync on tasks and surface blockers quickly.", (), 0.18, 0.18),
    ("misc/cats.md", "Cats are small domesticated animals that famously enjoy sleeping for most of the day.", (), 0.0, 0.0),
    ("misc/weather.md", "The weather this week is mild with a gentle breeze and only a slight chance of rain.", (), 0.05, 0.05),
)
QUESTIONS = ("atlas-status-risk", "orion-status-risk")


def published(spark: SparkSession) -> DataFrame:
    """`run` on the published notes, sized in white-space tokens."""
    notes = spark.createDataFrame([(d, t, list(e), len(t.split())) for d, t, e, *_ in NOTES], "doc_id string, text string, entities array<string>, tokens int")
    gold = [(q, d) for q in QUESTIONS for d, *_ in NOTES if d.startswith("deals/" + q.split("-")[0])]
    cosines = [(q, n[0], n[3 + i]) for i, q in enumerate(QUESTIONS) for n in NOTES]
    return run(notes, spark.createDataFrame([(q,) for q in QUESTIONS], "query_id string"), spark.createDataFrame(gold, "query_id string, doc_id string"), spark.createDataFrame(cosines, "query_id string, doc_id string, score double"))


def run(notes: DataFrame, questions: DataFrame, gold: DataFrame, cosines: DataFrame) -> DataFrame:
    """(strategy, recall, precision, f1, tokens, efficiency), macro-averaged; efficiency is the f1 of a thousand tokens.

    `notes` (doc_id, text, entities, tokens), `questions` (query_id), `gold`
    (query_id, doc_id), `cosines` (query_id, doc_id, score). The budget of a
    question is the tokens of its gold notes. raw takes all notes; naive fills
    the budget by cosine, skipping what doesn't fit; compiled adds notes that
    share entities with those above the floor.
    """
    budget = gold.join(notes, "doc_id").groupBy("query_id").agg(F.sum("tokens").cast("int").alias("budget"))
    rows = cosines.join(notes, "doc_id")
    seeds = rows.where(F.col("score") >= FLOOR).select("query_id", F.explode("entities").alias("e")).distinct().groupBy("query_id").agg(F.collect_set("e").alias("seed"))
    shared = F.size(F.array_intersect("entities", F.coalesce("seed", F.array().cast("array<string>"))))
    cand = rows.join(seeds, "query_id", "left").join(budget, "query_id").withColumn("shared_count", shared)
    cand = cand.select("query_id", F.concat("doc_id", F.lit("#0")).alias("chunk_id"), "doc_id", F.lit(0).alias("seq"), "text", "score", (F.col("shared_count") > 0).alias("graph_connected"), "shared_count", F.lit(False).alias("pinned"), F.col("tokens").cast("int").alias("tokens"), "budget")
    raw = rows.select("query_id", "doc_id")
    naive = compiled = None
    # few distinct budgets: one greedy pass each
    for b in sorted(r["budget"] for r in budget.select("budget").distinct().collect()):
        own = cand.where(F.col("budget") == b)
        flat = own.withColumn("graph_connected", F.lit(False))
        n, c = select_context(flat, b, floor=-1.0, duplicate=2.0), select_context(own, b)
        naive, compiled = (n, c) if naive is None else (naive.unionByName(n), compiled.unionByName(c))
    cost = lambda s: s.join(notes.select("doc_id", F.col("tokens").alias("_t")), "doc_id").groupBy("query_id").agg(F.sum("_t").alias("tokens"))
    per = [scores(s, gold).join(cost(s), "query_id", "left").withColumn("strategy", F.lit(k)) for k, s in (("raw", raw), ("naive", naive), ("compiled", compiled)) if s is not None]
    all_ = per[0]
    for p in per[1:]:
        all_ = all_.unionByName(p)
    means = all_.groupBy("strategy").agg(*[F.round(F.avg(c), 3).alias(c) for c in ("recall", "precision", "f1")], F.round(F.avg(F.coalesce("tokens", F.lit(0))), 0).cast("int").alias("tokens"))
    return means.withColumn("efficiency", F.when(F.col("tokens") > 0, F.round(F.col("f1") / F.col("tokens") * 1000, 3)).otherwise(0.0))
