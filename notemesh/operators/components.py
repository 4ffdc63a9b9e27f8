"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemesh.plans import materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component) for all nodes of `edges` (a long, b long); the component is its smallest node.

    Each round writes the new edges to the shared folder, so a lost executor
    costs one round at most. Self-loops are ignored; no edges give no rows. The
    steps need a number of rounds that grows with the logarithm of the longest
    path; should `rounds` not be enough, an error is raised.
    """
    now = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        now = materialize(_small(_large(now)), "edges")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (seen["n"], seen["h"]):
            break
        mark = (seen["n"], seen["h"])
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
