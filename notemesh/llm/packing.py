"""Problem 9: filling containers of fixed capacity with documents.

A document longer than a container fills whole containers and leaves a rest;
nothing else is split. Rests and documents are packed by cost: an item of t
tokens costs LINEAR·t + QUADRATIC·t², what attention over it takes, and items
in descending order go to the sequence of the least cost so far that has room.
A packing starts with as few sequences as could hold all tokens and opens one
more when an item fits none.

Documents are dealt by a hash of their key to shards of about SHARD_TOKENS
tokens, packed independently: each leaves about one container partly empty, a
small share of the shard's, so the waste doesn't grow with the corpus and no
task packs more than a shard.

Defined cases: documents without tokens (null, empty) need no room and are in no
container; repeated rows of a key count once; capacities under 1 or null are
left out; equal sizes are taken in order of their key.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemesh.llm.tokenize import token_counts
from notemesh.plans import materialize
from notemesh.plans.registry import Registry
from notemesh.sources import once, read_table

SHARD_TOKENS = 2_000_000
MAX_WINDOWS = 100
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def assign(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Sequence of every item; `sizes` must be descending and at most `capacity`."""
    sequences = int(-(-int(sizes.sum()) // capacity)) if len(sizes) else 0
    room = [capacity] * sequences
    ready = [(0.0, i) for i in range(sequences)]  # by cost; all have room for the item at hand, or are found not to
    full: list[tuple[int, float, int]] = []  # by room, largest first: too full for the items so far
    out = np.empty(len(sizes), np.int64)
    for at, size in enumerate(sizes.tolist()):
        while full and -full[0][0] >= size:
            _, cost, i = heapq.heappop(full)
            heapq.heappush(ready, (cost, i))
        place = -1
        while ready:
            cost, i = heapq.heappop(ready)
            if room[i] >= size:
                place = i
                break
            heapq.heappush(full, (-room[i], cost, i))
        if place < 0:
            place, cost = len(room), 0.0
            room.append(capacity)
        room[place] -= size
        out[at] = place
        heapq.heappush(ready, (cost + LINEAR * size + QUADRATIC * size * size, place))
    return out


def pack(sizes: DataFrame, windows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(model_id, container_id, key, piece, tokens) of sizes (key, tokens) for windows (model_id, window_tokens)."""
    kind = sizes.schema[key].dataType.simpleString()
    sizes = materialize(sizes.where("tokens > 0"), "sizes")
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    shards = max(1, -(-total // SHARD_TOKENS))
    # one row of the table a model; more than MAX_WINDOWS capacities are refused, not cut
    caps = windows.where("model_id IS NOT NULL AND window_tokens > 0").select("model_id", F.col("window_tokens").cast("long").alias("cap")).distinct().limit(MAX_WINDOWS + 1).collect()
    if len(caps) > MAX_WINDOWS:
        raise ValueError(f"more than {MAX_WINDOWS} capacities")
    of = F.array(*[F.struct(F.lit(r["model_id"]).alias("model_id"), F.lit(r["cap"]).alias("cap")) for r in sorted(caps)]) if caps else F.array().cast("array<struct<model_id:string,cap:bigint>>")
    each = sizes.select(key, "tokens", F.inline(of)).withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)))
    whole = each.where("tokens > cap").select("model_id", "cap", key, F.explode(F.sequence(F.lit(0).cast("long"), F.expr("tokens div cap - 1"))).alias("piece"))
    filled = whole.select("model_id", F.concat_ws("-", "model_id", F.lit("whole"), F.col(key).cast("string"), F.col("piece").cast("string")).alias("container_id"), key, F.col("piece").cast("int").alias("piece"), F.col("cap").cast("int").alias("tokens"))
    rest = each.select("model_id", "cap", "shard", F.col(key).alias("k"), F.expr("CASE WHEN tokens > cap THEN tokens div cap ELSE 0 END").cast("int").alias("piece"), F.expr("CASE WHEN tokens > cap THEN tokens % cap ELSE tokens END").cast("int").alias("tokens")).where("tokens > 0")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "k"], ascending=[False, True], kind="stable")
        model, shard = pdf["model_id"].iat[0], pdf["shard"].iat[0]
        seq = assign(pdf["tokens"].to_numpy(np.int64), int(pdf["cap"].iat[0]))
        return pd.DataFrame({"model_id": model, "container_id": [f"{model}-{shard}-{i}" for i in seq], key: pdf["k"].to_numpy(), "piece": pdf["piece"].to_numpy(), "tokens": pdf["tokens"].to_numpy()})

    packed = rest.groupBy("model_id", "shard").applyInPandas(work, f"model_id string, container_id string, {key} {kind}, piece int, tokens int")
    return filled.unionByName(packed)


def containers(spark: SparkSession, sf: str) -> DataFrame:
    docs = once(read_table(spark, sf, "documents"), ["doc_id"], ["text"])
    return pack(token_counts(docs, "doc_id", "text"), read_table(spark, sf, "model_windows"))


def register(reg: Registry) -> None:
    @reg.query("p9_containers")
    def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
        return containers(spark, sf)

    @reg.query("p9_fill")
    def p9_fill(spark: SparkSession, sf: str) -> DataFrame:
        """Containers, tokens and share of the space used, by capacity."""
        caps = read_table(spark, sf, "model_windows").select("model_id", "window_tokens")
        made = containers(spark, sf).groupBy("model_id").agg(F.count_distinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
        return made.join(F.broadcast(caps), "model_id").select("model_id", "window_tokens", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("window_tokens")), 4).alias("fill"))
