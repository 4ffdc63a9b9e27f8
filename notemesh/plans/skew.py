"""Joins that keep working when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sides up to this many bytes (as estimated from the written table, uncompressed) are broadcast.
BROADCAST_BYTES = 24 << 20
#: Hot keys that are broadcast at most; more are joined by shuffle.
HOT_KEYS = 100_000


def dictionary_join(facts: DataFrame, words: DataFrame, key: str, words_bytes: int, count: str | None = None, rows: int = 500_000) -> DataFrame:
    """Inner join of `facts` with a table that has one row per `key`.

    A dictionary of at most BROADCAST_BYTES is broadcast. A larger one is joined
    by shuffle. Its column `count`, if it has one, tells how many facts a key
    has: a key is spread over one salt for every `rows` of them, so no partition
    gets more of one key, however hot it is, and its dictionary row is repeated
    once per salt. Salts of a fact come from the key's count, which only the
    facts of keys with more than one salt look up; those are few, since there
    are at most (all facts) / `rows` of them, and they are broadcast only if
    they are few enough. The count is dropped.
    """
    if words_bytes <= BROADCAST_BYTES:
        return facts.join(F.broadcast(words.drop(*([count] if count else []))), key)
    if count is None:
        return facts.join(words, key)
    salts = F.ceil(F.col(count) / F.lit(rows)).cast("int")
    hot = words.where(F.col(count) > rows).select(key, salts.alias("_n"))
    few = hot.limit(HOT_KEYS + 1).count() <= HOT_KEYS
    spread = words.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop(count)
    flagged = facts.join(F.broadcast(hot) if few else hot, key, "left")
    salted = flagged.withColumn("_salt", F.when(F.col("_n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*facts.columns), F.col("_n")).cast("int"))).drop("_n")
    return salted.join(spread, [key, "_salt"]).drop("_salt")
