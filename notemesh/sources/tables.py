"""Table access: one Parquet file or folder per table under a dataset directory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan of one table; filters and column selection reach the Parquet reader."""
    return spark.read.parquet(table_path(root, name))


def once(df: DataFrame, keys: Sequence[str], cols: Sequence[str], newest: str | None = None) -> DataFrame:
    """One row per key, with the columns `keys + cols`.

    Rows delivered twice count once. If copies differ, the row with the latest
    `newest` wins, and among equals the largest struct of `cols`; without
    `newest` the largest struct wins, so the result never depends on row order.
    Rows with a null key are dropped. Maps can't be ordered and aren't allowed
    in `cols`.
    """
    order = ([F.col(newest)] if newest else []) + [F.col(c) for c in cols]
    kept = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    picked = kept.groupBy(*keys).agg(F.max(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)])).alias("_row"))
    skip = 1 if newest else 0
    return picked.select(*keys, *[F.col(f"_row.c{i + skip}").alias(c) for i, c in enumerate(cols)])


def hashed_sample(df: DataFrame, keys: Sequence[str], rows: int, total: int) -> DataFrame:
    """About `rows` of a table's `total` rows, at most twice as many: those whose key has a small hash.

    The choice doesn't depend on partitions or order, and each task keeps its
    share only, so what reaches the driver is bounded at any size of the table.
    """
    if total <= rows:
        return df
    bound = int(rows / total * (1 << 40))
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < bound).limit(2 * rows)
