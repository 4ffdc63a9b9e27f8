"""Keyed tables in Parquet: upserts, deletes and appends as rewrites that swap in atomically."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows whose key isn't in `new`, and the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def without(old: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't among `ids` (column `key`); rows with a null key stay."""
    return old.join(ids.select(key).distinct(), key, "left_anti").select(old.columns)


class Store:
    """Tables under a folder; each write makes a new version, and a pointer file names the current one.

    A failed write leaves the current version alone. Versions before the last
    two are removed by `prune`.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[str]:
        marks = self._fs.globStatus(self._path(f"{self.root}/{name}/current-*"))
        return sorted(s.getPath().getName()[len("current-") :] for s in marks or [])

    def read(self, name: str) -> DataFrame | None:
        versions = self._versions(name)
        return self.spark.read.parquet(f"{self.root}/{name}/{versions[-1]}") if versions else None

    def write(self, name: str, df: DataFrame) -> DataFrame:
        last = self._versions(name)
        number = int(last[-1].split("-")[0]) + 1 if last else 1
        version = f"{number:08d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.root}/{name}/{version}")
        self._fs.create(self._path(f"{self.root}/{name}/current-{version}")).close()
        return self.read(name)

    def upsert(self, name: str, new: DataFrame, keys: list[str]) -> DataFrame:
        old = self.read(name)
        return self.write(name, new if old is None else upserted(old, new, keys))

    def append(self, name: str, new: DataFrame) -> DataFrame:
        old = self.read(name)
        return self.write(name, new if old is None else old.unionByName(new.select(old.columns)))

    def delete(self, name: str, ids: DataFrame, key: str) -> DataFrame | None:
        old = self.read(name)
        return None if old is None else self.write(name, without(old, ids, key))

    def delete_docs(self, ids: DataFrame) -> None:
        """Removes documents (column doc_id) from all tables that have them; entities stay."""
        for name in ("chunks", "notes", "mentions", "relations", "graph_meta"):
            self.delete(name, ids, "doc_id")

    def replace_retrieval(self, hits: DataFrame) -> DataFrame:
        """Replaces the stored hits of the queries in `hits` (query_id, chunk_id, score), ranked from 1."""
        from pyspark.sql import Window

        ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
        old = self.read("retrieved_from")
        return self.write("retrieved_from", ranked if old is None else without(old, hits, "query_id").unionByName(ranked.select(old.columns)))

    def prune(self, name: str) -> None:
        for version in self._versions(name)[:-2]:
            self._fs.delete(self._path(f"{self.root}/{name}/current-{version}"), False)
            self._fs.delete(self._path(f"{self.root}/{name}/{version}"), True)
