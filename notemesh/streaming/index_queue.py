"""The index queue as a stream: notes that arrive are chunked, embedded, and their names extracted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notemesh.operators import chunking, graph
from notemesh.sources.store import Store


def index_batch(store: Store, notes: DataFrame, dim: int = 96) -> None:
    """Indexes a batch of notes (doc_id, body): documents with an unchanged hash are skipped, others replaced, their hash last."""
    one = notes.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("body").alias("body"))
    meta = store.read("graph_meta")
    empty = one.sparkSession.createDataFrame([], "doc_id string, hash string")
    changed = graph.changed_docs(one, empty if meta is None else meta).persist()
    try:
        pieces = chunking.chunk_notes(changed).withColumn("chunk_id", F.concat_ws("#", "doc_id", F.col("seq").cast("string")))
        chunks = chunking.embed(pieces, dim).select("chunk_id", "doc_id", "seq", "text", "char_start", "char_end", "embedding")
        for name in ("chunks", "mentions", "relations"):
            store.delete(name, changed, "doc_id")
        chunks = store.append("chunks", chunks)
        entities, relations = graph.resolve(graph.extract(changed))
        fresh = chunks.join(changed.select("doc_id"), "doc_id", "left_semi")
        store.append("mentions", graph.scan_mentions(entities, fresh))
        store.append("relations", relations.where(F.coalesce("confidence", F.lit(1.0)) >= graph.RELATION_FLOOR))
        store.upsert("entities", graph.last_write(entities.select("id", "name", F.lit("other").alias("type"), "aliases", "doc_id"), "doc_id"), ["id"])
        store.upsert("graph_meta", changed.select("doc_id", F.concat(F.lit("h:"), F.col("hash")).alias("hash")), ["doc_id"])
    finally:
        changed.unpersist()


def start(notes: DataFrame, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the queue on a streaming table of notes; a batch that is repeated after a failure changes nothing."""
    writer = notes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: index_batch(store, df))
    return (writer.trigger(availableNow=True) if once else writer).start()
