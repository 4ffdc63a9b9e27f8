"""Retrieval for many queries at once.

A hit table has (query_id, rank, chunk_id, doc_id, score, …). `rank` says the
order that results come in; every window is partitioned by query_id, and ties go
to the smaller chunk_id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType

from notemesh.functions import text as T
from notemesh.operators.graph import spread
from notemesh.plans import dealt, dealt_block, materialize

# Constants that define results.
RRF_K, ANCHOR_BAND, ABSOLUTE, RELATIVE, STRONG = 60, 0.8, 0.45, 0.75, 0.6
TOP_K, MAX_TERMS, MAX_ADD = 8, 8, 4

#: Digits of a cosine that count; what is equal to them is a tie.
DIGITS = 10
#: Vectors of a block of queries, and of the data that one task compares with it.
QUERY_BLOCK, DATA_BLOCK = 4_096, 32_768
#: Above the error of a product of unit vectors in single precision.
MARGIN = 2e-5
#: Signs of a block that are held as one byte a row.
DENSE_SIGNS = 2_000


def ranked(df: DataFrame, *order: Column, by: str = "query_id", name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as unit rows; a missing one, or one without length, is a row of zeros."""
    lists = column.combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(size) and lists.null_count == 0 and (size == size[0]).all() and size[0]:
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(size), -1)
    else:
        rows = lists.to_pylist()
        dim = max((len(v) for v in rows if v is not None), default=1)
        x = np.stack([np.zeros(dim) if v is None else np.asarray(v, np.float64) for v in rows]) if rows else np.zeros((0, 1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(x / np.linalg.norm(x, axis=1)[:, None])


def _pairs_of_blocks(queries: DataFrame, data: DataFrame, work: Callable, schema: str) -> DataFrame:
    """`work(table of a block of queries, iterator over the tables of blocks of data)` for every block of queries.

    Both sides are written once to the shared folder, dealt by key. A task has one block of queries and reads the blocks of data one after the
    other, so it knows what is best so far; a table of few queries meets the data in several tasks. Rows of a block of data are sorted by chunk_id.
    """
    spark = data.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    q, d = materialize(queries, "queries"), materialize(data, "data")
    sizes = q.count(), d.count()
    qb = max(1, -(-sizes[0] // QUERY_BLOCK), min(tasks, sizes[0] // 256))
    db = max(1, -(-sizes[1] // DATA_BLOCK))
    db = max(db, min(spark.sparkContext.defaultParallelism, sizes[1] // 1024)) if qb < tasks else db
    parts = min(db, -(-tasks // qb))
    left, right = dealt(q, "queries", "query_id", qb), dealt(d, "data", "chunk_id", db)
    columns = q.columns, d.columns

    def run(batches):
        for batch in batches:
            for i in batch["id"].to_pylist():
                own = dealt_block(left, i // parts, columns[0])
                if own is not None:
                    blocks = (dealt_block(right, j, columns[1]) for j in range(i % parts, db, parts))
                    out = work(own, (x.sort_by("chunk_id").combine_chunks() for x in blocks if x is not None))
                    yield from out.to_batches()

    return spark.range(0, qb * parts, 1, qb * parts).mapInArrow(run, schema)


def _types(queries: DataFrame, data: DataFrame) -> tuple[str, pa.Schema]:
    """The head of a result's schema, for Spark and for Arrow."""
    kinds = queries.schema["query_id"].dataType, data.schema["chunk_id"].dataType
    return f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}", pa.schema([("query_id", to_arrow_type(kinds[0])), ("chunk_id", to_arrow_type(kinds[1]))])


def _nearest(q: np.ndarray, blocks, k: int) -> list[list[tuple[float, object]]]:
    """Of each unit row of q the k best (-cosine, id) among the rows of blocks (ids, unit rows); ties go to the smaller id.

    Products are made in single precision; what may be among the best by them, with MARGIN for their error, is computed in full.
    """
    best: list[list[tuple[float, object]]] = [[] for _ in q]
    least = np.full(len(q), -np.inf)
    single = q.astype(np.float32)
    for ids, d in blocks:
        near = np.ascontiguousarray(d.astype(np.float32).T)
        for at in range(0, len(q), 256):
            s = single[at : at + 256] @ near
            floor = least[at : at + 256]
            new = ~np.isfinite(floor)
            if new.any() and s.shape[1] > k:
                floor = floor.copy()
                floor[new] = np.partition(s[new], -k, axis=1)[:, -k] - MARGIN
            where = np.flatnonzero(s >= (floor - MARGIN).astype(np.float32)[:, None])
            row, col = where // s.shape[1], where % s.shape[1]
            cos = np.concatenate([np.einsum("ij,ij->i", q[at + row[i : i + 65_536]], d[col[i : i + 65_536]]) for i in range(0, len(row), 65_536)] or [np.empty(0)]).round(DIGITS)
            order = np.lexsort((col, -cos, row))
            row, col, cos = row[order], col[order], cos[order]
            keep = (np.arange(len(row)) - np.searchsorted(row, row) < k) & (cos >= least[at + row])
            row, col, cos = row[keep], col[keep], cos[keep]
            cuts = np.searchsorted(row, np.arange(len(s) + 1))
            for i in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[i], cuts[i + 1]
                best[at + i] = sorted(best[at + i] + list(zip((-cos[a:b]).tolist(), ids.take(pa.array(col[a:b])).to_pylist())))[:k]
                if len(best[at + i]) == k:
                    least[at + i] = -best[at + i][-1][0]
    return best


def vector_top(queries: DataFrame, data: DataFrame, k: int = TOP_K) -> DataFrame:
    """Exact top k by cosine: (query_id, chunk_id, score, rank).

    `queries` (query_id, vec) and `data` (chunk_id, vec) with vectors of one
    length. Both sides are dealt to blocks of bounded size in the shared folder
    and a task holds one block of each, so neither side must fit in memory;
    vectors that are null take no part.
    """
    head, schema = _types(queries, data)

    def work(own: pa.Table, blocks) -> pa.Table:
        best = _nearest(_matrix(own["vec"]), ((x["chunk_id"].combine_chunks(), _matrix(x["vec"])) for x in blocks), k)
        n = np.array([len(x) for x in best], np.int64)
        columns = [own["query_id"].combine_chunks().take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array([c for x in best for _, c in x], schema.field(1).type), pa.array([-s + 0.0 for x in best for s, _ in x], pa.float64())]
        return pa.Table.from_arrays(columns, schema=schema.append(pa.field("score", pa.float64())))

    part = _pairs_of_blocks(queries.where("vec IS NOT NULL").select("query_id", "vec"), data.where("vec IS NOT NULL").select("chunk_id", "vec"), work, f"{head}, score double")
    return ranked(part, F.desc("score"), F.asc("chunk_id")).where(F.col("rank") <= k)


def floor_top(hits: DataFrame, floor: float) -> DataFrame:
    """All hits of a query if its best score reaches the floor, else none."""
    return hits.withColumn("_top", F.max("score").over(Window.partitionBy("query_id"))).where(F.col("_top") >= floor).drop("_top")


class _Signs:
    """The rows of a block that have a sign: as places, or for a frequent sign as one byte a row."""

    def __init__(self, lists: pa.Array):
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        sign, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)
        order = np.argsort(sign, kind="stable")
        self.rows, self.n = row[order], len(size)
        self.signs, start = np.unique(sign[order], return_index=True)
        self.ends = np.r_[start, len(row)]
        self.dense: dict[int, np.ndarray] = {}

    def places(self, signs: np.ndarray) -> np.ndarray:
        """The number of each sign here, -1 if no row has it."""
        if not len(self.signs):
            return np.full(len(signs), -1)
        at = np.minimum(np.searchsorted(self.signs, signs), len(self.signs) - 1)
        return np.where(self.signs[at] == signs, at, -1)

    def add(self, total: np.ndarray, place: int) -> None:
        a, b = self.ends[place], self.ends[place + 1]
        if (b - a) * 64 < self.n:
            total[self.rows[a:b]] += 1
            return
        one = self.dense.get(place)
        if one is None:
            one = np.zeros(self.n, np.uint8)
            one[self.rows[a:b]] = 1
            if len(self.dense) < DENSE_SIGNS:
                self.dense[place] = one
        total += one

    def count(self, places: list[int], labels: list[int]) -> tuple[np.ndarray, np.ndarray | None]:
        """How many labels each row shares; and, if it isn't the same as sharing any, which rows share something."""
        kind = np.uint8 if len(places) < 255 else np.uint16
        total = np.zeros(self.n, kind)
        if 0 not in labels and len(set(labels)) == len(labels):
            for p in places:
                if p >= 0:
                    self.add(total, p)
            return total, None
        for label in set(labels) - {0}:
            own = np.zeros(self.n, kind)
            for p, x in zip(places, labels):
                if x == label and p >= 0:
                    self.add(own, p)
            total += own > 0
        none = np.zeros(self.n, kind)
        for p, x in zip(places, labels):
            if x == 0 and p >= 0:
                self.add(none, p)
        return total, (total > 0) | (none > 0)


def _most_shared(own: pa.Table, blocks, k: int) -> list[list[tuple[int, float, object]]]:
    """Of each query the k best (-shared, -cosine, id)."""
    q = _matrix(own["vec"])
    single = q.astype(np.float32)
    signs, labels, skip = own["signs"].to_pylist(), own["labels"].to_pylist(), own["skip"].to_pylist()
    ends = np.r_[0, np.cumsum([len(x) for x in signs])].astype(np.int64)
    flat = np.array([x for own_ in signs for x in own_], np.int64)
    best: list[list[tuple[int, float, object]]] = [[] for _ in signs]
    for x in blocks:
        ids, d, have = x["chunk_id"].combine_chunks(), _matrix(x["vec"]), _Signs(x["signs"].combine_chunks())
        place = {c: i for i, c in enumerate(ids.to_pylist())} if any(skip) else {}
        near, at = have.places(flat).tolist(), None
        if d.shape[1] != q.shape[1]:  # vectors of no row, or of no query
            d, used = np.zeros((len(d), 1)), np.zeros((len(q), 1))
        else:
            used = q
        columns = np.ascontiguousarray(d.astype(np.float32).T) if used is q else None
        for at in range(0, len(q), 128):
            found = []
            for i in range(at, min(at + 128, len(q))):
                shared, any_ = have.count(near[ends[i] : ends[i + 1]], labels[i])
                if any_ is not None:
                    shared = np.where(any_, shared.astype(np.int32) + 1, 0)  # a row that shares no label, but a sign, is a candidate
                for c in skip[i]:
                    if c in place:
                        shared[place[c]] = 0
                level = 1
                if len(best[i]) == k:
                    level = max(1, -best[i][-1][0] + (any_ is not None))
                else:
                    top = int(shared.max(initial=0))
                    while top > 1 and np.count_nonzero(shared >= top) < k:
                        top -= 1
                    level = max(1, top)
                met = np.flatnonzero(shared >= level)
                if len(met):
                    found.append((i, met, shared[met].astype(np.int64) - (any_ is not None), level - (any_ is not None)))
            s = single[at : at + 128] @ columns if columns is not None and sum(len(m) for _, m, _, _ in found) > 128 * 512 else None
            for i, met, shared, level in found:
                if s is not None and len(met) > 4 * k:
                    cos = s[i - at, met]
                    tied = shared == level
                    more = len(met) - np.count_nonzero(tied)
                    low = np.float32(-np.inf)
                    if len(best[i]) == k:
                        low = np.float32(-best[i][-1][1] - 2 * MARGIN) if -best[i][-1][0] == level else low
                    elif more < k and np.count_nonzero(tied) > k - more:
                        low = np.partition(cos[tied], -(k - more))[-(k - more)] - np.float32(2 * MARGIN)
                    keep = ~tied | (cos >= low)
                    met, shared = met[keep], shared[keep]
                cos = (d[met] @ used[i]).round(DIGITS)
                order = np.lexsort((met, -cos, -shared))[:k]
                best[i] = sorted(best[i] + list(zip((-shared[order]).tolist(), (-cos[order]).tolist(), ids.take(pa.array(met[order])).to_pylist())))[:k]
    return best


def shared_top(queries: DataFrame, data: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top k by signs in common: (query_id, chunk_id, shared_count, score, rank).

    `queries` (query_id, vec, signs, labels, skip) and `data` (chunk_id, vec,
    signs), one row a key; `signs` are hashes of entities or words, `labels` (as
    long as a query's signs) say which signs count as one, 0 as none; `skip`
    holds keys that can't be results. Order: shared_count, cosine, smaller key.
    Both sides are dealt to blocks and a task counts one pair of blocks, so a
    sign that is in a third of the rows makes no rows, and no key is one task.
    """
    head, schema = _types(queries, data)

    def work(own: pa.Table, blocks) -> pa.Table:
        best = _most_shared(own, blocks, k)
        n = np.array([len(x) for x in best], np.int64)
        columns = [own["query_id"].combine_chunks().take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array([c for x in best for _, _, c in x], schema.field(1).type), pa.array([-m for x in best for m, _, _ in x], pa.int32()), pa.array([-s + 0.0 for x in best for _, s, _ in x], pa.float64())]
        return pa.Table.from_arrays(columns, schema=schema.append(pa.field("shared_count", pa.int32())).append(pa.field("score", pa.float64())))

    part = _pairs_of_blocks(queries.select("query_id", "vec", "signs", "labels", "skip"), data.select("chunk_id", "vec", "signs"), work, f"{head}, shared_count int, score double")
    return ranked(part, F.desc("shared_count"), F.desc("score"), F.asc("chunk_id")).where(F.col("rank") <= k)


def lexical_top(queries: DataFrame, chunks: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top k by whole folded query words, then cosine, then chunk_id: (query_id, chunk_id, words, score, rank).

    `queries` (query_id, text, and vec if there is one), `chunks` (chunk_id,
    text, vec). At most eight terms a query count, the first ones; terms that
    fold to one word count each. Without a query vector the cosine is 0.
    """
    no_vec = F.lit(None).cast("array<float>").alias("vec")
    vec = lambda df: "vec" if "vec" in df.columns else no_vec
    terms = F.transform(F.slice(T.query_terms(F.col("text")), 1, MAX_TERMS), lambda w: F.xxhash64(T.fold(w)))
    asked = queries.where("text IS NOT NULL").select("query_id", vec(queries), terms.alias("signs")).where("size(signs) > 0")
    left = asked.withColumn("labels", F.sequence(F.lit(1).cast("long"), F.size("signs").cast("long"))).withColumn("skip", F.array().cast("array<string>"))
    words = F.array_distinct(F.transform(T.unicode_words(T.fold(F.col("text"))), lambda w: F.xxhash64(w)))
    right = chunks.where("text IS NOT NULL").select("chunk_id", vec(chunks), words.alias("signs"))
    return shared_top(left, right, k).withColumnRenamed("shared_count", "words").select("query_id", "chunk_id", F.col("words").cast("long").alias("words"), "score", "rank")


def rrf(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, fused) of stacked rankings (query_id, chunk_id, rank): the sum of 1/(k + rank); repeats add up."""
    return rankings.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("fused"))


def hybrid_rerank(hits: DataFrame, terms: Column, k: int = RRF_K) -> DataFrame:
    """Re-ranks hits (with text) by their rank fused with that of their whole-word matches.

    `terms` is an array of the query's words. A query keeps its order if it has
    one hit, or none that matches.
    """
    per = Window.partitionBy("query_id")
    lex = hits.withColumn("lex", F.coalesce(T.whole_word_score(F.col("text"), terms), F.lit(0)))
    lex = lex.withColumn("lex_rank", F.when(F.col("lex") > 0, F.row_number().over(per.orderBy(F.desc("lex"), F.asc("chunk_id"), F.asc("rank")))))
    lex = lex.withColumn("fused", 1.0 / (k + F.col("rank")) + F.coalesce(1.0 / (k + F.col("lex_rank")), F.lit(0.0)))
    lex = lex.withColumn("_same", (F.max("lex").over(per) == 0) | (F.count("*").over(per) <= 1))
    order = [F.when(F.col("_same"), F.col("rank")), F.desc(F.round("fused", 12)), F.desc("score"), F.asc("chunk_id"), F.asc("rank")]
    return lex.withColumn("new_rank", F.row_number().over(per.orderBy(*order))).drop("_same", "lex_rank")


def relevant(hits: DataFrame, absolute: float = ABSOLUTE, relative: float = RELATIVE) -> DataFrame:
    """Drops a query's hits if its first is under `absolute`; else keeps those of at least the larger of both bounds."""
    first = F.first("score").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return hits.withColumn("_t", first).where((F.col("_t") >= absolute) & (F.col("score") >= F.greatest(F.lit(absolute), F.col("_t") * relative))).drop("_t")


def restrict_to_anchors(hits: DataFrame, anchors: DataFrame, strong: float = STRONG, protect: DataFrame | None = None) -> DataFrame:
    """Keeps hits of anchored documents (query_id, doc_id), strong and protected ones (query_id, chunk_id); a query without anchors keeps all."""
    flagged = hits.join(anchors.select("query_id", "doc_id").distinct().withColumn("_in", F.lit(1)), ["query_id", "doc_id"], "left")
    flagged = flagged.join(anchors.select("query_id").distinct().withColumn("_any", F.lit(1)), "query_id", "left")
    kept = "_any IS NULL OR _in = 1 OR score >= " + repr(strong)
    if protect is not None:
        flagged = flagged.join(protect.select("query_id", "chunk_id").distinct().withColumn("_p", F.lit(1)), ["query_id", "chunk_id"], "left")
        kept += " OR _p = 1"
    return flagged.where(kept).drop("_in", "_any", "_p")


def best_per_doc(hits: DataFrame, most: int | None = None) -> DataFrame:
    """The first hit of each document, at most `most` documents a query, with `nth` from 1."""
    one = hits.withColumn("_d", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank", "chunk_id"))).where("_d = 1").drop("_d")
    out = ranked(one, F.asc("rank"), F.asc("chunk_id"), name="nth")
    return out.where(F.col("nth") <= most) if most else out


def add_lexical(context: DataFrame, lexical: DataFrame, most: int = MAX_ADD) -> DataFrame:
    """Appends to each query's context the first `most` lexical hits that aren't in it."""
    new = lexical.join(context.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    new = ranked(new, F.asc("rank"), F.asc("chunk_id"), name="_n").where(F.col("_n") <= most)
    last = context.groupBy("query_id").agg(F.max("rank").alias("_m"))
    added = new.join(last, "query_id", "left").select("query_id", "chunk_id", (F.coalesce("_m", F.lit(0)) + F.col("_n")).alias("rank"))
    return context.select("query_id", "chunk_id", "rank").unionByName(added)


def _edges(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(chunk_id, entity_id, name), distinct, of mentions whose entity exists; of an entity's names the smallest counts, it may be null."""
    known = entities.where("id IS NOT NULL").groupBy(F.col("id").alias("entity_id")).agg(F.min("name").alias("name"))
    return mentions.select("chunk_id", "entity_id").where("chunk_id IS NOT NULL AND entity_id IS NOT NULL").distinct().join(known, "entity_id")


def _anchors(seeds: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of the seeds of at least 0.8 of the best score, or of all if none is."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    flagged = seeds.withColumn("_a", F.col("score") >= top * ANCHOR_BAND)
    return flagged.withColumn("_any", F.max("_a").over(Window.partitionBy("query_id"))).where("_a OR NOT _any").select("query_id", "chunk_id")


def expanded(seeds: DataFrame, queries: DataFrame, data: DataFrame, mentions: DataFrame, entities: DataFrame, most: int = TOP_K) -> DataFrame:
    """(query_id, chunk_id, shared_count, score, rank): chunks that share entities with a query's best seeds.

    `seeds` (query_id, chunk_id, score), `queries` (query_id, vec), `data`
    (chunk_id, vec). The count is that of distinct names of shared entities (an
    entity without name makes a chunk a candidate, but doesn't count); order:
    count, cosine to the query, chunk_id. Chunks without vector take no part.
    """
    edges = _edges(mentions, entities)
    sign = F.xxhash64("entity_id")
    label = F.coalesce(F.when(F.col("name").isNotNull(), F.xxhash64("name")), F.lit(0).cast("long"))
    of = _anchors(seeds).join(edges, "chunk_id").groupBy("query_id").agg(F.collect_set(F.struct(sign.alias("sign"), label.alias("label"))).alias("e"))
    own = seeds.groupBy("query_id").agg(F.collect_list("chunk_id").alias("skip"))
    asked = queries.select("query_id", "vec").join(of, "query_id").join(own, "query_id").select("query_id", "vec", F.col("e.sign").alias("signs"), F.col("e.label").alias("labels"), "skip")
    signed = edges.groupBy("chunk_id").agg(F.collect_list(sign).alias("signs"))
    return shared_top(asked, data.select("chunk_id", "vec").join(signed, "chunk_id"), most)


def graph_expand(seeds: DataFrame, queries: DataFrame, data: DataFrame, mentions: DataFrame, entities: DataFrame, most: int = TOP_K) -> DataFrame:
    """`expanded` with shared_entities, the sorted names; they are looked up for the chosen rows only."""
    seeds = materialize(seeds.select("query_id", "chunk_id", "score"), "seeds")
    edges = _edges(mentions, entities).where("name IS NOT NULL")
    chosen = expanded(seeds, queries, data, mentions, entities, most)
    of = _anchors(seeds).join(edges, "chunk_id").select("query_id", "entity_id").distinct()
    shared = chosen.select("query_id", "chunk_id").join(edges, "chunk_id").join(of, ["query_id", "entity_id"], "left_semi")
    names = shared.groupBy("query_id", "chunk_id").agg(F.sort_array(F.collect_set("name")).alias("shared_entities"))
    return chosen.join(names, ["query_id", "chunk_id"], "left").withColumn("shared_entities", F.coalesce("shared_entities", F.array().cast("array<string>")))


def fuse_graph(seeds: DataFrame, expansion: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, chunk_id, fused, rank): two rankings fused, that of seeds and expansion together by cosine, and that of the expansion.

    `seeds` (query_id, chunk_id, score), `expansion` (query_id, chunk_id, score,
    rank); of a chunk in both the seed's score counts. A handful of rows a query.
    """
    rows = seeds.select("query_id", "chunk_id", F.col("score").alias("s"), F.lit(None).cast("double").alias("e"), F.lit(None).cast("int").alias("g"))
    rows = rows.unionByName(expansion.select("query_id", "chunk_id", F.lit(None).cast("double").alias("s"), F.col("score").alias("e"), F.col("rank").alias("g")))
    one = rows.groupBy("query_id", "chunk_id").agg(F.coalesce(F.max("s"), F.max("e")).alias("score"), F.min("g").alias("g"))
    both = ranked(one, F.desc("score"), F.asc("chunk_id"), name="v")
    fused = F.round(1.0 / (RRF_K + F.col("v")) + F.coalesce(1.0 / (RRF_K + F.col("g")), F.lit(0.0)), 12)
    return ranked(both.select("query_id", "chunk_id", fused.alias("fused")), F.desc("fused"), F.asc("chunk_id")).where(F.col("rank") <= k)


def graph_retrieve(queries: DataFrame, data: DataFrame, mentions: DataFrame, entities: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, chunk_id, fused, rank): seeds by vector fused with the chunks that their entities lead to."""
    seeds = materialize(vector_top(queries, data, k).select("query_id", "chunk_id", "score"), "seeds")
    return fuse_graph(seeds, expanded(seeds, queries, data, mentions, entities, k), k)


def graph_context(seeds: DataFrame, expansion: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, nth): the context of an answer: the seeds that cleared the floor (query_id, chunk_id, score, rank), then the
    expansion in its order without them; a query without such seeds has none."""
    more = expansion.join(seeds.select("query_id").distinct(), "query_id", "left_semi").join(seeds.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    cols = ["query_id", "chunk_id", "score", "rank"]
    both = seeds.select(*cols, F.lit(0).alias("_x")).unionByName(more.select(*cols, F.lit(1).alias("_x")))
    return ranked(both, F.asc("_x"), F.asc("rank"), F.asc("chunk_id"), name="nth").drop("_x", "rank")


# --- hybrid search over the whole index ---------------------------------------------------------------------------------------


def _occurrences(asked: pd.Series, texts: list[str]) -> Callable[[list[str]], np.ndarray]:
    """How often terms stand in each text (substrings, without overlap); all terms of `asked` are looked for in one pass over the texts."""
    import ahocorasick

    known = sorted({t for terms in asked for t in terms})
    at: dict[str, tuple[list[int], list[int]]] = {t: ([], []) for t in known}
    if known:
        machine = ahocorasick.Automaton()
        for t in known:
            machine.add_word(t, t)
        machine.make_automaton()
        for i, text in enumerate(texts):
            end: dict[str, int] = {}
            n: dict[str, int] = {}
            for stop, t in machine.iter(text):
                if stop - len(t) >= end.get(t, -1):
                    n[t] = n.get(t, 0) + 1
                    end[t] = stop
            for t, c in n.items():
                at[t][0].append(i)
                at[t][1].append(c)
    packed = {t: (np.array(i, np.int64), np.array(c, np.int64)) for t, (i, c) in at.items()}

    def of(terms: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for t in terms:
            out[packed[t][0]] += packed[t][1]
        return out

    return of


def _first_terms(own: pa.Table, blocks, depth: int) -> list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(query, chunk_id, cosine, occurrences) of what may be among a query's `depth` first rows by cosine or by occurrences; `depth` a block at most."""
    q, terms = _matrix(own["vec"]), own["terms"].to_pylist()
    best = np.full((len(q), depth), -np.inf)
    out = []
    for x in blocks:
        ids, d, said_of = x["chunk_id"].combine_chunks(), _matrix(x["vec"]), _occurrences(terms, x["text"].fill_null("").to_pylist())
        who, what, cosines, said = [], [], [], []
        for at in range(0, len(q), 256):
            s = q[at : at + 256] @ d.T
            for i, row in enumerate(s, at):
                lex = said_of(terms[i])
                floor = best[i, 0]
                if len(row) > depth and not np.isfinite(floor):
                    floor = np.partition(row, -depth)[-depth]
                near = np.flatnonzero(row >= floor - 1e-9)
                cos = row[near].round(DIGITS)
                near = near[np.lexsort((near, -cos))[:depth]]
                best[i] = np.sort(np.r_[best[i], row[near].round(DIGITS)])[-depth:]
                held = np.flatnonzero(lex)
                if len(held) > depth:
                    held = held[np.argsort(-lex[held], kind="stable")[:depth]]
                both = np.union1d(near, held)
                who.append(np.full(len(both), i))
                what.append(both)
                cosines.append(row[both].round(DIGITS))
                said.append(lex[both])
        if who:
            out.append((np.concatenate(who), ids.take(pa.array(np.concatenate(what))), np.concatenate(cosines), np.concatenate(said)))
    return out


def _above(own: pa.Table, blocks) -> tuple[np.ndarray, np.ndarray]:
    """How many rows stand before each wanted row of each query (chunks, cosines, said) in its two orders."""
    q, terms = _matrix(own["vec"]), own["terms"].to_pylist()
    wanted = own["wanted"].combine_chunks()
    ends = np.r_[0, np.cumsum(wanted.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    chunk, cos, lex = (wanted.flatten().field(i) for i in range(3))
    chunk, cos, lex = chunk.dictionary_encode(), cos.to_numpy(), lex.to_numpy()
    names, code = np.array(chunk.dictionary.to_pylist(), object), chunk.indices.to_numpy()
    nearer, fuller = np.zeros(len(cos), np.int64), np.zeros(len(cos), np.int64)
    for x in blocks:
        d, said_of = _matrix(x["vec"]), _occurrences(terms, x["text"].fill_null("").to_pylist())
        before = np.searchsorted(np.array(x["chunk_id"].to_pylist(), object), names)[code]
        for at in range(0, len(q), 256):
            s = q[at : at + 256] @ d.T
            for i, row in enumerate(s, at):
                a, b = ends[i], ends[i + 1]
                if a == b:
                    continue
                # values are steps of 10^-DIGITS: what is a step apart is decided by rounding, the rest by the value itself
                edge, back = np.unique(cos[a:b], return_inverse=True)
                up = row[row >= edge[0] - 1e-9].round(DIGITS)
                at_ = np.searchsorted(edge, up, "right")
                exact = edge[np.maximum(at_ - 1, 0)] == up
                above = np.bincount(at_ - exact, minlength=len(edge) + 1)  # of a row of an equal value, its edge isn't below it
                more = above[::-1].cumsum()[::-1]  # rows above edge j: those of j + 1 and more
                nearer[a:b] += more[back + 1]
                equal = np.bincount(at_[exact] - 1, minlength=len(edge))
                for j in np.flatnonzero(equal):
                    places = np.flatnonzero(np.abs(row - edge[j]) < 1e-9)
                    places = places[row[places].round(DIGITS) == edge[j]]
                    same = a + np.flatnonzero(back == j)
                    nearer[same] += np.searchsorted(places, before[same])
                count = said_of(terms[i])
                held = np.flatnonzero(count)
                order = held[np.argsort(count[held], kind="stable")]
                have, want = count[order], lex[a:b]
                low, high = np.searchsorted(have, want, "left"), np.searchsorted(have, want, "right")
                fuller[a:b] += len(have) - high
                for j in np.flatnonzero((want > 0) & (high > low)):
                    fuller[a + j] += np.searchsorted(order[low[j] : high[j]], before[a + j])
    return nearer, fuller


def hybrid_search(queries: DataFrame, data: DataFrame, k: int = TOP_K, rrf_k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, fused, rank): the ranking of the whole index by cosine fused with that by occurrences of the query's terms.

    `queries` (query_id, vec, terms), `data` (chunk_id, vec, text). Occurrences are substrings of the folded text, without overlap; a row
    without any has no lexical rank. Only rows among the first rrf_k + 2k of one of the rankings can be in the top k, since the first k of
    either beat all others; each pair of blocks gives those, and a second pass counts their exact places.
    """
    depth = rrf_k + 2 * k
    head, schema = _types(queries, data)
    asked = materialize(queries.select("query_id", "vec", F.filter(F.transform("terms", T.fold), lambda t: t != "").alias("terms")), "asked")
    right = materialize(data.select("chunk_id", "vec", T.fold(F.col("text")).alias("text")), "folded")

    def first(own: pa.Table, blocks) -> pa.Table:
        kinds = schema.append(pa.field("cos", pa.float64())).append(pa.field("lex", pa.int64()))
        ids = own["query_id"].combine_chunks()
        tables = [pa.Table.from_arrays([ids.take(pa.array(who)), chunks, pa.array(cos), pa.array(lex)], schema=kinds) for who, chunks, cos, lex in _first_terms(own, blocks, depth)]
        return pa.concat_tables(tables) if tables else kinds.empty_table()

    def second(own: pa.Table, blocks) -> pa.Table:
        nearer, fuller = _above(own, blocks)
        wanted = own["wanted"].combine_chunks()
        ids = own["query_id"].combine_chunks().take(pa.array(np.repeat(np.arange(len(own)), wanted.value_lengths().to_numpy(zero_copy_only=False))))
        return pa.Table.from_arrays([ids, wanted.flatten().field(0), pa.array(nearer), pa.array(fuller)], schema=schema.append(pa.field("nearer", pa.int64())).append(pa.field("fuller", pa.int64())))

    part = _pairs_of_blocks(asked, right, first, f"{head}, cos double, lex long")
    place = lambda *by: F.row_number().over(Window.partitionBy("query_id").orderBy(*by))
    both = part.withColumn("c", place(F.desc("cos"), F.asc("chunk_id"))).withColumn("l", place(F.desc("lex"), F.asc("chunk_id")))
    cand = materialize(both.where((F.col("c") <= depth) | ((F.col("l") <= depth) & (F.col("lex") > 0))).drop("c", "l"), "hybrid")
    wanted = asked.join(cand.groupBy("query_id").agg(F.collect_list(F.struct("chunk_id", "cos", "lex")).alias("wanted")), "query_id")
    counted = _pairs_of_blocks(wanted, right, second, f"{head}, nearer long, fuller long").groupBy("query_id", "chunk_id").agg(F.sum("nearer").alias("v"), F.sum("fuller").alias("l"))
    lexical = F.when(F.col("lex") > 0, 1.0 / (rrf_k + 1 + F.col("l"))).otherwise(0.0)
    fused = counted.join(cand, ["query_id", "chunk_id"]).select("query_id", "chunk_id", F.round(1.0 / (rrf_k + 1 + F.col("v")) + lexical, 12).alias("fused"))
    return ranked(fused, F.desc("fused"), F.asc("chunk_id")).where(F.col("rank") <= k)


# --- subjects of a question ----------------------------------------------------------------------------------------------------


def anchor_docs(queries: DataFrame, entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(query_id, doc_id): the documents of a question's subjects, in two hops.

    `queries` (query_id, text), `entities` (id, name), `mentions` (entity_id,
    doc_id). A question names an entity if it holds its whole folded name (three
    characters or more), or a word of at least four letters that is in the name
    of one entity only. Documents of such entities are the first hop, documents
    of all entities that stand in those the second. Whole names meet questions by
    their first word, so no question meets all names; a name without letters and
    digits names nothing.
    """
    known = entities.where("id IS NOT NULL AND name IS NOT NULL").groupBy("id").agg(F.min("name").alias("name"))
    folded = known.select("id", T.fold(F.col("name")).alias("name")).withColumn("words", T.unicode_words(F.col("name")))
    asked = queries.where("text IS NOT NULL").select("query_id", T.fold(F.col("text")).alias("q"), F.transform(T.query_terms(F.col("text")), T.fold).alias("terms"))
    rare = folded.select("id", F.explode(F.array_distinct(F.filter("words", lambda w: F.length(w) >= 4))).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("word", "id")
    long = folded.where(F.length("name") >= 3)
    by_word = asked.select("query_id", F.explode(F.array_distinct("terms")).alias("word")).join(rare, "word").select("query_id", "id").join(long.select("id"), "id", "left_semi")
    # a name is held by a question as a string, so its first word may begin inside one of the question's: all ends of words meet
    ends = F.flatten(F.transform(T.unicode_words(F.col("q")), lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(w, i, F.length(w)))))
    heads = F.get("words", 0)
    inner = asked.select("query_id", "q", F.explode(F.array_distinct(ends)).alias("head")).join(long.where(F.size("words") > 1).select("id", "name", heads.alias("head")), "head")
    # a name of one word may also end inside a word: all runs of a word of its length meet
    lens = F.flatten(F.transform(T.unicode_words(F.col("q")), lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.transform(F.sequence(F.lit(1), F.length(w) - i + 1), lambda n: F.substring(w, i, n))))))
    single = asked.select("query_id", "q", F.explode(F.array_distinct(lens)).alias("head")).join(long.where(F.size("words") == 1).select("id", "name", heads.alias("head")), "head")
    named = inner.unionByName(single).where(F.contains("q", F.col("name"))).select("query_id", "id").unionByName(by_word).distinct()
    pairs = mentions.where("entity_id IS NOT NULL AND doc_id IS NOT NULL").select(F.col("entity_id").alias("id"), "doc_id").distinct().join(known.select("id"), "id", "left_semi")
    # questions that name the same entities ask alike; what stands in documents with an entity doesn't depend on the question
    asks = materialize(named.groupBy("query_id").agg(F.sort_array(F.collect_set("id")).alias("ids")).groupBy("ids").agg(F.collect_list("query_id").alias("askers")), "askers")
    one = asks.select(F.explode("ids").alias("id")).distinct()
    pairs = materialize(pairs, "pairs")
    around = one.join(pairs, "id").join(pairs.select(F.col("id").alias("entity"), "doc_id"), "doc_id").select("id", "entity").distinct()
    entities = asks.select("ids", F.explode("ids").alias("id")).join(around, "id").groupBy("ids").agg(F.collect_set("entity").alias("entities"))
    askers = asks.join(entities, "ids").select("askers", "entities", F.array().cast(ArrayType(pairs.schema["doc_id"].dataType)).alias("skip"))
    return spread(askers, pairs.select(F.col("id").alias("entity"), F.col("doc_id").alias("item"), F.lit(1).alias("c"))).select("query_id", F.col("item").alias("doc_id"))


def named_subjects(queries: DataFrame) -> DataFrame:
    """(query_id, subject, folded): phrases of two to four capitalised words of questions (query_id, text), each once by its folded form."""
    phrase = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{Lu}\p{L}*(?:\s+\p{Lu}\p{L}*)+"), F.lit(0))
    rows = queries.select("query_id", F.posexplode(phrase).alias("at", "subject")).withColumn("subject", F.trim("subject"))
    rows = rows.where(F.size(F.split("subject", r"\s+")).between(2, 4)).withColumn("folded", T.fold(F.col("subject")))
    return rows.groupBy("query_id", "folded").agg(F.min_by("subject", "at").alias("subject")).select("query_id", "subject", "folded")


def ungrounded_subjects(queries: DataFrame, context: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, subject) of questions none of whose subjects is grounded: neither the context (query_id, text) nor a known name holds one.

    A subject and a name of at least three characters match if one holds the
    other; they meet by a word in common.
    """
    subjects = named_subjects(queries)
    said = context.where("text IS NOT NULL").groupBy("query_id").agg(F.concat_ws("\n", F.sort_array(F.collect_list(T.fold(F.col("text"))))).alias("hay"))
    names = entities.where("name IS NOT NULL").select(T.fold(F.col("name")).alias("name")).where("length(name) >= 3").distinct()
    one = lambda df, c: df.withColumn("word", F.explode(F.array_distinct(T.unicode_words(F.col(c)))))
    met = one(subjects.select("folded").distinct(), "folded").join(one(names, "name"), "word").where(F.contains("folded", F.col("name")) | F.contains("name", F.col("folded"))).select("folded").distinct()
    known = subjects.join(met.withColumn("_k", F.lit(True)), "folded", "left").join(said, "query_id", "left")
    flag = F.coalesce("_k", F.lit(False)) | F.coalesce(F.contains("hay", F.col("folded")), F.lit(False))
    return known.withColumn("_any", F.max(flag).over(Window.partitionBy("query_id"))).where("NOT _any").select("query_id", "subject")
