"""The entity graph: edges, index, neighbourhoods and building it from text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from notemesh.functions import text as T
from notemesh.plans import materialize

# Caps and floors that define results.
HOPS, MOST_NODES, VIEW_NODES, RELATION_FLOOR = 2, 50, 24, 0.5
FAST_ENTITIES, FAST_RELATIONS = 24, 48

#: Askers of a block of `spread`; a join that makes more than so many times the rows of the edges is made by it.
ASKER_BLOCK, MANY_TIMES = 4_096, 20

# Words that name nothing by themselves.
PRONOUNS = (
    "i we you he she it they me us him her them our my your his its their this that these those here there who what which someone something anyone anything "
    "everyone everything nobody nothing myself itself themselves ourselves"
).split()
COMMON_VI = frozenset(
    "diem tong muc bang stt ngay thang nam ghi ket luan noi dung phan chuong tieu hinh anh bieu phu luc trang loai ten gia tri so bao cao bien ban nghien cuu thiet huong dan quy hoach danh sach "
    "thong tin cong chinh hien thoi gian chuc tich tai lieu quan hop doanh thu loi nhuan chi nhanh von tang truong qua mo dau".split()
)
STARTERS = frozenset(
    "the a an i we you he she it they my our your his her its their this that these those in on at by for to from with of as and or but so if when while after before during then now here there what who how "
    "why where is are was were be been do did does not no yes met see saw today yesterday tomorrow also please let hôm ngày sáng chiều tối trưa năm tháng tuần thứ tôi tớ mình chúng bạn anh chị em ông bà gặp "
    "xem đi về làm học viết đọc nếu khi sau trước trong ngoài với và hoặc nhưng vì do theo từ đến tại ở có không đã đang sẽ rất cần phải nên hãy xin".split()
)
ENTITY_TYPES = ("person", "organization", "project", "concept", "tool", "place", "event")


# --- reading edges --------------------------------------------------------------------------------------------------------


def live_mentions(mentions: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """Mention edges whose chunk and entity exist; repeated edges stay."""
    return mentions.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").join(entities.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi")


def live_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    ids = entities.select("id").distinct()
    out = relations.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return out.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def entity_doc_pairs(mentions: DataFrame) -> DataFrame:
    return mentions.select("entity_id", "doc_id").distinct()


def entity_index(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(entity_id, name, notes): distinct documents of each mentioned entity; the pairs are made distinct before counting, so a hub is pre-aggregated."""
    counts = entity_doc_pairs(mentions).groupBy("entity_id").agg(F.count("doc_id").alias("notes"))
    names = entities.groupBy(F.col("id").alias("entity_id")).agg(F.min("name").alias("name"))
    return names.join(counts, "entity_id")


def edges_both_ways(relations: DataFrame) -> DataFrame:
    """(src, dst) of relations read in both directions, distinct, without self-loops."""
    e = relations.where("source_id IS NOT NULL AND target_id IS NOT NULL AND source_id <> target_id")
    return e.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).union(e.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))).distinct()


def neighbours(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, id, name, type): the entities one relation away."""
    known = entities.groupBy("id").agg(F.min("name").alias("name"), F.min("type").alias("type"))
    return edges_both_ways(relations).select(F.col("src").alias("entity_id"), F.col("dst").alias("id")).join(known, "id")


def reach(starts: DataFrame, relations: DataFrame, hops: int = HOPS, most: int | None = MOST_NODES) -> DataFrame:
    """(start, node, hop): nodes within `hops` relations of each start (column start), nearest first, at most `most` a start.

    A loop over hops with the visited nodes taken off by an anti join; the
    frontier is distinct, so parallel paths don't multiply. With a bound, a start
    that has `most` nodes goes no further, and a step reads the `most` + 1
    smallest neighbours of a node: fewer than `most` of its start's nodes, and the
    start itself, can be among them, so what is missing is always there, and a hub
    isn't multiplied with its neighbours.
    """
    edges = edges_both_ways(relations)
    if most is not None:
        edges = edges.withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("_n") <= most + 1).drop("_n")
        edges = materialize(edges, "edges")
    seen = starts.select("start", F.col("start").alias("node")).distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for h in range(1, hops + 1):
        if most is not None and h > 1:
            frontier = frontier.join(seen.groupBy("start").agg(F.count("*").alias("_c")).where(F.col("_c") <= most).select("start"), "start", "left_semi")
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(frontier)
        if most is not None:
            seen = materialize(seen, "seen")
            frontier = seen.where(F.col("hop") == h)
    found = seen.where("hop > 0")
    if most is None:
        return found
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("start").orderBy("hop", "node"))).where(F.col("_n") <= most).drop("_n")


def relations_among(ids: DataFrame, relations: DataFrame) -> DataFrame:
    """(source_id, target_id, type), distinct, of relations with both ends in `ids` (column id)."""
    out = relations.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return out.select("source_id", "target_id", "type").distinct()


def entity_graph(starts: DataFrame, relations: DataFrame, most: int = VIEW_NODES) -> DataFrame:
    """(start, source_id, target_id, label), distinct: the relations among a start and its nearest `most` nodes; the label is the type.

    Nodes meet a relation at its end with fewer relations and are then looked up
    at the other, so the relations of a hub aren't read for all that it is near to.
    """
    near = materialize(reach(starts, relations, HOPS, most).select("start", "node").union(starts.select("start", F.col("start").alias("node"))).distinct(), "near")
    edges = materialize(relations.where("source_id IS NOT NULL AND target_id IS NOT NULL").select("source_id", "target_id", F.col("type").alias("label")).distinct(), "edges")
    degree = edges.select(F.col("source_id").alias("n")).unionByName(edges.select(F.col("target_id").alias("n"))).groupBy("n").agg(F.count("*").alias("d"))
    sized = edges.join(degree.select(F.col("n").alias("source_id"), F.col("d").alias("ds")), "source_id").join(degree.select(F.col("n").alias("target_id"), F.col("d").alias("dt")), "target_id")
    few = F.col("ds") <= F.col("dt")
    sized = sized.select("source_id", "target_id", "label", F.when(few, F.col("source_id")).otherwise(F.col("target_id")).alias("node"), F.when(few, F.col("target_id")).otherwise(F.col("source_id")).alias("other"))
    one = near.join(sized, "node").select("start", "other", "source_id", "target_id", "label")
    return one.join(near.select("start", F.col("node").alias("other")), ["start", "other"], "left_semi").select("start", "source_id", "target_id", "label")


def ring_layout(graph: DataFrame, radius: float = 100.0) -> DataFrame:
    """(start, node, hop, x, y): nodes (start, node, hop) on rings by hop, evenly spaced in order of their id."""
    ring = Window.partitionBy("start", "hop")
    i = F.row_number().over(ring.orderBy("node")) - 1
    angle = 2 * F.pi() * i / F.count("*").over(ring)
    return graph.select("start", "node", "hop", F.round(F.col("hop") * radius * F.cos(angle), 4).alias("x"), F.round(F.col("hop") * radius * F.sin(angle), 4).alias("y"))


def _spread(item: pa.DataType, query: pa.DataType):
    """Batches sorted by block, a block's postings (kind 0) before its askers (kind 1) → (query_id, item, n)."""
    schema = pa.schema([("query_id", query), ("item", item), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ready = None, [], None
        queries: list[np.ndarray] = []
        items: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        asked: list = []

        def out() -> pa.RecordBatch:
            at, hit = np.concatenate(queries), np.concatenate(items)
            rows = pa.RecordBatch.from_arrays([pa.array(asked, query).take(pa.array(at)), ready[0].take(pa.array(hit)), pa.array(np.concatenate(counts))], schema=schema)
            for x in (queries, items, counts, asked):
                x.clear()
            return rows

        for batch in batches:
            blocks, kinds = batch["block"].to_numpy(), batch["kind"].to_numpy()
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(blocks)]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if blocks[a] != block:
                    if queries:
                        yield out()
                    block, held, ready = blocks[a], [], None
                if kinds[a] == 0:
                    held.append(part.select(["entity", "item", "c"]))
                    continue
                if not held:
                    continue
                if ready is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    ent, it = (table[c].combine_chunks().dictionary_encode() for c in ("entity", "item"))
                    code = ent.indices.to_numpy()
                    order = np.argsort(code, kind="stable")
                    ends = np.r_[0, np.cumsum(np.bincount(code))]
                    ready = (it.dictionary, {x: i for i, x in enumerate(ent.dictionary.to_pylist())}, {x: i for i, x in enumerate(it.dictionary.to_pylist())}, it.indices.to_numpy()[order], table["c"].to_numpy()[order], ends)
                    held = held[:1]
                _, entity_of, item_of, rows, weight, ends = ready
                for ids, entities, skip in zip(part["askers"].to_pylist(), part["entities"].to_pylist(), part["skip"].to_pylist()):
                    own = [entity_of[e] for e in entities if e in entity_of]
                    if not own:
                        continue
                    met, w = (np.concatenate([x[ends[i] : ends[i + 1]] for i in own]) for x in (rows, weight))
                    if len(met) * 50 < len(item_of):
                        hit, where = np.unique(met, return_inverse=True)
                        n = np.bincount(where, w).astype(np.int64)
                    else:
                        total = np.bincount(met, w)
                        hit = np.flatnonzero(total)
                        n = total[hit].astype(np.int64)
                    if skip and (gone := [item_of[x] for x in skip if x in item_of]):
                        stays = ~np.isin(hit, gone)
                        hit, n = hit[stays], n[stays]
                    for q in ids:
                        queries.append(np.full(len(hit), len(asked)))
                        items.append(hit)
                        counts.append(n)
                        asked.append(q)
                        if sum(map(len, items[-50:])) > 200_000 or len(items) > 5_000:
                            yield out()
        if queries:
            yield out()

    return run


def spread(askers: DataFrame, postings: DataFrame, blocks: int | None = None) -> DataFrame:
    """(query_id, item, n): for each query the items of its entities with the sum of their counts.

    `askers` (askers, entities, skip): an array of query ids that ask alike, their entities, and items that can't be results; `postings`
    (entity, item, c), one row an entity and item. Askers are dealt to blocks and a block gets the postings of its entities once, so the rows of
    the result are made inside the tasks and never move: a hub costs what it adds to the result.
    """
    spark = askers.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = blocks or max(2 * tasks, -(-askers.count() // ASKER_BLOCK))
    dealt_to = F.pmod(F.xxhash64(F.get("askers", 0)), F.lit(blocks)).cast("int")
    asks = materialize(askers.select(dealt_to.alias("block"), "askers", "entities", "skip"), "askers")
    need = asks.select("block", F.explode("entities").alias("entity")).distinct()
    kinds = {"entity": postings.schema["entity"].dataType, "item": postings.schema["item"].dataType}
    empty = [F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    one = need.join(postings, "entity").select("block", F.lit(0).alias("kind"), "entity", "item", F.col("c").cast("long").alias("c"), *[F.lit(None).cast(asks.schema[c].dataType).alias(c) for c in ("askers", "entities", "skip")])
    two = asks.select("block", F.lit(1).alias("kind"), *empty, F.lit(None).cast("long").alias("c"), "askers", "entities", "skip")
    both = one.unionByName(two).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    query = asks.schema["askers"].dataType.elementType
    return both.mapInArrow(_spread(to_arrow_type(kinds["item"]), to_arrow_type(query)), f"query_id {query.simpleString()}, item {kinds['item'].simpleString()}, n long")


def expand_by_entities(seeds: DataFrame, mentions: DataFrame) -> DataFrame:
    """(query_id, chunk_id, edges): chunks that share entities with a query's seeds (query_id, chunk_id), by the number of edge rows.

    Edges are counted per (chunk, entity) first. Where a join of queries and edges by entity would make many times the rows that there are edges,
    as at a hub, the rows are made in blocks by `spread`.
    """
    counted = mentions.where("chunk_id IS NOT NULL AND entity_id IS NOT NULL").groupBy("chunk_id", "entity_id").agg(F.count("*").alias("c"))
    of = seeds.join(counted, "chunk_id").select("query_id", "entity_id").distinct()
    edges = counted.groupBy("entity_id").agg(F.count("*").alias("n"))
    all_edges, joined = edges.agg(F.sum("n")).first()[0] or 0, of.groupBy("entity_id").count().join(edges, "entity_id").agg(F.sum(F.col("count") * F.col("n"))).first()[0] or 0
    if joined <= MANY_TIMES * all_edges:
        hit = of.join(counted, "entity_id").groupBy("query_id", "chunk_id").agg(F.sum("c").alias("edges"))
        return hit.join(seeds.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    skip = seeds.groupBy("query_id").agg(F.collect_set("chunk_id").alias("skip"))
    askers = of.groupBy("query_id").agg(F.collect_list("entity_id").alias("entities")).join(skip, "query_id").select(F.array("query_id").alias("askers"), "entities", "skip")
    out = spread(askers, counted.select(F.col("entity_id").alias("entity"), F.col("chunk_id").alias("item"), "c"))
    return out.select("query_id", F.col("item").alias("chunk_id"), F.col("n").alias("edges"))


def micro_graph(hits: DataFrame, shared: DataFrame | None = None, most: int = 5, thin: float = 1.0, thick: float = 6.0) -> DataFrame:
    """(query_id, chunk_id, label, weight, width, via_graph): the edges from a query to its first `most` hits, clamped to three to five.

    `hits` (query_id, rank, chunk_id, doc_id, page, score); `shared` (query_id,
    chunk_id, shared_count) says which came through the graph: they weigh by the
    share of the largest count, others by cosine in [0, 1]. Two places.
    """
    top = hits.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))).where(F.col("_r") <= max(3, min(5, most)))
    none = F.lit(None).cast("int").alias("shared_count")
    rows = top.withColumn("shared_count", none) if shared is None else top.join(shared.select("query_id", "chunk_id", "shared_count"), ["query_id", "chunk_id"], "left")
    largest = F.greatest(F.lit(1), F.coalesce(F.max("shared_count").over(Window.partitionBy("query_id")), F.lit(0)))
    weight = F.when(F.col("shared_count").isNotNull(), F.col("shared_count") / largest).otherwise(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)))
    half_up = lambda x: F.floor(x * 100 + 0.5) / 100  # noqa: E731 — in binary, as the results expect
    label = F.concat("doc_id", F.when(F.col("page").isNull(), "").otherwise(F.concat(F.lit(" · p."), F.col("page").cast("string"))))
    weighed = rows.withColumn("w", weight)
    return weighed.select("query_id", "chunk_id", label.alias("label"), half_up(F.col("w")).alias("weight"), half_up(thin + F.col("w") * (thick - thin)).alias("width"), F.col("shared_count").isNotNull().alias("via_graph"))


# --- building ------------------------------------------------------------------------------------------------------------

_SENTENCE = re.compile(r"[.!?…]+\s+|\n+")
_LINK = re.compile(r"\[\[([^\[\]|#\n]+)(?:#[^\[\]|\n]*)?(?:\|[^\[\]\n]*)?\]\]")


def _fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not 0x300 <= ord(c) <= 0x36F).replace("đ", "d").replace("Đ", "D").lower()


def _runs(sentence: str) -> Iterator[tuple[int, str]]:
    """(position, text) of runs of capitalised words joined by single blanks."""
    at, n = 0, len(sentence)
    while at < n:
        if not sentence[at].isupper():
            at += 1
            continue
        end = at
        while end < n and sentence[end].isupper():
            while end < n and (sentence[end].isalnum() or sentence[end] in "'’-"):
                end += 1
            if end + 1 < n and sentence[end] == " " and sentence[end + 1].isupper():
                end += 1
            else:
                break
        yield at, sentence[at:end].rstrip(" ")
        at = max(end, at + 1)


def heuristic(text: str | None) -> tuple[list[tuple[str, int]], list[tuple[str, str, int]]]:
    """Names of a text with their counts, at most 24, and pairs of names of one sentence, at most 48, most frequent first.

    A single capitalised word counts only if it also stands inside a sentence;
    words that open sentences are taken off a run; wiki links always count.
    """
    if not text:
        return [], []
    count: dict[str, int] = {}
    inside: set[str] = set()
    per: list[list[str]] = []
    for s in (x.strip() for x in _SENTENCE.split(text)):
        names = []
        for at, run in _runs(s):
            if at == 0:
                words = run.split(" ")
                while words and words[0].lower() in STARTERS:
                    words.pop(0)
                run = " ".join(words)
            if not run:
                continue
            count[run] = count.get(run, 0) + 1
            if at:
                inside.add(run)
            names.append(run)
        per.append(names)

    def keep(name: str) -> bool:
        if 2 <= len(name) <= 6 and all(c.isupper() or c.isnumeric() for c in name):
            return True
        words = [w for w in re.split("[- ]+", name) if w]
        return (" " in name or name in inside) and len(name) > 1 and not all(_fold(w) in COMMON_VI for w in words)

    kept = {n: c for n, c in count.items() if keep(n)}
    for t in (m.strip() for m in _LINK.findall(text)):
        if t:
            kept.setdefault(t, count.get(t, 1))
    top = sorted(kept.items(), key=lambda x: -x[1])[:FAST_ENTITIES]
    names = {n for n, _ in top}
    pairs: dict[tuple[str, str], int] = {}
    for here in per:
        present = list(dict.fromkeys(n for n in here if n in names))
        for i, a in enumerate(present):
            for b in present[i + 1 :]:
                p = (a, b) if a < b else (b, a)
                pairs[p] = pairs.get(p, 0) + 1
    return top, sorted(((a, b, n) for (a, b), n in pairs.items()), key=lambda x: -x[2])[:FAST_RELATIONS]


def extract(notes: DataFrame) -> DataFrame:
    """(doc_id, kind, name, other, n): entities (kind entity) and pairs (kind relation) of notes (doc_id, body)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, body in zip(pdf["doc_id"], pdf["body"]):
                names, pairs = heuristic(body)
                rows += [(doc, "entity", n, None, c) for n, c in names] + [(doc, "relation", a, b, c) for a, b, c in pairs]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "name", "other", "n"])

    return notes.select("doc_id", "body").mapInPandas(run, "doc_id string, kind string, name string, other string, n int")


def resolve(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (doc_id, id, name, aliases) and relations (doc_id, source_id, target_id, confidence) of extracted rows.

    Names with one canonical id are one entity; the name with most capitals
    stands for it; pronouns are dropped, and relations that lose an end, or both
    of whose ends fall together.
    """
    named = extracted.where("kind = 'entity'").withColumn("id", T.canonical_id(F.col("name"))).where((F.col("id") != "") & ~F.col("id").isin(PRONOUNS))
    capitals = F.regexp_count("name", F.lit(r"\p{Lu}"))
    entities = named.groupBy("doc_id", "id").agg(F.max_by("name", F.struct(capitals, F.col("n"), F.col("name"))).alias("name"), F.sort_array(F.collect_set("name")).alias("aliases"))
    pairs = extracted.where("kind = 'relation'").select("doc_id", T.canonical_id(F.col("name")).alias("source_id"), T.canonical_id(F.col("other")).alias("target_id"), "n").where("source_id <> target_id")
    one = pairs.groupBy("doc_id", "source_id", "target_id").agg(F.max("n").alias("n"))
    ids = entities.select("doc_id", "id")
    both = one.join(ids.withColumnRenamed("id", "source_id"), ["doc_id", "source_id"], "left_semi").join(ids.withColumnRenamed("id", "target_id"), ["doc_id", "target_id"], "left_semi")
    return entities, both.select("doc_id", "source_id", "target_id", F.least(F.lit(0.9), 0.5 + 0.1 * (F.col("n") - 1)).alias("confidence"))


def scan_mentions(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, entity_id): chunks of a document that contain a name or alias of one of its entities.

    `entities` (doc_id, id, aliases). The document restricts the comparison, and
    its surfaces, at most a few dozen, travel as one array.
    """
    surfaces = entities.select("doc_id", F.col("id").alias("entity_id"), F.explode("aliases").alias("s")).where("trim(s) <> ''").groupBy("doc_id").agg(F.collect_set(F.struct("entity_id", F.lower("s").alias("s"))).alias("all"))
    hit = chunks.where("text IS NOT NULL").select("chunk_id", "doc_id", F.lower("text").alias("t")).join(surfaces, "doc_id")
    found = hit.select("chunk_id", "doc_id", F.explode(F.array_distinct(F.transform(F.filter("all", lambda x: F.contains(F.col("t"), x["s"])), lambda x: x["entity_id"]))).alias("entity_id"))
    return found


def changed_docs(notes: DataFrame, meta: DataFrame) -> DataFrame:
    """(doc_id, body, hash): notes whose text isn't the one of the stored hash (meta: doc_id, hash; 'h:' marks a fast pass)."""
    now = notes.withColumn("hash", T.content_hash(F.col("body")))
    old = meta.select("doc_id", F.regexp_replace("hash", "^h:", "").alias("old"))
    return now.join(old, "doc_id", "left").where(~F.col("hash").eqNullSafe(F.col("old"))).select("doc_id", "body", "hash")


def last_write(entities: DataFrame, order: str) -> DataFrame:
    """Entities (id, name, type, aliases) as an upsert in `order` leaves them: the last row of each id, whole."""
    return entities.groupBy("id").agg(F.max_by(F.struct("name", "type", "aliases"), order).alias("r")).select("id", "r.*")
