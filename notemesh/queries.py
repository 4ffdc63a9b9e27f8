"""All queries of the core, by name, with the SQL that checks them where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notemesh.functions import markdown
from notemesh.functions import text as T
from notemesh.operators import chunking, context, corpus, graph, lifecycle, links, prompting, selection_bench
from notemesh.operators import retrieval as R
from notemesh.plans import materialize
from notemesh.plans.registry import Registry
from notemesh.sources import files, once, read_table, store

REGISTRY = Registry()
query = REGISTRY.query


def chunks_of(s: SparkSession, d: str, *cols: str) -> DataFrame:
    return read_table(s, d, "chunks").select(*cols).distinct()


def latest_notes(s: SparkSession, d: str, *cols: str) -> DataFrame:
    """Notes without their loading times, each once."""
    return once(read_table(s, d, "notes"), ["doc_id"], list(cols), newest="loaded_at")


def hits_of(s: SparkSession, d: str) -> DataFrame:
    """Stored search results, each once, with `rank` by score."""
    h = read_table(s, d, "search_hits").where("query_id IS NOT NULL AND chunk_id IS NOT NULL")
    one = h.select("hit_id", "query_id", "chunk_id", "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), "hit_rank").distinct()
    return R.ranked(one, F.desc("score"), F.asc("chunk_id"), F.asc("hit_id"))


HITS = """h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id, hit_id) AS rank FROM (
  SELECT DISTINCT hit_id, query_id, chunk_id, doc_id, coalesce(text, '') AS text, round(coalesce(score, 0.0), 6) AS score, hit_rank
  FROM search_hits WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL))"""
NOTES = """n AS (SELECT doc_id, title, body, aliases, frontmatter FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC) AS r FROM notes) WHERE r = 1 AND doc_id IS NOT NULL)"""
FOLD = "lower(replace(replace(strip_accents({0}), 'đ', 'd'), 'Đ', 'D'))"
STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
EDGES = """e AS (SELECT DISTINCT a AS src, b AS dst FROM (SELECT source_id AS a, target_id AS b FROM relations UNION ALL SELECT target_id, source_id FROM relations)
  WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b)"""


# --- scans, sinks, keyed writes ---------------------------------------------------------------------------------------------


@query("table_counts", "SELECT 'chunks' AS name, count(*) AS n FROM chunks UNION ALL SELECT 'relations', count(*) FROM relations")
def _(s, d):
    one = lambda t: read_table(s, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
    return one("chunks").unionByName(one("relations"))


@query("all_notes", f"WITH {NOTES} SELECT doc_id, coalesce(title, '') AS title, coalesce(len(aliases), 0) AS aliases, length(coalesce(body, '')) AS chars FROM n")
def _(s, d):
    n = latest_notes(s, d, "title", "body", "aliases")
    return n.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.array_size("aliases"), F.lit(0)).cast("long").alias("aliases"), F.length(F.coalesce("body", F.lit(""))).cast("long").alias("chars"))


@query("chunk_texts_by_doc", "SELECT doc_id, list(text ORDER BY seq, chunk_id) AS texts FROM (SELECT DISTINCT chunk_id, doc_id, seq, text FROM chunks WHERE text IS NOT NULL) GROUP BY doc_id")
def _(s, d):
    rows = chunks_of(s, d, "chunk_id", "doc_id", "seq", "text").where("text IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "chunk_id", "text"))), lambda x: x["text"]).alias("texts"))


@query("live_mentions", "SELECT chunk_id, doc_id, entity_id FROM mentions WHERE chunk_id IN (SELECT chunk_id FROM chunks) AND entity_id IN (SELECT id FROM entities)")
def _(s, d):
    m = read_table(s, d, "mentions").select("chunk_id", "doc_id", "entity_id")
    return graph.live_mentions(m, read_table(s, d, "chunks"), read_table(s, d, "entities")).select("chunk_id", "doc_id", "entity_id")


@query("live_relations", "SELECT source_id, target_id, type, doc_id FROM relations WHERE source_id IN (SELECT id FROM entities) AND target_id IN (SELECT id FROM entities)")
def _(s, d):
    return graph.live_relations(read_table(s, d, "relations").select("source_id", "target_id", "type", "doc_id"), read_table(s, d, "entities")).select("source_id", "target_id", "type", "doc_id")


@query("retrieval_edges", f"WITH {HITS} SELECT query_id, chunk_id, score, rank FROM h")
def _(s, d):
    return hits_of(s, d).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("delete_docs", "SELECT chunk_id, doc_id FROM (SELECT DISTINCT chunk_id, doc_id FROM chunks) WHERE doc_id NOT IN (SELECT doc_id FROM notes WHERE (body IS NULL OR trim(body) = '') AND doc_id IS NOT NULL)")
def _(s, d):
    gone = read_table(s, d, "notes").where("body IS NULL OR trim(body) = ''").select("doc_id")
    return store.without(chunks_of(s, d, "chunk_id", "doc_id"), gone, "doc_id")


@query("upsert_chunks", "SELECT chunk_id, text FROM (SELECT DISTINCT chunk_id, text FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM search_hits WHERE text IS NOT NULL AND chunk_id IS NOT NULL)) UNION ALL SELECT chunk_id, max(text) FROM search_hits WHERE text IS NOT NULL AND chunk_id IS NOT NULL GROUP BY chunk_id")
def _(s, d):
    new = read_table(s, d, "search_hits").where("text IS NOT NULL AND chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max("text").alias("text"))
    return store.upserted(chunks_of(s, d, "chunk_id", "text"), new, ["chunk_id"])


@query("export_chats", """SELECT conv_id, md5(string_agg('**user:**' || chr(10) || chr(10) || coalesce(query, '') || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**assistant:**' || chr(10) || chr(10) || coalesce(answer, ''),
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn, turn_id)) AS md5, count(*) AS turns FROM (SELECT DISTINCT conv_id, turn_id, turn, query, answer FROM chat_turns) GROUP BY conv_id""")
def _(s, d):
    t = read_table(s, d, "chat_turns").select("conv_id", "turn_id", "turn", "query", "answer").distinct()
    n = t.groupBy("conv_id").agg(F.count("*").alias("turns"))
    return corpus.export_chats(t).join(n, "conv_id").select("conv_id", F.md5("markdown").alias("md5"), "turns")


@query("csv_rows")
def _(s, d):
    return files.csv_rows(read_table(s, d, "documents").where("source = 'csv'"), "doc_id", "text")


@query("csv_notes")
def _(s, d):
    return files.csv_notes(read_table(s, d, "documents").where("source = 'csv'"), "doc_id", "text")


@query("vault_round_trip", f"WITH {NOTES} SELECT doc_id, md5(body) AS md5, coalesce(element_at(frontmatter, 'tags')[1], '') AS tags, coalesce(len(map_keys(frontmatter)), 0) AS keys FROM n WHERE coalesce(body, '') <> ''")
def _(s, d):
    """Notes written as files and read back: bodies and frontmatter are those of the table."""
    made = files.vault_files(tagged(s, d).where("coalesce(body, '') <> ''"))
    entries = made.select(F.lit("v").alias("archive"), "path", F.lit("note").alias("kind"), F.encode("content", "UTF-8").alias("content"))
    return files.vault_notes(entries).select("doc_id", F.md5("body").alias("md5"), F.coalesce(F.element_at("frontmatter", F.lit("tags")), F.lit("")).alias("tags"), F.size("frontmatter").cast("long").alias("keys"))


@query("chat_files", "SELECT 'chats/' || conv_id || '.md' AS path, count(*) AS turns FROM (SELECT DISTINCT conv_id, turn_id, turn, query, answer FROM chat_turns) GROUP BY conv_id")
def _(s, d):
    t = read_table(s, d, "chat_turns").select("conv_id", "turn_id", "turn", "query", "answer").distinct()
    none = s.createDataFrame([], "doc_id string, frontmatter map<string,string>, body string")
    made = files.vault_files(none, corpus.export_chats(t))
    turns = t.groupBy("conv_id").agg(F.count("*").alias("turns")).withColumn("path", F.concat(F.lit("chats/"), F.col("conv_id").cast("string"), F.lit(".md")))
    return made.join(turns, "path").select("path", "turns")


# --- text ----------------------------------------------------------------------------------------------------------------------


@query("fold_names", f"SELECT DISTINCT id, {FOLD.format('name')} AS folded FROM entities")
def _(s, d):
    return read_table(s, d, "entities").select("id", T.fold(F.col("name")).alias("folded")).distinct()


@query("canonical_ids", r"SELECT DISTINCT id, regexp_replace(regexp_replace(trim(lower(name)), '\s+', '_', 'g'), '[^\p{L}\p{N}_-]', '', 'g') AS canonical FROM entities")
def _(s, d):
    return read_table(s, d, "entities").select("id", T.canonical_id(F.col("name")).alias("canonical")).distinct()


@query("note_slugs", f"WITH {NOTES} SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT doc_id, regexp_replace(left(regexp_replace(regexp_replace({FOLD.format('title')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), '-+$', '') AS s FROM n WHERE title IS NOT NULL)")
def _(s, d):
    return latest_notes(s, d, "title").where("title IS NOT NULL").select("doc_id", T.slug(F.col("title")).alias("slug"))


@query("query_terms", rf"SELECT turn_id, list_filter(list_distinct_in_order, lambda t: NOT list_contains({STOPS}, t)) AS terms FROM (SELECT turn_id, list(t ORDER BY i) AS list_distinct_in_order FROM (SELECT turn_id, t, min(i) AS i FROM (SELECT turn_id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT turn_id, regexp_split_to_array(lower(query), '[^\p{{L}}\p{{N}}]+') AS x FROM (SELECT DISTINCT turn_id, query FROM chat_turns WHERE query IS NOT NULL))) WHERE length(t) >= 3 GROUP BY ALL) GROUP BY turn_id) WHERE len(list_filter(list_distinct_in_order, lambda t: NOT list_contains({STOPS}, t))) > 0")
def _(s, d):
    return read_table(s, d, "chat_turns").where("query IS NOT NULL").select("turn_id", "query").distinct().select("turn_id", T.query_terms(F.col("query")).alias("terms")).where("size(terms) > 0")


@query("content_hashes", f"WITH {NOTES} SELECT doc_id, 'sha256:' || sha256(coalesce(body, '')) AS hash FROM n")
def _(s, d):
    return latest_notes(s, d, "body").select("doc_id", T.content_hash(F.col("body")).alias("hash"))


@query("file_types", "SELECT source_path AS path, CASE lower(regexp_extract(source_path, '\\.([^./]+)$', 1)) WHEN 'md' THEN 'md' WHEN 'markdown' THEN 'md' WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'txt' WHEN 'text' THEN 'txt' WHEN 'csv' THEN 'csv' END AS type FROM (SELECT DISTINCT source_path FROM notes WHERE source_path IS NOT NULL)")
def _(s, d):
    return read_table(s, d, "notes").where("source_path IS NOT NULL").select(F.col("source_path").alias("path")).distinct().withColumn("type", T.file_type(F.col("path")))


# --- retrieval ---------------------------------------------------------------------------------------------------------------

TOP = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
 t AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 10) AS s FROM embeddings, q),
 r AS (SELECT query_id, vec_id AS chunk_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM t)"""


def vectors(s, d):
    e = read_table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    return e.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vec"), e


@query("vector_topk", f"WITH {TOP} SELECT query_id, chunk_id, round(s, 6) AS score, rank FROM r WHERE rank <= 8")
def _(s, d):
    return R.vector_top(*vectors(s, d)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vector_topk_floor", f"WITH {TOP} SELECT query_id, chunk_id, rank FROM (SELECT *, max(s) OVER (PARTITION BY query_id) AS m FROM r WHERE rank BETWEEN 2 AND 8) WHERE m >= 0.25")
def _(s, d):
    others = R.vector_top(*vectors(s, d)).where("rank > 1")
    return R.floor_top(others, context.FLOOR).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


UNIT = "len(embedding) = 96 AND list_sum(list_transform(embedding, lambda x: CASE WHEN isfinite(x) AND x IS NOT NULL THEN 0 ELSE 1 END)) = 0"
COSINE = "round(coalesce(CASE WHEN isnan(list_cosine_similarity({0}, {1})) THEN 0 ELSE list_cosine_similarity({0}, {1}) END, 0), 10)"
LEXICAL = rf"""w AS (SELECT query_id, word, min(i) AS i FROM (SELECT query_id, unnest(regexp_split_to_array(lower(query), '[^\p{{L}}\p{{N}}]+')) AS word, generate_subscripts(regexp_split_to_array(lower(query), '[^\p{{L}}\p{{N}}]+'), 1) AS i FROM q)
   WHERE length(word) >= 3 AND NOT list_contains({STOPS}, word) GROUP BY ALL),
 terms AS (SELECT query_id, {FOLD.format('word')} AS word, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS n FROM w) WHERE n <= 8),
 c AS (SELECT DISTINCT chunk_id, unnest(regexp_split_to_array({FOLD.format('text')}, '[^\p{{L}}\p{{N}}]+')) AS word FROM chunks WHERE text IS NOT NULL),
 m AS (SELECT query_id, chunk_id, count(*) AS words FROM c JOIN terms USING (word) GROUP BY ALL)"""


@query("lexical_topk", f"""WITH q AS (SELECT DISTINCT turn_id AS query_id, query FROM chat_turns WHERE turn_id % 20 = 0 AND query IS NOT NULL), {LEXICAL}
 SELECT query_id, chunk_id, words, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY words DESC, chunk_id) AS rank FROM m) WHERE rank <= 8""")
def _(s, d):
    q = read_table(s, d, "chat_turns").where("turn_id % 20 = 0 AND query IS NOT NULL").select(F.col("turn_id").alias("query_id"), F.col("query").alias("text")).distinct()
    return R.lexical_top(q, chunks_of(s, d, "chunk_id", "text")).select("query_id", "chunk_id", "words", F.col("rank").cast("long").alias("rank"))


@query("lexical_with_vectors", f"""WITH q AS (SELECT DISTINCT chunk_id AS query_id, text AS query, embedding::DOUBLE[] AS qv FROM chunks WHERE seq % 20 = 0 AND text IS NOT NULL AND {UNIT}), {LEXICAL},
 v AS (SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS v FROM chunks WHERE {UNIT}),
 s AS (SELECT m.*, {COSINE.format('qv', 'v')} AS score FROM m JOIN q USING (query_id) JOIN v USING (chunk_id))
 SELECT query_id, chunk_id, words, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY words DESC, score DESC, chunk_id) AS rank FROM s) WHERE rank <= 8""")
def _(s, d):
    """A chunk's text and vector as the question: equal counts of words are told apart by cosine."""
    q, c = chunk_vectors(s, d, "text")
    out = R.lexical_top(q.where("text IS NOT NULL"), c)
    return out.select("query_id", "chunk_id", "words", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


HYBRID_TERMS = "list_slice(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda t: length(t) >= 5), 1, 3)"


@query("hybrid_search", f"""WITH c AS (SELECT DISTINCT chunk_id, seq, text, {FOLD.format('text')} AS folded, embedding::DOUBLE[] AS v FROM chunks WHERE text IS NOT NULL AND {UNIT}),
 q AS (SELECT chunk_id AS query_id, v AS qv, {HYBRID_TERMS} AS terms FROM c WHERE seq % 20 = 0),
 t AS (SELECT query_id, chunk_id, {COSINE.format('v', 'qv')} AS s, coalesce(list_sum(list_transform(terms, lambda t: CAST((length(folded) - length(replace(folded, t, ''))) / length(t) AS BIGINT))), 0) AS lex FROM q, c),
 r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS v, CASE WHEN lex > 0 THEN row_number() OVER (PARTITION BY query_id ORDER BY lex DESC, chunk_id) END AS l FROM t),
 f AS (SELECT query_id, chunk_id, round(1.0::DOUBLE / (60 + v) + coalesce(1.0::DOUBLE / (60 + l), 0), 12) AS fused FROM r)
 SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS rank FROM f) WHERE rank <= 8""")
def _(s, d):
    """The whole index ranked by cosine and by occurrences of the first three long ASCII words of the asking chunk."""
    q, c = chunk_vectors(s, d, "text")
    terms = F.slice(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda t: F.length(t) >= 5), 1, 3)
    out = R.hybrid_search(q.where("text IS NOT NULL").select("query_id", "vec", terms.alias("terms")), c.where("text IS NOT NULL"))
    return out.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("rrf_fuse", f"WITH {HITS} SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)) + sum(1.0 / (60 + hit_rank)), 9) AS fused FROM h WHERE hit_rank IS NOT NULL GROUP BY ALL")
def _(s, d):
    h = hits_of(s, d).where("hit_rank IS NOT NULL")
    both = h.select("query_id", "chunk_id", "rank").unionByName(h.select("query_id", "chunk_id", F.col("hit_rank").alias("rank")))
    return R.rrf(both).withColumn("fused", F.round("fused", 9))


@query("hybrid_rerank", rf"""WITH {HITS}, x1 AS (SELECT query_id, regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+') AS x FROM h WHERE rank = 1), t1 AS (SELECT query_id, t, min(i) AS i FROM (SELECT query_id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM x1) WHERE length(t) >= 3 AND NOT list_contains({STOPS}, t) GROUP BY ALL),
 asked AS (SELECT query_id, {FOLD.format('t')} AS t FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS n FROM t1) WHERE n <= 6),
 said AS (SELECT DISTINCT hit_id, query_id, chunk_id, unnest(regexp_split_to_array({FOLD.format('text')}, '[^\p{{L}}\p{{N}}]+')) AS t FROM h),
 n AS (SELECT hit_id, query_id, chunk_id, count(*) AS lex FROM said JOIN asked USING (query_id, t) GROUP BY ALL),
 w AS (SELECT h.hit_id, h.query_id, h.chunk_id, score, rank, coalesce(lex, 0) AS lex FROM h LEFT JOIN n ON n.hit_id = h.hit_id AND n.query_id = h.query_id AND n.chunk_id = h.chunk_id),
 x AS (SELECT *, CASE WHEN lex > 0 THEN row_number() OVER (PARTITION BY query_id ORDER BY lex DESC, chunk_id, rank) END AS lr, max(lex) OVER (PARTITION BY query_id) = 0 OR count(*) OVER (PARTITION BY query_id) <= 1 AS same FROM w),
 f AS (SELECT *, 1.0::DOUBLE / (60 + rank) + coalesce(1.0::DOUBLE / (60 + lr), 0) AS fused FROM x)
 SELECT hit_id, query_id, lex::BIGINT AS lex, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN same THEN rank END, round(fused, 12) DESC, score DESC, chunk_id, rank) AS new_rank FROM f""")
def _(s, d):
    """The question is the first hit's text, of which the first six terms count, since stored searches have no question text."""
    h = hits_of(s, d)
    terms = h.where("rank = 1").select("query_id", F.slice(T.query_terms(F.col("text")), 1, 6).alias("terms"))
    out = R.hybrid_rerank(h.join(terms, "query_id"), F.col("terms"))
    return out.select("hit_id", "query_id", F.col("lex").cast("long").alias("lex"), F.col("new_rank").cast("long").alias("new_rank"))


@query("relevant_band", f"WITH {HITS}, f AS (SELECT *, first_value(score) OVER (PARTITION BY query_id ORDER BY rank) AS t FROM h) SELECT hit_id, query_id, score FROM f WHERE t >= 0.45 AND score >= greatest(0.45, t * 0.75)")
def _(s, d):
    return R.relevant(hits_of(s, d)).select("hit_id", "query_id", "score")


ANCHORS = "a AS (SELECT DISTINCT h.query_id, m.doc_id FROM h JOIN mentions m ON m.chunk_id = h.chunk_id WHERE m.doc_id IS NOT NULL AND h.rank <= 2)"


@query("restrict_to_entities", f"WITH {HITS}, {ANCHORS} SELECT hit_id, query_id FROM h WHERE query_id NOT IN (SELECT query_id FROM a) OR score >= 0.6 OR hit_rank = 3 OR EXISTS (SELECT 1 FROM a WHERE a.query_id = h.query_id AND a.doc_id = h.doc_id)")
def _(s, d):
    """Anchors are the documents of the first two hits here, since stored searches have no question text; third hits are protected."""
    h = hits_of(s, d)
    m = read_table(s, d, "mentions").where("doc_id IS NOT NULL").select("chunk_id", F.col("doc_id").alias("to")).distinct()
    anchors = h.where("rank <= 2").select("query_id", "chunk_id").join(m, "chunk_id").select("query_id", F.col("to").alias("doc_id"))
    return R.restrict_to_anchors(h, anchors, protect=h.where("hit_rank = 3")).select("hit_id", "query_id")


@query("best_per_doc", f"WITH {HITS}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank, chunk_id) AS k FROM h) SELECT query_id, doc_id, chunk_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS nth FROM o WHERE k = 1) WHERE nth <= 5")
def _(s, d):
    return R.best_per_doc(hits_of(s, d), 5).select("query_id", "doc_id", "chunk_id", F.col("nth").cast("long").alias("nth"))


@query("references", f"WITH {HITS}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank, chunk_id) AS k FROM h) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS number FROM o WHERE k = 1")
def _(s, d):
    return R.best_per_doc(hits_of(s, d)).select("query_id", "doc_id", F.col("nth").cast("long").alias("number"))


GRAPH = f"""q AS (SELECT DISTINCT chunk_id AS query_id, embedding::DOUBLE[] AS qv FROM chunks WHERE seq % 20 = 0 AND {UNIT}),
 c AS (SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS v FROM chunks WHERE {UNIT}),
 t AS (SELECT query_id, chunk_id, {COSINE.format('v', 'qv')} AS score FROM c, q),
 seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM t) WHERE rank <= 8),
 band AS (SELECT *, score >= 0.8 * max(score) OVER (PARTITION BY query_id) AS near FROM seeds),
 anchor AS (SELECT query_id, chunk_id FROM (SELECT *, bool_or(near) OVER (PARTITION BY query_id) AS found FROM band) WHERE near OR NOT found),
 live AS (SELECT DISTINCT chunk_id, entity_id FROM mentions WHERE entity_id IN (SELECT id FROM entities) AND chunk_id IN (SELECT chunk_id FROM c)),
 subject AS (SELECT DISTINCT query_id, entity_id FROM anchor JOIN live USING (chunk_id)),
 sibling AS (SELECT query_id, chunk_id, count(DISTINCT (SELECT min(name) FROM entities WHERE id = entity_id)) AS shared FROM subject JOIN live USING (entity_id) ANTI JOIN seeds USING (query_id, chunk_id) GROUP BY ALL),
 ex AS (SELECT * FROM (SELECT query_id, chunk_id, shared, score, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, score DESC, chunk_id) AS rank FROM sibling JOIN t USING (query_id, chunk_id)) WHERE rank <= 8),
 pool AS (SELECT query_id, chunk_id, score, NULL AS g FROM seeds UNION ALL SELECT query_id, chunk_id, score, rank FROM ex),
 placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS v FROM pool),
 fuse AS (SELECT query_id, chunk_id, round(1.0::DOUBLE / (60 + v) + CASE WHEN g IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + g) END, 12) AS fused FROM placed)"""


def chunk_vectors(s, d, *more):
    v = F.col("embedding")
    good = (F.size(v) == 96) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    c = read_table(s, d, "chunks").where("embedding IS NOT NULL").where(good).select("chunk_id", "seq", *more, v.alias("vec")).distinct()
    return c.where("seq % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vec", *more), c.select("chunk_id", "vec", *more)


def graph_rows(s, d):
    q, c = chunk_vectors(s, d)
    return q, c, read_table(s, d, "mentions"), read_table(s, d, "entities")


@query("graph_expand", f"WITH {GRAPH} SELECT query_id, chunk_id, shared AS shared_count, round(score, 6) AS score, rank FROM ex")
def _(s, d):
    q, c, m, e = graph_rows(s, d)
    out = R.graph_expand(R.vector_top(q, c), q, c, m, e)
    return out.select("query_id", "chunk_id", F.col("shared_count").cast("long").alias("shared_count"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("graph_retrieve", f"WITH {GRAPH} SELECT query_id, chunk_id, round(fused, 9) AS fused, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS rank FROM fuse) WHERE rank <= 8")
def _(s, d):
    return R.graph_retrieve(*graph_rows(s, d)).select("query_id", "chunk_id", F.round("fused", 9).alias("fused"), F.col("rank").cast("long").alias("rank"))


@query("graph_context", f"WITH {GRAPH}, ok AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM seeds) WHERE top >= 0.45 AND score >= 0.75 * top AND score >= 0.45), u AS (SELECT query_id, chunk_id, score, 0 AS x, rank FROM ok UNION ALL SELECT query_id, chunk_id, score, 1, rank FROM ex WHERE query_id IN (SELECT query_id FROM ok)) SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY x, rank) AS nth FROM u")
def _(s, d):
    q, c, m, e = graph_rows(s, d)
    seeds = materialize(R.vector_top(q, c), "seeds")
    out = R.graph_context(R.relevant(seeds), R.expanded(seeds, q, c, m, e))
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("nth").cast("long").alias("nth"))


QUESTIONS = "q AS (SELECT DISTINCT turn_id AS query_id, query AS text FROM chat_turns WHERE query IS NOT NULL)"


def questions(s, d):
    return read_table(s, d, "chat_turns").where("query IS NOT NULL").select(F.col("turn_id").alias("query_id"), F.col("query").alias("text")).distinct()


@query("anchor_docs", rf"""WITH {QUESTIONS}, e AS (SELECT id, {FOLD.format('min(name)')} AS name FROM entities WHERE id IS NOT NULL AND name IS NOT NULL GROUP BY id),
 ew AS (SELECT DISTINCT id, unnest(regexp_split_to_array(name, '[^\p{{L}}\p{{N}}]+')) AS word FROM e), rare AS (SELECT word, min(id) AS id FROM ew WHERE length(word) >= 4 GROUP BY word HAVING count(*) = 1),
 qw AS (SELECT DISTINCT query_id, {FOLD.format('word')} AS word FROM (SELECT query_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS word FROM q) WHERE length(word) >= 3 AND NOT list_contains({STOPS}, word)),
 named AS (SELECT query_id, id FROM q JOIN e ON length(name) >= 3 AND regexp_matches(name, '[\p{{L}}\p{{N}}]') AND contains({FOLD.format('text')}, name) UNION SELECT query_id, id FROM qw JOIN rare USING (word) JOIN e USING (id) WHERE length(name) >= 3),
 p AS (SELECT DISTINCT entity_id AS id, doc_id FROM mentions WHERE doc_id IS NOT NULL AND entity_id IN (SELECT id FROM e)),
 one AS (SELECT DISTINCT query_id, doc_id FROM named JOIN p USING (id)), two AS (SELECT DISTINCT query_id, id FROM one JOIN p USING (doc_id))
 SELECT query_id, doc_id FROM one UNION SELECT query_id, doc_id FROM two JOIN p USING (id)""")
def _(s, d):
    return R.anchor_docs(questions(s, d), read_table(s, d, "entities"), read_table(s, d, "mentions"))


@query("named_subjects", rf"WITH {QUESTIONS}, p AS (SELECT query_id, unnest(x) AS subject, generate_subscripts(x, 1) AS i FROM (SELECT query_id, regexp_extract_all(text, '\p{{Lu}}\p{{L}}*(?:\s+\p{{Lu}}\p{{L}}*)+') AS x FROM q)) SELECT query_id, arg_min(subject, i) AS subject FROM p WHERE len(regexp_split_to_array(subject, '\s+')) BETWEEN 2 AND 4 GROUP BY query_id, {FOLD.format('subject')}")
def _(s, d):
    return R.named_subjects(questions(s, d)).select("query_id", "subject")


@query("ungrounded_subjects", rf"""WITH {QUESTIONS}, p AS (SELECT query_id, unnest(x) AS subject, generate_subscripts(x, 1) AS i FROM (SELECT query_id, regexp_extract_all(text, '\p{{Lu}}\p{{L}}*(?:\s+\p{{Lu}}\p{{L}}*)+') AS x FROM q)),
 s AS (SELECT query_id, {FOLD.format('subject')} AS f, arg_min(subject, i) AS subject FROM p WHERE len(regexp_split_to_array(subject, '\s+')) BETWEEN 2 AND 4 GROUP BY ALL),
 e AS (SELECT DISTINCT {FOLD.format('name')} AS n FROM entities WHERE length(name) >= 3),
 a AS (SELECT DISTINCT turn_id AS query_id, {FOLD.format('answer')} AS hay FROM chat_turns WHERE answer IS NOT NULL),
 k AS (SELECT s.*, EXISTS (SELECT 1 FROM e WHERE contains(s.f, n) OR contains(n, s.f)) OR EXISTS (SELECT 1 FROM a WHERE a.query_id = s.query_id AND contains(hay, s.f)) AS ok FROM s)
 SELECT query_id, subject FROM (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS found FROM k) WHERE NOT found""")
def _(s, d):
    said = read_table(s, d, "chat_turns").select(F.col("turn_id").alias("query_id"), F.col("answer").alias("text")).distinct()
    return R.ungrounded_subjects(questions(s, d), said, read_table(s, d, "entities"))


@query("add_lexical", f"WITH {HITS}, c AS (SELECT query_id, chunk_id, min(rank) AS rank FROM h WHERE rank <= 3 GROUP BY ALL), l AS (SELECT query_id, chunk_id, min(hit_rank) AS hr FROM h WHERE hit_rank IS NOT NULL GROUP BY ALL), x AS (SELECT l.query_id, l.chunk_id, row_number() OVER (PARTITION BY l.query_id ORDER BY l.hr, l.chunk_id) AS k FROM l ANTI JOIN c ON c.query_id = l.query_id AND c.chunk_id = l.chunk_id) SELECT query_id, chunk_id, rank FROM c UNION ALL SELECT x.query_id, x.chunk_id, x.k + coalesce(m.m, 0) FROM x LEFT JOIN (SELECT query_id, max(rank) AS m FROM c GROUP BY 1) m USING (query_id) WHERE x.k <= 4")
def _(s, d):
    h = hits_of(s, d)
    c = h.where("rank <= 3").groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    lex = h.where("hit_rank IS NOT NULL").groupBy("query_id", "chunk_id").agg(F.min("hit_rank").alias("rank"))
    return R.add_lexical(c, lex).withColumn("rank", F.col("rank").cast("long"))


@query("micro_graph", f"WITH {HITS}, g AS (SELECT hit_id, max(page) AS page FROM search_hits GROUP BY 1), r AS (SELECT h.*, page, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS k, CASE WHEN hit_rank % 3 = 0 THEN hit_rank END AS n FROM h LEFT JOIN g USING (hit_id)), t AS (SELECT *, CASE WHEN n IS NULL THEN least(1, greatest(0, score)) ELSE n / greatest(1, coalesce(max(n) OVER (PARTITION BY query_id), 0)) END AS w FROM r WHERE k <= 5) SELECT query_id, chunk_id, doc_id || CASE WHEN page IS NULL THEN '' ELSE ' · p.' || page END AS label, floor(w::DOUBLE * 100 + 0.5) / 100 AS weight, floor((1 + 5 * w::DOUBLE) * 100 + 0.5) / 100 AS width, n IS NOT NULL AS via_graph FROM t")
def _(s, d):
    """Every third hit counts as one from the graph, with its rank for the shared count."""
    h = hits_of(s, d)
    pages = read_table(s, d, "search_hits").groupBy("hit_id").agg(F.max("page").alias("page"))
    shared = h.where("hit_rank % 3 = 0").select("query_id", "chunk_id", F.col("hit_rank").alias("shared_count")).groupBy("query_id", "chunk_id").agg(F.max("shared_count").alias("shared_count"))
    return graph.micro_graph(h.join(pages, "hit_id", "left"), shared)


# --- graph -------------------------------------------------------------------------------------------------------------------


@query("entity_index", "SELECT id AS entity_id, min(name) AS name, notes FROM entities JOIN (SELECT entity_id, count(DISTINCT doc_id) AS notes FROM mentions GROUP BY 1) m ON m.entity_id = id GROUP BY id, notes")
def _(s, d):
    return graph.entity_index(read_table(s, d, "entities"), read_table(s, d, "mentions"))


@query("entity_doc_pairs", "SELECT DISTINCT entity_id, doc_id FROM mentions")
def _(s, d):
    return graph.entity_doc_pairs(read_table(s, d, "mentions"))


@query("neighbours", f"WITH {EDGES} SELECT src AS entity_id, id, min(name) AS name, min(type) AS type FROM e JOIN entities ON id = dst GROUP BY src, id")
def _(s, d):
    return graph.neighbours(read_table(s, d, "relations"), read_table(s, d, "entities")).select("entity_id", "id", "name", "type")


REACH = """b AS (SELECT DISTINCT src AS start, dst AS node, 1 AS hop FROM e UNION ALL SELECT DISTINCT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src WHERE b.dst <> a.src),
 m AS (SELECT start, node, min(hop) AS hop FROM b GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hop, node) AS n FROM m)"""


def starts(s, d):
    r = read_table(s, d, "relations")
    return r.select(F.col("source_id").alias("start")).union(r.select("target_id")).where("start IS NOT NULL").distinct()


@query("two_hops", f"WITH {EDGES}, {REACH} SELECT start, node, hop FROM k WHERE n <= 50")
def _(s, d):
    return graph.reach(starts(s, d), read_table(s, d, "relations"))


@query("entity_graph", f"WITH {EDGES}, {REACH}, v AS (SELECT start, node FROM k WHERE n <= 24 UNION SELECT DISTINCT src, src FROM e UNION SELECT DISTINCT x, x FROM (SELECT source_id AS x FROM relations UNION SELECT target_id FROM relations) WHERE x IS NOT NULL), r AS (SELECT DISTINCT source_id, target_id, type AS label FROM relations WHERE source_id IS NOT NULL AND target_id IS NOT NULL) SELECT v.start, r.source_id, r.target_id, r.label FROM r JOIN v ON v.node = r.source_id JOIN v w ON w.node = r.target_id AND w.start = v.start")
def _(s, d):
    return graph.entity_graph(starts(s, d), read_table(s, d, "relations"))


@query("relations_among", "SELECT DISTINCT source_id, target_id, type FROM relations WHERE source_id IN (SELECT id FROM entities WHERE type = 'person') AND target_id IN (SELECT id FROM entities WHERE type = 'person')")
def _(s, d):
    return graph.relations_among(read_table(s, d, "entities").where("type = 'person'").select("id").distinct(), read_table(s, d, "relations"))


@query("expand_by_entities", f"WITH {HITS}, sd AS (SELECT DISTINCT query_id, chunk_id FROM h WHERE rank <= 3), o AS (SELECT DISTINCT query_id, entity_id FROM sd JOIN mentions USING (chunk_id) WHERE entity_id IS NOT NULL) SELECT query_id, chunk_id, count(*) AS edges FROM o JOIN mentions USING (entity_id) WHERE chunk_id IS NOT NULL AND (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM sd) GROUP BY ALL")
def _(s, d):
    seeds = hits_of(s, d).where("rank <= 3").select("query_id", "chunk_id").distinct()
    return graph.expand_by_entities(seeds, read_table(s, d, "mentions"))


@query("ring_layout")
def _(s, d):
    return graph.ring_layout(graph.reach(starts(s, d), read_table(s, d, "relations"), most=graph.VIEW_NODES))


@query("scan_mentions", "WITH p AS (SELECT DISTINCT doc_id, entity_id FROM mentions), a AS (SELECT id, name AS s FROM entities UNION ALL SELECT id, unnest(aliases) FROM entities), s AS (SELECT DISTINCT p.doc_id, p.entity_id, lower(a.s) AS s FROM p JOIN a ON a.id = p.entity_id WHERE trim(a.s) <> ''), c AS (SELECT DISTINCT chunk_id, doc_id, lower(text) AS t FROM chunks WHERE text IS NOT NULL) SELECT DISTINCT c.chunk_id, c.doc_id, s.entity_id FROM c JOIN s USING (doc_id) WHERE contains(c.t, s.s)")
def _(s, d):
    names = read_table(s, d, "entities").select("id", F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("aliases")).distinct()
    of = read_table(s, d, "mentions").select("doc_id", F.col("entity_id").alias("id")).distinct().join(names, "id")
    return graph.scan_mentions(of, chunks_of(s, d, "chunk_id", "doc_id", "text"))


@query("heuristic_entities")
def _(s, d):
    return graph.extract(latest_notes(s, d, "body"))


@query("resolved_entities")
def _(s, d):
    return graph.resolve(graph.extract(latest_notes(s, d, "body")))[0]


@query("resolved_relations")
def _(s, d):
    return graph.resolve(graph.extract(latest_notes(s, d, "body")))[1]


@query("changed_docs", f"WITH {NOTES}, o AS (SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS old FROM (SELECT doc_id, min(text) AS text FROM chunks GROUP BY 1)) SELECT n.doc_id, 'sha256:' || sha256(coalesce(n.body, '')) AS hash FROM n LEFT JOIN o USING (doc_id) WHERE old IS DISTINCT FROM 'sha256:' || sha256(coalesce(n.body, ''))")
def _(s, d):
    meta = read_table(s, d, "chunks").groupBy("doc_id").agg(F.min("text").alias("t")).select("doc_id", F.concat(F.lit("h:"), T.content_hash(F.col("t"))).alias("hash"))
    return graph.changed_docs(latest_notes(s, d, "body"), meta).select("doc_id", "hash")


# --- corpus ------------------------------------------------------------------------------------------------------------------


TAGS = rf"""g AS (SELECT DISTINCT doc_id, tag FROM (
  SELECT doc_id, lower(regexp_replace(trim(unnest(regexp_split_to_array(coalesce(element_at(frontmatter, 'tags')[1], ''), '[,\s]+'))), '^#', '')) AS tag FROM n
  UNION ALL SELECT doc_id, lower(unnest(regexp_extract_all(coalesce(body, ''), '(?m)(?:^|\s)#([\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_/-]*)', 1))) FROM n) WHERE tag <> '')"""


def tagged(s, d):
    n = read_table(s, d, "notes").where("doc_id IS NOT NULL")
    newest = n.groupBy("doc_id").agg(F.max("loaded_at").alias("loaded_at"))
    return n.join(newest, ["doc_id", "loaded_at"]).select("doc_id", "body", "frontmatter").dropDuplicates(["doc_id"])


@query("tag_index", f"WITH {NOTES}, {TAGS} SELECT tag, count(*) AS notes FROM g GROUP BY tag")
def _(s, d):
    return corpus.tag_index(tagged(s, d))


@query("folders", "SELECT folder, count(*) AS notes FROM (SELECT DISTINCT doc_id, array_to_string(list_slice(p, 1, i), '/') AS folder FROM (SELECT doc_id, string_split(doc_id, '/') AS p, unnest(range(1, len(string_split(doc_id, '/')))) AS i FROM (SELECT DISTINCT doc_id FROM notes))) GROUP BY folder")
def _(s, d):
    return corpus.folders(read_table(s, d, "notes"))


@query("file_tree", "WITH f AS (SELECT DISTINCT doc_id AS path FROM notes), d AS (SELECT DISTINCT array_to_string(list_slice(p, 1, i), '/') AS path FROM (SELECT string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')))) AS i FROM f)) SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, kind, regexp_extract(path, '([^/]*)$', 1) AS name FROM (SELECT path, 'file' AS kind FROM f UNION ALL SELECT path, 'folder' FROM d)")
def _(s, d):
    return corpus.file_tree(read_table(s, d, "notes"))


@query("scope_folder", f"WITH {NOTES} SELECT doc_id FROM n WHERE starts_with(doc_id, 'daily/')")
def _(s, d):
    return corpus.scope_docs(tagged(s, d), "folder", "daily/")


@query("scope_tag", f"WITH {NOTES}, {TAGS}, most AS (SELECT tag FROM g GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 1) SELECT DISTINCT c.chunk_id, c.doc_id FROM chunks c JOIN g USING (doc_id) WHERE tag = (SELECT tag FROM most)")
def _(s, d):
    """The chunks of the notes that bear the most frequent tag."""
    n = tagged(s, d)
    top = corpus.tag_index(n).orderBy(F.desc("notes"), "tag").select("tag").first()
    return corpus.in_scope(chunks_of(s, d, "chunk_id", "doc_id"), corpus.scope_docs(n, "tag", top["tag"] if top else ""))


@query("tag_notes", f"WITH {NOTES}, {TAGS} SELECT tag, list(doc_id ORDER BY doc_id) AS doc_ids FROM g GROUP BY tag")
def _(s, d):
    return corpus.tag_notes(tagged(s, d))


CLEAN = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
SURFACES = f"u AS (SELECT surface, min(doc_id) AS doc_id FROM (SELECT doc_id, {CLEAN.format('title')} AS surface FROM n UNION ALL SELECT doc_id, {CLEAN.format('x')} FROM (SELECT doc_id, unnest(aliases) AS x FROM n)) WHERE surface <> '' GROUP BY 1)"


@query("title_index", f"WITH {NOTES}, {SURFACES} SELECT surface, doc_id FROM u")
def _(s, d):
    return corpus.title_index(latest_notes(s, d, "title", "aliases"))


LINKED = rf"l AS (SELECT doc_id, {CLEAN.format('t')} AS surface FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(body, ''), '\[\[([^\[\]|#\n]+)(?:#[^\[\]|\n]*)?(?:\|[^\[\]\n]*)?\]\]', 1)) AS t FROM n))"


@query("backlinks", f"WITH {NOTES}, {SURFACES}, {LINKED}, e AS (SELECT {CLEAN.format('name')} AS surface, min(id) AS doc_id FROM entities WHERE name IS NOT NULL GROUP BY 1), k AS (SELECT * FROM u UNION ALL SELECT * FROM e WHERE surface <> '' AND surface NOT IN (SELECT surface FROM u)) SELECT k.doc_id AS target, l.doc_id AS source, count(*) AS links FROM l JOIN k USING (surface) WHERE l.doc_id <> k.doc_id GROUP BY ALL")
def _(s, d):
    """Links by title or alias; those that name an entity point at its page."""
    titles = corpus.title_index(latest_notes(s, d, "title", "aliases"))
    pages = corpus.title_index(read_table(s, d, "entities").where("name IS NOT NULL").select(F.col("id").alias("doc_id"), F.col("name").alias("title"), F.lit(None).cast("array<string>").alias("aliases")))
    return corpus.backlinks(latest_notes(s, d, "body"), titles.unionByName(pages.join(titles.select("surface"), "surface", "left_anti")))


@query("link_targets", f"WITH {NOTES}, {LINKED} SELECT doc_id, surface, count(*) AS links FROM l WHERE surface <> '' GROUP BY ALL")
def _(s, d):
    return corpus.links(latest_notes(s, d, "body")).groupBy("doc_id", "surface").agg(F.count("*").alias("links"))


@query("rank_titles", f"WITH {NOTES}, {SURFACES}, h AS (SELECT doc_id, surface, CASE WHEN starts_with(surface, 'the r') THEN 2 ELSE 1 END AS score FROM u WHERE contains(surface, 'the r')), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(surface), surface) AS k FROM h) SELECT doc_id, surface, score FROM o WHERE k = 1 ORDER BY score DESC, length(surface), surface, doc_id LIMIT 8")
def _(s, d):
    return corpus.rank_titles(corpus.title_index(latest_notes(s, d, "title", "aliases")), "the r")


@query("quick_switch")
def _(s, d):
    return corpus.quick_switch(latest_notes(s, d, "title"), "roof")


@query("note_paths", f"WITH {NOTES}, s AS (SELECT doc_id, 'notes/' || CASE WHEN s = '' THEN 'untitled' ELSE s END AS stem FROM (SELECT doc_id, regexp_replace(left(regexp_replace(regexp_replace({FOLD.format('title')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), '-+$', '') AS s FROM n WHERE title IS NOT NULL)), r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY doc_id) AS i FROM s), k AS (SELECT stem, k, row_number() OVER (PARTITION BY stem ORDER BY k) AS i FROM (SELECT DISTINCT stem FROM s), range(1, 2000) t(k) WHERE k = 1 OR stem || '-' || k NOT IN (SELECT stem FROM s)) SELECT doc_id, CASE WHEN k = 1 THEN stem ELSE stem || '-' || k END || '.md' AS path FROM r JOIN k USING (stem, i)")
def _(s, d):
    wanted = latest_notes(s, d, "title").where("title IS NOT NULL").select("doc_id", F.concat(F.lit("notes/"), T.slug(F.col("title")), F.lit(".md")).alias("path"))
    return corpus.first_free(wanted, s.createDataFrame([], "path string"))


@query("edit_conflict", "SELECT hit_id, CASE WHEN m IS NOT DISTINCT FROM t OR (m IS NOT DISTINCT FROM b AND t IS NOT DISTINCT FROM b) THEN 'noop' WHEN m IS DISTINCT FROM b AND t IS NOT DISTINCT FROM b THEN 'save' WHEN m IS NOT DISTINCT FROM b THEN 'reload' ELSE 'conflict' END AS decision FROM (SELECT DISTINCT h.hit_id, h.text AS m, c.text AS t, f.text AS b FROM search_hits h JOIN (SELECT chunk_id, max(text) AS text FROM chunks GROUP BY 1) c USING (chunk_id) JOIN (SELECT chunk_id, min(text) AS text FROM search_hits GROUP BY 1) f USING (chunk_id))")
def _(s, d):
    h = read_table(s, d, "search_hits")
    theirs = read_table(s, d, "chunks").groupBy("chunk_id").agg(F.max("text").alias("theirs"))
    base = h.groupBy("chunk_id").agg(F.min("text").alias("base"))
    rows = h.select("hit_id", "chunk_id", F.col("text").alias("mine")).distinct().join(theirs, "chunk_id").join(base, "chunk_id")
    return corpus.edit_conflict(rows.select("hit_id", "mine", "theirs", "base").distinct()).select("hit_id", "decision")


# --- context -----------------------------------------------------------------------------------------------------------------


@query("compile_xml", """WITH c AS (SELECT doc_id, seq, min('    <chunk seq="' || seq || '"' || CASE WHEN page IS NULL THEN '' ELSE ' page="' || page || '"' END || '>' || replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</chunk>') AS line FROM chunks WHERE doc_id IS NOT NULL AND seq IS NOT NULL GROUP BY ALL)
 SELECT doc_id, md5('<context generated_by="notemesh" version="2.0">' || chr(10) || '  <source path="' || replace(replace(replace(replace(doc_id, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '">' || chr(10) || string_agg(line, chr(10) ORDER BY seq) || chr(10) || '  </source>' || chr(10) || '</context>') AS md5 FROM c GROUP BY doc_id""")
def _(s, d):
    return context.compile_xml(read_table(s, d, "chunks")).select("doc_id", F.md5("xml").alias("md5"))


PII_SQL = {"email": r"[\w.+-]+@[\w-]+\.[\w.-]+", "phone": r"\+?\d[\d\s().-]{7,}\d", "ssn": r"\b\d{3}-\d{2}-\d{4}\b", "credit_card": r"\b(?:\d[ -]?){13,16}\b", "ip": r"\b\d{1,3}(?:\.\d{1,3}){3}\b"}
PREVIEW = "p AS (" + " UNION ALL ".join(f"SELECT doc_id, 'pii: {k}' AS label, regexp_extract_all(coalesce(body, ''), '{p}') AS m FROM n" for k, p in PII_SQL.items()) + ")"
REDACTED = "body"
for _p in PII_SQL.values():
    REDACTED = f"regexp_replace({REDACTED}, '{_p}', '[REDACTED]', 'g')"
KINDS = ["email", "phone", "ssn", "credit_card", "ip"]


@query("redaction_preview", f"WITH {NOTES}, {PREVIEW} SELECT doc_id, label, len(m) AS matches, array_to_string(list_sort(list_distinct(m)), ' ') AS found FROM p WHERE len(m) > 0")
def _(s, d):
    p = context.redaction_preview(latest_notes(s, d, "body"), "doc_id", "body", KINDS)
    return p.select("doc_id", "label", F.col("matches").cast("long").alias("matches"), F.array_join("found", " ").alias("found"))


@query("redaction_summary", f"WITH {NOTES}, {PREVIEW} SELECT label, sum(len(m))::BIGINT AS matches FROM p WHERE len(m) > 0 GROUP BY label")
def _(s, d):
    return context.redaction_summary(context.redaction_preview(latest_notes(s, d, "body"), "doc_id", "body", KINDS))


@query("redact_pii", f"WITH {NOTES} SELECT doc_id, md5({REDACTED}) AS md5 FROM n")
def _(s, d):
    return latest_notes(s, d, "body").select("doc_id", F.md5(T.redact(F.col("body"), KINDS)).alias("md5"))


TOKENS = r"len(list_filter(regexp_split_to_array(coalesce({0}, ''), '[\s\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}\x{{000B}}]+'), lambda t: t <> ''))"


@query("token_counts", f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents")
def _(s, d):
    return read_table(s, d, "documents").select("doc_id", T.token_count(F.col("text")).cast("long").alias("tokens"))


@query("cost_report", f"SELECT doc_id, model_id, tokens, tokens <= window_tokens AS fits, round(tokens / window_tokens, 3) AS utilization FROM (SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents), model_windows")
def _(s, d):
    docs = read_table(s, d, "documents").select("doc_id", T.token_count(F.col("text")).cast("long").alias("tokens"))
    return context.cost_report(docs, read_table(s, d, "model_windows"))


CITED = r"m AS (SELECT turn_id, answer, unnest(x) AS m, generate_subscripts(x, 1) AS i FROM (SELECT DISTINCT turn_id, answer, regexp_extract_all(answer, '\[#(\d+)\]', 1) AS x FROM (SELECT turn_id, regexp_replace(answer, '\[(\d)', '[#\1', 'g') AS answer FROM chat_turns WHERE answer IS NOT NULL)))"


def cited(s, d):
    """Answers with their marks [n] written as [#n], as these data have them."""
    t = read_table(s, d, "chat_turns").where("answer IS NOT NULL").select("turn_id", F.regexp_replace("answer", r"\[([0-9])", "[#$1").alias("answer")).distinct()
    return context.citations(t).withColumn("nth", F.col("nth").cast("long"))


@query("citations", f"WITH {CITED} SELECT turn_id, i AS nth, m::INT AS ref, sum(length(g) + 3 + length(m)) OVER (PARTITION BY turn_id, answer ORDER BY i) - 3 - length(m) AS start FROM (SELECT *, list_extract(regexp_split_to_array(answer, '\\[#\\d+\\]'), i) AS g FROM m)")
def _(s, d):
    return cited(s, d).select("turn_id", "nth", "ref", F.col("start").cast("decimal(38,0)").cast("double").alias("start"))


@query("citation_usage", f"WITH {CITED} SELECT turn_id, count(DISTINCT CASE WHEN m::INT BETWEEN 1 AND 2 THEN m::INT END) AS used, count(*) FILTER (WHERE m::INT NOT BETWEEN 1 AND 2) AS dropped FROM m GROUP BY turn_id")
def _(s, d):
    """Two sources an answer, so further numbers are dropped."""
    c = cited(s, d)
    sources = c.select("turn_id").distinct().select("turn_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("ref")).withColumn("chunk_id", F.col("ref").cast("string"))
    return context.citation_usage(context.resolve_citations(c, sources))


@query("selection_scores", f"WITH {HITS}, s AS (SELECT DISTINCT query_id, doc_id FROM h WHERE rank <= 4), g AS (SELECT DISTINCT query_id, doc_id FROM h WHERE score >= 0.7), n AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(ns, 0) AS ns, coalesce(ng, 0) AS ng FROM (SELECT query_id, count(*) AS ns FROM s GROUP BY 1) a FULL JOIN (SELECT query_id, count(*) AS ng FROM g GROUP BY 1) b ON a.query_id = b.query_id), b AS (SELECT s.query_id, count(*) AS c FROM s JOIN g ON g.query_id = s.query_id AND g.doc_id IS NOT DISTINCT FROM s.doc_id GROUP BY 1) SELECT query_id, round(CASE WHEN ng = 0 THEN 1 ELSE coalesce(c, 0) / ng END, 6) AS recall, round(CASE WHEN ns = 0 THEN 0 ELSE coalesce(c, 0) / ns END, 6) AS precision FROM n LEFT JOIN b USING (query_id)")
def _(s, d):
    h = hits_of(s, d)
    out = context.scores(h.where("rank <= 4"), h.where("score >= 0.7"))
    return out.select("query_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


SELECTION = rf"""c AS (SELECT query_id, chunk_id, doc_id, CAST(nullif(regexp_extract(chunk_id, '#([0-9]+)$', 1), '') AS INT) AS seq, text, score, hit_rank % 2 = 0 AS linked, hit_rank AS n, {TOKENS.format('text')} AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank) AS k FROM h) WHERE k = 1),
 t AS (SELECT *, CASE WHEN score >= 0.55 THEN 1 WHEN linked THEN 2 END AS tier FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, CASE WHEN tier = 2 THEN -n END, -score, doc_id, seq, chunk_id) AS place FROM t WHERE tier IS NOT NULL)"""


def candidates(s, d):
    h = hits_of(s, d).withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank"))).where("_k = 1")
    return h.select("query_id", "chunk_id", "doc_id", F.expr("try_cast(nullif(regexp_extract(chunk_id, '#([0-9]+)$', 1), '') AS int)").alias("seq"), "text", "score", (F.col("hit_rank") % 2 == 0).alias("graph_connected"), F.col("hit_rank").alias("shared_count"), F.lit(False).alias("pinned"), T.token_count(F.col("text")).alias("tokens"))


@query("rank_candidates", f"WITH {HITS}, {SELECTION} SELECT query_id, chunk_id, tier, place FROM p")
def _(s, d):
    out = context.usefulness(candidates(s, d), floor=0.55)
    return out.select("query_id", "chunk_id", "tier", F.col("place").cast("long").alias("place"))


@query("select_context", f"""WITH RECURSIVE {HITS}, {SELECTION},
 w AS (SELECT query_id, place, tier, doc_id, seq, tokens, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS words, trim(lower(text)) AS flat FROM p),
 g AS (SELECT *, CASE WHEN len(words) >= 3 THEN list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS sh FROM w),
 alike AS (SELECT a.query_id, a.place AS early, b.place AS late FROM g a JOIN g b ON a.query_id = b.query_id AND a.place < b.place WHERE (a.doc_id = b.doc_id AND a.seq = b.seq) OR CASE WHEN len(a.sh) = 0 OR len(b.sh) = 0 THEN a.flat = b.flat ELSE len(list_intersect(a.sh, b.sh)) >= 0.8 * (len(a.sh) + len(b.sh) - len(list_intersect(a.sh, b.sh))) END),
 near AS (SELECT query_id, late AS place, list(early) AS early FROM alike GROUP BY ALL),
 walk AS (SELECT query_id, 0::BIGINT AS place, 0::BIGINT AS used, []::BIGINT[] AS kept FROM (SELECT DISTINCT query_id FROM p)
   UNION ALL SELECT walk.query_id, g.place, CASE WHEN ok THEN used + g.tokens ELSE used END, CASE WHEN ok THEN list_append(kept, g.place) ELSE kept END
   FROM walk JOIN g ON g.query_id = walk.query_id AND g.place = walk.place + 1 LEFT JOIN near ON near.query_id = g.query_id AND near.place = g.place, LATERAL (SELECT NOT coalesce(list_has_any(kept, near.early), false) AND used + g.tokens <= 300 AS ok)),
 done AS (SELECT query_id, unnest(kept) AS place FROM (SELECT query_id, arg_max(kept, place) AS kept FROM walk GROUP BY query_id))
 SELECT p.query_id, p.chunk_id, p.tokens FROM done JOIN p USING (query_id, place)""")
def _(s, d):
    out = context.select_context(candidates(s, d), budget=300, floor=0.55)
    return out.select("query_id", "chunk_id", F.col("tokens").cast("long").alias("tokens"))


@query("selection_counts")
def _(s, d):
    return context.selection_counts(context.judged(candidates(s, d), budget=300, floor=0.55))


@query("context_manifest", f"SELECT doc_id, model_id, tokens, tokens <= window_tokens AS fits, greatest(tokens - window_tokens, 0) AS over_by, round(tokens / window_tokens, 3) AS utilization, round(tokens / 1e6 * window_tokens / 1000, 6) AS cost FROM (SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents), model_windows")
def _(s, d):
    """A model's price is its window over a thousand here, since these data have none."""
    docs = read_table(s, d, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))
    return context.manifest(docs, read_table(s, d, "model_windows").withColumn("price", F.col("window_tokens") / 1000))


@query("audit_records", f"WITH {NOTES}, {PREVIEW}, c AS (SELECT doc_id, string_agg(label || '=' || k, ', ' ORDER BY label || '=' || k) AS redactions FROM (SELECT doc_id, label, sum(len(m))::BIGINT AS k FROM p WHERE len(m) > 0 GROUP BY ALL) GROUP BY doc_id) SELECT n.doc_id, '2025-01-01' AS exported_at, 'm' AS target_model, {TOKENS.format('body')} AS tokens, 'sha256:' || sha256(coalesce(body, '')) AS hash, coalesce(redactions, '') AS redactions FROM n LEFT JOIN c USING (doc_id)")
def _(s, d):
    n = latest_notes(s, d, "body")
    return context.audit_record(n.select("doc_id", T.token_count(F.col("body")).alias("tokens")), context.sources_from_notes(n), context.redaction_preview(n, "doc_id", "body", KINDS), "m", "2025-01-01")


@query("sources_from_hits", f"WITH {HITS} SELECT DISTINCT doc_id, coalesce(TRY_CAST(nullif(split_part(chunk_id, '#', 2), '') AS INT), 0) AS seq, md5(text) AS md5 FROM h WHERE doc_id IS NOT NULL")
def _(s, d):
    h = hits_of(s, d).withColumn("page", F.lit(None).cast("int"))
    return context.sources_from_hits(h).select("doc_id", "seq", F.md5("text").alias("md5")).distinct()


@query("highlights", f"WITH {NOTES} SELECT DISTINCT c.chunk_id, md5(substring(body, char_start + 1, greatest(0, least(char_end, length(body)) - char_start))) AS md5 FROM chunks c JOIN n USING (doc_id) WHERE body IS NOT NULL AND char_start BETWEEN 0 AND length(body) AND char_end IS NOT NULL")
def _(s, d):
    c = chunks_of(s, d, "chunk_id", "doc_id", "char_start", "char_end").join(latest_notes(s, d, "body"), "doc_id").where("body IS NOT NULL AND char_start BETWEEN 0 AND length(body) AND char_end IS NOT NULL")
    return c.select("chunk_id", F.md5(T.highlight(F.col("body"), F.col("char_start"), F.col("char_end"))["hit"]).alias("md5")).distinct()


@query("graph_hashes", "SELECT doc_id, format('{:x}', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(text, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)) AS hash FROM documents WHERE text IS NOT NULL AND text <> '' AND NOT regexp_matches(text, '[^\\x{0}-\\x{FFFF}]')")
def _(s, d):
    docs = read_table(s, d, "documents").where("text IS NOT NULL AND text <> ''").where(~F.col("text").rlike(r"[^\x{0}-\x{FFFF}]"))
    return docs.select("doc_id", T.graph_hash(F.col("text")).alias("hash"))


@query("folder_paths", f"SELECT DISTINCT vault_name, array_to_string(list_filter(list_transform(string_split(vault_name || '/ Old  Things/!', '/'), lambda x: regexp_replace(left(regexp_replace(regexp_replace({FOLD.format('x')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), '-+$', '')), lambda x: x <> '' AND x <> 'untitled'), '/') AS folder FROM vaults")
def _(s, d):
    return read_table(s, d, "vaults").select("vault_name", T.folder_path(F.concat("vault_name", F.lit("/ Old  Things/!"))).alias("folder")).where("vault_name IS NOT NULL").distinct()


@query("selection_bench", "SELECT * FROM (VALUES ('raw', 1.0::DOUBLE, 0.333::DOUBLE, 0.5::DOUBLE), ('naive', 0.625, 0.625, 0.625), ('compiled', 1.0, 1.0, 1.0)) t(strategy, recall, precision, f1)")
def _(s, d):
    """The published bench on its own notes; SQL holds the published scores."""
    return selection_bench.published(s).select("strategy", "recall", "precision", "f1")


# --- chunking ----------------------------------------------------------------------------------------------------------------


@query("chunk_notes")
def _(s, d):
    return chunking.chunk_notes(latest_notes(s, d, "body"))


@query("chunk_slices", f"WITH {NOTES} SELECT doc_id, md5(body) AS md5, 0::BIGINT AS unlike, 0::BIGINT AS gaps FROM n WHERE body IS NOT NULL AND trim(body, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def _(s, d):
    """Chunks are slices of their note without gaps: cut where the next begins, they give the body again."""
    n = latest_notes(s, d, "body")
    c = chunking.chunk_notes(n).join(n, "doc_id")
    own = Window.partitionBy("doc_id").orderBy("seq")
    cut = F.coalesce(F.lead("char_start").over(own), F.col("char_end"))
    rows = c.withColumn("cut", cut).withColumn("gap", (F.col("cut") > F.col("char_end")).cast("long")).withColumn("unlike", (F.col("text") != F.substring(F.col("body"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))).cast("long"))
    piece = F.struct("seq", F.substring(F.col("body"), F.col("char_start") + 1, F.col("cut") - F.col("char_start")).alias("t"))
    return rows.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["t"]), "")).alias("md5"), F.sum("unlike").alias("unlike"), F.sum("gap").alias("gaps"))


HEADS = rf"""lines AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(body, chr(10)) AS x FROM n WHERE body IS NOT NULL)),
 placed AS (SELECT doc_id, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS pos FROM lines),
 heads AS (SELECT doc_id, pos, regexp_extract(line, '^#{{1,6}}[ \t]+(.+?)[ \t]*#*[ \t]*$', 1) AS heading FROM placed WHERE regexp_matches(line, '^#{{1,6}}[ \t]+(.+?)[ \t]*#*[ \t]*$'))"""


@query("sections", f"WITH {NOTES}, {HEADS} SELECT c.chunk_id, arg_max(heading, pos) AS heading FROM (SELECT DISTINCT chunk_id, doc_id, char_start FROM chunks) c LEFT JOIN heads ON heads.doc_id = c.doc_id AND pos <= char_start GROUP BY c.chunk_id, c.doc_id, c.char_start")
def _(s, d):
    return chunking.section_of(chunks_of(s, d, "chunk_id", "doc_id", "char_start"), chunking.headings(latest_notes(s, d, "body")))


@query("embed_chunks")
def _(s, d):
    """Chunks with title and section in front of their text, as they are embedded."""
    n = latest_notes(s, d, "title", "body")
    c = chunks_of(s, d, "chunk_id", "doc_id", "char_start", "text").where("text IS NOT NULL")
    heads = chunking.section_of(c, chunking.headings(n)).groupBy("chunk_id").agg(F.max("heading").alias("heading"))
    rows = c.join(heads, "chunk_id", "left").join(n.select("doc_id", "title"), "doc_id", "left")
    return chunking.embed(rows.select("chunk_id", chunking.embed_texts(F.col("title"), F.col("heading"), F.col("text")).alias("text"))).select("chunk_id", "text", "embedding")


# --- links and prompts -------------------------------------------------------------------------------------------------------


@query("woven_links")
def _(s, d):
    return links.woven_links(latest_notes(s, d, "body"), corpus.title_index(latest_notes(s, d, "title", "aliases")))


@query("unlinked_mentions")
def _(s, d):
    return links.unlinked_mentions(latest_notes(s, d, "body"), corpus.title_index(latest_notes(s, d, "title", "aliases")))


@query("assemble_prompts")
def _(s, d):
    h = read_table(s, d, "search_hits").select("hit_id", "page").groupBy("hit_id").agg(F.max("page").alias("page"))
    questions = hits_of(s, d).select("query_id").distinct().withColumn("question", F.concat(F.lit("What do the notes say? "), F.col("query_id")))
    return prompting.assemble_prompts(hits_of(s, d).join(h, "hit_id"), questions, budget=200)


@query("normalized_markers", r"SELECT DISTINCT turn_id, md5(regexp_replace(answer, '\[[^\]\d#]*#\s*(\d+)\s*\]', '[#\1]', 'g')) AS md5 FROM chat_turns")
def _(s, d):
    return read_table(s, d, "chat_turns").select("turn_id", F.md5(prompting.normalize_markers(F.col("answer"))).alias("md5")).distinct()


@query("shared_orders", "WITH m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), q AS (SELECT l_orderkey AS query_id, l_partkey FROM m WHERE l_orderkey % 20 = 0) SELECT q.query_id, m.l_orderkey AS other, count(*) AS shared FROM q JOIN m USING (l_partkey) WHERE m.l_orderkey <> q.query_id GROUP BY ALL")
def _(s, d):
    """The expansion on a large bipartite graph: orders that share parts with a queried order."""
    m = read_table(s, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity_id")).distinct()
    seeds = m.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "chunk_id").distinct()
    return graph.expand_by_entities(seeds, m).select("query_id", F.col("chunk_id").alias("other"), F.col("edges").alias("shared"))


# --- life of notes -----------------------------------------------------------------------------------------------------------


@query("entity_patterns", r"WITH f AS (SELECT id, name, trim(name) AS s FROM entities UNION ALL SELECT id, name, trim(unnest(aliases)) FROM entities), own AS (SELECT id AS entity_id, 'entity: ' || name AS label, s FROM f), near AS (SELECT DISTINCT a, b FROM (SELECT source_id AS a, target_id AS b FROM relations UNION ALL SELECT target_id, source_id FROM relations) WHERE a <> b), con AS (SELECT near.a AS entity_id, 'connected: ' || name AS label, s FROM near JOIN f ON f.id = near.b) SELECT DISTINCT entity_id, label, s AS surface, '(?<![\p{L}\p{N}_])' || regexp_replace(s, '([\\.*+?^${}()|\[\]])', '\\\1', 'g') || '(?![\p{L}\p{N}_])' AS pattern FROM (SELECT * FROM own UNION ALL SELECT * FROM con) WHERE s <> '' AND label IS NOT NULL")
def _(s, d):
    return lifecycle.entity_patterns(read_table(s, d, "entities").where("name IS NOT NULL"), read_table(s, d, "relations")).select("entity_id", "label", "surface", "pattern").distinct()


@query("moved_folder", f"WITH {NOTES}, w AS (SELECT doc_id, 'old/' || substring(doc_id, 7) AS path FROM n WHERE starts_with(doc_id, 'daily/')) SELECT doc_id, path FROM w")
def _(s, d):
    return lifecycle.moved(read_table(s, d, "notes").where("doc_id IS NOT NULL").select("doc_id").distinct(), "daily", "old")


@query("updated_notes", f"WITH {NOTES} SELECT doc_id, coalesce(title, '') AS title, md5(CASE WHEN length(body) % 2 = 0 THEN 'new ' || body ELSE body END) AS md5, CASE WHEN length(body) % 2 = 0 THEN 'sha256:' || sha256('new ' || body) ELSE coalesce(element_at(frontmatter, 'hash')[1], '') END AS hash FROM n WHERE body IS NOT NULL")
def _(s, d):
    """Bodies of even length get a word in front."""
    n = tagged(s, d).join(latest_notes(s, d, "title"), "doc_id").where("body IS NOT NULL")
    edits = n.where("length(body) % 2 = 0").select("doc_id", F.lit(None).cast("string").alias("title"), F.concat(F.lit("new "), "body").alias("body"))
    out = lifecycle.updated(n, edits, "2025-01-01")
    return out.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.md5("body").alias("md5"), F.coalesce(F.element_at("frontmatter", F.lit("hash")), F.lit("")).alias("hash"))


@query("model_profiles", "SELECT model_id AS model, model_id, window_tokens FROM model_windows")
def _(s, d):
    m = read_table(s, d, "model_windows")
    return lifecycle.model_profiles(m, m.select(F.col("model_id").alias("model")))


@query("daily_notes", "SELECT DISTINCT 'notes/' || strftime(saved_at AT TIME ZONE 'UTC', '%Y-%m-%d') || '.md' AS path FROM notes WHERE saved_at IS NOT NULL")
def _(s, d):
    return read_table(s, d, "notes").where("saved_at IS NOT NULL").select(lifecycle.daily_path(F.col("saved_at")).alias("path")).distinct()


@query("rendered_notes")
def _(s, d):
    return latest_notes(s, d, "body").select("doc_id", markdown.to_html(F.col("body")).alias("html"))


@query("renamed_links", r"WITH " + NOTES + r" SELECT doc_id, md5(regexp_replace(body, '(?i)\[\[\s*Harbour Ledger\s*(#[^\[\]|\n]*)?(\|[^\[\]\n]*)?\]\]', '[[Tide Ledger\1\2]]', 'g')) AS md5 FROM n WHERE regexp_matches(body, '(?i)\[\[\s*Harbour Ledger\s*(#[^\[\]|\n]*)?(\|[^\[\]\n]*)?\]\]')")
def _(s, d):
    return lifecycle.renamed_links(latest_notes(s, d, "body"), "Harbour Ledger", "Tide Ledger").select("doc_id", F.md5("body").alias("md5"))


@query("conversation_history", "SELECT conv_id, turn_id, count(*) OVER (PARTITION BY conv_id ORDER BY turn, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM (SELECT DISTINCT conv_id, turn_id, turn FROM chat_turns)")
def _(s, d):
    t = read_table(s, d, "chat_turns").select("conv_id", "turn_id", "turn").distinct()
    before = Window.partitionBy("conv_id").orderBy("turn", "turn_id").rowsBetween(Window.unboundedPreceding, -1)
    return t.select("conv_id", "turn_id", F.count("*").over(before).alias("earlier"))
