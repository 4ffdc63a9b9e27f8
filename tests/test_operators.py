import io
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notemesh.operators import chunking, components, context, corpus, graph, links, models, prompting, selection_bench
from notemesh.operators import retrieval as R
from notemesh.plans.skew import dictionary_join
from notemesh.sources import files, once, store

VEC = "query_id string, vec array<float>"


def test_vector_top_ties_and_zero(spark):
    data = spark.createDataFrame([("c", [1.0, 0.0]), ("b", [1.0, 0.0]), ("a", [0.0, 1.0]), ("z", [0.0, 0.0])], "chunk_id string, vec array<float>")
    got = R.vector_top(spark.createDataFrame([("q", [2.0, 0.0])], VEC), data, 3).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in got] == [("b", 1.0), ("c", 1.0), ("a", 0.0)]
    assert R.vector_top(spark.createDataFrame([], VEC), data, 3).count() == 0


def test_relevant_takes_the_first_row(spark):
    h = spark.createDataFrame([("q", 1, "a", 0.8), ("q", 2, "b", 0.61), ("q", 3, "c", 0.5), ("r", 1, "a", 0.4)], "query_id string, rank int, chunk_id string, score double")
    assert {(r.query_id, r.chunk_id) for r in R.relevant(h).collect()} == {("q", "a"), ("q", "b")}


def test_rrf_adds_repeats(spark):
    r = spark.createDataFrame([("q", "a", 1), ("q", "a", 2), ("q", "b", 1)], "query_id string, chunk_id string, rank int")
    got = {x.chunk_id: x.fused for x in R.rrf(r).collect()}
    assert got["a"] == pytest.approx(1 / 61 + 1 / 62) and got["b"] == pytest.approx(1 / 61)


def test_rerank_demotes_topical(spark):
    h = spark.createDataFrame([("q", 1, "x", 0.9, "invoice for paint"), ("q", 2, "y", 0.8, "the tide budget"), ("r", 1, "x", 0.9, "tide")], "query_id string, rank int, chunk_id string, score double, text string")
    got = {(r.query_id, r.chunk_id): r.new_rank for r in R.hybrid_rerank(h, F.array(F.lit("tide"), F.lit("budget"))).collect()}
    assert got == {("q", "y"): 1, ("q", "x"): 2, ("r", "x"): 1}


V = "chunk_id string, vec array<float>"


def test_graph_expand(spark):
    seeds = spark.createDataFrame([("q", "c1", 0.9), ("q", "c2", 0.2)], "query_id string, chunk_id string, score double")
    m = spark.createDataFrame([("c1", "e1"), ("c1", "e1"), ("c3", "e1"), ("c3", "e1"), ("c2", "e2"), ("c4", "e2"), ("c5", "e1"), ("c1", "e3"), ("c5", "e3"), ("c6", "e4"), ("c1", "e5"), ("c7", "e5"), ("c8", "e1"), (None, "e1")], "chunk_id string, entity_id string")
    e = spark.createDataFrame([("e1", "Acme"), ("e2", "Beta"), ("e3", "Acme"), ("e4", "Acme"), ("e5", None)], "id string, name string")
    q = spark.createDataFrame([("q", [1.0, 0.0])], VEC)
    c = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.0, 1.0]), ("c3", [0.0, 1.0]), ("c4", [1.0, 0.0]), ("c5", [1.0, 1.0]), ("c6", [1.0, 0.0]), ("c7", [1.0, 0.0])], V)
    got = R.graph_expand(seeds, q, c, m, e).orderBy("rank").collect()
    # one name under two ids counts once, another id of the name is no shared entity, an entity without name counts nothing; then cosine decides
    assert [(r.chunk_id, r.shared_count, r.shared_entities) for r in got] == [("c5", 1, ["Acme"]), ("c3", 1, ["Acme"]), ("c7", 0, [])]


@pytest.mark.parametrize(
    ("seeds", "more", "k", "want"),
    [([("a", 0.9), ("b", 0.8)], [], 2, ["a", "b"]), ([("a", 0.9)], [("e", 0.2)], 1, ["e"]), ([("a", 0.9)], [("a", 0.5), ("b", 0.2)], 5, ["a", "b"]), ([("a", 0.9), ("b", 0.8)], [("c", 0.3), ("d", 0.2)], 3, None)],
)
def test_graph_fusion(spark, seeds, more, k, want):
    s = spark.createDataFrame([("q", *x) for x in seeds], "query_id string, chunk_id string, score double")
    x = spark.createDataFrame([("q", c, v, i) for i, (c, v) in enumerate(more, 1)], "query_id string, chunk_id string, score double, rank int")
    got = [r.chunk_id for r in R.fuse_graph(s, x, k).orderBy("rank").collect()]
    assert got == want if want else len(got) == k


def test_graph_context(spark):
    shape = "query_id string, chunk_id string, score double, rank int"
    seeds = spark.createDataFrame([("q", "s1", 0.68, 1)], shape)
    more = spark.createDataFrame([("q", "s1", 0.4, 1), ("q", "e1", 0.21, 2), ("r", "e1", 0.2, 1)], shape)
    assert [(r.query_id, r.chunk_id, r.score) for r in R.graph_context(seeds, more).orderBy("nth").collect()] == [("q", "s1", 0.68), ("q", "e1", 0.21)]


def test_lexical_search(spark):
    c = spark.createDataFrame([("sleep#0", "melatonin regulates the circadian rhythm", [1.0, 0.0, 0.0]), ("inv#0", "Invoice ACME-9931 paid in full", [0.0, 1.0, 0.0]), ("spend#0", "we spend the weekend offsite", [0.0, 0.0, 1.0]), ("vn#0", "ngân sách cho chuyến đi Kyoto", [0.5, 0.5, 0.0]), ("z", "acme", [0.9, 0.1, 0.0]), ("null", None, [1.0, 0.0, 0.0])], "chunk_id string, text string, vec array<float>")
    find = lambda t: [r.chunk_id for r in R.lexical_top(spark.createDataFrame([("q", t, [1.0, 0.0, 0.0])], "query_id string, text string, vec array<float>"), c).orderBy("rank").collect()]
    assert find("Acme 9931") == ["inv#0", "z"] and find("acme") == ["z", "inv#0"] and find("end") == [] and find("ngan sach") == ["vn#0"] and find("the") == []


def small_blocks(spark, monkeypatch):
    """Blocks of a few rows; the list gets the number of rows of each table that is dealt."""
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    monkeypatch.setattr(R, "DATA_BLOCK", 40)
    written, deal = [], R.dealt
    monkeypatch.setattr(R, "dealt", lambda df, *a: written.append(df.sparkSession.read.parquet(path := deal(df, *a)).count()) or path)
    return written


def vectors(rng, n):
    """Vectors with copies, opposites and some without length."""
    v = rng.integers(-1, 2, (n, 3)).astype(float)
    return (v + (rng.random(n) < 0.5)[:, None] * rng.standard_normal((n, 3))).tolist()


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(np.dot(a, b) / n), 10) + 0.0 if n else 0.0


def test_vector_top_over_blocks(spark, monkeypatch):
    written = small_blocks(spark, monkeypatch)
    rng = np.random.default_rng(11)
    d, q = vectors(rng, 210), vectors(rng, 30)
    rows = R.vector_top(spark.createDataFrame([(i, v) for i, v in enumerate(q)], "query_id long, vec array<double>"), spark.createDataFrame([(f"c{i:03d}", v) for i, v in enumerate(d)], "chunk_id string, vec array<double>"), 5).collect()
    want = {i: [c for _, c in sorted((-cosine(v, w), f"c{j:03d}") for j, w in enumerate(d))[:5]] for i, v in enumerate(q)}
    got = {i: [r.chunk_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == i] for i in want}
    assert got == want
    assert written == [30, 210]  # each side is stored once, however many blocks it meets


def test_shared_top_over_blocks(spark, monkeypatch):
    written = small_blocks(spark, monkeypatch)
    rng = np.random.default_rng(12)
    d, q = vectors(rng, 210), vectors(rng, 30)
    have = [sorted({int(x) for x in rng.zipf(1.4, 6) if x < 30}) for _ in d]
    ask = [(sorted({int(x) for x in rng.zipf(1.3, 6) if x < 30}), [f"c{j:03d}" for j in rng.integers(0, 210, 2)]) for _ in q]
    ask = [(s, rng.permutation(range(1, len(s) + 1)).tolist() if i % 3 else rng.integers(0, 4, len(s)).tolist(), skip) for i, (s, skip) in enumerate(ask)]
    left = spark.createDataFrame([(i, v, *a) for i, (v, a) in enumerate(zip(q, ask))], "query_id long, vec array<double>, signs array<long>, labels array<long>, skip array<string>")
    right = spark.createDataFrame([(f"c{j:03d}", v, s) for j, (v, s) in enumerate(zip(d, have))], "chunk_id string, vec array<double>, signs array<long>")
    rows = R.shared_top(left, right, 5).collect()
    for i, (v, (signs, labels, skip)) in enumerate(zip(q, ask)):
        met = [(j, {x for s, x in zip(signs, labels) if s in have[j]}) for j in range(len(d)) if f"c{j:03d}" not in skip]
        want = sorted((-len(x - {0}), -cosine(v, d[j]), f"c{j:03d}") for j, x in met if x)[:5]
        assert [(-r.shared_count, r.chunk_id) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == i] == [(n, c) for n, _, c in want]
    assert written == [30, 210]


def test_hybrid_search_over_blocks(spark, monkeypatch):
    written = small_blocks(spark, monkeypatch)
    rng = np.random.default_rng(13)
    d, q = vectors(rng, 210), vectors(rng, 20)
    texts = [" ".join(rng.choice(["aa", "ab", "b", "é", "x"], 5)) for _ in d]
    terms = [rng.choice(["aa", "b", "e", "x", "zz", "b x"], 2).tolist() for _ in q]
    left = spark.createDataFrame([(i, v, t) for i, (v, t) in enumerate(zip(q, terms))], "query_id long, vec array<double>, terms array<string>")
    rows = R.hybrid_search(left, spark.createDataFrame([(f"c{j:03d}", v, t) for j, (v, t) in enumerate(zip(d, texts))], "chunk_id string, vec array<double>, text string"), 4, 10).collect()
    for i, v in enumerate(q):
        lex = [sum(t.replace("é", "e").count(w) for w in terms[i]) for t in texts]
        fused = dict.fromkeys(range(len(d)), 0.0)
        for order in (sorted(fused, key=lambda j: (-cosine(v, d[j]), j)), sorted((j for j in fused if lex[j]), key=lambda j: (-lex[j], j))):
            for n, j in enumerate(order, 1):
                fused[j] += 1 / (10 + n)
        assert [r.chunk_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == i] == [f"c{j:03d}" for j in sorted(fused, key=lambda j: (-round(fused[j], 12), j))[:4]]
    assert written == [20, 210, 20, 210]


def test_hybrid_search_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(f"c{i:03d}", rng.standard_normal(4).tolist(), " ".join(rng.choice(["aa", "ab", "b", "é", "x"], 6))) for i in range(120)]
    q = spark.createDataFrame([("q", [1.0, 0.5, 0.0, 0.0], ["aa", "É", ""]), ("r", [0.0, 1.0, 0.0, 0.0], ["zzz"])], "query_id string, vec array<double>, terms array<string>")
    got = R.hybrid_search(q, spark.createDataFrame(rows, "chunk_id string, vec array<double>, text string"), 4, 10).toPandas().sort_values("rank")
    for qid, vec, terms in (("q", [1.0, 0.5, 0, 0], ["aa", "é"]), ("r", [0, 1.0, 0, 0], ["zzz"])):
        cos = {c: round(float(np.dot(v, vec) / np.linalg.norm(v) / np.linalg.norm(vec)), 10) for c, v, _ in rows}
        lex = {c: sum(t.count(w) for w in terms) for c, _, t in rows}
        fused = dict.fromkeys(cos, 0.0)
        for order in (sorted(cos, key=lambda c: (-cos[c], c)), sorted((c for c in lex if lex[c]), key=lambda c: (-lex[c], c))):
            for i, c in enumerate(order, 1):
                fused[c] += 1 / (10 + i)
        assert got.loc[got["query_id"] == qid, "chunk_id"].tolist() == sorted(fused, key=lambda c: (-round(fused[c], 12), c))[:4]


def test_anchor_documents(spark):
    e = spark.createDataFrame([("h", "Project Harmony"), ("y", "Yamaha"), ("g", "Globex Industries"), ("f", "Project Falcon"), ("n", None)], "id string, name string")
    m = spark.createDataFrame([("h", "budget"), ("h", "competition"), ("y", "competition"), ("y", "poc"), ("g", "globex"), ("f", "falcon"), ("n", "x")], "entity_id string, doc_id string")
    ask = lambda t: {r.doc_id for r in R.anchor_docs(spark.createDataFrame([("q", t)], "query_id string, text string"), e, m).collect()}
    assert ask("How do I de-risk the Project Harmony budget?") == ask("what is the harmony budget") == {"budget", "competition", "poc"}
    assert ask("summarize the open risks") == ask("the project") == set()


def test_anchor_documents_of_like_questions_are_made_once(spark, monkeypatch):
    asked, spread = [], R.spread
    monkeypatch.setattr(R, "spread", lambda a, p: asked.append(a.count()) or spread(a, p))
    names = ["Alder", "Birch", "Cedar"]
    e = spark.createDataFrame([(n[0], n) for n in names], "id string, name string")
    m = [("A", "d1"), ("A", "d1"), ("B", "d1"), ("B", "d2"), ("C", "d3")] + [("B", f"h{i}") for i in range(50)]
    q = spark.createDataFrame([(i, f"what of {names[i % 3]}") for i in range(12)], "query_id long, text string")
    got = [tuple(r) for r in R.anchor_docs(q, e, spark.createDataFrame(m, "entity_id string, doc_id string")).collect()]
    both = {"d1", "d2", *(f"h{i}" for i in range(50))}
    assert len(got) == len(set(got)) and set(got) == {(i, d) for i in range(12) for d in ({"d3"} if i % 3 == 2 else both)}
    assert asked == [3]


def test_subjects(spark):
    q = spark.createDataFrame([(1, "Who is Ngọc Anh?"), (2, "Is Project Harmony with Jane Roe?"), (3, "What Does Everybody Think About This Now"), (4, None)], "query_id long, text string")
    assert {(r.query_id, r.subject) for r in R.named_subjects(q).collect()} == {(1, "Ngọc Anh"), (2, "Is Project Harmony"), (2, "Jane Roe")}
    said = spark.createDataFrame([(1, "nothing"), (2, None)], "query_id long, text string")
    names = spark.createDataFrame([("Harmony",), (None,), ("an",)], "name string")
    assert {r.query_id for r in R.ungrounded_subjects(q, said, names).collect()} == {1}
    assert R.ungrounded_subjects(q, spark.createDataFrame([(1, "say NGOC ANH here")], "query_id long, text string"), names).count() == 0


def test_reach_and_components(spark):
    rel = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "a"), (None, "a")], "source_id string, target_id string")
    s = spark.createDataFrame([("a",)], "start string")
    assert {(r.node, r.hop) for r in graph.reach(s, rel).collect()} == {("b", 1), ("c", 2)}
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (4, 4)], "a long, b long")
    assert {(r.node, r.component) for r in components.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def hubs(spark):
    """Relations with two hubs, loops, copies and nulls."""
    rng = np.random.default_rng(5)
    e = [(f"n{a:03d}", f"n{b:03d}", str(t)) for a, b, t in rng.integers(0, [300, 300, 3], (260, 3)).tolist()]
    e += [("n150", f"n{b:03d}", "h") for b in range(0, 300, 2)] + [(f"n{b:03d}", "n007", "g") for b in range(0, 300, 5)] + [(None, "n001", "x"), ("n002", None, "x"), ("n003", "n003", "loop"), ("n150", "n000", "h")]
    rel = spark.createDataFrame(e, "source_id string, target_id string, type string")
    near: dict[str, set[str]] = {}
    for a, b, _ in e:
        for x, y in ((a, b), (b, a)):
            if x is not None and y is not None:
                near.setdefault(x, set()).update({y} - {x})
    return e, rel, near


def test_reach_equals_brute_force_at_hubs(spark, monkeypatch):
    _, rel, near = hubs(spark)
    made = []
    monkeypatch.setattr(graph, "materialize", lambda df, name: made.append((name, out := df.localCheckpoint())) or out)
    starts = spark.createDataFrame([(x,) for x in near], "start string")
    for most, hops in ((10, 2), (24, 3), (None, 2)):
        want = set()
        for s in near:
            hop, front = {s: 0}, {s}
            for h in range(1, hops + 1):
                front = {y for x in front for y in near[x]} - set(hop)
                hop |= dict.fromkeys(front, h)
            want |= {(s, n, h) for n, h in sorted(((n, h) for n, h in hop.items() if h), key=lambda x: (x[1], x[0]))[:most]}
        assert {tuple(r) for r in graph.reach(starts, rel, hops, most).select("start", "node", "hop").collect()} == want
    # a step keeps what can be among the nearest; all paths over the hubs would be some 28,000
    assert max(df.count() for name, df in made[:3] if name == "seen") < 9_000


def test_entity_graph_equals_brute_force_at_hubs(spark, monkeypatch):
    e, rel, near = hubs(spark)
    made = {}
    monkeypatch.setattr(graph, "materialize", lambda df, name: made.setdefault(name, df.localCheckpoint()) if name in ("near",) else df.localCheckpoint())
    starts = spark.createDataFrame([(x,) for x in near], "start string")
    want = set()
    for s in near:
        two = sorted({y for x in near[s] for y in near[x]} - near[s] - {s})
        own = {s, *[*sorted(near[s]), *two][:12]}
        want |= {(s, a, b, t) for a, b, t in e if a in own and b in own}
    got = [tuple(r) for r in graph.entity_graph(starts, rel, 12).collect()]
    assert set(got) == want and len(got) == len(want)
    assert made["near"].count() <= 13 * len(near)


@pytest.mark.parametrize("times", [0, 10**6])
def test_expand_by_entities_in_blocks(spark, monkeypatch, times):
    monkeypatch.setattr(graph, "MANY_TIMES", times)
    rng = np.random.default_rng(2)
    m = [(f"c{c}", f"e{e}") for c, e in rng.integers(0, [400, 60], (900, 2)).tolist()] + [(f"c{c}", "hub") for c in range(0, 400, 2)] * 2 + [(None, "hub"), ("c1", None)]
    seeds = [(f"q{q}", f"c{c}") for q, c in {tuple(x) for x in rng.integers(0, [50, 500], (150, 2)).tolist()}]
    want = {}
    for q in {q for q, _ in seeds}:
        own = {c for x, c in seeds if x == q}
        of = {e for c, e in m if c in own and e}
        for c, e in m:
            if c and e in of and c not in own:
                want[q, c] = want.get((q, c), 0) + 1
    got = [tuple(r) for r in graph.expand_by_entities(spark.createDataFrame(seeds, "query_id string, chunk_id string"), spark.createDataFrame(m, "chunk_id string, entity_id string")).collect()]
    assert {(q, c): n for q, c, n in got} == want and len(got) == len(want) > 2_000


def test_heuristic_extraction():
    names, pairs = graph.heuristic("Met Jane Smith in Hanoi. The plan is set. Hanoi likes Jane Smith. [[Project X]]")
    assert ("Jane Smith", 2) in names and ("Hanoi", 2) in names and ("Project X", 1) in names
    assert all(n != "The" for n, _ in names)
    assert ("Hanoi", "Jane Smith", 2) in pairs
    assert graph.heuristic(None) == ([], [])


def test_last_write_and_changes(spark):
    e = spark.createDataFrame([("x", "A", "t", ["A"], 1), ("x", "B", None, None, 2)], "id string, name string, type string, aliases array<string>, at int")
    assert [tuple(r) for r in graph.last_write(e, "at").collect()] == [("x", "B", None, None)]
    n = spark.createDataFrame([("d", "text"), ("e", None)], "doc_id string, body string")
    first = graph.changed_docs(n, spark.createDataFrame([], "doc_id string, hash string"))
    assert first.count() == 2
    meta = first.select("doc_id", F.concat(F.lit("h:"), "hash").alias("hash"))
    assert graph.changed_docs(n, meta).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["one", "two.", "three\n", "\n\n", "\n## head", " ", "four"]), max_size=60))
def test_chunks_are_slices(parts):
    text = " ".join(parts)
    got = chunking.chunk(text, 7, 2)
    assert all(text[a:b] == t for _, t, _, a, b in got)
    covered = set()
    for _, _, _, a, b in got:
        covered |= set(range(a, b))
    assert all(i in covered or text[i].isspace() or not text.strip() for i in range(len(text)))


def test_chunk_sizes():
    text = " ".join(f"word{i} more text." for i in range(5))
    assert [c[0] for c in chunking.chunk(text, 7, 2)] == list(range(len(chunking.chunk(text, 7, 2))))
    assert chunking.chunk(None) == [] and chunking.chunk("  ") == []
    with pytest.raises(ValueError):
        chunking.chunk("a b", 512)


def test_sections(spark):
    notes = spark.createDataFrame([("d", "intro\n# One\ntext\n## Two\nmore")], "doc_id string, body string")
    ch = spark.createDataFrame([("c0", "d", 0), ("c1", "d", 6), ("c2", "d", 25)], "chunk_id string, doc_id string, char_start int")
    assert {r.chunk_id: r.heading for r in chunking.section_of(ch, chunking.headings(notes)).collect()} == {"c0": None, "c1": "One", "c2": "Two"}


def test_embed(spark):
    v = np.array(chunking.embed(spark.createDataFrame([("tide table",), (None,)], "text string"), 16).collect()[0]["embedding"])
    assert np.linalg.norm(v) == pytest.approx(1.0)


def cand(rows):
    return [("q", f"{d}#{s}", d, s, t, sc, g, n, p, len((t or "").split())) for d, s, t, sc, g, n, p in rows]


SHAPE = "query_id string, chunk_id string, doc_id string, seq int, text string, score double, graph_connected boolean, shared_count int, pinned boolean, tokens int"


def test_select_context(spark):
    rows = cand([("a", 0, "one two three four", 0.9, False, 0, False), ("b", 0, "one two three four", 0.8, False, 0, False), ("c", 0, "five six seven eight nine ten", 0.7, False, 0, False), ("d", 0, "graph only", 0.1, True, 2, False), ("e", 0, "low", 0.1, False, 0, False), ("p", 0, "pinned text here that is long enough", 0.0, False, 0, True)])
    got = [r.doc_id for r in context.select_context(spark.createDataFrame(rows, SHAPE), 13).collect()]
    assert got == ["a", "d", "p"]  # b repeats a, c exceeds the budget, d still fits, e is under the floor


def test_compile_is_stable(spark):
    rows = [("d<1>", 1, None, "b & c"), ("d<1>", 0, 3, "a"), ("d<1>", 0, 3, "a")]
    one = context.compile_xml(spark.createDataFrame(rows, "doc_id string, seq int, page int, text string")).first()["xml"]
    two = context.compile_xml(spark.createDataFrame(rows[::-1], "doc_id string, seq int, page int, text string")).first()["xml"]
    assert one == two and '<chunk seq="0" page="3">a</chunk>' in one and "b &amp; c" in one and 'path="d&lt;1&gt;"' in one


def test_citations(spark):
    t = spark.createDataFrame([(1, "ä [#2][#3] b [1, 4] [#99999999999]"), (2, None)], "turn_id long, answer string")
    rows = context.citations(t)
    assert [(r.nth, r.ref, r.start, r.end) for r in rows.orderBy("nth").collect()] == [(1, 2, 2, 6), (2, 3, 6, 10), (3, None, 20, 34)]
    sources = spark.createDataFrame([(1, 2, "c#0")], "turn_id long, ref int, chunk_id string")
    assert [tuple(r) for r in context.citation_usage(context.resolve_citations(rows, sources)).collect()] == [(1, 1, 2)]
    assert context.split_reasoning("<think>x</think>y<think>z") == ("x\nz", "y")


def test_selection_bench(spark):
    """The published scores, exactly."""
    got = {r.strategy: (r.recall, r.precision, r.f1) for r in selection_bench.published(spark).collect()}
    assert got == {"raw": (1.0, 0.333, 0.5), "naive": (0.625, 0.625, 0.625), "compiled": (1.0, 1.0, 1.0)}


def test_selection_details(spark):
    assert context.text_similarity("One, two three four.", "one two three four") == 1.0 and context.text_similarity("?!", " ?! ") == 1.0 and context.text_similarity("", "a") == 0.0
    rows = cand([("a", 10, "x one two", 0.5, False, 0, False), ("a", 2, "y three four", 0.5, False, 0, False), ("b", 0, "z five six", 0.1, True, 1, False), ("c", 0, "w seven eight", 0.2, True, 1, False), ("d", 0, "pin nine ten", None, None, None, True), ("e", 0, None, 0.9, None, None, None)])
    placed = context.usefulness(spark.createDataFrame(rows, SHAPE)).orderBy("place").collect()
    assert [(r.doc_id, r.seq, r.tier) for r in placed] == [("d", 0, 0), ("e", 0, 1), ("a", 2, 1), ("a", 10, 1), ("c", 0, 2), ("b", 0, 2)]
    fates = context.judged(spark.createDataFrame(rows, SHAPE), 6)
    assert {r.chunk_id: r.fate for r in fates.collect()} == {"d#0": "kept", "e#0": "kept", "a#2": "kept", "a#10": "budget", "c#0": "budget", "b#0": "budget"}
    assert [tuple(r) for r in context.selection_counts(fates).collect()] == [("q", 3, 6, 3, 0)]


def test_corpus(spark):
    n = spark.createDataFrame([("a/x.md", "X", ["ex"], "see [[Y]] and [[why|w]] #t", {"tags": "a, #B"}), ("a/b/y.md", "Y", ["why"], "[[X]] [[Y]]", None)], "doc_id string, title string, aliases array<string>, body string, frontmatter map<string,string>")
    assert {(r.tag, r.notes) for r in corpus.tag_index(n).collect()} == {("a", 1), ("b", 1), ("t", 1)}
    assert {(r.folder, r.notes) for r in corpus.folders(n).collect()} == {("a", 2), ("a/b", 1)}
    assert {(r.target, r.source, r.links) for r in corpus.backlinks(n, corpus.title_index(n)).collect()} == {("a/b/y.md", "a/x.md", 2), ("a/x.md", "a/b/y.md", 1)}
    assert corpus.fuzzy_score("rf", "Roof") is not None and corpus.fuzzy_score("zz", "Roof") is None
    free = corpus.first_free(n.select("doc_id", F.lit("n.md").alias("path")), spark.createDataFrame([("n.md",)], "path string"))
    assert {r.path for r in free.collect()} == {"n-2.md", "n-3.md"}
    want = spark.createDataFrame([("1", "a.md"), ("2", "a.md"), ("3", "a.md"), ("4", "a-4.md"), ("5", "b.md")], "doc_id string, path string")
    free = corpus.first_free(want, spark.createDataFrame([("a-2.md",), ("a.md",), ("c.md",), (None,)], "path string"))
    assert {r.doc_id: r.path for r in free.collect()} == {"1": "a-3.md", "2": "a-5.md", "3": "a-6.md", "4": "a-4.md", "5": "b.md"}
    tagged = n.select("doc_id", "body", "frontmatter")
    assert [r.doc_id for r in corpus.scope_docs(tagged, "tag", "#B").collect()] == ["a/x.md"] and corpus.in_scope(n, None).count() == 2
    assert corpus.in_scope(n, corpus.scope_docs(tagged, "folder", "a/b/")).count() == 1 and corpus.scope_label("tag", "#Client/A") == "#client/a"
    c = spark.createDataFrame([("b", "b", "b"), ("b", "m", "b"), ("b", "b", "t"), ("b", "m", "t"), ("b", "m", "m"), (None, None, "t")], "base string, mine string, theirs string")
    assert [r.decision for r in corpus.edit_conflict(c).collect()] == ["noop", "save", "reload", "conflict", "noop", "reload"]


def test_links(spark):
    index = {"machine learning": ("ml", "Machine Learning"), "machine": ("m", "Machine")}
    pat = links.surface_pattern(list(index))
    text = "Machine learning, `machine` [[machine]] and machines; a machine."
    got = links.weave(text, pat, index)
    assert "".join(s for s, _ in got) == text and [t for _, t in got if t] == ["ml", "m"]
    assert links.rewrite_title("[[Old#h|x]] [[Older]]", "old", "New") == "[[New#h|x]] [[Older]]"
    assert links.resolve_refs("[a.md#2] [#1] [#9]", {"a.md"}, ["c#0"]) == [("a.md#2", True), ("c#0", True), (None, False)]


@pytest.mark.parametrize("block", [200_000, 7])
def test_woven_links_equal_weave_over_all_titles(spark, monkeypatch, block):
    monkeypatch.setattr(links, "SURFACE_BLOCK", block)
    rng = np.random.default_rng(3)
    word = ["the", "The", "an", "đan", "roof", "`roof`", "[[the roof]]", "cost", "x-ray", "İ", "\n\n", "roof.", "the  roof", "[an](roof)"]
    index = {"the roof": ("t1", ""), "the": ("t2", ""), "roof cost": ("t3", ""), "an": ("t4", ""), "the roof the": ("t5", ""), "x-ray": ("t6", ""), "cost the roof": ("n0", ""), "ray": ("n1", "")}
    index |= {f"the title {i}": (f"u{i}", "") for i in range(40)}
    notes = [(f"n{i}", " ".join(rng.choice(word, 25))) for i in range(40)] + [("n98", ""), ("n99", None)]
    got = {tuple(r) for r in links.woven_links(spark.createDataFrame(notes, "doc_id string, body string"), spark.createDataFrame([(s, d) for s, (d, _) in index.items()], "surface string, doc_id string")).collect()}
    want = set()
    for doc, body in notes[:-1]:
        own = {s: x for s, x in index.items() if x[0] != doc}
        want |= {(doc, i, s, t) for i, (s, t) in enumerate(links.weave(body, links.surface_pattern(list(own)), own)) if t}
    assert got == want and len(want) > 100


def test_unlinked_mentions_count_beside_other_letters(spark):
    notes = spark.createDataFrame([("a", "đan an [[an]] can an"), ("b", "an")], "doc_id string, body string")
    got = links.unlinked_mentions(notes, spark.createDataFrame([("an", "b")], "surface string, doc_id string"))
    assert [tuple(r) for r in got.collect()] == [("b", "a", 3)]
    only = spark.createDataFrame([("a", "đan")], "doc_id string, body string")  # no word of its own
    assert [tuple(r) for r in links.unlinked_mentions(only, spark.createDataFrame([("an", "b")], "surface string, doc_id string")).collect()] == [("b", "a", 1)]


def test_prompting():
    hits = [{"chunk_id": "a", "doc_id": "d", "page": 2, "text": "one two three"}, {"chunk_id": "b", "doc_id": "d", "page": None, "text": "one two three"}, {"chunk_id": "c", "doc_id": "e", "page": None, "text": "four five six seven"}]
    msg, order = prompting.assemble("why?", hits, 100)
    assert order == ["a", "c"] and "[#1] (source: d, p.2)" in msg
    assert prompting.assemble("q", [], 10) == (None, [])
    assert prompting.assemble("q", hits[2:], 5)[1] == ["c"]
    assert prompting.strip_echo("# Question x\n# Answer\nyes") == "yes"
    assert [m[0] for m in prompting.messages("u", [("q", "a")])] == ["system", "user", "assistant", "user"]


def test_models(spark):
    raw = 'Sure: {"entities":[{"name":"Acme","type":"org"},{"name":"acme"},{"name":"Jane","type":"alien"}],"relations":[{"source":"jane","target":"Acme","type":"Works At","confidence":3},{"source":"x","target":"Acme"}]} ok'
    assert models.read_extraction(raw) == ([("Acme", "org"), ("Jane", "other")], [("Jane", "Acme", "works_at", 1.0)])
    assert models.read_extraction("no") is None
    assert models.plan_batches([5, 5, 5], 10, 6) == [[0, 1], [2]] and models.plan_batches([50, 1], 10) == [[0], [1]]
    got = models.extract_with(spark.createDataFrame([("d", "text"), ("e", None)], "doc_id string, body string"), lambda t: raw)
    assert got.where("kind = 'entity'").count() == 2
    log = []
    done = models.run_ingestion({"id": 1, "state": "queued"}, {}, lambda d: log.append(d["state"]))
    assert done["state"] == "indexed" and log[-1] == "indexed"
    bad = models.run_ingestion({"id": 1, "state": "queued"}, {"chunked": lambda d: 1 / 0}, lambda d: None)
    assert bad["state"] == "failed" and models.retry(bad)["state"] == "queued"
    assert models.expand_template("{{ a }} {{b}}", {"a": "1"}) == "1 {{b}}"


def test_csv_and_notes():
    assert files.parse_csv('﻿a,"b ""x"", c"\r\n1,\n') == [["a", 'b "x", c'], ["1", ""]]
    assert files.csv_markdown([["a", "b"], ["1|2"]]) == "| a | b |\n| --- | --- |\n| 1\\|2 |  |"
    fm, body = files.parse_note("---\ntags: [a, b]\nlist:\n  - x\n  - y\n---\n\nbody")
    assert fm == {"tags": "a, b", "list": "x, y"} and body == "body"
    assert files.parse_note("plain") == ({}, "plain")
    assert files.parse_note(files.serialize_note({"k": "v"}, "b"))[1] == "b"


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.from_regex(r"\A[a-z]{1,6}\Z"), st.text("ab \"'\\\n:#[],-é", min_size=1, max_size=12), max_size=4), st.text("a\n-: ", max_size=20))
def test_notes_round_trip(frontmatter, body):
    got = files.parse_note(files.serialize_note(frontmatter, "x" + body))
    assert got == (frontmatter, "x" + body)


def test_csv_linear_and_lists():
    assert files.csv_linear("DoanhThu_trieu,Q\n1|2,\n,\n") == "| DoanhThu_trieu | Q |\n| --- | --- |\n| 1\\|2 |  |\n|  |  |\n\n## Dữ liệu theo dòng\n\n- Doanh Thu trieu: 1\\|2"
    assert files.csv_linear("a,b") == files.csv_markdown([["a", "b"]]) and files.csv_linear("") == ""
    assert files.inline_list('[a, "b, c", \'d\', ]') == ["a", "b, c", "d"] and files.scalar('"a\\"b"') == 'a"b'


def test_vault_files_and_updates(spark):
    from notemesh.operators import lifecycle

    shape = "doc_id string, title string, body string, frontmatter map<string,string>"
    n = spark.createDataFrame([("a.md", "A", "old", {"tags": "x", "hash": "h"}), ("b.md", "B", "[[A]]", None), ("c.md", None, None, None)], shape)
    entries = files.vault_files(n, spark.createDataFrame([(1, "**user:**")], "conv_id int, markdown string"))
    got = {r.path: r.content for r in entries.collect()}
    assert got == {"a.md": "---\nhash: h\ntags: x\n---\n\nold", "b.md": "[[A]]", "c.md": "", "chats/1.md": "---\ntype: chat\nid: 1\n---\n\n**user:**"}
    e = spark.createDataFrame([("a.md", None, "new"), ("z.md", "Z", "z")], "doc_id string, title string, body string")
    out = {r.doc_id: r for r in lifecycle.updated(n, e, "now").collect()}
    assert set(out) == {"a.md", "b.md", "c.md"} and (out["a.md"].title, out["a.md"].body) == ("A", "new") and out["b.md"].frontmatter is None
    assert {k: v for k, v in out["a.md"].frontmatter.items() if k != "hash"} == {"tags": "x", "updated": "now"} and out["a.md"].frontmatter["hash"].startswith("sha256:")
    assert {(r.doc_id, r.title, r.body) for r in lifecycle.renamed(n, "a.md", "A", "New").collect()} == {("a.md", "New", "old"), ("b.md", "B", "[[New]]"), ("c.md", None, None)}
    assert "Vietnamese" in prompting.system_prompt("reason", "Vietnamese", ["Jane"]) and "'Jane'" in prompting.system_prompt(absent=["Jane"]) and prompting.system_prompt() == prompting.SYSTEM
    with pytest.raises(ValueError):
        prompting.system_prompt("guess")


def test_intake_and_archives(spark, tmp_path):
    for name, data in {"a.md": b"# hi", "b.txt": b"\xff\xfe\xfa", "c.exe": b"x", "d.pdf": b"%PDF"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.reason, r.text) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.md"] == ("ok", None, "# hi") and got["b.txt"][:2] == ("failed", "not_utf8") and got["c.exe"][0] == "skipped" and got["d.pdf"] == ("ok", None, None)
    z = files.vault_zip([("n/b.md", b"b"), ("a.bin", b"1")])
    assert z == files.vault_zip([("a.bin", b"1"), ("n/b.md", b"b")]) and zipfile.ZipFile(io.BytesIO(z)).namelist() == ["a.bin", "n/b.md"]
    rows = files.vault_entries(spark.createDataFrame([("v.zip", bytearray(z))], "path string, content binary")).collect()
    assert {(r.path, r.kind) for r in rows} == {("a.bin", "original"), ("n/b.md", "note")}


def test_store_and_stream(spark, tmp_path):
    from notemesh.streaming import index_queue

    s = store.Store(spark, str(tmp_path / "store"))
    a = spark.createDataFrame([("k", 1), ("l", 2)], "id string, v int")
    s.upsert("t", a, ["id"])
    s.upsert("t", spark.createDataFrame([("k", 3)], "id string, v int"), ["id"])
    assert {tuple(r) for r in s.read("t").collect()} == {("k", 3), ("l", 2)}
    s.delete("t", spark.createDataFrame([("l",)], "id string"), "id")
    assert s.read("t").count() == 1 and s.read("none") is None
    src = tmp_path / "in"
    notes = spark.createDataFrame([("n.md", "Ask Jane Smith of Acme Works. We saw Jane Smith there."), ("m.md", None)], "doc_id string, body string")
    notes.write.parquet(str(src))
    for _ in range(2):
        index_queue.start(spark.readStream.schema(notes.schema).parquet(str(src)), s, str(tmp_path / "cp")).awaitTermination()
    assert s.read("chunks").count() == 1 and s.read("graph_meta").count() == 2
    assert s.read("mentions").where("entity_id = 'jane_smith'").count() == 1
    index_queue.index_batch(s, notes)  # a repeated batch changes nothing
    assert s.read("chunks").count() == 1


def test_once_and_skew(spark):
    rows = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), (None, "x", 3)], "k string, v string, at int")
    assert [tuple(r) for r in once(rows, ["k"], ["v"], newest="at").collect()] == [("k", "b")]
    facts = spark.createDataFrame([(i, "hot" if i % 3 else "cold") for i in range(30)], "i int, w string")
    words = spark.createDataFrame([("hot", 1), ("cold", 2)], "w string, id int")
    counted = words.withColumn("n", F.when(F.col("w") == "hot", 20).otherwise(10))
    want = sorted((i, "hot" if i % 3 else "cold", 1 if i % 3 else 2) for i in range(30))
    for size, rows in ((1 << 40, 12), (1 << 40, 3), (10, 3)):
        assert sorted((r.i, r.w, r.id) for r in dictionary_join(facts, counted, "w", size, "n", rows).collect()) == want
    assert dictionary_join(facts, words, "w", 10).count() == dictionary_join(facts, words, "w", 1 << 40).count() == 30


def test_lifecycle(spark):
    from notemesh.functions import markdown
    from notemesh.operators import lifecycle

    drafts = spark.createDataFrame([("1", "a/", "Roof!", "x"), ("2", "a", "roof", None), ("3", None, " ", "y"), ("4", None, "Roof", "z")], "draft_id string, folder string, title string, body string")
    got = {r.doc_id for r in lifecycle.created(drafts, spark.createDataFrame([("notes/roof.md",)], "path string"), "2025-01-01").collect()}
    assert got == {"a/roof.md", "a/roof-2.md", "notes/roof-2.md"}
    notes = spark.createDataFrame([("a/x.md", "[[Old t#h|d]] [[Older]]"), ("b/x.md", None), ("ab/y.md", "")], "doc_id string, body string")
    assert {tuple(r) for r in lifecycle.moved(notes, "a", "b").collect()} == {("a/x.md", "b/x-2.md")}
    assert [tuple(r) for r in lifecycle.renamed_links(notes, "old T", "New$").collect()] == [("a/x.md", "[[New$#h|d]] [[Older]]")]
    e = spark.createDataFrame([("x", "Acme (UK)", ["Acme", None])], "id string, name string, aliases array<string>")
    p = {r.surface: r.pattern for r in lifecycle.entity_patterns(e).collect()}
    assert set(p) == {"Acme (UK)", "Acme"}
    assert spark.createDataFrame([("Acme Acmeé",)], "t string").select(F.regexp_count("t", F.lit(p["Acme"])).alias("n")).first()["n"] == 1
    m = spark.createDataFrame([("big-2", 10), ("big", 5)], "model_id string, window_tokens int")
    want = spark.createDataFrame([("BIG-2-2025",), ("big",), ("none",)], "model string")
    assert {r.model: r.window_tokens for r in lifecycle.model_profiles(m, want).collect()} == {"BIG-2-2025": 10, "big": 5, "none": None}
    assert markdown.render("# A\n- x **b**\n\n<script> [l](javascript:x)") == "<h1>A</h1>\n<ul><li>x <strong>b</strong></li></ul>\n<p>&lt;script&gt; l</p>"
    assert markdown.render(None) is None
