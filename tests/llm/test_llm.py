import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notemesh.llm import language, markup, names, neardup, neighbours, packing, pairs, pii, residue, tokenize

HIT = "kind string, key string, scope string, item string, text string, at timestamp"


def rows_of(spark, rows):
    return spark.createDataFrame([(k, key, s, i, t, None) for k, key, s, i, t in rows], HIT)


# --- 8 -----------------------------------------------------------------------------------------------------------------------


def test_token_ids_round_trip(spark):
    texts = ["The tide's out, they've 12 bells.", "", None, "  \n\t ", "Đà Nẵng – été 🧵\u00a0x\u3000y", "a" * 5000, "<|endoftext|>", "the the the", "\r\n  x\n\n\ny "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("word", F.lit(1))
    got = {r.doc_id: list(r.ids) for r in tokenize.token_ids(docs, "doc_id", "text").collect()}
    tok = tokenize.load_tokenizer(f"{tokenize.TOKENIZER_DIR}/{tokenize.BYTE_BPE}")
    assert got == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    back = tokenize.decode(spark.createDataFrame([(k, v) for k, v in got.items()], "doc_id long, ids array<int>"), "doc_id", spark)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    sizes = {r.doc_id: r.tokens for r in tokenize.token_counts(docs, "doc_id", "text").collect()}
    assert sizes == {k: len(v) for k, v in got.items()}
    assert tokenize.token_ids(docs.limit(0), "doc_id", "text").count() == 0
    # copies of a key give one row, and an unlike copy doesn't add to it
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "x"), (2, None), (3, "  "), (3, "  ")], "doc_id long, text string")
    got = tokenize.token_ids(twice, "doc_id", "text").collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: tok.encode(t, add_special_tokens=False).ids for i, t in ((1, "a b"), (2, "x"), (3, "  "))} and len(got) == 3


def test_token_ids_with_a_large_dictionary(spark, monkeypatch):
    from notemesh.plans import skew

    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(tokenize, "WORD_ROWS", 2)
    texts = ["the tide the the", "the ferry", "the the", "tide the", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tok = tokenize.load_tokenizer(f"{tokenize.TOKENIZER_DIR}/{tokenize.BYTE_BPE}")
    assert {r.doc_id: list(r.ids) for r in tokenize.token_ids(docs, "doc_id", "text").collect()} == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r.doc_id: r.tokens for r in tokenize.token_counts(docs, "doc_id", "text").collect()} == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


# --- 3 -----------------------------------------------------------------------------------------------------------------------


def words3(t):
    import re

    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(rows, threshold):
    out = set()
    for a in rows:
        for b in rows:
            if a[:1] == b[:1] and a[2] == b[2] and a[1] < b[1] and a[3] != b[3] and a[4] and b[4]:
                x, y = words3(a[4]), words3(b[4])
                if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                    out.add((a[0], a[1], b[1]))
    return out


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_RUN", 6)
    monkeypatch.setattr(neardup, "SMALL_SCOPE", 5)
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 40))]
        for v in range(8):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice([[], [rng.choice(vocab)], [rng.choice(vocab), t[at]]]) or [t[at]]
            rows.append(("chunks", f"k{g:02d}{v}", "", f"k{g:02d}{v}", " ".join(t)))
            rows.append(("hits", f"h{g:02d}{v}", f"q{g % 3}", f"c{v % 5}", " ".join(t)))
    rows += [("chunks", "null", "", "n", None), ("chunks", "short", "", "s", "two words"), ("chunks", "empty", "", "e", "")]
    got = {tuple(r) for r in neardup.alike(rows_of(spark, rows + rows[:7]), 0.6, 3).collect()}
    want = brute(rows, 0.6)
    assert got == want and len(want) > 100
    assert neardup.alike(rows_of(spark, rows).limit(0), 0.6, 3).count() == 0
    # classes hold what pairs link; copies are in one class
    got = {(r.kind, r.key): r.cls for r in neardup.grouped(rows_of(spark, rows + rows[:7]), 0.6, 3).collect()}
    assert len(got) == len({r[:2] for r in rows}) - 3 and all(got[k, a] == got[k, b] for k, a, b in want)
    alone = {x for x in got} - {(k, x) for k, a, b in want for x in (a, b)}
    texts = {(r[0], r[1]): r[4] for r in rows}
    assert all(got[x] != got[y] or texts[x] == texts[y] for x in alone for y in got if x != y)


def test_ordinary_runs_stay_cold_in_a_large_corpus(monkeypatch):
    """With full slots a text goes into as many tries as with empty ones."""
    monkeypatch.setattr(neardup, "RARITY_SLOTS", 8)
    monkeypatch.setattr(neardup, "HOT_RUN", 20)
    rng = np.random.default_rng(1)
    sets = [sorted(rng.integers(-(2**62), 2**62, 50).tolist()) for _ in range(200)]
    counts, limit = np.bincount(neardup.slot(np.array(sets).ravel()), minlength=8), neardup.hot_limit(10_000)
    assert counts.min() > neardup.HOT_RUN and counts.sum() == 10_000 and (counts <= limit).all()
    placed = next(neardup.place(0.6, type("T", (), {"value": (counts, limit)}))(iter([pd.DataFrame({"rec": [1], "scope": [0], "runs": [np.array(sets[0])]})])))
    assert len(placed) == 50 - 30 + 1


def test_run_counts_reach_the_driver_packed(spark, monkeypatch):
    """However many slots are in use, the driver gets a row a block, and the counts are those of all runs."""
    rng = np.random.default_rng(4)
    flat = rng.integers(-(2**62), 2**62, 40_000)
    flat[:9_000] = flat[0]
    frame = type(spark.range(1))
    got, collect, to_pandas = [], frame.collect, frame.toPandas
    monkeypatch.setattr(frame, "collect", lambda df: got.append(collect(df)) or got[-1])
    monkeypatch.setattr(frame, "toPandas", lambda df: got.append(to_pandas(df)) or got[-1])
    rows = spark.createDataFrame([(x.tolist(),) for x in flat.reshape(-1, 50)], "runs array<bigint>")
    table, limit = neardup.rarity(rows)
    assert (table == np.bincount(neardup.slot(flat), minlength=neardup.RARITY_SLOTS)).all() and limit == neardup.hot_limit(len(flat))
    assert 0 < sum(map(len, got)) <= 1024 < (table > 0).sum()
    table, limit = neardup.rarity(rows.limit(0))
    assert not table.any() and limit == neardup.HOT_RUN
    # a count beyond int32 is the largest in the table, but whole in the sum
    some = pd.DataFrame({"block": [3, 3, 5], "place": [7, 7, 0], "n": [2**31, 5, 1]})
    packed = pd.concat(neardup._blocks(iter([some[:1], some[1:]]))).set_index("block")
    assert packed["total"].to_dict() == {3: 2**31 + 5, 5: 1} and np.frombuffer(packed["counts"][3], "<i4")[7] == 2**31 - 1


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(4, 9)), min_size=1, max_size=40), st.integers(0, 2**32 - 1))
def test_trie_finds_all_pairs_in_budget(shape, seed):
    rng = np.random.default_rng(seed)
    cell = np.array(sorted(c for c, _ in shape), np.int64)
    n = np.array([s for _, s in shape], np.int64)
    sk = (rng.integers(0, 4, (len(cell), 4)) * (rng.random((len(cell), 4)) < 0.4)).astype(np.uint64)
    a, b = neardup.trie_pairs(cell, n, sk, 0.25)
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    want = set()
    for i in range(len(cell)):
        for j in range(i + 1, len(cell)):
            d = int(np.bitwise_count(sk[i] ^ sk[j]).sum())
            if cell[i] == cell[j] and d <= 0.25 * (n[i] + n[j]) and abs(n[i] - n[j]) <= 0.25 * (n[i] + n[j]):
                want.add((i, j))
    assert got == want


def test_trie_walk_is_bounded_in_one_cell(monkeypatch):
    rng = np.random.default_rng(4)
    sk = rng.integers(0, 1 << 63, (3000, 4), dtype=np.uint64)
    sk[1500:1510] = sk[:10]
    sizes, product = [], neardup._product

    def seen(*args):
        out = product(*args)
        sizes.append(len(out[0]))
        return out

    monkeypatch.setattr(neardup, "_product", seen)
    monkeypatch.setattr(neardup, "CHUNK_PAIRS", 1 << 12)
    a, b = neardup.trie_pairs(np.zeros(3000, np.int64), np.full(3000, 20, np.int64), sk, 0.25)
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())} == {(i, 1500 + i) for i in range(10)}
    assert max(sizes) <= 256 * 256  # all pairs of the cell are 4.5 million


# --- 6 -----------------------------------------------------------------------------------------------------------------------


def test_neighbours_recall_and_copies(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16))
    x = (centres[rng.integers(0, 40, 900)] + 0.15 * rng.standard_normal((900, 16))).astype(np.float32)
    x[100:112] = x[100]  # copies
    rows = [(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)] + [("null", None), ("zero", [0.0] * 16), ("nan", [float("nan")] * 16), ("short", [1.0])]
    df = spark.createDataFrame(rows + rows[:5], "key string, vec array<float>")
    got = neighbours.nearest(neighbours.usable(df, "key", "vec", 16), 5, 16).toPandas()
    assert got.groupby("key").size().eq(5).all() and got["key"].nunique() == 900
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = (u @ u.T).round(10)
    np.fill_diagonal(s, -9)
    want = {(f"v{i:04d}", f"v{j:04d}") for i, r in enumerate(np.argsort(-s, axis=1, kind="stable")[:, :5]) for j in r}
    assert len(want & set(zip(got["key"], got["neighbour"]))) >= 0.95 * len(want)
    few = neighbours.nearest(neighbours.usable(df.where("key in ('v0000', 'v0001')"), "key", "vec", 16), 5, 16)
    assert few.count() == 2
    assert neighbours.nearest(neighbours.usable(df.limit(0), "key", "vec", 16), 5, 16).count() == 0


def test_windows_grow_and_count_collisions():
    rng = np.random.default_rng(2)
    data, ask = rng.standard_normal((50, neighbours.PROJECTIONS)), rng.standard_normal((7, neighbours.PROJECTIONS))
    w = neighbours.Windows(data)
    w.ask(ask)
    for width in (0.3, 0.7, 3.0):
        w.widen(width)
        assert (w.count == (np.abs(data[None] - ask[:, None]) <= width).sum(axis=2)).all()
    w.keep(np.arange(7) > 4)
    w.widen(9.0)
    assert (w.count == neighbours.PROJECTIONS).all() and w.count.shape == (2, 50)


def test_lonely_vectors_ask_further_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 10)
    rng = np.random.default_rng(3)
    x = np.concatenate([np.eye(16)[i] + 0.01 * rng.standard_normal((n, 16)) for i, n in enumerate((30, 30, 1, 2))])
    df = spark.createDataFrame([(f"v{i:03d}", v.tolist()) for i, v in enumerate(x)], "key string, vec array<float>")
    got = neighbours.nearest(neighbours.usable(df, "key", "vec", 16), 5, 16).toPandas()
    assert got.groupby("key").size().eq(5).all() and got["key"].nunique() == len(x)


# --- 4 -----------------------------------------------------------------------------------------------------------------------


def test_edit_metric():
    assert names.edits("abcd", "abdc", 2) == 1 and names.edits("ca", "abc", 3) == 2 and names.edits("abc", "abc", 1) == 0 and names.edits("a", "xyz", 1) == 2


@settings(max_examples=80, deadline=None)
@given(*[st.text("abc", max_size=5)] * 3)
def test_edit_metric_is_a_metric(a, b, c):
    d = lambda x, y: names.edits(x, y, 20)
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, c) <= d(a, b) + d(b, c)


def test_names_are_linked(spark):
    people = ["Isabella Fakubohon", "Ms Isabella Fakubohon", "FAKUBOHON, ISABELLA", "Isabela Fakubohon", "Isabella Fakubohno", "Izzy Fakubohon", "I. Fakubohon", "Isabella Q. Faku-Bohon"]
    firm = ["Hebuzivistead Foods Ltd", "The Hebuzivistead Fds GmbH", "Foods, Hebuzivistead", "Hebuzi Vistead Foods"]
    other = ["Robert Fakubohon", "Isabella Nuledenix", "Hebuzivistead Textiles", "R. Tuvutitox", "", None, "  ", "IF"]
    every = [(f"p{i}", n, None) for i, n in enumerate(people)] + [(f"f{i}", n, []) for i, n in enumerate(firm)] + [(f"o{i}", n, [None]) for i, n in enumerate(other)]
    every += [("p8", "IF", ["Isabella Fakubohon"]), (None, "Isabella Fakubohon", None)]
    e = spark.createDataFrame(every + every[:3], "id string, name string, aliases array<string>").withColumn("grp", F.lit(0))
    got = names.link(e, {"izzy": "isabella", "bob": "robert"}).toPandas()
    groups = {frozenset(g["id"]) for _, g in got.groupby("grp") if len(g) > 1}
    assert groups == {frozenset(f"p{i}" for i in range(9)), frozenset(f"f{i}" for i in range(4))}
    assert names.link(e.limit(0), {}).count() == 0


def test_frequent_surnames_are_no_given_names(spark):
    rng = random.Random(2)
    made = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4))
    given = sorted({made() for _ in range(60)})
    every = [f"{g} Nguyen" for g in given] + [f"{g} {made()}x" for g in given for _ in range(5)]
    every += ["Isabella Nguyen", "NGUYEN, Isabella", "Izzy Nguyen", "Isabella Nguyne", "Robert Nguyen"]
    e = spark.createDataFrame([(f"{i:03d}", n, None) for i, n in enumerate(every)], "id string, name string, aliases array<string>")
    got = names.link(e, {"izzy": "isabella", "bob": "robert"}).toPandas()
    mine = set(got.loc[got["grp"] == got.set_index("id")["grp"][f"{len(every) - 5:03d}"], "id"])
    assert mine == {f"{len(every) - k:03d}" for k in (5, 4, 3, 2)}
    # in a small table, too, a given name is learnt from surnames of several families
    few = ["Karolina Bafo", "Karolina Dimu", "Karolina Gesa", "Robert Bafo", "Robert Dimu", "Robert Gesa"]
    common = names.common_tokens(spark.createDataFrame([(n,) for n in few], "name string"), frozenset({"robert"}))
    assert common == {"karolina": 3, "robert": 3}
    # a name of common words only keeps a form
    vocab = names.Vocabulary({"robert": 9, "nguyen": 30}, {"bob": "robert"})
    assert names.forms_of("Bob Nguyen", vocab) == names.forms_of("NGUYEN, Robert", vocab) == [("nguyen", "robert", "")]
    assert names.forms_of("Bob Robert", vocab) == []


# --- 10, 5, 7 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("404 Not Found\n\nopenproxy/1.2", "error_page"), ("Lỗi máy chủ 503, vui lòng thử lại sau.\nback", "error_page"), ("Seite nicht gefunden. Der Link ist veraltet.", "error_page"),
        ("Please enable JavaScript to continue.", "script_notice"), ("Menu  Sign in\nAtive o JavaScript para ver esta página.", "script_notice"), ("Lorem ipsum dolor amet velit. Lorem dolor.", "filler"),
        ("Dies ist ein Blindtext. Platzhaltertext.", "filler"), ("# <<project>>\n\nThe crew cleaned the spring budget while it rained.\n\nOwner: {Owner}", "placeholder"), ("Dear {{first_name}},\nwe met on $DATE$ about @@TITLE@@.", "placeholder"),
        ("The letter template starts with {{first_name}} and the mailer fills it in. The night shift borrowed the ledger.", None), ("We fixed the 404 on the shelf list; the route had a typo.", None),
        ('Our viewer showed "please enable JavaScript" until the cache was cleared. The crew went home early after that.', None), ("TODO: ask whether the bakery downstairs questioned the pump schedule.", None), (None, None), ("", None), (" \n", None),
    ],
)
def test_residue(text, kind):
    assert residue.kind_of(text) == kind


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Hello {{first_name}}, your order {{order_id}} ships on {{date}}.", "placeholder"), ("Dear {{name}}, thank you for the visit.", "placeholder"), ("The parcel of ${CLIENT} left on <<delivery day>> by rail.", "placeholder"),
        ("Owner: {{the full name of the person who looks after the shelf}}", "placeholder"), ("The template greets with Dear {{name}} and {{title}}.", None), ("Variables such as ${CLIENT} and ${DAY} are explained in the manual.", None),
        ("Run this:\n```\ncp ${HOME}/a ${TARGET}/b\n```\nand wait.", None), ('It opens with "Dear {{name}}", as always. The crew went home.', None), ("Lines $AB$ and $CD$ meet. The note [sic] said so [citation needed].", None),
        ("{{cite book|title=The long way round the harbour|year=2001|page=4}}", None),
    ],
)
def test_fields_inside_sentences(text, kind):
    assert residue.kind_of(text) == kind


def test_dummy_words_are_learnt_and_the_automaton_decides(spark, monkeypatch):
    rows = [f"Lorem ipsum dolor zorbu kelta amet {w}." for w in ("kelta", "zorbu", "mirta", "mirta", "mirta")] + ["Zorbu kelta mirta zorbu. Kelta zorbu mirta.", "The ledger says kelta once.", None, ""]
    docs = spark.createDataFrame(list(enumerate(rows)) + [(0, rows[0])], "doc_id long, text string").withColumn("kind", F.lit(1))
    assert residue.dummy_words(docs, "text") >= {"zorbu", "kelta", "mirta"}
    assert {tuple(r) for r in residue.classify(docs, "doc_id", "text").collect()} == {(i, "filler") for i in range(6)}
    assert residue.classify(docs.limit(0), "doc_id", "text").count() == 0
    # without the automaton nothing is found
    monkeypatch.setattr(residue, "automaton", lambda learnt: type("None", (), {"iter": lambda self, t: iter(())})())
    assert residue.kind_of("Dear {{name}}, thank you.") is None and residue.kind_of("404 Not Found") is None and residue.kind_of(rows[0]) is None


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("a <b>bold</b> &mdash; word", {"html"}), ("## Head\n\n- item", {"markdown"}), ("Loose ends\n==========\ntext", {"markdown"}), ("== Head ==\n''x y'' [[Link|l]]", {"wiki"}), ("so $x^{2} + y_1$ and \\emph{this}", {"latex"}),
        ("```sh\necho '$x^3$' '[[shelf]]' <b>\n```\nplain", {"markdown"}), ("<pre><code>a &lt; b [[x]]</code></pre>", {"html"}), ("5 * 3 * 2 crates, a < b and c > d, R&D, my_old_v2.txt under C:\\temp\\new, it's '90s, $5 or $6", set()), ("", set()), (None, set()),
    ],
)
def test_markup_kinds(text, kinds):
    assert markup.kinds_of(text) == kinds


def test_markup_clean_and_templates(spark):
    assert markup.clean("<h2>Head</h2><p>Some <b>text</b></p><ul><li>one</li></ul>") == "## Head\nSome text\n\n- one"
    assert markup.clean("== H ==\n[[A|b]] ''c''\n$x^2$") == "# H\nb c\n$x^2$"
    assert markup.clean(None) is None and markup.clean(" ") is None
    pages = spark.createDataFrame([("h", f"p{i}", f"<div>{i}</div> <i>x" + ("<hr>" if i % 2 else "")) for i in range(4)] + [(None, "n", "plain"), ("h", "null", None)], "host string, page string, body string")
    assert {r.host: set(r.tokens) for r in markup.template_tokens(pages.where("body is not null and host is not null")).collect()} == {"h": {"<div>", "</div>"}}
    assert {tuple(r) for r in markup.found(pages).collect()} == {(f"p{i}", "html") for i in range(4)}


def test_markup_is_read_in_slots(spark):
    cells = '<td class="n">$</td><td class="n">$</td>'
    pages = spark.createDataFrame([("h", f"p{i}", cells + f" row {i}") for i in range(3)] + [("h", "code", "```\n<td class='n'>\n```\nx")], "host string, page string, body string")
    assert {tuple(r) for r in markup.found(pages).collect()} == {(f"p{i}", "html") for i in range(3)} | {("code", "markdown")}
    free, inner, kinds = markup.slots_of("<td>a</td> [[b]] `<td>`", {"<td>", "</td>", "[[", "]]"})
    assert (free.split(), inner, kinds) == (["a", "`<td>`"], ["b"], {"html", "wiki"})
    # delimiters of a formula or table say that what is between them isn't Markdown
    assert markup.page_kinds("\\[ a *b* c \\] x", {"\\[", "\\]"}) == {"latex"} and markup.page_kinds("x *b* y", {"\\[", "\\]"}) == {"markdown"}


def test_markup_rows_rest_on_the_template(spark, monkeypatch):
    pages = spark.createDataFrame([("h", f"p{i}", f"<li>a</li> $x^{i}$") for i in range(3)] + [("h", "q", "<b>once</b>")], "host string, page string, body string")
    want = {(f"p{i}", k) for i in range(3) for k in ("html", "latex")} | {("q", "html")}
    assert {tuple(r) for r in markup.found(pages).collect()} == want
    assert {r.page: r.clean for r in markup.cleaned(pages).collect()} == {f"p{i}": f"- a\n $x^{i}$" for i in range(3)} | {"q": "once"}
    # the grammar doesn't see the template's tokens: without their kinds rows are lost
    slots = [markup.slots_of(f"<li>a</li> $x^{i}$", {"<li>", "</li>"}) for i in range(3)]
    assert all(markup.kinds_of(free) == {"latex"} for free, _, _ in slots)


GIVEN = frozenset({"robert", "bob", "isabella"})


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("Write to a.b+list@mail.example.org or c at owlgate dot test.", [("email", 9), ("email", 38)]), ("Ring +33 1 55 50 09 10 after six", [("phone", 5)]), ("Mobile (0145) 555-0131, tel. 0703 555 0355", [("phone", 7), ("phone", 29)]),
        ("Passport no. ZZ3871921, valid", [("idno", 13)]), ("Número: El pasaporte n.º 42 784 783 vale", [("idno", 25)]), ("The deed says Flat 3, 177 Rookery Road, X.", [("address", 14)]), ("Pakete gehen an Quince-Weg 192, 88977 Y", [("address", 16)]),
        ("Ho da chuyen den so 178 duong Weir, phuong", [("address", 17)]), ("Ask Robert K. Dífikupond about it", [("name", 4)]), ("Thanks, ZÖSIBUSATH, BOB!", [("name", 8)]), ("Ask **Robert** Dífikupond now", [("name", 6)]),
        ("Batch 297-297-297 passed. ISBN-like: 978-0-660-76-5. Order no. 00869869. On 2023-08-15 v10.5.12.6 @loom Oakmere Lane. Robert Foods", []), ("", []), (None, []),
    ],
)
def test_pii(text, items):
    assert [(k, a) for k, a, _ in pii.find(text, GIVEN)] == items


def test_pii_masking_and_checks():
    assert pii.redact("Ask Bob Tuvutitox, a@b.test.", GIVEN) == "Ask [NAME], [EMAIL]."
    assert pii.luhn("4539148803436467") and not pii.luhn("4539148803436468") and pii.mod23("12345678Z") and pii.mod23("X1234567L") and not pii.mod23("12345678A") and pii.mod97("1850578006084" + "91")


@pytest.mark.parametrize("right", ["12345678Z", "X1234567-L", "529.982.247-25", "86 095 742 719", "811218-9876", "85.07.30-033.28"])
def test_checksums_confirm_and_reject(right):
    """Without a word for what it is, a number counts if, and only if, its checksum is right."""
    assert pii.checked(right) and [k for k, _, _ in pii.find(f"It was {right} again", frozenset())] == ["idno"]
    last = right[-1]
    wrong = right[:-1] + (chr((ord(last) - 65 + 1) % 26 + 65) if last.isalpha() else str((int(last) + 1) % 10))
    assert not pii.checked(wrong) and pii.find(f"It was {wrong} again", frozenset()) == []
    assert pii.find(f"Invoice no. {right}", frozenset()) == [] and len(pii.find(f"ID card {wrong}", frozenset())) == 1


# --- 1, 2 -----------------------------------------------------------------------------------------------------------------------

SAMPLES = {
    "en": "The night shift sorted the route sheet on Tuesday because the shelves were damp.", "de": "Die Nachtschicht sortierte den Fahrplan am Dienstag, weil die Regale feucht waren.",
    "fr": "L'équipe de nuit a trié la feuille de route mardi, parce que les étagères étaient humides.", "es": "El turno de noche ordenó la hoja de ruta el martes, porque los estantes estaban húmedos.",
    "pt": "O turno da noite arrumou a folha de rota na terça-feira, porque as prateleiras estavam húmidas.", "vi": "Ca trực đêm đã sắp xếp tờ lộ trình vào thứ ba, vì các kệ đều bị ẩm.",
}


@pytest.fixture(scope="module")
def model():
    return language.train(list(SAMPLES.values()) * 3, sorted(SAMPLES))


def test_languages(model):
    for code, text in SAMPLES.items():
        assert [model.languages[k] for k in language.analyse(text, model)[0]] == [code]
        bare = language.fold(text).capitalize()
        assert [model.languages[k] for k in language.analyse(bare, model)[0]] == [code]
    kept, rows = language.analyse(f"{SAMPLES['en']} {SAMPLES['vi']}", model)
    assert {model.languages[k] for k in kept} == {"en", "vi"} and all(0 <= c <= 1 for *_, c in rows)
    assert [model.languages[k] for k in language.analyse(SAMPLES["en"] + ' The label says "' + SAMPLES["de"] + '" only.', model)[0]] == ["en"]
    assert language.analyse(None, model) == ([], []) and language.analyse("12 – ??", model) == ([], [])


def test_confidence_and_unknown_languages(model):
    for text in ("Ночная смена разобрала маршрутный лист во вторник, потому что полки были сырыми.", "夜勤は火曜日に経路表を整理した。棚が湿っていたからだ。", "Η νυχτερινή βάρδια ταξινόμησε το φύλλο διαδρομής."):
        kept, rows = language.analyse(text, model)
        assert kept == [] and rows and all(k == -1 for *_, k, _ in rows)
    clear = language.analyse(SAMPLES["en"], model)[1][0][3]
    doubtful = [language.analyse(t, model)[1][0][3] for t in ("No", "Que", "Era hora")]
    assert 0.95 < clear <= 1 and max(doubtful) < 0.8


def test_language_model_counts_all_records(spark, monkeypatch, tmp_path):
    """Words that one record of thousands has are in the model, records delivered twice count once, and parts don't matter."""
    monkeypatch.setattr(language, "COUNTED_WORDS", 40, raising=False)
    monkeypatch.setattr(language, "KNOWN_WORDS", 30, raising=False)
    codes, rng = sorted(SAMPLES), random.Random(5)
    rare = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(1300)]
    texts = [SAMPLES[codes[i % 6]].replace(".", f" {w}.") for i, w in enumerate(rare * 2)]
    at = "timestamp'2024-01-01 00:00:00'"
    notes, chats = ([(str(i), t) for i, t in enumerate(x)] for x in (texts[:1300], texts[1300:]))
    for name, key, text, rows in (("notes", "doc_id string", "body", notes + notes[:400]), ("chat_turns", "turn_id string", "query", chats)):
        made = spark.createDataFrame(rows, f"{key}, {text} string").selectExpr("*", "'en' AS lang", f"{at} AS loaded_at")
        made.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.createDataFrame([(c,) for c in codes], "lang string").write.parquet(str(tmp_path / "languages.parquet"))
    got, want = language.fitted(spark, str(tmp_path)), language.train(texts, codes)
    assert got.languages == codes and np.allclose(got.floor, want.floor)
    words = rare + [w for t in SAMPLES.values() for _, _, x, _ in language.sentences(t) for w in x]
    assert all(np.allclose(got.word(w), want.word(w), atol=1e-4) for w in words)
    assert np.allclose(got.each(words), [want.word(w) for w in words], atol=1e-4) and len(got.each([])) == 0


def test_labels():
    assert [language.label_code(x) for x in ("EN", "en-US", "pt_BR", "Vietnamese", "deu", "Español", "??", "", None, "und", "n/a", "unknown")] == ["en", "en", "pt", "vi", "de", "es", None, None, None, None, None, None]


def test_defects(model):
    q = "What do my notes say about the route sheet?"
    d = lambda a, refuses=False, q=q: pairs.defects(q, a, refuses, model)
    for a in (None, "", " \u200b", "...", "null", "[]", "(no answer)", "—"):
        assert d(a) == ["empty"]
    for a in ("No", "42 crates", "On page 9", "- the tide tables\n- the roof", SAMPLES["en"] + " [2][3]", SAMPLES["en"] + "\n```\nlog(1)\n```", q + " " + SAMPLES["en"], "Nothing in your notes covers this."):
        assert d(a) == []
    assert d(q.upper()) == ["echo"] and d('"' + q[:-1] + '" ...') == ["echo"]
    assert d("The night shift sorted the sheet. As agreed, the") == ["truncated"] and d("x is so.\n```\ndef total(") == ["truncated"] and d("- one\n- two\n- ") == ["truncated"]
    assert d(SAMPLES["de"]) == ["wrong_language"] and d(SAMPLES["de"], q=q + " Please answer in German.") == []
    assert d("I must decline.", refuses=True) == ["refusal"] and pairs.defects(None, None, False, model) == [] and pairs.defects(" ", "x", False, model) == []


def test_refusal_templates(spark):
    rows = [(pairs.opening(a), f"q{i}") for i, a in enumerate(["I'm sorry, but I can't help with that. Bye.", "I'm sorry, but I can't help with that.", "Nothing in your notes covers this.", "Nothing in your notes covers this.", 'The note says: "I cannot come", and so on it goes.'])]
    got = {r.opening for r in pairs.refusal_openings(spark.createDataFrame(rows, "opening string, query string")).collect()}
    assert got == {"i'm sorry but i can't help with that"}


def test_refusal_templates_in_other_words(spark):
    unlisted = "Questions of this sort go unanswered here, sorry."
    assert not pairs.REFUSALS.search(pairs.opening(unlisted))
    rows = [(pairs.opening(unlisted), q) for q in ("Where is the old ledger?", "Who fixed the boiler?", "When does the ferry sail?")]
    rows += [(pairs.opening("Nothing in your notes answers this question."), q) for q in ("Where is the old ledger?", "Who fixed the boiler?")]
    rows += [(pairs.opening("Sorry, the crew never got a reply there."), "Did the crew get a reply?"), (pairs.opening("I won't do that."), "Could you?")]
    got = {r.opening for r in pairs.refusal_openings(spark.createDataFrame(rows, "opening string, query string")).collect()}
    assert got == {pairs.opening(unlisted), "i won't do that"}
    # the same question put twice is no recurrence
    once = spark.createDataFrame([(pairs.opening(unlisted), q) for q in ("Where is page 3?", "where is PAGE 4")], "opening string, query string")
    assert pairs.refusal_openings(once).count() == 0


def test_refusal_templates_without_any_listed_word(spark):
    """Recurrence under unrelated questions and words that nobody asks about decide, whatever the words."""
    strange = "Cette matiere demeure hors de mon perimetre, voila tout."
    assert not pairs.REFUSALS.search(pairs.opening(strange)) and not pairs.declines(pairs.opening(strange))
    things = ["ledger", "boiler", "ferry", "lease", "harbour", "lantern", "orchard"]
    ask = [f"Where did the crew put the {t} last week?" for t in things]
    topic = "The lantern and the ledger and the lease"
    rows = [(pairs.opening(strange), q) for q in ask] + [(pairs.opening(topic), q) for q in ask]
    found = lambda r: {x.opening for x in pairs.refusal_openings(spark.createDataFrame(r, "opening string, query string")).collect()}
    filler = [(f"opening number {t}", f"What about {t} and {u}?") for t in things for u in ("paint", "slate", "canvas")]
    assert found(rows + filler) == {pairs.opening(strange)}
    # questions that share a telling word aren't unrelated
    same = [(pairs.opening(strange), f"Tell {w} of the gramophone") for w in things]
    assert found(same + [(f"opening number {i}", f"What about item{chr(97 + i % 26)}{chr(97 + i // 26)} then?") for i in range(300)]) == set()
    # a single opening needs a word for what is refused
    assert found([(pairs.opening("We cannot ship before Friday because the pump failed."), ask[0]), (pairs.opening("I cannot answer that."), ask[1])]) == {"i cannot answer that"}


def test_openings_of_a_split_band_all_meet(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 2)
    texts = {1: "a b c d e f g h i j k l m n o p", 2: "a b c d e f g h i j k l m n o q", 3: "z y x w v u t s", 4: "z y x w v u t s", 5: "unlike all of them here"}
    signed = spark.createDataFrame([(k, v, [7]) for k, v in texts.items()], "id long, opening string, bands array<long>")
    assert {tuple(sorted(r)) for r in pairs.alike_openings(signed).collect()} == {(1, 2), (3, 4)}


# --- 9 -------------------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120), st.integers(50, 90))
def test_assign_never_overflows(sizes, capacity):
    s = np.array(sorted(sizes, reverse=True), np.int64)
    seq = packing.assign(s, capacity)
    assert len(seq) == len(s) and all(np.bincount(seq, weights=s) <= capacity) if len(s) else True


def test_pack(spark):
    sizes = spark.createDataFrame([(1, 1000), (2, 30), (3, 0), (4, None), (5, 70), (6, 100)], "doc_id long, tokens long")
    windows = spark.createDataFrame([("m", 100), ("n", None), ("m", 100)], "model_id string, window_tokens int")
    got = packing.pack(sizes, windows).toPandas()
    assert got.groupby("doc_id")["tokens"].sum().to_dict() == {1: 1000, 2: 30, 5: 70, 6: 100}
    assert got.groupby("container_id")["tokens"].sum().max() <= 100 and got["container_id"].nunique() == 12
    assert packing.pack(sizes.limit(0), windows).count() == 0
    assert isinstance(got, pd.DataFrame)
