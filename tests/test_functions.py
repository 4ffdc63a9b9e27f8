from pyspark.sql import functions as F

from notemesh.functions import text as T


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "x string").select(col(F.col("x")).alias("y")).first()["y"]


def test_fold(spark):
    assert one(spark, T.fold, "Đà Nẵng Été") == "da nang ete"
    assert one(spark, T.fold, "Straße ø ł") == "straße ø ł"  # only marks go
    assert one(spark, T.fold, None) is None


def test_query_terms(spark):
    assert one(spark, T.query_terms, "What is the Roof estimate, the ROOF?") == ["roof", "estimate"]
    assert one(spark, T.query_terms, "") == []


def test_whole_word_score(spark):
    score = lambda c: T.whole_word_score(c, F.array(F.lit("end"), F.lit("mua")))
    assert one(spark, score, "We spend it") == 0
    assert one(spark, score, "The end. Múa!") == 2
    assert one(spark, score, None) == 0


def test_ids_slugs_tags(spark):
    assert one(spark, T.canonical_id, " Sơn Tùng  M-TP! ") == "sơn_tùng_m-tp"
    assert one(spark, T.slug, "Đơn xin – tài trợ!") == "don-xin-tai-tro"
    assert one(spark, T.slug, "???") == "untitled"
    assert one(spark, T.norm_tag, " #Client/Acme ") == "client/acme"
    assert one(spark, T.norm_tag, "#") is None
    assert one(spark, T.inline_tags, "a #Tag b#no\n#two") == ["tag", "two"]


def test_wikilinks_and_paths(spark):
    assert one(spark, T.wikilink_targets, "[[A b|x]] [[C#d]] [[ ]] [[E]]") == ["A b", "C", "E"]
    assert one(spark, T.folder_of, "a/b/c.md") == "a/b"
    assert one(spark, T.file_type, "x/y.PDF") == "pdf"
    assert one(spark, T.file_type, "x/y.exe") is None


def test_redact_and_escape(spark):
    red = lambda c: T.redact(c, ["email", "ssn"])
    assert one(spark, red, "to a.b@c.test and 000-11-2222") == "to [REDACTED] and [REDACTED]"
    assert one(spark, T.xml_attr, 'a<b>&"') == "a&lt;b&gt;&amp;&quot;"


def test_tokens(spark):
    assert one(spark, T.token_count, "a b\n c") == 3
    assert one(spark, T.token_count, None) == 0
    assert one(spark, lambda c: T.truncate(c, 20), "  much   to say ") == "much to say"
    assert one(spark, lambda c: T.truncate(c, 5), "much to say") == "much…"


def test_paths_hashes_and_spans(spark):
    assert one(spark, T.canonical_id, "Ａcme ﬁrm") == "acme_firm" and one(spark, T.slug, "Ｒoof ½") == "roof-1-2"
    assert one(spark, T.folder_path, "Clients / Acme Inc/ /!") == "clients/acme-inc" and one(spark, T.folder_path, None) == ""
    assert one(spark, lambda c: T.child_folder(c, F.lit("Đồ án")), " ") == "notes/do-an" and one(spark, lambda c: T.renamed_folder(c, F.lit("D")), "a/b/c") == "a/b/d"
    assert one(spark, lambda c: T.conflict_path(c, F.lit("1:2.3")), "n/x.md") == "n/x.1-2-3.conflict.md"
    assert one(spark, T.graph_hash, "") == "811c9dc5" and one(spark, T.graph_hash, "a") == "e40c292c" and one(spark, T.graph_hash, None) is None
    assert tuple(one(spark, lambda c: T.highlight(c, F.lit(1), F.lit(99)), "äbc")) == ("ä", "bc", "") and tuple(one(spark, lambda c: T.highlight(c, F.lit(-5), F.lit(-9)), "ab")) == ("", "", "ab")
    assert one(spark, T.file_type, "x.text") == "txt" and one(spark, T.clean_title, "  A \t B ") == "a b"
