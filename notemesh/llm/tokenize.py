"""Problem 8: token ids of a whole corpus through a table of distinct words.

Words are split in Spark, every distinct word is encoded once, and the ids are
joined back by position. A document's occurrences of one word travel as one row
with all their positions. Decoding joins ids to pieces.

Defined cases: a null, and an empty text, give an empty list; a blank text is
text like any other (its white space has ids); repeated rows of one key give
one row if they agree, else the largest text counts; other columns of the input
play no part, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notemesh.plans import materialize, skew
from notemesh.plans.registry import Registry
from notemesh.sources import once, read_table

#: Folder of the tokenizers' vocabulary files.
TOKENIZER_DIR = os.environ.get("NOTEMESH_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"

#: White space as Unicode's White_Space property has it, and the split pattern of the byte-level tokenizer.
SPACE = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: When the dictionary is too large to broadcast, a word has one partition for so many of the rows that hold it.
WORD_ROWS = 500_000


@functools.cache
def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(word, n) → (word, n, ids): each row's word encoded on its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = load_tokenizer(path)
        for pdf in batches:
            ids = [e.ids for e in tok.encode_batch(pdf["word"].tolist(), add_special_tokens=False)]
            yield pdf.assign(ids=pd.Series(ids, index=pdf.index, dtype=object))

    return words.mapInPandas(run, "word string, n long, ids array<int>")


def _words(docs: DataFrame, text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_PATTERN), F.lit(0))


def _split(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, w): every key once, with the words of its text; of different texts the largest counts. The rows are partitioned by k."""
    one = once(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), ["k"], ["t"])
    return one.select("k", _words(one, "t").alias("w"))


def _dictionary(docs: DataFrame, text: str, path: str, name: str) -> tuple[DataFrame, int]:
    """(word, n, ids) of all distinct words, n the rows that hold it, and the table's size in bytes."""
    counted = docs.select(F.explode(F.array_distinct(_words(docs, text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = materialize(encode_words(counted, path), name)
    size = words.agg(F.coalesce(F.sum(F.length("word") * 2 + F.size("ids") * 4 + 64), F.lit(0)).alias("b")).first()["b"]
    return words, size


def token_ids(docs: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids) for every key of `docs`; null and empty texts have an empty list.

    The word counts are pre-aggregated before their shuffle. The texts move once,
    to bring copies of a key together. A small dictionary is broadcast, and
    nothing moves for it; a larger one is joined by shuffle, with one row for each
    document and distinct word, each word spread over as many partitions as its
    rows need, and one shuffle by key puts the ids in order.
    """
    path = path or os.path.join(TOKENIZER_DIR, BYTE_BPE)
    split = _split(docs, key, text)
    words, size = _dictionary(docs, text, path, "words")
    occ = split.select("k", F.posexplode("w").alias("pos", "word"))
    if size <= skew.BROADCAST_BYTES:
        lists = occ.join(F.broadcast(words.select("word", "ids")), "word").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("p"))
    else:
        held = occ.groupBy("k", "word").agg(F.collect_list("pos").alias("at"))
        joined = skew.dictionary_join(held, words.select("word", "ids", "n"), "word", size, "n", WORD_ROWS)
        lists = joined.groupBy("k").agg(F.sort_array(F.flatten(F.collect_list(F.transform("at", lambda p: F.struct(p.alias("pos"), F.col("ids").alias("ids")))))).alias("p"))
    full = lists.select("k", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
    empty = split.where(F.size("w") == 0).select("k", F.array().cast("array<int>").alias("ids"))
    return full.unionByName(empty).select(F.col("k").alias(key), "ids")


def token_counts(docs: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, tokens): the length of `token_ids` without building the lists."""
    path = path or os.path.join(TOKENIZER_DIR, BYTE_BPE)
    split = _split(docs, key, text)
    words, _ = _dictionary(docs, text, path, "wordlen")
    lengths = words.select("word", "n", F.size("ids").alias("t"))
    size = lengths.agg(F.coalesce(F.sum(F.length("word") * 2 + 64), F.lit(0)).alias("b")).first()["b"]
    occ = split.select("k", F.explode("w").alias("word")).groupBy("k", "word").agg(F.count("*").alias("m"))
    sums = skew.dictionary_join(occ, lengths, "word", size, "n", WORD_ROWS).groupBy("k").agg(F.sum(F.col("m") * F.col("t")).alias("tokens"))
    empty = split.where(F.size("w") == 0).select("k", F.lit(0).cast("long").alias("tokens"))
    return sums.unionByName(empty).select(F.col("k").alias(key), "tokens")


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary → byte: printable Latin-1 bytes stand for themselves, the rest for 256, 257, …"""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, piece): the bytes of every token of the vocabulary; its size is that of the vocabulary file."""
    with open(path or os.path.join(TOKENIZER_DIR, BYTE_BPE), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    of = byte_alphabet()
    rows = [(i, bytes(of[c] for c in w)) for w, i in vocab.items() if all(c in of for c in w)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece"]), "id int, piece binary")


def decode(ids: DataFrame, key: str, spark: SparkSession, path: str | None = None) -> DataFrame:
    """(key, text) of (key, ids) by a join of ids and pieces; an empty list gives an empty text."""
    flat = ids.select(F.col(key).alias("k"), F.posexplode_outer("ids").alias("pos", "id"))
    joined = flat.join(F.broadcast(pieces(spark, path)), "id", "left")
    bytes_ = joined.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("h")))).alias("p"))
    return bytes_.select(F.col("k").alias(key), F.decode(F.unhex(F.array_join(F.transform("p", lambda x: F.coalesce(x["h"], F.lit(""))), "")), "UTF-8").alias("text"))


def register(reg: Registry) -> None:
    @reg.query("p8_ids")
    def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
        return token_ids(read_table(spark, sf, "documents"), "doc_id", "text")

    @reg.query("p8_decoded")
    def p8_decoded(spark: SparkSession, sf: str) -> DataFrame:
        """Every document's text, from its ids."""
        return decode(p8_ids(spark, sf), "doc_id", spark)
