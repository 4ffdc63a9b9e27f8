"""Problem 1: the language of every record and of its stretches in other languages.

A word's likelihood in a language comes from its character n-grams and itself,
without accents, so a text typed without them reads the same. The counts are
those of all records: their sentences are first told apart by common function
words, then the model labels them anew, twice. Tasks count words by language, and
n-grams by their words; the model has a hash and a number a language for each
distinct n-gram, so it grows with the vocabulary, not with rows. Labels of rows
play no part in the fit, since they may be wrong.

A record is a mixture of languages. Expectation-maximisation estimates its
proportions from the likelihoods of its sentences; the set of languages starts
with the best single one and grows while the log likelihood gains more than a
penalty for each further language. Each sentence then has the language of its
posterior. Its confidence is the posterior among all languages, by their words in
the record and PRIOR_WORDS more, and a background that knows no language, for which a letter sequence that none has is as good as any. A record
that the background explains better than all languages is in none of them.

Defined cases: names (capitalised words within a sentence), code, addresses and
quoted titles are left out; records without words have no language, and records in
none of the languages are no cases, their stretches are `und`; null, empty and
blank texts have none; rows delivered twice count once.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemesh.llm.markup import CODE, HTML
from notemesh.plans import materialize
from notemesh.plans.registry import Registry
from notemesh.sources import once, read_table

#: Words that a task counts before it hands them on, and whose likelihoods it keeps at hand; neither changes a result.
COUNTED_WORDS, KNOWN_WORDS = 100_000, 200_000
#: Nats that a further language must gain over the record, and for each of its sentences over the main language.
PENALTY, MARGIN = 6.0, 5.0
#: Counted words of a whole sentence.
SENTENCE_WORDS = 3
#: Most that one word may tell for or against a language, in nats.
WORD_NATS = 6.0
#: Words that every language has in a record before any is read, and how many times likelier than in a language an unseen n-gram is in the background.
PRIOR_WORDS, UNSEEN = 0.5, 4.0
#: Words, and n-grams of a word, aren't independent: for the confidence their nats count this much less.
TEMPER = 5.0
#: Nats by which the background must beat every language.
STRANGE_NATS = 4.0
UNKNOWN = "und"
#: Nats that a change of language inside a sentence without stops must gain.
SPLIT_NATS = 14.0

# Frequent function words, without accents, and usual labels of the languages.
FUNCTION_WORDS = {
    "en": "the of and to in is was were with for on that this by from at are be it as an but which have has had not we they you what who when where before after because although",
    "vi": "va cua cac nhung mot la da duoc cho khi voi trong ngoai truoc sau nay do thi ma khong co ban nguoi vi de tai len con minh hay ve chung toi se dang cung roi nao",
    "de": "der die das und den dem des ein eine einen mit fur von zu ist war wir sie nicht auf im am weil obwohl damit nach vor bei wurde hat haben was wer wann wo dass sich",
    "fr": "le la les des un une et est du dans pour avec sur que qui pas nous vous ils elle ont ete parce car bien avant apres aux au ce cette dont mais plus quelle quand",
    "es": "el la los las un una y es del por con para que se no su fue en al lo como porque aunque antes despues nos esta este cuando donde muy mas han hemos ya quien cual",
    "pt": "o a os as um uma e do da dos das no na nos nas com para que se nao foi em ao por mais como porque embora antes depois quando onde ja muito quem qual pela pelo",
}
LABELS = {
    "en": "en eng english anglais inglés inglês englisch",
    "vi": "vi vie vietnamese việt tiếng-việt tieng-viet vietnamesisch vietnamien vietnamita",
    "de": "de deu ger german deutsch allemand alemán alemão",
    "fr": "fr fra fre french français francais französisch francés francês",
    "es": "es spa spanish español espanol castellano spanisch espagnol espanhol",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués",
}


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c)).replace("đ", "d").replace("ß", "ss")


@functools.lru_cache(maxsize=100_000)
def fold_word(w: str) -> str:
    return w.lower() if w.isascii() else fold(w)


def label_code(label: str | None) -> str | None:
    """The language that a label names: a code, tag or name, in any case; None if it names none."""
    if label is None:
        return None
    t = label.strip().lower().replace("_", "-")
    for code, names in LABELS.items():
        known = names.split()
        if t.replace(" ", "-") in known or t.split("-")[0] in known[:3] or t.split(" ")[0] in known[2:]:
            return code
    return None


QUOTED = re.compile(r"\"[^\"\n]{1,200}\"|“[^”\n]{1,200}”|«[^»\n]{1,200}»|„[^“”\n]{1,200}[“”]|‘[^’\n]{3,200}’|\[\[[^\]\n]*\]\]|\{\{[^{}]*\}\}|\]\([^)\s]*\)|\S+@\S+|https?://\S+|\$[^$\n]*\$|\\[a-zA-Z]+(?:\[[^\]\n]*\])?|\b\w+_\w+\b|\b(?:[Ss]ố|[Ss]o) \d+\w? (?:đường|duong|phố|pho)\b[^.,\n|]*(?:,\s*(?:phường|phuong)[^.,\n|]*)?")
BREAK = re.compile(r"(?<=[.!?…])[\"”»)\]]*\s+|[\n|•;]+|\s[–—]\s")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def sentences(text: str | None) -> list[tuple[int, int, list[str], list[int]]]:
    """(start, end, counted words, their places) of the sentences of a text; the words are folded."""
    if not text or not text.strip():
        return []
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    t = CODE.sub(blank, text)
    t = HTML.sub(lambda m: ("\n" if re.match(r"</?(?:p|div|li|t[drh]|h\d|br|hr|ul|ol|table)\b", m[0], re.I) else " ") + " " * (len(m[0]) - 1), t)
    t = QUOTED.sub(blank, t)
    out = []
    at = 0
    ends = [(m.start(), m.end()) for m in BREAK.finditer(t)] + [(len(t), len(t))]
    for stop, following in ends:
        part = t[at:stop]
        found = list(WORD.finditer(part))
        words = [m[0] for m in found]
        if words:
            upper = sum(w.isupper() and len(w) > 1 for w in words) > 0.6 * len(words)
            # after an opening word, capitals mark names (and German nouns, which the other words make up for)
            kept = [m for i, m in enumerate(found) if (upper or i == 0 or not m[0][0].isupper()) and (len(m[0]) > 1 or m[0].lower() in "aáàeéoóyơởê")]
            if kept:
                out.append((at, stop, [fold_word(m[0]) for m in kept], [at + m.start() for m in kept]))
        at = following
    return out


Parts = list[tuple[int, int, list[str], list[int]]]


@functools.lru_cache(maxsize=100_000)
def gram_hash(gram: str) -> int:
    return int.from_bytes(hashlib.blake2b(gram.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def counted_grams(words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the words' n-grams, sorted, and their counts by language, given those of the words."""
    grams = [[gram_hash(g) for g in LanguageModel.grams(w)] for w in words]
    hashes, at = np.unique(np.array([h for x in grams for h in x], np.int64), return_inverse=True)
    out = np.zeros((len(hashes), counts.shape[1]), np.int64)
    np.add.at(out, at, np.repeat(counts, [len(x) for x in grams], axis=0))
    return hashes, out


class LanguageModel:
    def __init__(self, languages: list[str]):
        self.languages = languages
        self.hashes = np.empty(0, np.int64)
        self.logs = np.empty((0, len(languages)), np.float32)
        self.floor: np.ndarray | None = None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.vectors = np.empty((1024, len(self.languages) + 1))

    @staticmethod
    def grams(word: str) -> list[str]:
        w = f"<{word}>"
        return [w, *(w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1))]

    def fit(self, labelled: list[tuple[list[str], int]]) -> None:
        words: dict[str, int] = {}
        where = [[words.setdefault(w, len(words)) for w in sentence] for sentence, _ in labelled]
        counts = np.zeros((len(words), len(self.languages)), np.int64)
        for at, (_, k) in zip(where, labelled):
            np.add.at(counts[:, k], at, 1)
        self.fit_counts(*counted_grams(list(words), counts))

    def fit_counts(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Fits the model on the counts by language of distinct n-grams, whose hashes are sorted."""
        total = counts.sum(axis=0) + 0.5 * (len(hashes) or 1)
        self.hashes, self.logs = hashes, np.empty(counts.shape, np.float32)
        for k, t in enumerate(total):
            self.logs[:, k] = np.log((counts[:, k] + 0.5) / t)
        self.floor = np.log(0.5 / total)
        self.forget()

    def word(self, w: str) -> np.ndarray:
        """Log likelihood of a word in each language and, last, in the background, relative to the best language, per gram and bounded."""
        grams = np.array([gram_hash(g) for g in self.grams(w)], np.int64)
        at = np.searchsorted(self.hashes, grams)
        at[at == len(self.hashes)] = 0
        at = at[self.hashes[at] == grams] if len(self.hashes) else at[:0]
        own = self.logs[at].astype(float).sum(axis=0) + (len(grams) - len(at)) * self.floor
        none = (self.floor.max() + np.log(UNSEEN)) * len(grams)
        got = np.array([*own, none]) / (0.35 * len(grams) + 1)
        return np.clip(got - got[:-1].max(), -WORD_NATS, WORD_NATS)

    def place(self, w: str) -> int:
        """The row of `vectors` that has a word's likelihoods."""
        at = self.known.get(w)
        if at is None:
            at = len(self.known)
            if at == len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
            self.vectors[at] = self.word(w)
            self.known[w] = at
        return at

    def sentence(self, words: list[str]) -> np.ndarray:
        return self.each(words)[:, :-1].sum(axis=0)

    def each(self, words: list[str]) -> np.ndarray:
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        at = [self.place(w) for w in words]
        return self.vectors[np.array(at, np.int64)]


def basis(languages: list[str]) -> list[tuple[list[str], int]]:
    return [(FUNCTION_WORDS[c].split(), k) for k, c in enumerate(languages) if c in FUNCTION_WORDS]


def first_labels(parts: Parts, seeds: list[set[str]]) -> Iterator[tuple[list[str], int]]:
    """Sentences of a record with the language that function words tell."""
    scores = [[sum(w in seed for w in s) for seed in seeds] for _, _, s, _ in parts]
    total = [sum(x) for x in zip(*scores)] or [0]
    if max(total) < 2:
        return
    main = total.index(max(total))
    for (_, _, s, _), x in zip(parts, scores):
        own = x.index(max(x))
        yield s, own if x[own] >= x[main] + 2 else main


def labels(parts: Parts, model: LanguageModel) -> Iterator[tuple[list[str], int]]:
    """Sentences of a record with the language that the model tells, where it is sure."""
    for (_, _, s, _), (_, _, k, c) in zip(parts, judge(parts, model, whole=True)[1]):
        if c > 0.8:
            yield s, k


def seeds_of(languages: list[str]) -> list[set[str]]:
    return [set(FUNCTION_WORDS.get(c, "").split()) for c in languages]


#: Fits after the first, on what the model itself has told.
ROUNDS = 2


def train(texts: list[str], languages: list[str]) -> LanguageModel:
    """Fits a model on records that are told apart by function words, then by the model itself.

    A sentence takes the language of its record unless its own words speak
    clearly for another, so that a sentence with few function words is learnt
    from its surroundings. `fitted` does the same for tables.
    """
    docs = [sentences(t) for t in texts]
    seeds = seeds_of(languages)
    model = LanguageModel(languages)
    model.fit(basis(languages) + [x for parts in docs for x in first_labels(parts, seeds)])
    for _ in range(ROUNDS):
        model.fit(basis(languages) + [x for parts in docs for x in labels(parts, model)])
    return model


def mixture(ll: np.ndarray, weight: np.ndarray, among: list[int], rounds: int = 12) -> tuple[float, np.ndarray]:
    """Log likelihood and posteriors of sentences under the best proportions of the languages `among`."""
    part = ll[:, among]
    if len(among) == 1:
        return float(part.sum()), np.ones_like(part)
    share = np.full(len(among), 1 / len(among))
    for _ in range(rounds):
        with np.errstate(divide="ignore"):
            x = part + np.log(share)
        top = x.max(axis=1, keepdims=True)
        post = np.exp(x - top)
        norm = post.sum(axis=1, keepdims=True)
        post /= norm
        share = (post * weight[:, None]).sum(axis=0) / weight.sum()
    return float((top[:, 0] + np.log(norm[:, 0])).sum()), post


def weighed(part: tuple[int, int, list[str], list[int]], each: np.ndarray, whole: bool) -> list[tuple[int, int, int, np.ndarray]]:
    """(start, end, words, log likelihoods) of a sentence, or of its two halves if it changes language without a stop."""
    a, b, words, places = part
    total = each.sum(axis=0)
    if whole or len(words) < 2 * SENTENCE_WORDS or -total[:-1].max() < SPLIT_NATS:
        return [(a, b, len(words), total)]
    ahead = each.cumsum(axis=0)[SENTENCE_WORDS - 1 : len(words) - SENTENCE_WORDS]
    both = ahead[:, :-1].max(axis=1) + (total - ahead)[:, :-1].max(axis=1)
    i = int(np.argmax(both))
    if both[i] - total[:-1].max() < SPLIT_NATS:
        return [(a, b, len(words), total)]
    k = i + SENTENCE_WORDS
    return [(a, places[k], k, ahead[i]), (places[k], b, len(words) - k, total - ahead[i])]


def analyse(text: str | None, model: LanguageModel, whole: bool = False) -> tuple[list[int], list[tuple[int, int, int, float]]]:
    """Languages of a record, the main one first, and its (start, end, language, confidence) by sentence.

    The language is its number in the model, -1 for none of them; a record in none has no languages.
    """
    return judge(sentences(text), model, whole)


def judge(found: Parts, model: LanguageModel, whole: bool = False) -> tuple[list[int], list[tuple[int, int, int, float]]]:
    """`analyse` of a record whose sentences are known."""
    if not found:
        return [], []
    each = np.split(model.each([w for _, _, words, _ in found for w in words]), np.cumsum([len(words) for _, _, words, _ in found])[:-1])
    parts = [x for p, e in zip(found, each) for x in weighed(p, e, whole)]
    ll = np.stack([p[3] for p in parts])
    ll, background = ll[:, :-1], ll[:, -1]
    weight = np.array([p[2] for p in parts], float)
    single = ll.sum(axis=0)
    chosen = [int(np.argmax(single))]
    best, post = mixture(ll, weight, chosen)
    most = ll.max(axis=1).sum()
    while len(chosen) < len(model.languages) and most - best > PENALTY:
        tries = [(mixture(ll, weight, [*chosen, k])[0], k) for k in range(len(model.languages)) if k not in chosen]
        gain, k = max(tries)
        if gain - best <= PENALTY + 0.5 * np.log(weight.sum()):
            break
        chosen.append(k)
        best = gain
    best, post = mixture(ll, weight, chosen)
    own = np.array([chosen[i] for i in post.argmax(axis=1)])
    size = {k: weight[own == k].sum() for k in chosen}
    main = max(chosen, key=lambda k: (size[k], -k))
    kept = [main]
    for k in sorted(chosen, key=lambda k: (-size[k], k)):
        # one whole sentence that the main language doesn't explain
        clear = (own == k) & (weight >= SENTENCE_WORDS) & (ll[:, k] - ll[:, main] >= MARGIN)
        if k != main and clear.any():
            kept.append(k)
    alone = len(kept) == 1
    of = [main if alone or own[i] not in kept else int(own[i]) for i in range(len(parts))]
    if whole:
        return kept, [(p[0], p[1], k, float(x)) for p, k, x in zip(parts, of, post.max(axis=1))]
    if (background - ll.max(axis=1)).sum() > STRANGE_NATS:
        kept, of = [], [-1] * len(parts)
    share = np.full(ll.shape[1] + 1, PRIOR_WORDS)
    share[chosen] += (post * weight[:, None]).sum(axis=0)
    x = np.c_[ll, background] / TEMPER + np.log(share / share.sum())
    x = np.exp(x - x.max(axis=1, keepdims=True))
    sure = x[np.arange(len(of)), of] / x.sum(axis=1)
    return kept, [(p[0], p[1], k, float(c)) for p, k, c in zip(parts, of, sure)]


def fitted(spark: SparkSession, sf: str) -> LanguageModel:
    codes = sorted(r["lang"] for r in read_table(spark, sf, "languages").select("lang").where("lang IS NOT NULL").distinct().collect())
    return fit_all(records(spark, sf).select("text"), codes)


def fit_all(texts: DataFrame, languages: list[str]) -> LanguageModel:
    """`train` on all rows of `texts` (text)."""
    spark = texts.sparkSession
    cols = [f"n{k}" for k in range(len(languages))]
    by_language = ", ".join(f"{c} long" for c in cols)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lines = ["\n".join(" ".join(words) for _, _, words, _ in sentences(t)) for t in pdf["text"]]
            yield pd.DataFrame({"words": [x for x in lines if x]}, dtype=object)

    def frame(counts: dict[str, list[int]]) -> pd.DataFrame:
        n = np.array(list(counts.values()), np.int64).reshape(len(counts), len(cols))
        return pd.DataFrame({"word": pd.Series(list(counts), dtype=object)} | {c: n[:, k] for k, c in enumerate(cols)})

    def count(tell: Callable[[Parts], Iterator[tuple[list[str], int]]]) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts: dict[str, list[int]] = {}
            for pdf in batches:
                for text in pdf["words"]:
                    for words, k in tell([(0, 0, line.split(" "), []) for line in text.split("\n")]):
                        for w in words:
                            (counts.get(w) or counts.setdefault(w, [0] * len(cols)))[k] += 1
                    if len(counts) > COUNTED_WORDS:
                        yield frame(counts)
                        counts = {}
            yield frame(counts)

        return run

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hashes, n = counted_grams(pdf["word"].tolist(), pdf[cols].to_numpy(np.int64))
            yield pd.DataFrame({"gram": hashes} | {c: n[:, k] for k, c in enumerate(cols)})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"grams": [pdf["gram"].to_numpy("<i8").tobytes()], "counts": [pdf[cols].to_numpy("<i8").tobytes()]})

    known: dict[str, list[int]] = {}
    for words, k in basis(languages):
        for w in words:
            known.setdefault(w, [0] * len(cols))[k] += 1
    own = spark.createDataFrame([(w, *n) for w, n in known.items()], f"word string, {by_language}")
    sums = [F.sum(c).alias(c) for c in cols]

    def fit(model: LanguageModel, tell: Callable) -> None:
        words = parsed.mapInPandas(count(tell), f"word string, {by_language}").unionByName(own).groupBy("word").agg(*sums)
        counted = words.mapInPandas(grams, f"gram long, {by_language}").groupBy("gram").agg(*sums)
        rows = counted.mapInPandas(pack, "grams binary, counts binary").collect()
        hashes = np.concatenate([np.frombuffer(r["grams"], "<i8") for r in rows] or [np.empty(0, np.int64)])
        counts = np.concatenate([np.frombuffer(r["counts"], "<i8").reshape(-1, len(cols)) for r in rows] or [np.empty((0, len(cols)), np.int64)])
        order = np.argsort(hashes)
        model.fit_counts(hashes[order], counts[order])

    parsed = materialize(texts.mapInPandas(read, "words string"), "sentences")
    seeds, model = seeds_of(languages), LanguageModel(languages)
    fit(model, lambda parts: first_labels(parts, seeds))
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)
        model = LanguageModel(languages)
        fit(model, lambda parts, shared=shared: labels(parts, shared.value))
        shared.unpersist()
    return model


def records(spark: SparkSession, sf: str) -> DataFrame:
    notes = once(read_table(spark, sf, "notes"), ["doc_id"], ["body", "lang"], newest="loaded_at")
    chats = once(read_table(spark, sf, "chat_turns"), ["turn_id"], ["query", "lang"], newest="loaded_at")
    one = notes.select(F.lit("notes").alias("src"), F.col("doc_id").alias("rec_key"), F.col("body").alias("text"), F.col("lang").alias("label"))
    return one.unionByName(chats.select(F.lit("chat_turns").alias("src"), F.col("turn_id").cast("string").alias("rec_key"), F.col("query").alias("text"), F.col("lang").alias("label")))


def register(reg: Registry) -> None:
    @reg.query("p1_found")
    def p1_found(spark: SparkSession, sf: str) -> DataFrame:
        shared = spark.sparkContext.broadcast(fitted(spark, sf))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = shared.value
            for pdf in batches:
                out = []
                for src, key, text, label in zip(pdf["src"], pdf["rec_key"], pdf["text"], pdf["label"]):
                    kept, _ = analyse(text, model)
                    if kept and (len(kept) > 1 or label_code(label) != model.languages[kept[0]]):
                        out += [(src, key, model.languages[k]) for k in kept]
                yield pd.DataFrame(out, columns=["src", "rec_key", "lang"])

        return records(spark, sf).mapInPandas(run, "src string, rec_key string, lang string")

    @reg.query("p1_segments")
    def p1_segments(spark: SparkSession, sf: str) -> DataFrame:
        """Every record's stretches of one language, with the mean confidence of their sentences."""
        shared = spark.sparkContext.broadcast(fitted(spark, sf))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = shared.value
            for pdf in batches:
                out = []
                for src, key, text in zip(pdf["src"], pdf["rec_key"], pdf["text"]):
                    runs: list[list] = []
                    for a, b, k, c in analyse(text, model)[1]:
                        if runs and runs[-1][2] == k:
                            runs[-1][1] = b
                            runs[-1][3].append(c)
                        else:
                            runs.append([a, b, k, [c]])
                    out += [(src, key, a, b, UNKNOWN if k < 0 else model.languages[k], round(float(np.mean(c)), 4)) for a, b, k, c in runs]
                yield pd.DataFrame(out, columns=["src", "rec_key", "start_pos", "end_pos", "lang", "confidence"]).astype({"start_pos": "int32", "end_pos": "int32"})

        return records(spark, sf).mapInPandas(run, "src string, rec_key string, start_pos int, end_pos int, lang string, confidence double")
