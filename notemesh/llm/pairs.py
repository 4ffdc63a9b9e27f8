"""Problem 2: defects of question–answer pairs.

Refusals: the openings of answers are clustered by MinHash, each link verified by
the Jaccard similarity of their five-word runs (0.8). A cluster that recurs under
unrelated questions (different ones that share no telling word) and doesn't take
its words from them is a template. Most templates are no refusals: they name
things that people ask about, numbers, or what the notes hold. A template under
RECURS questions of whose words FOREIGN_SHARE are words that nobody asks about
says nothing but that it doesn't answer, whatever its words and language; other
templates refuse if most of their openings deny an answer by the word lists. An
opening of no template refuses if it has a phrase of a refusal and a word for what
is refused. Copy, language and termination checks find the other defects, with the
language model of problem 1.

Defined cases: turns without a question (null, blank) have no defect; a null or
blank answer is empty and nothing else; quoted words of an answer don't count as
its own; turns delivered twice count once, the latest load winning.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemesh.llm.language import QUOTED, LanguageModel, analyse, fitted, fold, sentences
from notemesh.llm.names import by_cell
from notemesh.operators.components import components
from notemesh.plans import materialize
from notemesh.plans.registry import Registry
from notemesh.sources import once, read_table

OPENING_WORDS = 16
RUN, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 2
#: A template stands under this many different questions at least, and at most this share of its words is in its question.
MIN_QUESTIONS, OWN_SHARE = 2, 0.4
#: Questions are related if a word that is in at most COMMON_WORD of all questions is in more than RELATED of them.
COMMON_WORD, RELATED = 0.05, 0.5
#: A template without numbers, of this many words, under this many questions refuses if this share of its words is foreign to questions: in
#: FOREIGN times as many of the answered questions' openings as of the questions.
RECURS, WHOLE_WORDS, FOREIGN, FOREIGN_SHARE = 5, 5, 10, 0.4
#: Openings of a band that are compared in one piece of work.
BLOCK = 512
#: Nats by which an answer's language must beat every language of its question.
LANGUAGE_NATS = 4.0
#: Words that an answer must have for its language to be judged; one word may belong to several.
LEAST_WORDS = 2

# Marks that stand for no answer, refusal phrases (folded), and names of languages in requests (folded).
FILLERS = frozenset({"null", "none", "nil", "n/a", "na", "nan", "undefined", "empty", "tbd", "(no answer)", "[no answer]", "no answer", "(empty)", "(none)", "[empty]", "<empty>", "[null]"})
REFUSALS = re.compile(
    r"\b(?:i|we) (?:can ?not|can'?t|could not|couldn'?t|won'?t|will not|am not able|'m not able|am unable|'m unable|must decline|have to decline|do not feel comfortable|don'?t feel comfortable|am not comfortable|am not allowed|am only an assistant"
    r"|have been told not|must refuse|have to refuse)\b|against my guidelines|no can do|as an? (?:large )?(?:language model|ai)\b|(?:something|that) i (?:won'?t|can'?t|cannot)\b|outside what i am allowed|unable to (?:help|assist|answer)|decline (?:to answer|this)"
    r"|mo hinh ngon ngu|tu choi|khong duoc phep|khong the (?:giup|tra loi|ho tro)|ngoai pham vi|khong the dap ung"
    r"|als (?:ki|sprachmodell|sprach-?modell)|ablehnen|dabei kann ich (?:leider )?nicht|kann ich (?:leider )?nicht (?:helfen|beantworten)|ich kann (?:dabei |das |ihnen |dir )?(?:leider )?nicht (?:helfen|beantworten)|darf ich (?:leider )?(?:solche|das|diese|keine)|nicht beantworten"
    r"|je ne peux pas|je ne suis pas (?:en mesure|autorise)|dois refuser|je refuse|modele de langage|modele de langue|ne m'est pas permis|je dois decliner"
    r"|no puedo (?:ayudar|responder|contestar|atender)|no me es posible|debo rechazar|tengo que rechazar|modelo de lenguaje|no se me permite|me niego|debo declinar|rechazar (?:esta|su)"
    r"|nao posso (?:ajudar|responder|atender)|tenho de recusar|devo recusar|recusar este|modelo de linguagem|nao me e permitido|nao estou autorizad"
)
# Templates may decline in other words: a denial, and what is denied (an answer, help, the request), but no word on what the notes hold.
DENIAL = re.compile(
    r"\b(?:not|never|cannot|\w+n't|unable|declin\w*|refus\w*|sorry|unfortunately|apolog\w+|against|outside|beyond|forbidden|prohibited|khong|tu choi|xin loi|rat tiec|ngoai|nicht|kein\w*|leider|ablehn\w*|verweiger\w*|untersagt|verboten"
    r"|ne|n'\w+|pas|desole\w*|interdit\w*|impossible|no (?:puedo|podemos|puede|me|nos|se|esta|estoy|es|debo|respond\w+|contest\w+|coment\w+|habl\w+)|niego|rechaz\w+|lamento|siento|prohibid\w+|imposible|nao|recus\w+|proibid\w+|impossivel)\b"
)
DENIED = re.compile(
    r"\b(?:answer(?:s|ing|ed)?|respond(?:ing)?|response|reply|assist(?:ing|ance|ant)?|help(?:ing)?|discuss(?:ing|ed|ion)?|request(?:s|ed)?|questions?|topics?|tra loi|cau hoi (?:nay|nhu|ve)|yeu cau nay|giup|ho tro|beantwort\w*|antwort\w*|helfen|anfragen?|fragen?|auskunft|auskunfte"
    r"|repon(?:dre|se|ses)|aider|(?:cette|votre|ta) demande|questions?|requete|sujets?|responder\w*|respuestas?|contestar\w*|ayudar\w*|ayuda|(?:esta|su|tu) (?:peticion|solicitud)|preguntas?|respostas?|ajudar\w*|(?:este|esse|seu|teu) pedido|perguntas?)\b"
)
SPEAKER = re.compile(r"\b(?:language model|assistant|guidelines|mo hinh ngon ngu|sprachmodell|modele de langag?ue?|modelo de lengua\w*|modelo de linguagem|peticion|solicitud|demande|pedido|yeu cau|viec nay|no can do|discuss|comfortable|with (?:that|this)|(?:won't|will not|can't|cannot) (?:do|say|comment))\b")
HELD = re.compile(r"\b(?:notes?|entry|entries|notizen|notiz|eintrag|notas?|ghi chu|anotac\w+|apuntes|document\w*|dokument\w*|tai lieu|registr\w+)\b")
ASKED = {
    "en": "english englisch anglais ingles inglese anh",
    "vi": "vietnamese vietnamesisch vietnamien vietnamita viet",
    "de": "german deutsch allemand aleman alemao duc",
    "fr": "french franzosisch francais frances phap",
    "es": "spanish spanisch espagnol espanol espanhol castellano nha",
    "pt": "portuguese portugiesisch portugais portugues bo",
}
REQUEST = re.compile(r"\b(?:in|auf|en|em|bang tieng|tieng|au)\s+(?:tieng\s+)?([a-z]+)\b")

LAST_MARK = re.compile(r"(?:\s*(?:\[\d+(?:\s*[,;–-]\s*\d+)*\]|\(p\. ?\d+\)|[→✓✔]\s*\d+))+\s*$")
CLOSED = re.compile(r"[.!?…。:][\"'”’»)\]*_]*$")
ITEM = re.compile(r"^\s*(?:[-*•+]|\d{1,3}[.)])(?:\s+|$)")


def plain_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold(text))


def opening(answer: str | None) -> str:
    """The first sentence of an answer (and the next, if it is short), folded, with 0 for numbers and without what it quotes."""
    if not answer:
        return ""
    words: list[str] = []
    for part in re.split(r"(?<=[.!?…:])\s+|\n+", QUOTED.sub(" ", answer).replace("’", "'")):
        words += ["0" if w.isdigit() else w for w in re.findall(r"[^\W_]+(?:'[^\W_]+)*", fold(part))]
        if len(words) > 3:
            break
    return " ".join(words[:OPENING_WORDS])


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    t = re.sub(r"[\s\u200b-\u200f\u2060\ufeff\u00ad]+", " ", answer).strip()
    return not re.search(r"[^\W_]", t) or t.lower() in FILLERS


def is_echo(question: str, answer: str) -> bool:
    """Says nothing but the question, or a whole sentence of it that asks, over again."""
    a = plain_words(answer)
    if len(a) < 3:
        return False
    for part in [question, *re.findall(r"[^.!?\n]+\?", question)]:
        q = plain_words(part)
        if not q:
            continue
        common = sum((Counter(a) & Counter(q)).values())
        if common >= 0.9 * len(a) and common >= 0.8 * len(q):
            return True
    return False


def is_truncated(answer: str) -> bool:
    """Breaks off in the middle of a sentence, list or code."""
    t = answer.rstrip()
    if t.count("```") % 2:
        return True
    if t.endswith("```"):
        return False
    body = LAST_MARK.sub("", t)
    if not body.strip() or body != t:
        return False
    if CLOSED.search(t):
        return False
    lines = [x for x in t.split("\n") if x.strip()]
    items = [x for x in lines if ITEM.match(x)]
    if items and ITEM.match(lines[-1]):
        last = ITEM.sub("", lines[-1]).strip()
        if not last:
            return True
        others = [ITEM.sub("", x).strip() for x in items[:-1]]
        # items that are sentences end as such; items that are phrases end anywhere but in a comma or a little word
        if others and all(CLOSED.search(o) for o in others):
            return True
        return bool(re.search(r"[,;(\"“«]$", last)) or (not others and bool(CLOSED.search(" ".join(lines[:-1]) or ".")) is False)
    before = re.search(r"[.!?…]\s+\S", t) or len(lines) > 1
    words = plain_words(t)
    if before:
        return True
    return len(words) >= 5 or bool(re.search(r"[,;(]\s*[\"“]?$", t))


def languages_asked(question: str) -> set[str]:
    words = set(REQUEST.findall(fold(question)))
    return {code for code, names in ASKED.items() if words & set(names.split())}


def wrong_language(question: str, answer: str, model: LanguageModel) -> bool:
    allowed, _ = analyse(question, model)
    if not allowed:
        return False
    wanted = {model.languages[k] for k in allowed} | languages_asked(question)
    kept, rows = analyse(answer, model)
    if not kept or {model.languages[k] for k in kept} & wanted:
        return False
    words = [w for _, _, s, _ in sentences(answer) for w in s]
    if len(words) < LEAST_WORDS:
        return False
    ll = model.sentence(words)
    return bool(ll.max() - max(ll[i] for i, c in enumerate(model.languages) if c in wanted) >= LANGUAGE_NATS)


def defects(question: str | None, answer: str | None, refuses: bool, model: LanguageModel) -> list[str]:
    if question is None or is_empty(question):
        return []
    if is_empty(answer):
        return ["empty"]
    if is_echo(question, answer):
        return ["echo"]
    out = []
    if refuses:
        out.append("refusal")
    if is_truncated(answer):
        out.append("truncated")
    if wrong_language(question, answer, model):
        out.append("wrong_language")
    return out


def signatures(text: str) -> list[int]:
    """MinHash of an opening's runs: BANDS keys of ROWS values each; a shorter opening is one run."""
    runs = run_set(text)
    base = pd.util.hash_array(np.array(sorted(runs), dtype=object)).astype(np.uint64)
    rng = np.random.default_rng(5)
    mult = rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * 2 + 1
    with np.errstate(over="ignore"):
        least = ((base[:, None] * mult[None, :]) ^ (base[:, None] >> np.uint64(31))).min(axis=0).reshape(BANDS, ROWS)
        keys = least[:, 0] * np.uint64(0x9E3779B97F4A7C15) + least[:, 1] + np.arange(BANDS, dtype=np.uint64)
    return keys.view(np.int64).tolist()


def run_set(text: str) -> frozenset[str]:
    w = text.split()
    return frozenset(" ".join(w[i : i + RUN]) for i in range(max(1, len(w) - RUN + 1)))


def declines(text: str) -> bool:
    return bool(REFUSALS.search(text) or (DENIAL.search(text) and DENIED.search(text) and not HELD.search(text)))


def refuses_alone(text: str) -> bool:
    """Whether an opening of no template is a refusal: a phrase of one, and a word for what is refused or who refuses."""
    return bool(REFUSALS.search(text) and (DENIED.search(text) or SPEAKER.search(text)))


def same_template(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) between alike openings of each cell: all pairs are compared, and as many links given as join them."""
    left, right = [], []
    for _, g in pdf.groupby("cell", sort=False):
        ids, part, cross = g["id"].tolist(), g["part"].tolist(), g["cross"].iat[0]
        runs = [run_set(o) for o in g["opening"]]
        root = list(range(len(ids)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for j in range(len(ids)):
            for i in range(j):
                if (cross and part[i] == part[j]) or top(i) == top(j):
                    continue
                if len(runs[i] & runs[j]) >= SIMILARITY * len(runs[i] | runs[j]):
                    root[top(j)] = top(i)
                    left.append(ids[i])
                    right.append(ids[j])
    return pd.DataFrame({"a": np.array(left, np.int64), "b": np.array(right, np.int64)})


def alike_openings(signed: DataFrame) -> DataFrame:
    """(a, b): links that join all openings (id, opening, bands) with a band in common and SIMILARITY of their runs."""
    banded = signed.select("id", "opening", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).alias("parts"), F.count("*").alias("n")).where("n > 1")
    placed = banded.join(sizes, "band").withColumn("part", F.pmod("id", "parts"))
    # a large band is split: each pair of its parts is a cell
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = spread.select("id", "opening", "part", (F.col("part") != F.col("other")).alias("cross"), F.xxhash64("band", F.least("part", "other"), F.greatest("part", "other")).alias("cell"))
    return cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(by_cell(same_template), "a long, b long").distinct()


def refusal_openings(turns: DataFrame) -> DataFrame:
    """(opening): openings of turns (opening, query) that belong to a refusal template."""

    def subjects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            asked = [set(re.sub(r"\d+", "0", w) if w.isdigit() else w for w in plain_words(q)) for q in pdf["query"]]
            own = [sum(w in q for w in o.split()) / max(1, len(o.split())) for o, q in zip(pdf["opening"], asked)]
            yield pd.DataFrame({"opening": pdf["opening"], "subject": [" ".join(sorted(q)) for q in asked], "own": np.array(own, float)})

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            o = pdf["opening"]
            flags = {n: np.array([bool(f(x)) for x in o], bool) for n, f in (("cue", refuses_alone), ("says", declines), ("held", HELD.search))}
            yield pdf.assign(**flags, bands=pd.Series([signatures(x) for x in o], index=pdf.index, dtype=object))

    # a question put again in other letters, order or numbers is the same; counts are exact
    asked = turns.where("opening <> '' AND query IS NOT NULL").select("opening", "query").distinct().mapInPandas(subjects, "opening string, subject string, own double")
    asked = materialize(asked.groupBy("opening", "subject").agg(F.max("own").alias("own")), "asked")
    counted = asked.groupBy("opening").agg(F.count("*").alias("questions"), F.sum("own").alias("own"))
    signed = materialize(counted.mapInPandas(sign, "opening string, questions long, own double, cue boolean, says boolean, held boolean, bands array<long>").withColumn("id", F.xxhash64("opening")), "openings")
    groups = components(alike_openings(signed))
    placed = materialize(signed.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("grp", F.coalesce("component", "id")).drop("bands", "component"), "clusters")
    said = F.sum(F.when(F.col("says"), F.col("questions")).otherwise(0))
    held = F.sum(F.when(F.col("held"), F.col("questions")).otherwise(0))
    grouped = placed.groupBy("grp").agg(F.sum("questions").alias("n"), F.sum("own").alias("shared"), said.alias("said"), held.alias("held"))
    several = grouped.where((F.col("n") >= MIN_QUESTIONS) & (F.col("shared") <= F.col("n") * OWN_SHARE))

    # words of all questions, and of the openings by the questions they answer
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(F.translate(c, "'", " "), " "), lambda w: w != ""))).alias("word")
    subject = asked.select("subject").distinct()
    in_questions = materialize(subject.select(words("subject")).groupBy("word").agg(F.count("*").alias("q")), "question_words")
    total = subject.count()
    members = placed.join(several.select("grp", "n"), "grp")
    telling = in_questions.where(F.col("q") <= COMMON_WORD * total).select("word")
    shared = members.select("grp", "n", "opening").join(asked.select("opening", "subject"), "opening").select("grp", "n", words("subject")).groupBy("grp", "n", "word").agg(F.count("*").alias("c"))
    related = shared.where((F.col("c") > RELATED * F.col("n")) & (F.col("c") > 1)).join(telling, "word", "left_semi").select("grp").distinct()
    templates = several.join(related, "grp", "left_anti")
    in_openings = placed.select("questions", words("opening")).groupBy("word").agg(F.sum("questions").alias("o"))
    often = members.where((F.col("n") >= RECURS) & (F.size(F.split("opening", " ")) >= WHOLE_WORDS) & ~F.col("opening").rlike(r"\b0\b")).select("grp", "questions", "opening", words("opening"))
    foreign = (F.coalesce("q", F.lit(0)) * FOREIGN <= F.col("o")).cast("int")
    strange = often.join(in_openings, "word").join(in_questions, "word", "left").groupBy("grp", "opening", "questions").agg(F.avg(foreign).alias("f"))
    strange = strange.groupBy("grp").agg((F.sum(F.col("f") * F.col("questions")) / F.sum("questions")).alias("foreign"))
    refuses = (F.col("said") * 2 > F.col("n")) | ((F.col("foreign") >= FOREIGN_SHARE) & (F.col("held") * 2 <= F.col("n")))
    judged = placed.join(templates.join(strange, "grp", "left").select("grp", F.coalesce(refuses, F.lit(False)).alias("refuses")), "grp", "left")
    return judged.where(F.coalesce("refuses", F.col("cue"))).select("opening").distinct()


def register(reg: Registry) -> None:
    @reg.query("p2_found")
    def p2_found(spark: SparkSession, sf: str) -> DataFrame:
        turns = once(read_table(spark, sf, "chat_turns"), ["turn_id"], ["query", "answer"], newest="loaded_at")
        shared = spark.sparkContext.broadcast(fitted(spark, sf))

        def open_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(opening=pd.Series([opening(a) for a in pdf["answer"]], index=pdf.index, dtype=object))

        opened = materialize(turns.mapInPandas(open_, "turn_id long, query string, answer string, opening string"), "turns")
        known = refusal_openings(opened.select("opening", "query")).withColumn("refuses", F.lit(True))
        judged = opened.join(known, "opening", "left").select("turn_id", "query", "answer", F.coalesce("refuses", F.lit(False)).alias("refuses"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = [(t, d) for t, q, a, r in zip(pdf["turn_id"], pdf["query"], pdf["answer"], pdf["refuses"]) for d in defects(q, a, r, shared.value)]
                yield pd.DataFrame(out, columns=["turn_id", "defect"])

        return judged.mapInPandas(run, "turn_id long, defect string")
