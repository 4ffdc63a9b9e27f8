"""Problem 4: variant spellings of the names of persons and organisations, linked.

Every name and alias becomes forms: a *rare part* (a surname, the invented word
of a firm) and a *common part* (given name, kind of business), without titles,
legal forms and case; nicknames and abbreviations are put back to full words.
Forms with the same common part are points of a metric space, the rare part
under the edit distance with transpositions; two forms within RADIUS name the
same one.

The space is partitioned by pivots: in each block of one common part, names are
assigned to their nearest pivot by Levenshtein distance, and by the triangle
inequality a name is repeated in every cell whose pivot is at most 2·RADIUS
farther than its nearest. Pairs within RADIUS edits so meet in some cell.
Transpositions, which Levenshtein distance counts as two edits, keep the letters
of a word and meet in a cell of their sorted letters. Inside a cell an exact
radius join with the true metric finds the pairs.

Entities that share forms, or have forms within the radius, are linked; linked
entities make groups.

Defined cases: null and blank names and aliases give no forms; a name of which
only initials or a lone given name remain gives none (it doesn't tell who is
meant) except an initial with a surname that only one given name fits; rows
delivered twice count once; the type plays no part.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notemesh.operators.components import components
from notemesh.plans import materialize
from notemesh.plans.registry import Registry
from notemesh.sources import read_table

RADIUS = 1
#: A token is common (a given name or a word for a business, not a surname) if the initials of its partners are this many times those
#: of its partners' own partners, there are COMMON_INITIALS at least, and at most KNOWN_SHARE of its partners are known given names or business words.
COMMON_RATIO, COMMON_INITIALS, KNOWN_SHARE = 1.5, 3, 0.2
#: Names per pivot, and the most pivots of a block.
PIVOT_SHARE, MAX_PIVOTS = 16, 256
#: A nickname is learnt if it shares its surname with the full name this often.
NICKNAME_SHARE, NICKNAME_SURNAMES = 0.35, 4

# Words without weight in names, and usual words for a kind of business.
TITLES = frozenset("mr mrs ms miss dr prof professor sir madam herr frau mme mlle sr sra ing".split())
LEGAL = frozenset("ltd limited gmbh sa bv inc incorporated llc co company corp corporation plc ag kg oy ab srl sarl nv spa pty".split())
SMALL = frozenset("the and of und et y e de la".split())
BUSINESS = tuple(
    "brokers brothers ceramics consulting dental department engineering foods glass holdings industries institute instruments insurance "
    "international laboratories logistics manufacturing marine media partners pharma publishing research services shipping solutions "
    "systems technology textiles timber trading transport works".split()
)

ABBREVIATIONS = {
    "bros": "brothers", "ceram": "ceramics", "cerams": "ceramics", "brkrs": "brokers", "brks": "brokers", "cer": "ceramics", "cons": "consulting", "dent": "dental", "dept": "department", "dep": "department",
    "eng": "engineering", "engr": "engineering", "engrg": "engineering", "fds": "foods", "gl": "glass", "ins": "insurance", "inst": "institute", "instr": "instruments",
    "int": "international", "intl": "international", "lab": "laboratories", "labs": "laboratories", "log": "logistics", "mar": "marine", "mfg": "manufacturing",
    "prtnrs": "partners", "ptnrs": "partners", "pub": "publishing", "publ": "publishing", "res": "research", "serv": "services", "svc": "services", "svcs": "services",
    "tech": "technology", "text": "textiles", "tmbr": "timber", "trad": "trading", "trdg": "trading", "trans": "transport",
}


def fold(s: str) -> str:
    s = unicodedata.normalize("NFD", s.lower()).replace("đ", "d").replace("ß", "ss").replace("ø", "o").replace("ł", "l")
    return "".join(c for c in s if not unicodedata.combining(c))


def tokens(name: str) -> list[str]:
    s = fold(name).replace("&", " and ")
    s = re.sub(r"\b(\w)\.(?=\w\b)", r"\1", s)  # s.a. → sa
    s = re.sub(r"(?<=\w)[-'’](?=\w)", "", s)
    return re.findall(r"[^\W_]+", s)


def edits(a: str, b: str, most: int) -> int:
    """Damerau–Levenshtein distance (unrestricted, a true metric), or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        seen = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), seen
            cost = 0 if x == y else 1
            if x == y:
                seen = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return min(d[-1][-1], most + 1)


def subsequence(short: str, word: str) -> bool:
    at = iter(word)
    return short[:1] == word[:1] and all(c in at for c in short)


class Vocabulary:
    """Common tokens, with nicknames; small and sent to the workers."""

    def __init__(self, common: dict[str, int], nicknames: dict[str, str]):
        # a spelling one edit from a far more common token is a slip, however often it occurs
        known = set(nicknames) | set(nicknames.values()) | set(BUSINESS)
        by_size = sorted(common, key=lambda t: (-common[t], t))
        self.common: set[str] = set(known)
        for t in by_size:
            if t not in known and not any(common.get(u, 0) > 8 * common[t] and edits(t, u, 1) == 1 for u in self.common if abs(len(u) - len(t)) <= 1):
                self.common.add(t)
        self.known, self.count = known, common
        self.nicknames = dict(nicknames)
        self.by_deletion: dict[str, set[str]] = defaultdict(set)
        for t in self.common:
            for v in self._deletions(t):
                self.by_deletion[v].add(t)
        self.snapped: dict[str, str | None] = {}

    @staticmethod
    def _deletions(t: str) -> set[str]:
        return {t} | {t[:i] + t[i + 1 :] for i in range(len(t))}

    def snap(self, t: str) -> str | None:
        """The common tokens within one edit, joined by bars; None if there is none."""
        if t not in self.snapped:
            near = {u for v in self._deletions(t) for u in self.by_deletion.get(v, ()) if len(u) >= 4 and edits(t, u, 1) <= 1} if len(t) >= 4 else set()
            self.snapped[t] = near.pop() if len(near) == 1 else "|".join(sorted(near)) or None
        return self.snapped[t]

    def expand(self, t: str) -> str | None:
        """The business word that `t` abbreviates: one with its letters in order, the nearest in length."""
        fits = sorted((len(w), w) for w in BUSINESS if 3 <= len(t) < len(w) and not re.search("[aeiou]", t[1:]) and subsequence(t, w))
        return fits[0][1] if fits else None


def forms_of(name: str | None, vocab: Vocabulary) -> list[tuple[str, str, str]]:
    """(rare, common, initial) forms of a name; the initial is set only if no common part is left."""
    if not name or not name.strip():
        return []
    all_ = tokens(name)
    words = [ABBREVIATIONS.get(t, t) for t in all_ if t not in TITLES and t not in LEGAL and t not in SMALL]
    initials = [t for t in words if len(t) <= 2 and not t.isdigit()]
    if len(all_) == 2 and len(words) == 1 and not initials:
        # beside a lone surname two letters are initials, even if they spell a title or legal form
        initials = [t for t in all_ if len(t) <= 2 and t not in words]
    words = [t for t in words if t not in initials]
    rare = [t for t in words if t not in vocab.common]
    common = [t for t in words if t in vocab.common]
    for t in list(rare):
        if len(rare) < 2:
            break
        full = vocab.snap(t) or (vocab.expand(t) if len(t) <= 5 else None)
        near = full.split("|") if full else []
        business = [w for w in near if w in BUSINESS]
        if business or any(w in BUSINESS for w in common):  # a firm's name has no given names
            near = business
        if len(near) == 1:
            rare.remove(t)
            common.append(near[0])
    if not rare and len(full := {vocab.nicknames.get(t, t) for t in common}) > 1:
        # all are common: the least common one, a known one last, tells who is meant
        rare = [min(full, key=lambda t: (t in vocab.known, vocab.count.get(t, 0), t))]
        common = sorted(full - set(rare))
    # a single strange word beside an abbreviation of two letters is a firm's name; its business stays unknown
    if not rare or len("".join(rare)) < 4:
        return []
    key = " ".join(sorted({vocab.nicknames.get(t, t) for t in common}))
    initial = initials[0][0] if initials and not key else ""
    if not key and not initial and len(rare) == 1:
        return []
    out = {("".join(rare), key, initial)}
    if len(rare) == 2:
        out.add(("".join(reversed(rare)), key, initial))
        if not key:  # a given name that isn't known, such as a nickname: its first letter may tell
            short, surname = sorted(rare, key=len)
            if len(surname) >= 4:
                out.add((surname, "", short[0]))
    return sorted(out)


def by_cell(work: Callable[[pd.DataFrame], pd.DataFrame], cell: str = "cell") -> Callable:
    """For mapInPandas over partitions sorted by `cell`: calls `work` with whole cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            other = np.flatnonzero(pdf[cell].to_numpy() != pdf[cell].iat[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield work(pd.concat([*held, pdf.iloc[:cut]]))
                held = []
            held.append(pdf.iloc[cut:])
        if held:
            yield work(pd.concat(held))

    return run


def _letters(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for i, w in enumerate(words):
        m = 0
        for c in w:
            m |= 1 << (ord(c) % 61)
        out[i] = m
    return out


def radius_join(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of forms of one cell within RADIUS of each other, by the true metric."""
    left, right = [], []
    for _, g in pdf.groupby("cell", sort=False):
        words, ids = g["rare"].tolist(), g["form"].to_numpy(np.int64)
        if len(words) < 2:
            continue
        mask, size = _letters(words), np.array([len(w) for w in words])
        step = max(1, (1 << 21) // len(words))
        for at in range(0, len(words), step):
            # an edit changes at most two letters of the set, and one of the length
            near = (np.bitwise_count(mask[at : at + step, None] ^ mask[None, :]) <= 2 * RADIUS) & (np.abs(size[at : at + step, None] - size[None, :]) <= RADIUS)
            for i, j in zip(*np.nonzero(near)):
                i += at
                if i < j and edits(words[i], words[j], RADIUS) <= RADIUS:
                    left.append(ids[i])
                    right.append(ids[j])
    return pd.DataFrame({"a": np.array(left, np.int64), "b": np.array(right, np.int64)})


def within_radius(forms: DataFrame) -> DataFrame:
    """(a, b): ids of forms (form long, rare, common) of one common part within RADIUS of each other."""
    block = forms.groupBy("common").agg(F.count("*").alias("size"))
    nth = F.row_number().over(Window.partitionBy("common").orderBy(F.xxhash64("rare"), "rare"))
    ranked = forms.select("common", "rare").withColumn("nth", nth).where(F.col("nth") <= MAX_PIVOTS)
    wanted = F.greatest(F.lit(1), F.least(F.lit(MAX_PIVOTS), F.floor(F.col("size") / PIVOT_SHARE)))
    pivots = ranked.join(block, "common").where(F.col("nth") <= wanted).groupBy("common").agg(F.sort_array(F.collect_list("rare")).alias("pivots"))
    away = forms.join(pivots, "common").withColumn("far", F.transform("pivots", lambda p: F.levenshtein(F.col("rare"), p)))
    near = F.array_min("far") + F.lit(2 * RADIUS)
    cells = F.filter(F.sequence(F.lit(0), F.size("far") - 1), lambda i: F.get("far", i) <= near)
    letters = F.array_join(F.array_sort(F.split("rare", "")), "")
    keys = F.concat(F.transform(cells, lambda i: F.xxhash64("common", i)), F.array(F.xxhash64("common", letters)))
    spread = away.select("form", "rare", F.explode(keys).alias("cell"))
    return spread.repartition("cell").sortWithinPartitions("cell").mapInPandas(by_cell(radius_join), "a long, b long").distinct()


def learnt_nicknames(forms: DataFrame, known: dict[str, str]) -> dict[str, str]:
    """Short → full given names that share surnames, with the first letter, too often for chance.

    Counted over all forms; the pairs of common words that reach the driver
    passed the support threshold, and common words are few.
    """
    one = forms.where("common <> '' AND NOT common LIKE '% %'").select("rare", "common").distinct()
    per = one.groupBy("common").agg(F.count("*").alias("n")).where(F.col("n") >= NICKNAME_SURNAMES)
    # a surname has the few given names of a family
    pairs = one.withColumnRenamed("common", "short").join(one.withColumnRenamed("common", "full"), "rare").where("short <> full AND left(short, 1) = left(full, 1) AND length(short) < length(full)")
    seen = pairs.groupBy("short", "full").agg(F.count("*").alias("both")).join(per.withColumnRenamed("common", "short"), "short")
    good = seen.where((F.col("both") >= NICKNAME_SURNAMES) & (F.col("both") >= F.col("n") * NICKNAME_SHARE))
    best: dict[str, tuple[int, str]] = {}
    for r in good.toPandas().itertuples():
        if r.short not in known.values() and r.short not in known:
            best[r.short] = max(best.get(r.short, (0, "")), (r.both, r.full))
    return {s: f for s, (_, f) in best.items()}


def common_tokens(names: DataFrame, known: frozenset[str]) -> dict[str, int]:
    """Common tokens of names (name), and the known ones that occur, with the number of their partners.

    A given name stands beside surnames of many families, each of which has few given
    names; a surname, however frequent, stands beside given names that have many
    surnames. Spellings of one name mostly share the initial, so initials are counted.
    """

    def pairs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = {(a, b, a in known, b in known) for n in pdf["name"] for t in [{w for w in tokens(n) if len(w) > 2} - TITLES - LEGAL - SMALL] for a in t for b in t if a != b}
            yield pd.DataFrame(sorted(rows), columns=["t", "u", "sure", "of_sure"])

    together = materialize(names.mapInPandas(pairs_of, "t string, u string, sure boolean, of_sure boolean").distinct(), "together")
    initials = F.count_distinct(F.left("u", F.lit(1)))
    per = together.groupBy("t").agg(initials.alias("initials"), F.count("*").alias("n"), F.first("sure").alias("sure"), F.avg(F.col("of_sure").cast("int")).alias("share"))
    theirs = together.join(per.select(F.col("t").alias("u"), F.col("initials").alias("theirs")), "u").groupBy("t").agg(F.avg("theirs").alias("theirs"))
    rule = (F.col("initials") >= COMMON_INITIALS) & (F.col("initials") >= COMMON_RATIO * F.col("theirs")) & (F.col("share") <= KNOWN_SHARE)
    got = per.join(theirs, "t").where(F.col("sure") | rule).select("t", "n").toPandas()
    return dict(zip(got["t"], got["n"].tolist()))


def link(entities: DataFrame, nicknames: dict[str, str]) -> DataFrame:
    """(id, grp): entities (id, name, aliases) that are linked to another, with their group."""
    spark = entities.sparkSession
    named = entities.where("id IS NOT NULL").select("id", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"))
    named = materialize(named.where("name IS NOT NULL AND trim(name) <> ''").distinct(), "names")

    common = common_tokens(named.select("name"), frozenset(nicknames) | frozenset(nicknames.values()) | frozenset(BUSINESS))
    vocab = Vocabulary(common, nicknames)

    def forms_with(shared) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(i, *f) for i, n in zip(pdf["id"], pdf["name"]) for f in forms_of(n, shared.value)]
                yield pd.DataFrame(rows, columns=["id", "rare", "common", "initial"])

        return run

    shape = "id string, rare string, common string, initial string"
    first = named.mapInPandas(forms_with(spark.sparkContext.broadcast(vocab)), shape)
    extra = learnt_nicknames(first.select("rare", "common").distinct(), nicknames)
    if extra:
        vocab = Vocabulary(common, {**nicknames, **extra})
    got = materialize(named.mapInPandas(forms_with(spark.sparkContext.broadcast(vocab)), shape).distinct(), "forms")
    full = got.where("initial = ''").withColumn("form", F.xxhash64("rare", "common"))
    near = within_radius(full.select("form", "rare", "common").distinct())
    # an initial stands for the only given name that fits
    given = full.where("common <> ''").select("rare", "common", "form").distinct()
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    slips = given.join(both, given["form"] == both["a"]).select(F.col("b").alias("form"), F.col("common").alias("as"), F.col("form").alias("of"))
    spelt = given.select("form", "rare").join(slips, "form").select("rare", F.col("as").alias("common"), F.col("of").alias("form"))
    fits = given.unionByName(spelt).withColumn("initial", F.left("common", F.lit(1)))
    only = fits.groupBy("rare", "initial").agg(F.count_distinct("common").alias("n"), F.min("form").alias("form")).where("n = 1")
    short = got.where("initial <> ''").select("id", "rare", "initial").join(only, ["rare", "initial"]).select("id", "form")
    # initials that no given name fits still agree among themselves
    lone = got.where("initial <> ''").join(only, ["rare", "initial"], "left_anti").join(fits.select("rare", "initial").distinct(), ["rare", "initial"], "left_anti").select("id", F.xxhash64("rare", F.lit("initial"), "initial").alias("form"))
    node = F.xxhash64(F.lit("entity"), "id")
    spokes = full.select("id", "form").unionByName(short).unionByName(lone).distinct()
    edges = spokes.select(node.alias("a"), F.col("form").alias("b")).unionByName(near)
    groups = components(edges)
    return entities.where("id IS NOT NULL").select("id").distinct().withColumn("node", node).join(groups, "node").select("id", F.col("component").alias("grp"))


def register(reg: Registry) -> None:
    def linked_entities(spark: SparkSession, sf: str) -> DataFrame:
        table = read_table(spark, sf, "nicknames").where("given_name IS NOT NULL AND nickname IS NOT NULL").toPandas()
        nicknames = {fold(n): fold(g) for g, n in zip(table["given_name"], table["nickname"])}
        return link(read_table(spark, sf, "entities").select("id", "name", "aliases"), nicknames)

    @reg.query("p4_found")
    def p4_found(spark: SparkSession, sf: str) -> DataFrame:
        linked = materialize(linked_entities(spark, sf), "linked")
        many = linked.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp")
        kept = linked.join(many, "grp", "left_semi")
        # the result is all pairs of a group, as its definition asks
        one, two = kept.withColumnRenamed("id", "entity_id_a"), kept.withColumnRenamed("id", "entity_id_b")
        return one.join(two, "grp").where("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b")

    @reg.query("p4_groups")
    def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
        """Every entity with a name that tells who is meant, and its group."""
        return linked_entities(spark, sf).select(F.col("id").alias("entity_id"), "grp")
