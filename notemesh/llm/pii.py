"""Problem 7: personal information in free text, found and replaced by typed placeholders.

Regular expressions propose spans with a score, nearby context words adjust it,
and spans that reach THRESHOLD count. A number without such words is below it;
a checksum of the number's own scheme (Luhn, mod 97, mod 23, mod 11) confirms it,
a failed one doesn't. A number that words name counts with a wrong checksum too,
since people mistype them. Inline markup is looked through: patterns run over the text
without it, and positions are those of the original text.

Given names come from the table of nicknames and from names of the knowledge
graph that stand beside GIVEN_SURNAMES different surnames; the list of such words
is short beside the names themselves and is sent to the workers.

Defined cases: null and empty texts have no items; rows delivered twice count
once; overlapping proposals of different types are settled by score, then
length; positions are code points of the original text, from 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemesh.llm.names import BUSINESS, LEGAL, SMALL, TITLES, fold, tokens
from notemesh.plans.registry import Registry
from notemesh.sources import once, read_table

THRESHOLD = 0.55
#: A word of the graph's names is a given name if it stands beside this many surnames.
GIVEN_SURNAMES = 4
NEAR = 42

# Words near a number that tell what it is.
PHONE_WORDS = re.compile(
    r"(?i)\b(?:tel|phone|mobile|mobil|cell|ring|call|text me|fax|number on the door|landline|gọi|goi so|điện thoại|dien thoai|zalo|anrufen|telefon|handy|rufnummer|nummer an der tür|appeler|téléphone|telephone|numéro|numero sur|portable"
    r"|llamar|teléfono|telefono|número de la puerta|numero de la puerta|móvil|ligar|telefone|telemóvel|número na porta|numero na porta|nach sechs|nummer|sms|ext|hotline|tür|tur)\b"
)
ID_WORDS = re.compile(
    r"(?i)(?:passport|id card|national id|identity card|identity number|social security|ssn|tax id|tax number|tax no|insurance number|hộ chiếu|ho chieu|căn cước|can cuoc|chứng minh|chung minh|cmnd|cccd|mã số thuế|ma so thue|bảo hiểm xã hội|bao hiem xa hoi|an sinh"
    r"|reisepass|ausweis|personalausweis|steuer-?id|steuernummer|steueridentifikation|sozialversicherung|passeport|carte d['’]identité|carte d['’]identite|numéro fiscal|numero fiscal|sécurité sociale|securite sociale"
    r"|pasaporte|documento de identidad|carné de identidad|\bdni\b|\bnie\b|\bnif\b|número fiscal|seguridad social|identificación fiscal|identificacion fiscal|passaporte|bilhete de identidade|cartão de cidadão|cartao de cidadao|contribuinte|segurança social|seguranca social|\bcpf\b)(?:[^.\n|]|\b(?:no|nr|n)\.[º°]?){0,28}$"
)
NOT_PERSONAL = re.compile(r"(?i)(?:isbn[- ]?(?:like)?|order|invoice|batch|lot|reference|ref|ticket|version|firmware|serial|bestellung|rechnung|charge|commande|facture|pedido|factura|encomenda|fatura|đơn hàng|hóa đơn|lô)[^\w\n]{0,3}(?:no|nr|n[.º°]+|số)?[.:#\s]*$")

EMAIL = re.compile(
    r"[\w.+%-]+(?:@|\[@\]|\(@\)|\s?\[at\]\s?|\s?\(at\)\s?)[A-Za-z0-9-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\s?\[\.\]\s?)[A-Za-z0-9-]+)+"
    r"|[\w.+%-]+\s+(?:at|\(at\)|\[at\]|AT)\s+[A-Za-z0-9-]+(?:\s+(?:dot|\(dot\)|\[dot\]|DOT)\s+[A-Za-z0-9-]+)+"
)
PHONES = (
    (0.9, re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .\-]?\(\d{1,4}\))?(?:[ .\-]?\d{1,4}){2,5}(?!\d)")),
    (0.8, re.compile(r"(?<![\w.])00\d{1,2}(?: \d{2,4}){2,5}(?!\d)")),
    (0.8, re.compile(r"(?<![\w.(])\(0?\d{2,4}\)[ .]?\d{3,4}[-. ]\d{3,4}(?!\d)")),
    (0.6, re.compile(r"(?<![\w.,/-])0\d{2,3}([ .\-])\d{3}\1\d{3,4}(?![\d-])")),
    (0.6, re.compile(r"(?<![\w.,/-])\d{3}[- ]\d{4}\s?(?:ext|x|Durchwahl|poste|máy lẻ)\.?\s?\d{1,5}\b")),
    (0.3, re.compile(r"(?<![\w.,/-])\d{3}-\d{4}-\d{3}(?![\d-])")),
    (0.25, re.compile(r"(?<![\w.,/(-])\d{3}[- .]\d{4}(?![\d-])")),
    (0.25, re.compile(r"(?<![\w.,/(-])\d{3}[-. ]\d{3}[-. ]\d{4}(?![\d-])")),
)
IDNO = re.compile(r"(?<![\w/.-])(?:(?!ID|NO|NR)[A-Z]{1,3} ?)?\d(?:[ .\-]?\d){5,14}(?:[ \-]?[A-Z])?(?![\w-])")

_NAME = r"[A-ZÀ-ÖØ-ÞĐ][\w'’]*(?:[- ][A-ZÀ-ÖØ-ÞĐ][\w'’]*){0,2}"
_STREET = r"(?:Street|St\b\.?|Road|Rd\b\.?|Lane|Ln\b\.?|Avenue|Ave\b\.?|Boulevard|Blvd\b\.?|Drive|Dr\b\.?|Close|Court|Ct\b\.?|Way|Row|Quay|Terrace|Square|Place|Hill|Walk|Crescent)"
_RUE = r"(?:rue|avenue|boulevard|bd|place|chemin|allée|allee|quai|impasse|cours|route|Rue|RUE)\s+(?:de la |de l['’]|du |des |de |d['’])?"
#: What may follow a house number, and what may stand before one.
NUMBER_FIRST = re.compile(rf"\d{{1,4}}(?:\s?[a-zA-Z])?\s+{_NAME}\s+{_STREET}|\d{{1,4}}\s?(?:bis|ter|[a-d])?,?\s+{_RUE}{_NAME}|\d{{1,4}}\w?\s+(?:đường|duong|phố|pho|ngõ|ngo|hẻm|hem|Đường|Phố)\s+{_NAME}")
FLAT = re.compile(r"\b(?:(?:[Ff]lat|[Aa]pt\.?|[Aa]partment|[Uu]nit|[Ss]uite|FLAT|APT|UNIT)\s+\w{1,4},\s+|(?:[Ss]ố nhà|[Ss]o nha|[Ss]ố|[Ss]o|SỐ)\s+)$")
STREET_FIRST = re.compile(
    rf"\b(?:(?:Calle|Avenida|Avda\.?|Av\.|Plaza|Paseo|Camino|Carrera|C/|Rua|Travessa|Praça|Praca|Largo|Alameda|Estrada|Via|CALLE|RUA)\s+(?:de la |de los |de las |del |de |do |da |dos |das )?{_NAME},?\s+(?:n[.º°]*\s?)?"
    rf"|[A-ZÄÖÜ][\wäöüß]*(?:[- ]?[A-ZÄÖÜ][\wäöüß]*)?[- ]?(?:[Ww]eg|[Ss]traße|[Ss]trasse|[Ss]tr\.|[Gg]asse|[Pp]latz|[Aa]llee|[Uu]fer|[Rr]ing|[Dd]amm)\s+)$"
)
HOUSE = re.compile(r"\d{1,4}(?:\s?[a-zA-Z]\b)?(?![\w%€$])")
DIGITS = re.compile(r"\d+")
EMAIL_SIGN = re.compile(r"@|[ (\[](?:dot|DOT)[ )\]]|[(\[]at[)\]]")


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (int(d) * 2 - 9 if int(d) > 4 else int(d) * 2) for i, d in enumerate(reversed(digits)))
    return len(digits) >= 8 and total % 10 == 0


def mod97(digits: str) -> bool:
    """Whether the last two digits are 97 less the rest modulo 97."""
    return len(digits) >= 10 and 97 - int(digits[:-2]) % 97 == int(digits[-2:])


def mod23(number: str) -> bool:
    m = re.fullmatch(r"([XYZ]?)(\d{7,8})[ -]?([A-Z])", number)
    if not m or len(m[1] + m[2]) != 8:
        return False
    lead = str("XYZ".index(m[1])) if m[1] else ""
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(lead + m[2]) % 23] == m[3]


def mod11(digits: str) -> bool:
    """Eleven digits, of which the last two check those before them, weighted from 2 up."""
    if len(digits) != 11 or len(set(digits)) == 1:
        return False
    for n in (9, 10):
        rest = sum(int(d) * (n + 1 - i) for i, d in enumerate(digits[:n])) * 10 % 11 % 10
        if rest != int(digits[n]):
            return False
    return True


def mod11_10(digits: str) -> bool:
    """Eleven digits with a check digit by ISO 7064 mod 11,10."""
    p = 10
    for d in digits[:10]:
        p = ((int(d) + p) % 10 or 10) * 2 % 11
    return len(digits) == 11 and digits[0] != "0" and (11 - p) % 10 == int(digits[10])


# Numbers that are written in the way of a scheme with a checksum, and the check.
CHECKED = (
    (re.compile(r"[XYZ]?\d{7,8}[ -]?[A-Z]"), lambda n, d: mod23(n)),
    (re.compile(r"[12] ?\d\d ?(?:0[1-9]|1[0-2]) ?\d\d ?\d{3} ?\d{3} ?\d\d"), lambda n, d: mod97(d)),
    (re.compile(r"\d\d\.(?:0\d|1[0-2])\.[0-3]\d-\d{3}\.\d\d"), lambda n, d: mod97(d) or mod97("2" + d)),
    (re.compile(r"\d{3}\.\d{3}\.\d{3}-\d\d"), lambda n, d: mod11(d)),
    (re.compile(r"\d\d \d{3} \d{3} \d{3}"), lambda n, d: mod11_10(d)),
    (re.compile(r"(?:\d\d)?\d\d(?:0[1-9]|1[0-2])(?:[0-2]\d|3[01])-\d{4}"), lambda n, d: luhn(d[-10:])),
)


def checked(number: str) -> bool:
    """Whether a number is of a scheme with a checksum and has the right one."""
    digits = re.sub(r"\D", "", number)
    return any(p.fullmatch(number) and right(number, digits) for p, right in CHECKED)


INLINE = re.compile(
    r"</?(?:b|i|em|strong|u|s|span|font|a|code|mark|small|sub|sup)\b[^<>]*>|&nbsp;|&#160;|\*{1,3}|~~|`|'{2,3}|(?<![\w_])_{1,2}(?=\w)|(?<=[\w.,!])_{1,2}(?![\w_@])"
    r"|\\(?:emph|textbf|textit|texttt|underline)\{|\}|\]\([^)\s]*\)|!?\[(?=[^\]\n@]{1,80}\]\()|\[\[(?:[^\[\]|\n]*\|)?|\]\]",
    re.I,
)
SIGNS = re.compile(r"''|[<&*~`_\\}\]\[!]")


def look_through(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text without inline markup, and (position there, position in the original) of each piece."""
    parts, starts, at, length = [], [], 0, 0
    sign = SIGNS.search(text)
    while sign:
        m = INLINE.match(text, sign.start())
        if m is None:
            sign = SIGNS.search(text, sign.end())
            continue
        if m.start() > at:
            parts.append(text[at : m.start()])
            starts.append((length, at))
            length += m.start() - at
        if m[0][0] == "&":
            parts.append(" ")
            starts.append((length, m.start()))
            length += 1
        at = m.end()
        sign = SIGNS.search(text, at)
    if not starts and not at:
        return text, [(0, 0)]
    parts.append(text[at:])
    starts.append((length, at))
    return "".join(parts), starts


def original(starts: list[tuple[int, int]], pos: int) -> int:
    lo, hi = 0, len(starts)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if starts[mid][0] <= pos else (lo, mid)
    return starts[lo][1] + pos - starts[lo][0]


# Words that begin sentences and no surname.
OPENERS = frozenset(
    "the a an in on at by for as and but of to if we i they he she it that this these those there here when while after before between during meanwhile once ask contact signed thanks last early late "
    "der die das ein eine und im am zum zur bei nach vor mit für wir ich sie es wegen bitte le la les un une et en au à de du des il elle nous je por el los las y con para que se o os as um uma em no na "
    "và các những một của cho với khi vì để tại trong sau trước hãy xin demander pregunta pergunta fragen hỏi hoi hay".split()
)
_WORD = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"


CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞĐ][^\W\d_]+")


EDGE = re.compile(r"[@/+\w]|\.\w|-\w")
EDGE_BEFORE = re.compile(r"[\w@./+-]")
BEFORE = re.compile(rf"(?P<s>{_WORD})(?P<sep>,[ \t]?\n?| |\n)$")
AFTER = re.compile(rf"(?:[ ]+[A-ZĐ]\.?(?=[ ]))?[ \n]+(?P<s>{_WORD})")
MIDDLE = re.compile(r"[ ]+[A-ZĐ]\.")


def _surname(w: str, given: frozenset[str]) -> bool:
    return len(w) >= 3 and w[0].isupper() and fold(w) not in OPENERS and fold(w) not in given and w.lower() not in BUSINESS


def names_in(text: str, given: frozenset[str]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    taken = -1
    for m in CAPITAL.finditer(text):
        word = m[0].lower()
        if (word if word.isascii() else fold(word)) not in given or m.start() < taken or EDGE.match(text, m.end()):
            continue
        if m.start() and EDGE_BEFORE.match(text[m.start() - 1]):
            continue
        before = BEFORE.search(text, max(0, m.start() - 40), m.start())
        after = AFTER.match(text, m.end(), m.end() + 48)
        ahead = before is not None and _surname(before["s"], given) and before.start() >= taken
        behind = after is not None and _surname(after["s"], given)
        if behind:
            out.append((m.start(), after.end()))
            taken = after.end()
        elif ahead:
            mid = MIDDLE.match(text, m.end())
            out.append((before.start(), mid.end() if mid else m.end()))
            taken = m.end()
    return out


ID_START = re.compile(r"[A-Z]{1,3} ?$")


def _addresses(text: str, at: int, found: list[tuple[float, int, int, str]]) -> None:
    """Proposes the address that has its house number at `at`."""
    if at and EDGE_BEFORE.match(text[at - 1]):
        return
    m = NUMBER_FIRST.match(text, at)
    if m:
        flat = FLAT.search(text[max(0, at - 24) : at])
        found.append((0.8, at - (len(flat[0]) if flat else 0), m.end(), "address"))
        return
    m = HOUSE.match(text, at)
    if m:
        lead = text[max(0, at - 64) : at]
        street = STREET_FIRST.search(lead)
        if street:
            found.append((0.8, at - len(lead) + street.start(), m.end(), "address"))


def find(text: str | None, given: frozenset[str]) -> list[tuple[str, int, int]]:
    """(type, start, end) of the personal items of a text, by position."""
    if not text:
        return []
    plain, starts = look_through(text)
    found: list[tuple[float, int, int, str]] = []
    if EMAIL_SIGN.search(plain):
        for m in EMAIL.finditer(plain):
            lead = len(m[0]) - len(m[0].lstrip("._%+-"))
            found.append((1.0, m.start() + lead, m.end(), "email"))
    done = 0
    for d in DIGITS.finditer(plain):
        at = d.start()
        first = at - (1 if at and plain[at - 1] in "+(" else 0)
        if d.end() - at <= 4:
            _addresses(plain, at, found)
        if first < done:
            continue
        for score, pattern in PHONES:
            m = pattern.match(plain, first) or (first < at and pattern.match(plain, at)) or None
            if m and 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                lead, tail = plain[max(0, m.start() - NEAR) : m.start()], plain[m.end() : m.end() + 18]
                s = score + 0.35 * bool(PHONE_WORDS.search(lead) or PHONE_WORDS.search(tail)) - 0.7 * bool(NOT_PERSONAL.search(lead)) - 0.7 * bool(ID_WORDS.search(lead))
                found.append((s, m.start(), m.end(), "phone"))
                done = max(done, m.end())
                break
        begin = ID_START.search(plain, max(0, at - 4), at)
        m = IDNO.match(plain, begin.start() if begin else at) or IDNO.match(plain, at)
        if m:
            lead = plain[max(0, m.start() - 60) : m.start()]
            s = 0.3 + 0.6 * bool(ID_WORDS.search(lead)) - 0.7 * bool(NOT_PERSONAL.search(lead))
            if re.fullmatch(r"(?!9[78]\d-)\d{3}-\d{2}-\d{4}", m[0]):
                s += 0.3
            if checked(m[0]):
                s += 0.35
            found.append((s, m.start(), m.end(), "idno"))
            done = max(done, m.end())
    if given:
        found += [(0.75, a, b, "name") for a, b in names_in(plain, given)]
    good = sorted((f for f in found if f[0] >= THRESHOLD), key=lambda f: (-f[0], f[1] - f[2], f[1], f[3]))
    out: list[tuple[int, int, str]] = []
    for _, a, b, kind in good:
        if all(b <= x or a >= y for x, y, _ in out):
            out.append((a, b, kind))
    return [(kind, original(starts, a), original(starts, b - 1) + 1) for a, b, kind in sorted(out)]


def redact(text: str | None, given: frozenset[str]) -> str | None:
    """The text with [EMAIL], [PHONE], [IDNO], [ADDRESS] and [NAME] for its personal items."""
    if not text:
        return text
    parts, at = [], 0
    for kind, a, b in find(text, given):
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def given_names(spark: SparkSession, sf: str) -> frozenset[str]:
    """Given names and nicknames, folded."""
    table = read_table(spark, sf, "nicknames").toPandas()
    known = {fold(n) for c in ("given_name", "nickname") for n in table[c].dropna()}

    def pairs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = set()
            for n in pdf["name"].dropna():
                t = [x for x in tokens(n) if x not in TITLES and len(x) > 2]
                if 2 <= len(t) <= 3 and not set(t) & (LEGAL | SMALL | set(BUSINESS)):
                    rows |= {(a, b) for a in t for b in t if a != b}
            yield pd.DataFrame(sorted(rows), columns=["t", "u"])

    near = read_table(spark, sf, "entities").select("name").mapInPandas(pairs_of, "t string, u string").distinct()
    # beside known given names stand surnames; a word beside several surnames is a given name too
    surnames = near.where(F.col("t").isin(sorted(known))).select(F.col("u").alias("t")).distinct()
    given = near.join(surnames, "t").groupBy(F.col("u").alias("t")).agg(F.count("*").alias("m")).where(F.col("m") >= GIVEN_SURNAMES).toPandas()["t"]
    return frozenset(known | {t for t in given if len(t) >= 3})


def texts(spark: SparkSession, sf: str) -> DataFrame:
    notes = once(read_table(spark, sf, "notes"), ["doc_id"], ["body"], newest="loaded_at").select(F.lit("notes").alias("src"), F.col("doc_id").alias("rec_key"), F.col("body").alias("text"))
    chunks = once(read_table(spark, sf, "chunks"), ["chunk_id"], ["text"]).select(F.lit("chunks").alias("src"), F.col("chunk_id").alias("rec_key"), "text")
    return notes.unionByName(chunks)


def items(rows: DataFrame, given: frozenset[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(s, k, kind, a) for s, k, t in zip(pdf["src"], pdf["rec_key"], pdf["text"]) for kind, a, _ in find(t, given)]
            yield pd.DataFrame(out, columns=["src", "rec_key", "pii_type", "start_pos"]).astype({"start_pos": "int32"})

    return rows.where("text IS NOT NULL").mapInPandas(run, "src string, rec_key string, pii_type string, start_pos int")


def masked(rows: DataFrame, given: frozenset[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["src", "rec_key"]].assign(text=pd.Series([redact(t, given) for t in pdf["text"]], index=pdf.index, dtype=object))

    return rows.mapInPandas(run, "src string, rec_key string, text string")


def register(reg: Registry) -> None:
    @reg.query("p7_found")
    def p7_found(spark: SparkSession, sf: str) -> DataFrame:
        return items(texts(spark, sf), given_names(spark, sf))

    @reg.query("p7_masked")
    def p7_masked(spark: SparkSession, sf: str) -> DataFrame:
        return masked(texts(spark, sf), given_names(spark, sf))
