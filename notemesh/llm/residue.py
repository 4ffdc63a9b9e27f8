"""Problem 10: template residue, filler, error pages and script notices.

A multi-pattern automaton (Aho–Corasick) with phrases of several languages, the
words of dummy text and the openings of template fields runs over every whole
text. The characters its matches cover, as a share of those that aren't page
furniture, decide: a text that mostly consists of such phrases or words is a
left-over; one that quotes a phrase among real sentences is not. Dummy words are
the usual Latin ones and those the corpus shows to be such: words of which nearly
all documents have several of the usual ones (counted over all documents).

Openings of fields are read with the fields' syntax. Fields count wherever they
stand for a value (a line, the value of a label, a heading, a salutation), even
with real text around them; inside sentences they count if there are several or
one stands for a name, unless the sentence speaks about fields.

Defined cases: null, empty and blank texts are no cases; repeated rows of a key
count once; one kind per document, in the order placeholder, script_notice,
error_page, filler by coverage; extra columns play no part.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemesh.plans.registry import Registry
from notemesh.sources import read_table

#: Share of a text that the phrases of one kind must cover; dummy words must be this many.
COVERAGE, LEAST_DUMMY = 0.5, 3
#: Dummy words are learnt from documents in which the usual ones, at least LEAST_DUMMY, are SEED_SHARE of the words: words that stand in
#: LEARN_DOCS such documents, of all their documents LEARN_SHARE. The MOST_LEARNT most frequent make the model that is sent to the workers.
SEED_SHARE, LEARN_DOCS, LEARN_SHARE, MOST_LEARNT = 0.15, 3, 0.6, 20_000

# Phrases, lower case; 0 stands for a number. The first words of a message are enough, its sentence counts as covered.
SCRIPT_NOTICE = """
enable javascript|enable scripts|turn on scripts|turn on javascript|javascript is disabled|javascript is required|requires javascript|javascript required|scripts are blocked|
scripts are allowed|scripts and cookies must be allowed|does not run scripts|without js enabled|without javascript enabled|checking your browser|noscript
bật javascript|cần javascript|chặn script|cho phép script|bật script|tắt javascript
aktivieren sie javascript|javascript aktivieren|javascript ist deaktiviert|ohne skripte|skripte sind blockiert|skripte erlauben|skripte zulassen|blockiert skripte
activer javascript|activez javascript|javascript est désactivé|scripts sont bloqués|autoriser les scripts|bloque les scripts|sans scripts
active javascript|activa javascript|activar javascript|habilite javascript|habilitar javascript|javascript está desactivado|bloquea los scripts|bloqueando scripts|bloquear scripts|scripts están bloqueados|sin scripts|permita los scripts
ative o javascript|ativar o javascript|ative javascript|o javascript está desativado|bloqueia os scripts|bloquear scripts|bloquear os scripts|scripts estão bloqueados|sem scripts|permita os scripts
"""
ERROR_PAGE = """
not found|page not found|could not be found|page you were looking for|internal server error|bad gateway|service unavailable|gateway timeout|0 forbidden|0 gone|requested address|access denied|
do not have permission|unusual traffic|not a robot|site is down|down for maintenance|back shortly|session has expired|sign in again|please log in|log in to continue|something went wrong|try again later|oops|
fatal error|cannot connect to database|traceback (most recent call last)|timeouterror|file "|"error":|resource unavailable|connection refused|too many requests|unauthorized|go back to the start page|connection timed out|error 0:|unexpected error
không tìm thấy trang|liên kết có thể|lỗi máy chủ|thử lại sau|hết hạn|đăng nhập lại|truy cập bị từ chối|không có quyền|đang bảo trì|trang không tồn tại
seite nicht gefunden|link ist veraltet|interner serverfehler|später erneut|zugriff verweigert|sitzung ist abgelaufen|melden sie sich|erneut anmelden|keine berechtigung|wartungsarbeiten|sitzung abgelaufen
page introuvable|lien est peut-être|erreur interne|erreur 0|service indisponible|erreur du serveur|erreur serveur|réessayer plus tard|accès refusé|session a expiré|session expirée|reconnecter|en maintenance|réessayez
página no encontrada|enlace puede|error 0 del servidor|error interno|más tarde|acceso denegado|sesión ha caducado|sesión ha expirado|vuelva a iniciar|inicie sesión|en mantenimiento|no tiene permiso
página não encontrada|ligação pode|erro 0 do servidor|erro interno|mais tarde|acesso negado|sessão expirou|inicie sessão|volte a entrar|em manutenção|não tem permissão
"""
FILLER = """
placeholder copy|placeholder text|replace this paragraph|your text here|sample text|body copy to be supplied|dummy text|would stand a summary|text follows later|coming soon|content goes here|filler text
văn bản mẫu|nội dung sẽ được|đoạn chữ giữ chỗ|chữ giữ chỗ|nội dung mẫu
blindtext|platzhaltertext|hier steht später|der richtige inhalt|beispieltext|text folgt
texte de remplissage|faux texte|texte factice|votre texte ici|contenu à venir|texte à venir|texte provisoire
texto de relleno|texto de ejemplo|su texto aquí|tu texto aquí|contenido pendiente|texto provisional|próximamente
texto de preenchimento|texto de exemplo|o seu texto aqui|seu texto aqui|conteúdo a definir|texto provisório|em breve
"""
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua veniam nostrud exercitation ullamco laboris nisi aliquip commodo consequat "
    "duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa officia deserunt mollit anim est laborum"
)
MASHED = "asdf asdfgh qwer qwerty qwertz jkl foo bar baz bla blah test xxx abc"
PROMPTS = "heading 0|type something|untitled section|add a description|click to edit|click to add|enter text here|new section|add a title|write something"
FURNITURE = "request id|menu|sign in|home|search|login|contact the administrator|back|clip service|clipped page|loading...|learn how|reader view|<title>error</title>|incident|ref|0%"

FIELD = (
    r"(?:\{\{\s*(?:[^{}\n]{1,40}|[^{}|\n]+)\}\}|\$\{\s*[^{}\n]+\}|\$[A-Z][A-Z0-9_]+\$|@@\w+@@|%%\w+%%|__[A-Z][A-Z0-9_]*__|<<[^<>\n]+>>|<%=?[^%\n]+%>"
    r"|\[INSERT [^\]\n]+\]|\[(?:Your|Insert|Enter)? ?[A-Z]?[a-z]+(?: [a-z]+){0,3}\]|TODO: ?[a-z]+(?: [a-z]+){0,2}|XXXX ?\([^)\n]+\)|<[a-z]+(?: [a-z]+){0,3} here>|\{[A-Z]\w+\}|_{5,})"
)
# Within a sentence only signs that prose, code and formulas don't have count: several different ones in a text, or one where a name or a date stands.
INSIDE = r"(?:\{\{\s*[^\W\d][\w. -]*\}\}|\$\{\s*[^\W\d][\w. -]*\}|\$[A-Z][A-Z0-9_]{3,}\$|@@\w+@@|%%\w+%%|<<[^<>\n]+>>|<%=[^%\n]+%>|\[(?:INSERT|Insert|Enter|Your|YOUR) [^\]\n]+\]|XXXX ?\([^)\n]+\)|<[a-z]+(?: [a-z]+){0,3} here>)"
IN_PLACE = re.compile(rf"(?i:\b(?:dear|hello|hi|hey|mr\.?|mrs\.?|ms\.?|liebe[rs]?|hallo|herr|frau|cher|chère|bonjour|querid[oa]|estimad[oa]|hola|prezad[oa]|car[oa]|olá|kính gửi|thân gửi|chào))[ \t]+{INSIDE}")
INSIDE_FIELD = re.compile(INSIDE)
# Sentences with these words speak about fields; what stands in code or quotes is shown.
MENTIONS = re.compile(
    r"(?i)\b(?:templates?|variables?|placeholders?|headings?|fields?|mailer|syntax|manual|vorlagen?|platzhalter|variablen?|felder?|überschrift|modèles?|champs?|titre|gabarits?|plantillas?|marcador(?:es)?|campos?|encabezado|modelos?|cabeçalho|variáve(?:l|is)|variáveis|mẫu|biến|trường|tiêu đề)\b"
)
SHOWN = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»", re.S)
SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|\n+")
UNFILLED = re.compile(rf"(?m)^[ \t>*\-]*(?:#+[ \t]*|[\w ]{{1,30}}:[ \t]*|[A-Z]\w*[ \t])?{FIELD}[ \t]*[,.;:]?[ \t]*$|\b(?:met on|dear|an|für|pour|para|am)[ \t]+{FIELD}[ \t]+(?:about|über|sur|sobre)[ \t]+{FIELD}")


def unfilled_inside(text: str) -> bool:
    """Whether sentences have fields in the place of values."""
    if not INSIDE_FIELD.search(text):
        return False
    said = [x for x in SENTENCE_END.split(SHOWN.sub(" ", text)) if x and INSIDE_FIELD.search(x) and not MENTIONS.search(INSIDE_FIELD.sub(" ", x))]
    return any(IN_PLACE.search(x) for x in said) or len({f for x in said for f in INSIDE_FIELD.findall(x)}) > 1


def normal(text: str) -> str:
    t = unicodedata.normalize("NFC", text).lower().replace("’", "'")
    return re.sub(r"\d+", "0", t)


# How the fields above begin, lower case.
OPENINGS = "{{|${|$|@@|%%|__|<<|<%|[|todo:|xxxx|<|{"


@functools.lru_cache(maxsize=4)
def automaton(learnt: frozenset[str] = frozenset()):
    import ahocorasick

    a = ahocorasick.Automaton()
    words = "|".join([*LATIN.split(), *MASHED.split(), *sorted(learnt)])
    for kind, phrases in (("field", OPENINGS), ("word", words), ("script_notice", SCRIPT_NOTICE), ("error_page", ERROR_PAGE), ("filler", FILLER), ("placeholder", PROMPTS), ("", FURNITURE)):
        for p in re.split(r"[|\n]+", phrases.strip()):
            if p.strip():
                a.add_word(p.strip(), (kind, len(p.strip())))
    a.make_automaton()
    return a


SEEDS = frozenset(w for w in LATIN.split() if len(w) > 3)
_PIECES = re.compile(r"[^.!?;\n|]+(?:[.](?=\w)[^.!?;\n|]+)*[.!?;\n|]*")
# Names of programs with a version, and codes: furniture whatever they are called.
BANNER = re.compile(r"\W*(?:\w+ ){0,2}[a-z]\w*[/#-]v?0(?:\.0)*\W*")


def kind_of(text: str | None, learnt: frozenset[str] = frozenset()) -> str | None:
    if text is None or not text.strip():
        return None
    t = normal(text)
    inside = lambda a, b: (a and t[a - 1].isalpha()) or (b < len(t) and t[b].isalpha())
    hits = sorted((end - n + 1, end + 1, kind) for end, (kind, n) in automaton(learnt).iter(t) if kind != "word" or not inside(end - n + 1, end + 1))
    if any(h[2] == "field" for h in hits):
        if UNFILLED.search(text) or unfilled_inside(text):
            return "placeholder"
        hits = [h for h in hits if h[2] != "field"]
    if not hits:
        return None
    dummy = sum(h[2] == "word" for h in hits) >= LEAST_DUMMY
    covered: dict[str, int] = {}
    total = at = 0
    for m in _PIECES.finditer(t):
        size = len(re.sub(r"\W", "", m[0]))
        while at < len(hits) and hits[at][0] < m.start():
            at += 1
        kinds: dict[str, int] = {}
        i = at
        while i < len(hits) and hits[i][0] < m.end():
            kinds[hits[i][2]] = kinds.get(hits[i][2], 0) + hits[i][1] - hits[i][0]
            i += 1
        words = kinds.pop("word", 0)
        if (set(kinds) == {""} and size <= 2 * kinds[""] + 6) or BANNER.fullmatch(m[0]):
            continue
        total += size
        real = {k: n for k, n in kinds.items() if k}
        if real:
            best = max(real, key=lambda k: (real[k], k))
            # a long sentence that merely mentions a phrase is covered by the phrase only
            covered[best] = covered.get(best, 0) + (size if size <= 4 * real[best] + 24 and '"' not in m[0].strip('{}\n "') else real[best])
        elif words and dummy:
            covered["filler"] = covered.get("filler", 0) + words  # words cover themselves only
    if not covered:
        return None
    best = max(covered, key=lambda k: (covered[k], k))
    return best if sum(covered.values()) >= COVERAGE * total else None


def dummy_words(docs: DataFrame, text: str) -> frozenset[str]:
    """Words that the corpus uses as dummy text; one pre-aggregated count over the distinct words of all documents."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}{4,}"), F.lit(0)))
    seeds = F.size(F.array_intersect("w", F.array(*[F.lit(x) for x in sorted(SEEDS)])))
    of = docs.where(F.col(text).isNotNull()).select(words.alias("w")).where("size(w) > 0").select("w", ((seeds >= LEAST_DUMMY) & (seeds >= SEED_SHARE * F.size("w"))).cast("int").alias("d"))
    counted = of.select(F.explode("w").alias("word"), "d").groupBy("word").agg(F.count("*").alias("n"), F.sum("d").alias("d"))
    got = counted.where((F.col("d") >= LEARN_DOCS) & (F.col("d") >= LEARN_SHARE * F.col("n"))).orderBy(F.desc("d"), "word").limit(MOST_LEARNT).toPandas()
    return frozenset(got["word"])


def classify(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind) of the documents that are left-overs."""

    shared = docs.sparkSession.sparkContext.broadcast(dummy_words(docs, text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds = [kind_of(t, shared.value) for t in pdf["t"]]
            yield pd.DataFrame({"k": pdf["k"], "kind": pd.Series(kinds, index=pdf.index, dtype=object)}).dropna(subset=["kind"])

    kind = docs.schema[key].dataType.simpleString()
    got = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, kind string")
    return got.groupBy("k").agg(F.max("kind").alias("kind")).select(F.col("k").alias(key), "kind")


def register(reg: Registry) -> None:
    @reg.query("p10_found")
    def p10_found(spark: SparkSession, sf: str) -> DataFrame:
        return classify(read_table(spark, sf, "documents"), "doc_id", "text")

    @reg.query("p10_kept")
    def p10_kept(spark: SparkSession, sf: str) -> DataFrame:
        """The corpus without the left-overs."""
        docs = read_table(spark, sf, "documents").select("doc_id", "text", "source")
        return docs.join(p10_found(spark, sf).select("doc_id"), "doc_id", "left_anti")
