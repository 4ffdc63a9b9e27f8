"""Problem 5: markup residue in note bodies, found and turned into clean text.

Template deduction: the markup tokens of all notes of a host (a vault) are
counted per note; tokens with the same occurrence vector over the host's notes
form an equivalence class. A class is valid if it occurs in MIN_PAGES notes and
its tokens nest (every opening token has its closing one in the class). Valid
classes are the host's template; what lies between their tokens are the slots.
Occurrence vectors are compared by sums of note hashes times counts, so they are
built by one pre-aggregated shuffle, whatever the size of a host.

A page is cut at its host's template tokens. They tell their own kinds; what is
left are slots, and a slot knows the delimiters of the template it stands between
(a formula's, a table's, a comment's). Most markup of notes was typed once and
belongs to no template, so slots are read with a small grammar of each notation,
without the template's tokens. Markup shown inside code counts only as the code
block's own kind. For clean text the template's tags become the signs of what they
mean (an item's, a cell's, a heading's), delimiters stay, and the rules clean the slots.

Defined cases: null and blank bodies have no markup and no clean text (null);
notes delivered twice count once, the latest load winning; a null vault is a
host of its own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemesh.plans import materialize
from notemesh.plans.registry import Registry
from notemesh.sources import once, read_table

MIN_PAGES = 3

# Names of tags that count as HTML.
TAGS = (
    "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del div dl dt em embed figcaption figure font footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html i iframe img input ins kbd label li link main mark meta nav nobr object ol option p param pre q s samp script section select small span strike strong style sub "
    "summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video details"
).split()
_TAG = rf"</?(?:{'|'.join(sorted(TAGS, key=len, reverse=True))})(?:\s+[^<>]*)?/?>"

CODE = re.compile(
    r"(?P<fence>^[ \t>]*(?P<f>`{3,}|~{3,})[^\n]*\n.*?(?:^[ \t>]*(?P=f)[`~]*[ \t]*$|\Z))"
    r"|(?P<pre><pre\b[^>]*>.*?</pre>|<code\b[^>]*>.*?</code>)"
    r"|(?P<verb>\\begin\{(?P<e>verbatim|lstlisting|minted)\}.*?\\end\{(?P=e)\}|\\verb\|[^|\n]*\|)"
    r"|(?P<wiki><(?:nowiki|syntaxhighlight|source)\b[^>]*>.*?</(?:nowiki|syntaxhighlight|source)>)"
    r"|(?P<tick>(?<!`)(?P<t>`{1,2})(?!`)[^`\n]+(?P=t)(?!`))",
    re.S | re.M | re.I,
)
KINDS = {"fence": "markdown", "tick": "markdown", "pre": "html", "verb": "latex", "wiki": "wiki"}

HTML = re.compile(rf"{_TAG}|<!--|<!doctype\b|&(?:#\d{{1,6}}|#x[0-9a-f]{{1,5}}|[a-z][a-z0-9]{{1,10}});", re.I)
WIKI = re.compile(
    r"\[\[[^\[\]\n]+\]\]|\{\{[^{}]+\}\}|^[ \t]*(={2,6})[ \t]*[^=\s][^\n]*?[ \t]*\1[ \t]*$|(?<!')'{2,3}(?!'|\s)[^'\n][^\n]*?'{2,3}|^[ \t]*\{\|[^\n]*$|^[ \t]*\|\}[ \t]*$"
    r"|__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION|NEWSECTIONLINK|HIDDENCAT|INDEX|NOINDEX|NOGALLERY|DISAMBIG)__|^#REDIRECT\b|</?(?:ref|references|gallery)\b[^>]*>|\[https?://\S+ [^\]\n]+\](?!\()",
    re.M,
)
LATEX = re.compile(
    r"\\(?:begin|end)\{[a-zA-Z*]+\}|(?<![\w:\\])\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{|(?<![\w:\\])\\(?:item|alpha|beta|gamma|delta|Delta|sum|int|frac|leq|geq|cdot|times|ldots|LaTeX|TeX|maketitle|tableofcontents|newpage|noindent|par|hline|centering|infty|pm|to|sqrt|lambda|mu|sigma|omega|pi)\b"
    r"|\$\$.+?\$\$|(?<![\w$\\])\$(?!\s)(?=[^$\n]*[\\^_={}])[^$\n]{1,200}?(?<!\s)\$(?![\w$])|\\\((?=[^\n]).{1,300}?\\\)|\\\[.{1,500}?\\\]",
    re.S,
)
MARKDOWN = re.compile(
    r"^[ \t]{0,3}#{1,6}[ \t]+\S|^[ \t]*(?:[-+*])[ \t]+(?:\[[ xX]\][ \t]+)?\S|^[ \t]*\d{1,3}[.)][ \t]+\S|^[ \t]{0,3}>[ \t]?\S|!?\[[^\]\[\n]+\]\([^)\s]+(?:[ \t]+\"[^\"]*\")?\)"
    r"|(?<![\w*])\*{1,3}(?![\s*])[^*\n]+?(?<![\s*])\*{1,3}(?![\w*])|(?<![\w_])__(?![\s_])[^_\n]+?(?<![\s_])__(?![\w_])|(?<![\w_/.:@\\])_(?![\s_])[^_\n]+?(?<![\s_])_(?![\w_@])|~~(?!\s)[^~\n]+?~~"
    r"|^[^\s#>|\-=*+][^\n]*\n(?:={3,}|-{3,})[ \t]*$|^[ \t]*\|?[^\n|]+\|[^\n]*\n[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$|^\[\^?[\w-]+\]:[ \t]|\[\^[\w-]+\]|^[ \t]{0,3}(?:\*[ \t]*){3,}$|<https?://[^\s>]+>",
    re.M,
)
SHOWN = re.compile(r"\[\[[^\[\]\n]+\]\]|\{\{[^{}]+\}\}|<!--.*?-->|^[ \t]*\{\|.*?^[ \t]*\|\}[ \t]*$|\\begin\{(?:equation|align|itemize|enumerate|math)\*?\}|\\end\{[a-z]+\*?\}|\$\$.+?\$\$|\\\[.{1,500}?\\\]|\\\(.{1,300}?\\\)", re.S | re.M)


def without_code(body: str) -> tuple[str, set[str]]:
    kinds: set[str] = set()

    def cut(m: re.Match) -> str:
        kinds.add(next(KINDS[k] for k in KINDS if m.group(k) is not None))
        return " "

    return CODE.sub(cut, body), kinds


def kinds_of(body: str | None) -> set[str]:
    """Kinds of markup in a text or in the slots of one."""
    if body is None or not body.strip():
        return set()
    text, kinds = without_code(body.replace("\r\n", "\n"))
    if HTML.search(text):
        kinds.add("html")
    if LATEX.search(text):
        kinds.add("latex")
    wiki = WIKI.search(text)
    if wiki:
        kinds.add("wiki")
    # tables, formulas and headings of the other notations have signs that aren't Markdown's
    rest = WIKI.sub(" ", SHOWN.sub(" ", text))
    rest = HTML.sub(" ", LATEX.sub(" ", rest))
    if MARKDOWN.search(rest):
        kinds.add("markdown")
    return kinds


# --- template deduction ------------------------------------------------------------------------------------------------

TOKEN = re.compile(rf"(?P<html>{_TAG}|<!--|-->)|(?P<wiki>^[ \t]*(?:\{{\||\|\}}|\|-)|\{{\{{|\}}\}}|\[\[|\]\])|(?P<latex>\\(?:begin|end)\{{[a-zA-Z*]+\}}|\\\[|\\\]|\\\(|\\\))", re.M | re.I)
PAIRS = {"<!--": "-->", "{|": "|}", "{{": "}}", "[[": "]]", "\\[": "\\]", "\\(": "\\)"}


def shape(token: str) -> str:
    """A token without what varies from page to page: digits and attribute values."""
    return re.sub(r"\d+", "0", re.sub(r"=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "=", token.strip().lower()))


def closing(token: str) -> str | None:
    if token in PAIRS:
        return PAIRS[token]
    if m := re.match(r"<([a-z][a-z0-9]*)", token):
        return f"</{m[1]}>"
    return token.replace("\\begin", "\\end") if token.startswith("\\begin") else None


def template_tokens(pages: DataFrame) -> DataFrame:
    """(host, tokens): the tokens of the valid equivalence classes of each host's pages (host, page, body)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for host, page, body in zip(pdf["host"], pdf["page"], pdf["body"]):
                seen: dict[str, int] = {}
                for m in TOKEN.finditer(without_code(body)[0]):
                    t = shape(m[0])
                    seen[t] = seen.get(t, 0) + 1
                rows += [(host, page, t, n) for t, n in seen.items()]
            yield pd.DataFrame(rows, columns=["host", "page", "token", "n"])

    counted = pages.mapInPandas(run, "host string, page string, token string, n long")
    vector = F.sum((F.pmod(F.xxhash64("page"), F.lit(1 << 40)) * F.col("n")).cast("decimal(38,0)"))
    tokens = counted.groupBy("host", "token").agg(vector.alias("vector"), F.count("*").alias("pages")).where(F.col("pages") >= MIN_PAGES)
    # the shapes of tokens are few, so a class, and a host's list of classes, is short
    classes = tokens.groupBy("host", "vector", "pages").agg(F.collect_set("token").alias("members")).where("size(members) > 1")

    def valid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = []
            for host, members in zip(pdf["host"], pdf["members"]):
                group = set(members)
                nested = sorted({t for o in group if (c := closing(o)) and c in group for t in (o, c)})
                if nested:
                    kept.append((host, nested))
            yield pd.DataFrame(kept, columns=["host", "nested"])

    good = classes.select("host", "members").mapInPandas(valid, "host string, nested array<string>")
    return good.groupBy("host").agg(F.array_distinct(F.flatten(F.collect_list("nested"))).alias("tokens"))


#: Delimiters whose slots are read for the other notations only: signs in them aren't Markdown's.
OPAQUE = re.compile(r"<!--|\{\||\{\{|\[\[|\\\[|\\\(|\\begin\{(?:equation|align|math|displaymath|eqnarray)\*?\}")


def template_parts(body: str, template: set[str]) -> Iterator[tuple[str, str | None]]:
    """(text, notation) of a page's pieces in order; the notation is None for slots and that of the token for the template's tokens."""
    code = [m.span() for m in CODE.finditer(body)]
    at = 0
    for m in TOKEN.finditer(body):
        if shape(m[0]) in template and not any(a <= m.start() < b for a, b in code):
            yield body[at : m.start()], None
            yield m[0], m.lastgroup
            at = m.end()
    yield body[at:], None


def slots_of(body: str, template: set[str]) -> tuple[str, list[str], set[str]]:
    """The open slots of a page, joined by blanks where its host's template was, the slots inside delimiters, and the kinds of the template's tokens."""
    kinds: set[str] = set()
    free: list[str] = []
    inner: list[str] = []
    until: str | None = None
    for text, notation in template_parts(body, template):
        if notation is None:
            (free if until is None else inner).append(text)
            continue
        kinds.add(notation)
        token = text.strip()
        if until is None and OPAQUE.fullmatch(token):
            until = closing(shape(token))
        elif until is not None and shape(token) == until:
            until = None
        free.append(" ")
    return "".join(free), inner, kinds


def page_kinds(body: str, template: set[str]) -> set[str]:
    """Kinds of markup of a page: those of its template tokens, and those the grammar reads in its slots."""
    if not template:
        return kinds_of(body)
    free, inner, kinds = slots_of(body.replace("\r\n", "\n"), template)
    return kinds | kinds_of(free) | set().union(*(kinds_of(x) - {"markdown"} for x in inner))


def _page_kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(page, k) for page, body, tokens in zip(pdf["page"], pdf["body"], pdf["tokens"]) for k in sorted(page_kinds(body, set() if tokens is None else set(tokens)))]
        yield pd.DataFrame(rows, columns=["page", "markup"])


def templated(pages: DataFrame) -> DataFrame:
    """(page, body, tokens) of pages (host, page, body) with text: each with the template tokens of its host, null if there are none."""
    pages = pages.where("body IS NOT NULL").withColumn("host", F.coalesce("host", F.lit("")))
    # one short row a host; a host with very many pages isn't moved if the table is small
    return pages.join(materialize(template_tokens(pages), "templates"), "host", "left").select("page", "body", "tokens")


def found(pages: DataFrame) -> DataFrame:
    """(page, markup) of pages (host, page, body)."""
    return templated(pages).mapInPandas(_page_kinds, "page string, markup string")


# --- clean text --------------------------------------------------------------------------------------------------------

_BLOCK = re.compile(r"</(?:p|div|li|tr|h[1-6]|ul|ol|table|blockquote)>|<(?:br|hr)\b[^>]*>", re.I)


def clean(body: str | None) -> str | None:
    """Plain text with headings as '# …', items as '- …', table cells between '|', fenced code and $formulas$."""
    if body is None or not body.strip():
        return None
    kept: list[str] = []

    def keep(text: str) -> str:
        kept.append(text)
        return f"\x00{len(kept) - 1}\x00"

    def code(m: re.Match) -> str:
        t = m[0]
        if m.group("tick"):
            return keep(t.strip("`"))
        inner = re.sub(r"^[^\n]*\n|\n[^\n]*$", "", t) if m.group("fence") or m.group("verb") else html.unescape(re.sub(r"<[^>]+>", "", t))
        return "\n" + keep("```\n" + inner.strip("\n") + "\n```") + "\n"

    t = CODE.sub(code, body.replace("\r\n", "\n"))
    t = re.sub(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\begin\{(?:equation|align|math)\*?\}(.+?)\\end\{(?:equation|align|math)\*?\}", lambda m: keep(f"$${next(g for g in m.groups() if g).strip()}$$"), t, flags=re.S)
    t = re.sub(r"\\\((.+?)\\\)|(?<![\w$\\])\$(?!\s)([^$\n]*[\\^_={}][^$\n]*?)\$(?![\w$])", lambda m: keep(f"${next(g for g in m.groups() if g).strip()}$"), t)
    t = re.sub(r"<!--.*?-->", "", t, flags=re.S)
    t = re.sub(r"<(script|style)\b.*?</\1>", "", t, flags=re.S | re.I)
    t = re.sub(r"<h([1-6])\b[^>]*>", lambda m: "\n" + "#" * int(m[1]) + " ", t, flags=re.I)
    t = re.sub(r"[ \t]*<li\b[^>]*>", "\n- ", t, flags=re.I)
    t = re.sub(r"<t[dh]\b[^>]*>", "| ", t, flags=re.I)
    t = re.sub(r"</t[dh]>", " ", t, flags=re.I)
    t = _BLOCK.sub("\n", t)
    t = re.sub(_TAG, "", t, flags=re.I)
    t = html.unescape(t).replace("\xa0", " ")
    t = re.sub(r"__[A-Z]{3,}__", "", t)
    t = re.sub(r"\[\[(?:Category|File|Image|Kategorie|Catégorie):[^\]]*\]\]", "", t)
    t = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]+)\]\]", r"\1", t)
    t = re.sub(r"\{\{[^{}]*\}\}", lambda m: "\n".join(f"- {p.strip()}" for p in m[0][2:-2].split("|")[1:] if p.strip()), t)
    t = re.sub(r"^[ \t]*(={2,6})[ \t]*(.+?)[ \t]*\1[ \t]*$", lambda m: "#" * (len(m[1]) - 1) + " " + m[2], t, flags=re.M)
    t = re.sub(r"'{2,3}(.+?)'{2,3}", r"\1", t)
    t = re.sub(r"^[ \t]*(?:\{\|.*|\|\}|\|-.*)[ \t]*$", "", t, flags=re.M)
    t = re.sub(r"^[ \t]*!\s*(.+)$", lambda m: "| " + m[1].replace("!!", "|"), t, flags=re.M)
    t = re.sub(r"^(\|.*)$", lambda m: m[1].replace("||", "|"), t, flags=re.M)
    t = re.sub(r"^([^\s#>|\-=*+][^\n]*)\n(={3,}|-{3,})[ \t]*$", lambda m: ("# " if m[2][0] == "=" else "## ") + m[1], t, flags=re.M)
    t = re.sub(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$", "", t, flags=re.M)
    t = re.sub(r"^([ \t]*)[*+][ \t]+", r"\1- ", t, flags=re.M)
    t = re.sub(r"^[ \t]{0,3}>[ \t]?", "", t, flags=re.M)
    t = re.sub(r"!?\[([^\]\[\n]+)\]\([^)\s]+(?:[ \t]+\"[^\"]*\")?\)", r"\1", t)
    t = re.sub(r"(?<![\w*])(\*{1,3})(?![\s*])([^*\n]+?)(?<![\s*])\1(?![\w*])", r"\2", t)
    t = re.sub(r"(?<![\w_/.:@\\])(_{1,2})(?![\s_])([^_\n]+?)(?<![\s_])\1(?![\w_@])", r"\2", t)
    t = re.sub(r"~~([^~\n]+)~~", r"\1", t)
    t = re.sub(r"\\(?:sub)*section\*?\{([^{}]*)\}", r"\n# \1\n", t)
    t = re.sub(r"\\item\b[ \t]*", "- ", t)
    t = re.sub(r"\\(?:begin|end)\{[a-zA-Z*]+\}(?:\[[^\]]*\])?", "", t)
    t = re.sub(r"\\(?:cite|ref|label)\{[^{}]*\}", "", t)
    t = re.sub(r"(?<![\w:\\])\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", t, flags=re.M))
    return re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], t)).strip()


def sign_of(tag: str) -> str:
    """What a tag of a template means in clean text."""
    m = re.match(r"<(/?)([a-z][a-z0-9]*)", tag.strip(), re.I)
    if not m:
        return tag
    end, name = m[1], m[2].lower()
    if not end and (h := re.fullmatch(r"h([1-6])", name)):
        return "\n" + "#" * int(h[1]) + " "
    if name in ("td", "th"):
        return " " if end else "| "
    if name == "li" and not end:
        return "\n- "
    return "\n" if _BLOCK.fullmatch(tag.strip()) else "" if name not in ("pre", "code", "script", "style", "syntaxhighlight", "source", "nowiki") else tag


def clean_page(body: str, template: set[str]) -> str | None:
    """`clean` of a page whose template tags have become their signs."""
    return clean("".join(sign_of(t) if notation == "html" and t not in ("<!--", "-->") else t for t, notation in template_parts(body, template))) if template else clean(body)


def cleaned(pages: DataFrame) -> DataFrame:
    """(page, clean) of pages (host, page, body); pages without text have null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [clean_page(b, set() if t is None else set(t)) for b, t in zip(pdf["body"], pdf["tokens"])]
            yield pd.DataFrame({"page": pdf["page"], "clean": pd.Series(texts, index=pdf.index, dtype=object)})

    none = pages.where("body IS NULL").select("page", F.lit(None).cast("string").alias("clean"))
    return templated(pages).mapInPandas(run, "page string, clean string").unionByName(none)


def note_pages(spark: SparkSession, sf: str) -> DataFrame:
    notes = once(read_table(spark, sf, "notes"), ["doc_id"], ["body", "vault_key"], newest="loaded_at")
    return notes.select(F.col("vault_key").alias("host"), F.col("doc_id").alias("page"), "body")


def register(reg: Registry) -> None:
    @reg.query("p5_found")
    def p5_found(spark: SparkSession, sf: str) -> DataFrame:
        return found(note_pages(spark, sf)).select(F.col("page").alias("doc_id"), "markup").distinct()

    @reg.query("p5_clean")
    def p5_clean(spark: SparkSession, sf: str) -> DataFrame:
        return cleaned(note_pages(spark, sf)).select(F.col("page").alias("doc_id"), F.col("clean").alias("clean_text"))
