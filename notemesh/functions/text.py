"""Text functions as Column expressions; all but Unicode normal forms stay inside the JVM.

Nulls give null unless stated. Offsets and lengths are code points.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without weight in a query.
STOP_WORDS = (
    "the and for are was were our you your this that these those with what who whom whose which how why when where does did can could will would should "
    "has have had not but its his her from into about they them their than then out get any all"
).split()

# White space as JavaScript's \s has it, for splitting as the reference results expect.
WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: An ASCII word boundary; Java's own \b takes accented letters as word characters.
ASCII_B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


@functools.cache
def _fold_tables() -> tuple[str, str]:
    """Characters that decompose to one base character and marks of U+0300–036F, with the base characters."""
    src, dst = ["đ", "Đ"], ["d", "D"]
    for code in range(0xC0, 0x10000):
        c = chr(code)
        d = "".join(x for x in unicodedata.normalize("NFD", c) if not 0x300 <= ord(x) <= 0x36F)
        if len(d) == 1 and d != c and not 0xD800 <= code <= 0xDFFF and d not in "\\'":
            src.append(c)
            dst.append(d)
    assert sys.maxunicode > 0xFFFF
    return "".join(src), "".join(dst)


def fold(c: Column) -> Column:
    """Lower case without diacritics: NFD, U+0300–036F dropped, đ as d."""
    src, dst = _fold_tables()
    return F.lower(F.translate(F.regexp_replace(c, r"[\u0300-\u036f]", ""), src, dst))


def unicode_words(c: Column) -> Column:
    """Maximal runs of letters and digits, in order."""
    return F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def query_terms(c: Column) -> Column:
    """Lower-cased distinct words of at least three characters that aren't stop words, in order."""
    w = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 3)
    return F.array_except(w, F.array(*[F.lit(s) for s in STOP_WORDS]))  # array_except also drops repeats


def whole_word_score(text: Column, terms: Column) -> Column:
    """How many of the terms (repeats counted) stand as whole folded words in the text."""
    words = unicode_words(fold(F.coalesce(text, F.lit(""))))
    return F.get(F.transform(F.array(words), lambda w: F.size(F.filter(terms, lambda t: F.array_contains(w, fold(t))))), 0)


def token_count(c: Column) -> Column:
    """Number of white-space-separated tokens."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), WS + "+"), lambda t: t != ""))


def first_tokens(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(c, WS + "+"), lambda t: t != ""), 1, n), " ")


def normalized(c: Column, form: str) -> Column:
    """A Unicode normal form; the JVM's functions have none, so it takes an Arrow batch."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x.isascii() else unicodedata.normalize(form, x), na_action="ignore").astype(object)

    return run(c)


def canonical_id(name: Column) -> Column:
    """NFKC, lower case, trimmed, white space as one underscore, other signs than letters, digits, _ and - dropped."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(normalized(name, "NFKC"))), r"\s+", "_"), r"[^\p{L}\p{N}_-]", "")


def norm_tag(tag: Column) -> Column:
    t = F.lower(F.regexp_replace(F.trim(tag), "^#", ""))
    return F.when(t != "", t)


def inline_tags(body: Column) -> Column:
    """Tags written as #tag after a blank or at a line's start, without the sign, lower-cased."""
    return F.transform(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?m)(?:^|\s)#([\p{L}\p{N}_][\p{L}\p{N}_/-]*)"), F.lit(1)), F.lower)


def slug(title: Column) -> Column:
    """ASCII slug of at most 80 characters; 'untitled' if nothing is left."""
    return _slugged(fold(normalized(title, "NFKD")))


def _slugged(folded: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, 80), "-+$", "")
    return F.when(s != "", s).otherwise("untitled")


def folder_path(folder: Column) -> Column:
    """A typed folder as a path of slugs; segments without letters or digits drop out, so it may be empty."""
    parts = F.transform(F.split(fold(normalized(F.coalesce(folder, F.lit("")), "NFKD")), "/"), _slugged)
    return F.array_join(F.filter(parts, lambda x: x != "untitled"), "/")


def child_folder(parent: Column, name: Column) -> Column:
    """The path of a new folder under a typed parent ('notes' if it is empty)."""
    base = folder_path(parent)
    return F.concat(F.when(base == "", "notes").otherwise(base), F.lit("/"), slug(name))


def renamed_folder(folder: Column, name: Column) -> Column:
    """A folder's path with another last segment."""
    parent = F.regexp_extract(folder, "^(.*)/[^/]*$", 1)
    return F.concat(F.when(parent == "", "").otherwise(F.concat(parent, F.lit("/"))), slug(name))


def conflict_path(path: Column, stamp: Column) -> Column:
    """The path beside a note for a copy in conflict."""
    safe = F.regexp_replace(stamp, "[:.]", "-")
    return F.concat(F.regexp_replace(path, r"\.md$", ""), F.lit("."), safe, F.lit(".conflict.md"))


def graph_hash(c: Column) -> Column:
    """FNV-1a of the UTF-16 code units, 32 bits, as hexadecimal digits without leading zeros."""
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    step = lambda h, u: ((h.bitwiseXOR(F.conv(u, 16, 10).cast("long"))) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.lower(F.hex(F.aggregate(units, F.lit(0x811C9DC5).cast("long"), step)))


def clean_title(c: Column) -> Column:
    """A title or alias as links meet it: lower case, trimmed, white space of any width as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), WS + "+", " "))


def highlight(body: Column, start: Column, end: Column) -> Column:
    """(pre, hit, post) of a span in a text; offsets out of the text are moved to its ends."""
    n = F.length(body)
    a = F.least(F.greatest(start, F.lit(0)), n)
    b = F.least(F.greatest(end, a), n)
    return F.struct(F.substring(body, F.lit(1), a).alias("pre"), F.substring(body, a + 1, b - a).alias("hit"), F.substring(body, b + 1, n - b).alias("post"))


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def is_under(path: Column, folder: Column) -> Column:
    return (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def wikilink_targets(body: Column) -> Column:
    """Targets of [[target#heading|display]] links, trimmed, in order."""
    raw = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"\[\[([^\[\]|#\n]+)(?:#[^\[\]|\n]*)?(?:\|[^\[\]\n]*)?\]\]"), F.lit(1))
    return F.filter(F.transform(raw, lambda t: F.trim(t)), lambda t: t != "")


def xml_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_attr(c: Column) -> Column:
    return F.replace(xml_text(c), F.lit('"'), F.lit("&quot;"))


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(c, F.lit("")), 256))


def file_type(path: Column) -> Column:
    """pdf, md, txt or csv by extension; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("md", "markdown"), "md").when(ext.isin("txt", "text"), "txt").when(ext.isin("pdf", "csv"), ext)


def humanize(header: Column) -> Column:
    s = F.regexp_replace(header, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(s, r"[_\-\s]+", " "))


def truncate(c: Column, n: int) -> Column:
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, n)), F.lit("…")))


# Patterns of personal data for the redactor.
PII_PATTERNS = {
    "email": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "phone": r"\+?\d[\d\s().-]{7,}\d",
    "ssn": ASCII_B + r"\d{3}-\d{2}-\d{4}" + ASCII_B,
    "credit_card": ASCII_B + r"(?:\d[ -]?){13,16}" + ASCII_B,
    "ip": ASCII_B + r"\d{1,3}(?:\.\d{1,3}){3}" + ASCII_B,
}


def redact(c: Column, kinds: list[str]) -> Column:
    """Matches of the kinds' patterns, one kind after the other, become [REDACTED]."""
    for k in kinds:
        c = F.regexp_replace(c, PII_PATTERNS[k], "[REDACTED]")
    return c
