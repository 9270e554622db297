"""Text functions: columns where built-ins can say it, Arrow functions where they can't."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C

SPACES = r"\s+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def token_estimate(text: Column) -> Column:
    """int(words * 1.3)."""
    return F.floor(word_count(text) * F.lit(1.3)).cast("long")


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def paragraphs(text: Column) -> Column:
    return F.split(text, r"\n\s*\n")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word sets; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def slug(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9]+", "_")


def normalize_whitespace(text: Column) -> Column:
    """Six steps in order: runs of spaces, runs of newlines, trailing spaces, blank lines, other white space, ends."""
    out = F.regexp_replace(text, r" {2,}", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"(?dm) +$", "")
    out = F.regexp_replace(out, r"(?dm)^\s+$", "")
    out = F.regexp_replace(out, r"[\t\r\f\x0B]", " ")
    return F.regexp_replace(out, r"^\s+|\s+\z", "")


def clean_sql(text: Column, categories: tuple[str, ...] = ("headers", "footers", "page_numbers", "watermarks", "noise")) -> Column:
    """The removal chain alone, without the preserve step."""
    for category in categories:
        for pattern in C.CLEANING[category]:
            flags, body = ("(?dmi)", pattern[4:]) if pattern.startswith("(?i)") else ("(?dm)", pattern)
            text = F.regexp_replace(text, flags + body, "")
    return normalize_whitespace(text)


def normalize_query(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text), SPACES, " "), r"\?$", "")


def context_window(text: Column, start: Column, end: Column, window: int = 80) -> Column:
    first = F.greatest(F.lit(0), start - window)
    return F.trim(F.substr(text, first + 1, F.least(F.char_length(text), end + window) - first))


def sentence_context(text: Column, start: Column, end: Column) -> Column:
    """What stands between the nearest '.', ';' or newline on either side of [start, end)."""
    before = F.regexp_extract(F.substr(text, F.lit(1), start), r"([^.;\n]*)\z", 1)
    after = F.regexp_extract(F.substr(text, end + 1), r"^([^.;\n]*)", 1)
    return F.trim(F.concat(before, F.substr(text, start + 1, end - start), after))


def clean_expansion(text: Column) -> Column:
    out = F.btrim(F.regexp_replace(F.trim(text), SPACES, " "), F.lit(" -;:,"))
    return F.trim(F.regexp_replace(out, r"^(?:The|A|An) ", ""))


def is_acronym(token: Column) -> Column:
    return (F.char_length(token) > 1) & (F.upper(token) == token) & token.rlike("[A-Z]")


def ascii_bar(value: Column, top: Column, width: int = 20) -> Column:
    return F.when((top <= 0) | (value <= 0), F.lit("")).otherwise(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.round(value / top * width).cast("int"))))


def truncate_words(text: Column, max_tokens: int = 512) -> Column:
    """At most 4 * max_tokens characters, cut at a word, with three dots."""
    limit = 4 * max_tokens
    cut = F.substr(text, F.lit(1), F.lit(limit))
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, r"\s+\S*\z", ""), F.lit("...")))


def preserved(original: Column, rewritten: Column) -> Column:
    """A rewrite keeps numbers and acronyms and doesn't lose most of a long text."""
    lost = lambda p: F.size(F.array_except(F.regexp_extract_all(original, F.lit(p), F.lit(0)), F.regexp_extract_all(rewritten, F.lit(p), F.lit(0)))) > 0
    short = (F.char_length(original) > 400) & (F.char_length(rewritten) < 0.4 * F.char_length(original))
    return F.when(lost(r"\d+(?:\.\d+)?"), "numbers").when(lost(r"\b[A-Z]{2,}\b"), "acronyms").when(short, "length")


# ---------------------------------------------------------------- names

OPEN, SHUT = "\ue000", "\ue001"  # private characters around place holders, whose numbers are written with a to j: words, no digits
_TO = {48 + d: 97 + d for d in range(10)}
_BACK = {v: k for k, v in _TO.items()}
_CASE = [re.compile(re.escape(t), re.I) for t in C.CASE_TERMS] + [re.compile(p) for p in C.CASE_PATTERNS]
_DROP = re.compile(rf"[^\w\s\ue000\ue001{re.escape(C.KEPT_SYMBOLS)}]")
_ARTICLE = re.compile(rf"^(?:{'|'.join(C.ARTICLES)})\s+", re.I)


def _mark(i: int) -> str:
    return f"{OPEN}{str(i).translate(_TO)}{SHUT}"


def _protect(text: str) -> tuple[str, list[str]]:
    """Terms whose case and symbols stay, replaced by place holders; of overlapping ones the first and longest."""
    spans = sorted((m.start(), -m.end()) for p in _CASE for m in p.finditer(text))
    out, kept, end = [], [], 0
    for start, stop in spans:
        if start < end:
            continue
        out += [text[end:start], _mark(len(kept))]
        kept.append(text[start:-stop])
        end = -stop
    return "".join(out) + text[end:], kept


def _restore(text: str, kept: list[str]) -> str:
    return re.sub(f"{OPEN}([a-j]+){SHUT}", lambda m: kept[int(m[1].translate(_BACK))], text)


def normalize_text(text: str | None) -> tuple[str, str]:
    """(normalized, display) of a name."""
    if not text or not text.strip():
        return "", ""
    body, kept = _protect(text)
    body = unicodedata.normalize("NFKC", body)
    for c in C.INVISIBLE:
        body = body.replace(c, "")
    for a, b in C.PUNCTUATION.items():
        body = body.replace(a, b)
    body = _DROP.sub(" ", body)
    body = re.sub(r"\s*([+#/])\s*", r"\1", body)
    body = re.sub(r"\s+-\s*|\s*-\s+", " - ", body)
    body = re.sub(r"\s+", " ", body).strip()
    while _ARTICLE.match(body):
        body = _ARTICLE.sub("", body, count=1)
    return _restore(body.lower(), [t.lower() for t in kept]).strip(), _restore(body, kept).strip()


@F.pandas_udf(T.StringType())
def normalize_name(names: pd.Series) -> pd.Series:
    """Canonical normalised form of names."""
    return names.map(lambda t: normalize_text(t)[0], na_action="ignore")


@F.pandas_udf(T.StringType())
def display_name(names: pd.Series) -> pd.Series:
    return names.map(lambda t: normalize_text(t)[1], na_action="ignore")


def normalize_ascii(name: Column) -> Column:
    """The SQL fast path, equal to normalize_name for names without protected terms, symbols and non-ASCII letters."""
    out = F.regexp_replace(name, rf"[^\w\s{re.escape(C.KEPT_SYMBOLS)}]", " ")
    out = F.regexp_replace(out, r"\s*([+#/])\s*", "$1")
    out = F.regexp_replace(out, r"\s+-\s*|\s*-\s+", " - ")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.lower(F.regexp_replace(out, rf"(?i)^(?:(?:{'|'.join(C.ARTICLES)})\s+)+", ""))


# ---------------------------------------------------------------- cleaning with preserved parts

_CLEAN = [(k, [re.compile(p, re.M) for p in v]) for k, v in C.CLEANING.items()]
_KEEP = [re.compile(p) for p in C.PRESERVED]


def _ocr(text: str) -> str:
    """Single l and O between digits are 1 and 0."""
    return re.sub(r"\d+[^\d]*\d+", lambda m: re.sub(r"\bO\b", "0", re.sub(r"\bl\b", "1", m[0])), text)


def clean_text(text: str, fix_words: bool = False, chain=None, keep=None) -> str:
    """Headers, footers, page numbers, watermarks, noise and OCR slips removed; code and formulas kept.

    Only what the removal chain could touch inside code, formulas and `$...$` is set aside,
    so lines are judged with their plain words in place. chain and keep are compiled
    patterns of other rules.
    """
    chain, keep = _CLEAN if chain is None else chain, _KEEP[:5] if keep is None else keep
    kept: list[str] = []

    def aside(m: re.Match) -> str:
        kept.append(m[0])
        return _mark(len(kept) - 1)

    for pattern in keep:
        text = pattern.sub(aside, text)
    for _, patterns in chain:
        for pattern in patterns:
            text = pattern.sub("", text)
    text = _ocr(text)
    if fix_words:
        text = text.replace("rn", "m")
    for pattern, new in ((r" {2,}", " "), (r"\n{3,}", "\n\n"), (r"(?m) +$", ""), (r"(?m)^\s+$", ""), (r"[\t\r\f\v]", " ")):
        text = re.sub(pattern, new, text)
    for _ in keep:  # code may hold a formula that was set aside before it
        text = _restore(text, kept)
    return text.strip()


@F.pandas_udf(T.StringType())
def clean(texts: pd.Series) -> pd.Series:
    return texts.map(clean_text, na_action="ignore")


def cleaner(cleaning: dict[str, tuple[str, ...]], preserved: tuple[str, ...] = C.PRESERVED[:5], fix_words: bool = False):
    """A column function that cleans by other patterns than the fixed ones."""
    chain = [(k, [re.compile(p, re.M) for p in v]) for k, v in cleaning.items()]
    keep = [re.compile(p) for p in preserved]

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: clean_text(t, fix_words, chain, keep), na_action="ignore")

    return run


def cleaning_stats(original: Column, cleaned: Column) -> list[Column]:
    a, b = F.char_length(original), F.char_length(cleaned)
    return [
        a.cast("long").alias("original_chars"),
        b.cast("long").alias("cleaned_chars"),
        (a - b).cast("long").alias("removed_chars"),
        F.round(F.when(a > 0, (a - b) / a).otherwise(F.lit(0.0)), 6).alias("removed_share"),
    ]
