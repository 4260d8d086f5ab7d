"""Text scalars as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Title words that say nothing about the event.
COMMON_WORDS = (
    "a an and as at by for from in into is it its new of on or s says the to with "
    "report reports reported exclusive breaking news via"
).split()


def collapse(c: Column, blanks: str = r"(?U)\s+") -> Column:
    """Runs of any blanks as one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), blanks, " "))


def html_unescape(c: Column) -> Column:
    """Character references decoded. Spark has no expression for it, hence an Arrow batch function."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        import html

        return s.map(lambda x: x if x is None or "&" not in x else html.unescape(x), na_action="ignore")

    return run(c)


def clean_text(c: Column, unescape: bool = True) -> Column:
    """Character references decoded, tags replaced by blanks, blanks collapsed."""
    c = F.coalesce(c, F.lit(""))
    return collapse(F.regexp_replace(html_unescape(c) if unescape else c, "<[^>]+>", " "))


def looks_english(c: Column, least_letters: int = 20, ratio: float = 0.82) -> Column:
    """Enough ASCII letters, and ASCII characters a larger part of the text than ratio."""
    letters = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    ascii_chars = F.length(F.regexp_replace(c, r"[^\x00-\x7F]", ""))
    return F.coalesce((letters >= least_letters) & (ascii_chars / F.greatest(F.length(c), F.lit(1)) > ratio), F.lit(False))


def term_array(terms: Sequence[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")


def term_hits(c: Column, terms: Sequence[str]) -> Column:
    """The terms that occur in the text as substrings, letter case aside, in the order of the list."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.filter(term_array(terms), lambda t: F.contains(low, F.lower(t)))


def has_any(c: Column, terms: Sequence[str]) -> Column:
    """Whether any term occurs; one alternation, so the text is read once."""
    import re

    if not terms:
        return F.lit(False)
    return F.coalesce(F.lower(c).rlike("|".join(re.escape(t.lower()) for t in terms)), F.lit(False))


def gate(c: Column, terms: Sequence[str] | None) -> Column:
    """has_any, but an absent or empty list lets everything pass."""
    return has_any(c, terms) if terms else F.lit(True)


def keyword_match(c: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Hits of include; none where an excluded term occurs."""
    return F.when(has_any(c, exclude), term_array([])).otherwise(term_hits(c, include))


def event_tokens(title: Column, drop: Sequence[str] = ()) -> Column:
    """The set of words of a headline that may name its event, sorted.

    A trailing " - Publisher" is cut; words of two letters and less, common words and those of drop are left out.
    """
    base = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+-\s+[^-]+$", "")
    words = F.regexp_extract_all(base, F.lit("([a-z0-9]+)"))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*COMMON_WORDS, *drop))))


def slug(c: Column) -> Column:
    """Other than letters and digits as one underscore, none at the ends, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def heading_id(c: Column) -> Column:
    h = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(h == "", "section").otherwise(h)


def clean_cell(c: Column, most: int = 110) -> Column:
    """Text fit for a table cell: one line, no bars, cut with dots, a dash for nothing."""
    v = F.trim(F.translate(F.coalesce(c, F.lit("")), "\n|", " /"))
    return F.when(v == "", "-").when(F.length(v) > most, F.concat(F.substring(v, 1, most - 3), F.lit("..."))).otherwise(v)


def extract_summary(title: Column, text: Column, most: int = 340, default: str = "No summary.", blanks: str = r"(?U)\s+") -> Column:
    """The first two sentences of the text, without the title it may begin with."""
    body, head = collapse(text, blanks), F.trim(F.coalesce(title, F.lit("")))
    rest = F.when((head != "") & F.startswith(F.lower(body), F.lower(head)), F.regexp_replace(F.substr(body, F.length(head) + 1), r"^[ \-:.,]+|[ \-:.,]+$", "")).otherwise(body)
    two = F.array_join(F.filter(F.slice(F.split(rest, r"(?<=[.!?])" + blanks), 1, 2), lambda s: s != ""), " ")
    return F.when(two == "", default).when(F.length(two) > most, F.concat(F.rtrim(F.substring(two, 1, most - 3)), F.lit("..."))).otherwise(two)


def truncated(c: Column, most: int) -> Column:
    """The first `most` code points; a null text is empty."""
    return F.substring(F.coalesce(c, F.lit("")), 1, most)


def named(title: Column, url: Column) -> Column:
    """Whether a record has both a title and an address."""
    return (F.coalesce(title, F.lit("")) != "") & (F.coalesce(url, F.lit("")) != "")


def entry_id(url: Column, title: Column) -> Column:
    """16 hex digits of the SHA-1 of the address, else of the title, in lower case."""
    raw = F.when(F.coalesce(url, F.lit("")) != "", url).otherwise(F.coalesce(title, F.lit("")))
    return F.substring(F.sha1(F.lower(raw).cast("binary")), 1, 16)


def python_title(c: Column) -> Column:
    """Each run of letters with a capital first and the rest small, as slugs become headlines."""
    spaced = F.regexp_replace(F.lower(c), r"([^\p{L}]?)(\p{L}+)", "$1\u0001$2")
    parts = F.split(spaced, "\u0001")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))), "")


def py_round(c: Column, digits: int) -> Column:
    """Rounding of the exact binary value, half to even, where parity to the last digit matters."""

    @F.pandas_udf(T.DoubleType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: round(x, digits), na_action="ignore")

    return run(c)


def escape_html(c: Column) -> Column:
    """Markup characters and both quotes as references."""
    out = F.coalesce(c, F.lit(""))
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(ref))
    return out


def blank_if(c: Column, terms: Sequence[str]) -> Column:
    """Empty where a term of boilerplate occurs."""
    return F.when(has_any(c, terms), "").otherwise(c)


def json_array(c: Column, item: str) -> Column:
    """An array of items (a DDL type) from JSON that may stand in a fenced code block; null if unreadable."""
    return F.from_json(F.trim(F.regexp_replace(c, r"^\s*```(?:json)?\s*|\s*```\s*$", "")), f"array<{item}>")


def inline_markdown(c: Column) -> Column:
    """Links, code and bold of a Markdown line as HTML; other markup is escaped."""
    out = escape_html(c)
    out = F.regexp_replace(out, r"\[([^\]]+)\]\((https?://[^)\s]+)\)", '<a href="$2">$1</a>')
    out = F.regexp_replace(out, "`([^`]+)`", "<code>$1</code>")
    return F.regexp_replace(out, r"\*\*(.+?)\*\*", "<strong>$1</strong>")
