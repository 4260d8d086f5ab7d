"""Rule tables compiled to expressions: the first rule that holds decides."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.text import has_any

#: (name, groups): a rule holds when of every group of terms at least one occurs in the text.
Rule = tuple[str, Sequence[Sequence[str]]]


def first_rule(text: Column, rules: Sequence[Rule], default: str | None, other: Column | None = None) -> Column:
    """The name of the first rule that holds, else default, or what other gives."""
    default = F.lit(default) if other is None else other
    out: Column | None = None
    for name, groups in rules:
        held: Column = F.lit(True)
        for g in groups:
            held = held & has_any(text, g)
        out = F.when(held, name) if out is None else out.when(held, name)
    return default if out is None else out.otherwise(default)


def any_word(text: Column, words: Sequence[str]) -> Column:
    """Whether any of the words or phrases occurs with no letter, digit or underscore beside it; one alternation."""
    return F.coalesce(F.lower(text).rlike(r"(?<![\p{L}\p{N}_])(?:" + "|".join(re.escape(w) for w in words) + r")(?![\p{L}\p{N}_])"), F.lit(False))


def mapped(c: Column, table: Mapping[str, str], default: Column | str | None = None) -> Column:
    out: Column | None = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    other = F.lit(default) if default is None or isinstance(default, str) else default
    return other if out is None else out.otherwise(other)


def keyword_scores(text: Column, categories: Mapping[str, Sequence[str]]) -> Column:
    """(category, score, place) of every category that scores, best first: 2 a phrase found, 1 a single word."""
    low = F.lower(F.coalesce(text, F.lit("")))
    rows = []
    for place, (name, words) in enumerate(categories.items()):
        score: Column = F.lit(0)
        for w in words:
            score = score + F.when(F.contains(low, F.lit(w.lower())), 2 if " " in w else 1).otherwise(0)
        rows.append(F.struct((-score).alias("neg"), F.lit(place).alias("place"), F.lit(name).alias("category")))
    return F.filter(F.array_sort(F.array(*rows)), lambda r: r["neg"] < 0)


def effective_source(source: Column, title: Column, prefix: str) -> Column:
    """The publisher a headline ends with, where the source is only an aggregator whose name begins with prefix, as it is written."""
    return F.when(F.startswith(source, F.lit(prefix)) & F.contains(title, F.lit(" - ")), F.trim(F.substring_index(title, " - ", -1))).otherwise(source)


def publisher(source: Column, title: Column, prefix: str, unknown: str = "unknown") -> Column:
    """The publisher a headline ends with, where the source is only an aggregator whose name begins with prefix, in any letter case.

    A source that is null or empty, of a headline that names none, is unknown.
    """
    own = F.trim(F.coalesce(source, F.lit("")))
    last = F.trim(F.substring_index(F.trim(F.coalesce(title, F.lit(""))), " - ", -1))
    inferred = F.startswith(F.lower(own), F.lit(prefix.lower())) & F.contains(F.trim(F.coalesce(title, F.lit(""))), F.lit(" - ")) & (last != "")
    return F.when(inferred, last).when(own == "", unknown).otherwise(own)


def organization(source: Column, title: Column, url: Column, names: Mapping[str, str], prefix: str) -> Column:
    """The first of names (a term and the organization it stands for) that source, headline or address mentions, else the source in lower case."""
    own = publisher(source, title, prefix)
    text = F.lower(F.concat_ws(" ", own, F.coalesce(title, F.lit("")), F.coalesce(url, F.lit(""))))
    return first_rule(text, [(name, [[term]]) for term, name in names.items()], None, F.lower(own))


def lead_phrase(title: Column, leads: Mapping[str, Sequence[str]], default: str) -> Column:
    """The phrase whose openings the title begins with, in any letter case."""
    low = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    out: Column | None = None
    for phrase, openings in leads.items():
        held: Column = F.lit(False)
        for o in openings:
            held = held | F.startswith(low, F.lit(o))
        out = F.when(held, phrase) if out is None else out.when(held, phrase)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def excluded_noise(title: Column, source: Column, text: Column, terms: Sequence[str]) -> Column:
    """Whether headline, source or text holds a term of another subject that shares a section's words."""
    return has_any(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, source, text)]), terms)


def page_category(c: Column) -> Column:
    """Aliases of engineering made one; all else stays as it is."""
    return F.when(c.isin("cae_ai_engineering", "engineering_ai"), "engineering_ai").otherwise(F.coalesce(c, F.lit("")))


def trusted(kind: Column, tags: Column, aggregator: str, tag: str) -> Column:
    """Whether a record doesn't come from an aggregator, or its source bears the tag."""
    return (F.coalesce(kind, F.lit("")) != aggregator) | F.coalesce(F.array_contains(tags, tag), F.lit(False))


def broad_discovery(kind: Column, source: Column, tags: Column, aggregator: str, prefix: str, tag: str) -> Column:
    """Whether a record was only found by an aggregator's broad search."""
    return (kind == aggregator) & F.startswith(source, F.lit(prefix)) & ~F.coalesce(F.array_contains(tags, tag), F.lit(False))


def section_matches(section: str, category: Column, preferred: Column) -> Column:
    """Whether a record may stand in a section: general takes preferred research too, others their own category."""
    if section == "general_ai":
        return (category == "general_ai") | ((category == "research") & preferred)
    return category == section
