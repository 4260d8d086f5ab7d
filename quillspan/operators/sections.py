"""Sections of an issue: how each is filled from ranked records, as passes of a greedy selection.

Records come from event_columns with category (canonical), preferred and trusted (boolean), broad ("broad" for what
only an aggregator's broad search found, else null), topic and origin (the source that caps count by).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.rules import section_matches
from quillspan.operators.dedup import first_wins
from quillspan.operators.events import BUILDER, RENDERER, SUMMARISER, Variant
from quillspan.operators.selection import Pass, select_greedily
from quillspan.session import cut

GENERAL, ENGINEERING, RESEARCH = "general_ai", "engineering_ai", "research"
#: Records of one topic, and of one source, that a section takes while it diversifies.
PER_TOPIC = 2
PER_SOURCE = {GENERAL: 2, ENGINEERING: 1}
EVENT = ("_tok", "_url", "_key", "_src")


@dataclass(frozen=True)
class Issue:
    """How records are grouped into issues, named and ordered; known is what each issue has told of before."""

    group: Sequence[str]
    ident: str
    order: Sequence[str]
    known: DataFrame | None = None

    def knowing(self, *more: DataFrame) -> Issue:
        """The same with further records told."""
        cols = [*self.group, *EVENT]
        known = self.known
        for m in more:
            known = m.select(*cols) if known is None else known.select(*cols).union(m.select(*cols))
        return Issue(self.group, self.ident, self.order, known)

    def select(self, df: DataFrame, passes: Sequence[Pass], limit: int, variant: Variant) -> DataFrame:
        return select_greedily(df, self.group, self.ident, list(self.order), passes, limit, variant, self.known)

    def rows(self, df: DataFrame, chosen: DataFrame) -> DataFrame:
        """The chosen records with all columns of df."""
        return df.join(F.broadcast(chosen.select(*self.group, self.ident)), [*self.group, self.ident], "left_semi") if chosen is not None else df


def draft_section(df: DataFrame, issue: Issue, section: str, limit: int, variant: Variant = BUILDER) -> DataFrame:
    """(group, ident, place) of a section of the draft.

    First trusted records of the section (in general and engineering) under the caps of topic and source, then others
    with few of broad search among them, then without the cap of topics, then with it again. The general section takes
    preferred records only; if it stays short, it is chosen once more without that condition, from counts of zero, and
    what repeats nothing is added.
    """
    capped, per = section in PER_SOURCE, PER_SOURCE.get(section, limit)
    broad = {"broad": per} if capped else {}
    passes = [
        Pass("_first", {"topic": PER_TOPIC, "origin": per}, ("topic", "origin")),
        Pass("_fits", {"topic": PER_TOPIC, "origin": per} | broad, ("topic", "origin", "broad")),
        Pass("_fits", {"origin": per} | broad, ("origin", "broad")),
        Pass("_fits", {"topic": PER_TOPIC} | ({"origin": per} if capped else {}) | broad, ("topic", "origin", "broad")),
    ]

    def run(preferred: bool) -> DataFrame:
        fits = section_matches(section, F.col("category"), F.col("preferred"))
        if preferred:
            fits = fits & F.col("preferred")
        return issue.select(df.withColumns({"_fits": fits, "_first": fits & F.col("trusted") if capped else fits}), passes, limit, variant)

    if section != GENERAL:
        return run(False)
    keys = [*issue.group, issue.ident]
    first, again = cut(run(True)), run(False)
    again = again.join(first.select(*keys), keys, "left_anti")
    listed = first.withColumn("_list", F.lit(0)).union(again.withColumn("_list", F.lit(1))).withColumnRenamed("place", "_place")
    both = df.select(*keys, *EVENT).join(listed, keys).withColumn("_all", F.lit(True))
    # what was chosen first tells of no event twice, so all of it is taken again
    return select_greedily(both, issue.group, issue.ident, ["_list", "_place"], [Pass("_all")], limit, variant)


def draft_topic_section(df: DataFrame, issue: Issue, about: Column, limit: int, variant: Variant = BUILDER) -> DataFrame:
    """A section by subject: records of general and research that are about it; trusted ones by topic first, then others, one of broad search at most."""
    fits = F.col("category").isin(GENERAL, RESEARCH) & about
    rows = df.withColumns({"_fits": fits, "_first": fits & F.col("trusted")})
    return issue.select(rows, [Pass("_first", {"topic": PER_TOPIC}, ("topic",)), Pass("_fits", {"broad": 1}, ("broad",))], limit, variant)


def pooled(lists: Sequence[DataFrame], issue: Issue) -> DataFrame:
    """Lists of records one after the other, each record where it stands first; _list is the number of its list."""
    every = None
    for k, part in enumerate(lists):
        one = part.withColumn("_list", F.lit(k))
        every = one if every is None else every.unionByName(one)
    return first_wins(every, [*[F.col(g) for g in issue.group], F.col(issue.ident)], ["_list", issue.ident])


def page_section(pool: DataFrame, issue: Issue, section: str, limit: int, listed: DataFrame | None = None, excluded: Column | None = None, variant: Variant = RENDERER) -> DataFrame:
    """(group, ident, place) of a section as shown: under the caps of topic and source, then of source, then none but in general and engineering.

    pool is in order of issue.order (give _list first where it has lists). The general section takes preferred records
    only, in issues whose listed records have a preferred one; where it stays short it is chosen anew without that.
    """
    per = 1 if section == ENGINEERING else 2
    last = {"origin": per} if section in PER_SOURCE else {}
    passes = [Pass("_fits", {"topic": PER_TOPIC, "origin": per}, ("topic", "origin")), Pass("_fits", {"origin": per}, ("origin",)), Pass("_fits", last, ("origin",))]
    free = F.lit(True) if excluded is None or section != ENGINEERING else ~excluded

    def run(rows: DataFrame, preferred: bool) -> DataFrame:
        fits = section_matches(section, F.col("category"), F.col("preferred")) & free
        return issue.select(rows.withColumn("_fits", fits & F.col("preferred") if preferred else fits), passes, limit, variant)

    if section != GENERAL or listed is None:
        return run(pool, False)
    by = list(issue.group)
    asked = listed.where("preferred").select(*by).distinct()
    first = cut(run(pool.join(asked, by, "left_semi"), True))
    full = first.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= limit).select(*by)
    return first.join(full, by, "left_semi").unionByName(run(pool.join(full, by, "left_anti"), False))


def filled(chosen: DataFrame, fallback: DataFrame, pool: DataFrame, issue: Issue, limit: int, variant: Variant = RENDERER) -> DataFrame:
    """A section and, while it is short, the records of a fallback list that tell of nothing told; in their order, under no cap."""
    keys = [*issue.group, issue.ident]
    more = fallback.join(chosen.select(*keys), keys, "left_anti").select(*keys, *EVENT, F.lit(1).alias("_part"), F.col("place").alias("_place"))
    own = pool.join(chosen, keys).select(*keys, *EVENT, F.lit(0).alias("_part"), F.col("place").alias("_place"))
    both = own.union(more).withColumn("_all", F.lit(True))
    return select_greedily(both, issue.group, issue.ident, ["_part", "_place"], [Pass("_all")], limit, variant, issue.known)


def topic_page_section(pool: DataFrame, issue: Issue, about: Column, limit: int, variant: Variant = RENDERER) -> DataFrame:
    """A section by subject as shown."""
    return issue.select(pool.withColumn("_fits", F.col("category").isin(GENERAL, RESEARCH) & about), [Pass("_fits", {"topic": PER_TOPIC}, ("topic",))], limit, variant)


def summary_section(df: DataFrame, issue: Issue, section: str, limit: int, excluded: Column | None = None, variant: Variant = SUMMARISER) -> DataFrame:
    """A section for summaries: the cap of topics, then none."""
    fits = F.col("category") == section
    if excluded is not None and section == ENGINEERING:
        fits = fits & ~excluded
    return issue.select(df.withColumn("_fits", fits), [Pass("_fits", {"topic": PER_TOPIC}, ("topic",)), Pass("_fits")], limit, variant)


def day_sections(audit: DataFrame, listed: dict[str, DataFrame], issue: Issue, about: Column, excluded: Column | None = None, variant: Variant = RENDERER) -> DataFrame:
    """(group, section, ident, place) of a shown issue: general, engineering, the section by subject, research.

    audit is the list of an issue's best records; listed holds the records (with place) of the sections of the draft,
    "general_ai", "engineering_ai", "topic" and "research". A section tells of nothing that issue.known or a section
    before it told of; what an audit list leaves short is filled from the draft's section.
    """
    limits = {GENERAL: 10, ENGINEERING: 5, "topic": 5, RESEARCH: 5}
    pool = cut(pooled([listed[GENERAL].drop("place"), audit], issue))
    audit = cut(audit)
    general = cut(page_section(pool, Issue(issue.group, issue.ident, ["_list", *issue.order], issue.known), GENERAL, limits[GENERAL], listed[GENERAL], variant=variant))
    out = [general.withColumn("section", F.lit(GENERAL))]
    known = issue.knowing(issue.rows(pool, general))
    for name in (ENGINEERING, "topic", RESEARCH):
        one = topic_page_section(audit, known, about, limits[name], variant) if name == "topic" else page_section(audit, known, name, limits[name], excluded=excluded, variant=variant)
        one = cut(filled(one, listed[name], audit, known, limits[name], variant))
        out.append(one.withColumn("section", F.lit(name)))
        # both sides come from these lists, so their events are there to be known
        known = known.knowing(issue.rows(pooled([audit, listed[name].drop("place")], issue), one))
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole.select(*issue.group, "section", issue.ident, "place")
