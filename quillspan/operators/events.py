"""Records that tell of the same event: pairs, and anti-joins against history."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.rules import Rule, first_rule
from quillspan.functions.text import event_tokens
from quillspan.functions.urls import page_url, shown_url


@dataclass(frozen=True)
class Variant:
    """Which rules tell same events: by address, by event key, by same source; words count in all."""

    url: str | None = "page"
    event_key: bool = True
    same_source: bool = True


BUILDER, RENDERER, SUMMARISER = Variant(), Variant("shown", False, True), Variant(None, True, False)
#: Common words, and the part they are of the smaller set or of the union, that make one event.
SAME_SOURCE, OF_SMALLER, OF_UNION = (2, 0.67), (5, 0.5), (4, 0.42)


def event_columns(df: DataFrame, title: str, url: str, source: str, rules: Sequence[Rule] = (), drop: Sequence[str] = (), variant: Variant = BUILDER) -> DataFrame:
    """df with _tok, _url, _key and _src, computed once a record."""
    address = {"page": page_url, "shown": shown_url}.get(variant.url or "", lambda c: F.lit(""))
    key = first_rule(F.col(title), rules, None) if variant.event_key and rules else F.lit(None).cast("string")
    return df.withColumns({"_tok": event_tokens(F.col(title), drop), "_url": address(F.col(url)), "_key": key, "_src": F.lower(F.coalesce(F.col(source), F.lit("")))})


def same_event(a: str, b: str, variant: Variant = BUILDER) -> Column:
    """Whether two aliased sides of event_columns tell of one event."""
    x, y = F.col(f"{a}._tok"), F.col(f"{b}._tok")
    smaller = F.least(F.size(x), F.size(y))

    def by_words(both: Column) -> Column:
        either = F.size(x) + F.size(y) - both
        words = ((both >= OF_SMALLER[0]) & (both >= OF_SMALLER[1] * smaller)) | ((both >= OF_UNION[0]) & (both >= OF_UNION[1] * either))
        if variant.same_source:
            words = words | ((F.col(f"{a}._src") == F.col(f"{b}._src")) & (both >= SAME_SOURCE[0]) & (both >= SAME_SOURCE[1] * smaller))
        return words

    words = F.exists(F.array(F.size(F.array_intersect(x, y))), by_words)  # a join condition would compute it at each mention
    held = words
    if variant.url:
        held = held | ((F.col(f"{a}._url") != "") & (F.col(f"{a}._url") == F.col(f"{b}._url")))
    if variant.event_key:
        held = held | F.coalesce(F.col(f"{a}._key") == F.col(f"{b}._key"), F.lit(False))
    return held


def _pairs_of(words: Column, kind: Column) -> Column:
    """A hash of kind and each two of the words, whatever their order."""
    places = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(places, lambda i: F.transform(F.slice(words, i + 1, F.size(words)), lambda x: F.xxhash64(kind, F.least(x, F.element_at(words, i)), F.greatest(x, F.element_at(words, i))))))


def _blocks(df: DataFrame, group: Sequence[str], ident: str, frequency: DataFrame, variant: Variant, by_two: bool = False) -> DataFrame:
    """(group, block, ident): any two records that are one event share a block.

    Rules by words need 4 common words, or 2 of one source: of the words, rarest first, all but the 3 (or 1)
    most frequent are enough to share one, so the crowded blocks of frequent words are never made. by_two makes
    blocks of two words each instead: two of 4 common words are among all but the 2 most frequent, and of one source
    both. Such blocks are far smaller and more; they are named by a hash, which can only propose more.
    """
    words = df.select(*group, ident, "_src", F.size("_tok").alias("n"), F.explode("_tok").alias("w")).join(frequency, "w")
    listed = words.groupBy(*group, ident, "_src", "n").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("l"))
    if by_two:
        listed = listed.withColumn("l", F.transform("l", lambda x: x["w"]))
        rare = _pairs_of(F.slice("l", 1, F.greatest(F.col("n") - 2, F.lit(0))), F.lit("w"))
        own = _pairs_of(F.col("l"), F.concat(F.lit("s:"), F.col("_src"))) if variant.same_source else F.array().cast("array<bigint>")
        keep = listed.select(*group, ident, F.explode(F.array_union(rare, own)).alias("block"))
    else:
        keep = listed.select(*group, ident, F.explode(F.array_union(
            F.transform(F.slice("l", 1, F.greatest(F.col("n") - 3, F.lit(0))), lambda x: F.concat(F.lit("w:"), x["w"])),
            F.transform(F.slice("l", 1, F.greatest(F.col("n") - 1, F.lit(0))), lambda x: F.concat(F.lit("s:"), F.col("_src"), F.lit(" "), x["w"])) if variant.same_source else F.array().cast("array<string>"),
        )).alias("block"))
    named = F.xxhash64 if by_two else F.concat
    parts = [keep]
    if variant.url:
        parts.append(df.where("_url <> ''").select(*group, ident, named(F.lit("u:"), "_url").alias("block")))
    if variant.event_key:
        parts.append(df.where("_key IS NOT NULL").select(*group, ident, named(F.lit("k:"), "_key").alias("block")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def word_frequency(df: DataFrame) -> DataFrame:
    return df.select(F.explode("_tok").alias("w")).groupBy("w").agg(F.count("*").alias("f"))


def same_event_pairs(df: DataFrame, ident: str, group: Sequence[str] = (), variant: Variant = BUILDER, once: bool = True) -> DataFrame:
    """(group, left, right), left < right, of all pairs within a group that tell of one event.

    df comes from event_columns and has one row per ident, or, unless once, more that are alike.
    """
    from quillspan.operators.pairs import pairs_within  # it takes the rules from here

    return pairs_within(df, ident, group, variant, once)


def repeats_of(df: DataFrame, past: DataFrame, ident: str, day: str, lookback_days: int, variant: Variant = BUILDER) -> DataFrame:
    """(ident, earlier): for each record of df the least ident of past that tells of the same event and is
    1 to lookback_days days older. Both come from event_columns."""
    f = word_frequency(df.select("_tok").union(past.select("_tok")))
    new, old = _blocks(df, [day], ident, f, variant, True), _blocks(past, [day], ident, f, variant, True)
    l = new.select(F.col(day).alias("d"), "block", F.col(ident).alias("left"))
    r = old.select(F.col(day).alias("e"), "block", F.col(ident).alias("right"))
    near = l.join(r, "block").where((F.col("e") < F.col("d")) & (F.col("e") >= F.date_sub("d", lookback_days))).select("left", "right").distinct()
    need = [ident, "_tok", "_url", "_key", "_src"]
    a, b = df.select(*need).alias("a"), past.select(*need).alias("b")
    hit = near.join(a, F.col("left") == F.col(f"a.{ident}")).join(b, F.col("right") == F.col(f"b.{ident}")).where(same_event("a", "b", variant))
    return hit.groupBy(F.col("left").alias(ident)).agg(F.min("right").alias("earlier"))


def repeats_of_few(df: DataFrame, past: DataFrame, ident: str, day: str, lookback_days: int, variant: Variant = BUILDER) -> DataFrame:
    """repeats_of where past is small, counted beforehand, and read more than once: it is broadcast, and df isn't shuffled for it.

    Only the past's words are cut to the rarest; a record of df looks up all of its own, so no order of them is needed.
    """
    none = F.array().cast("array<string>")
    listed = [F.transform("_tok", lambda x: F.concat(F.lit("w:"), x))]
    if variant.same_source:
        listed.append(F.transform("_tok", lambda x: F.concat(F.lit("s:"), F.col("_src"), F.lit(" "), x)))
    if variant.url:
        listed.append(F.when(F.col("_url") != "", F.array(F.concat(F.lit("u:"), "_url"))).otherwise(none))
    if variant.event_key:
        listed.append(F.when(F.col("_key").isNotNull(), F.array(F.concat(F.lit("k:"), "_key"))).otherwise(none))
    need = [ident, day, "_tok", "_url", "_key", "_src"]
    a = df.select(*need, F.explode(F.concat(*listed)).alias("block")).alias("a")
    old = _blocks(past, [], ident, word_frequency(past), variant)
    b = F.broadcast(old.join(past.select(*need), ident)).alias("b")
    near = (F.col(f"b.{day}") < F.col(f"a.{day}")) & (F.col(f"b.{day}") >= F.date_sub(f"a.{day}", lookback_days))
    hit = a.join(b, (F.col("a.block") == F.col("b.block")) & near & same_event("a", "b", variant))
    return hit.groupBy(F.col(f"a.{ident}").alias(ident)).agg(F.min(f"b.{ident}").alias("earlier"))


def without_repeats(df: DataFrame, past: DataFrame, ident: str, day: str, lookback_days: int, variant: Variant = BUILDER) -> DataFrame:
    """The records of df that repeat none of past."""
    return df.join(repeats_of(df, past, ident, day, lookback_days, variant).select(ident), ident, "left_anti")
