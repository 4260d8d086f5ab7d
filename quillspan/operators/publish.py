"""Issues over time: published index, calendar, gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.operators.events import BUILDER, Variant, repeats_of, same_event, same_event_pairs
from quillspan.session import cut, scratch

#: Published rows of a lookback that may be broadcast.
BROADCAST_ROWS = 10_000


def published_index(items: DataFrame, day: str, ident: str, select: Callable[[DataFrame], DataFrame], lookback_days: int = 7, variant: Variant = BUILDER) -> DataFrame:
    """What was published on each day, when a day may not repeat what the days before published.

    The result of a day depends on those of the days before, so days are gone through in order, one job a day
    that reads that day's folder and the written results of the last lookback_days days, and writes its own. select takes the rows of
    one day that repeat nothing and returns the idents chosen (with any further columns). What a few days
    published is a section's limit times the days, so it is broadcast and compared directly while that is at
    most BROADCAST_ROWS rows, and joined by blocks of words beyond.
    """
    spark = items.sparkSession
    cols = items.columns
    folders = scratch(spark, "items")
    items.where(F.col(day).isNotNull()).repartition(day).write.partitionBy(day).parquet(folders)
    items = spark.read.schema(items.schema).parquet(folders).select(*cols)
    days = [r[0] for r in items.select(day).distinct().orderBy(day).collect()]  # one a day, by the folders' names
    path = scratch(spark, "published")
    schema = None
    sizes: dict = {}
    for d in days:
        today = items.where(F.col(day) == F.lit(d))
        if schema is not None:
            past = spark.read.schema(schema).parquet(path).where((F.col(day) < F.lit(d)) & (F.col(day) >= F.date_sub(F.lit(d), lookback_days)))
            if sum(n for e, n in sizes.items() if (d - e).days <= lookback_days) <= BROADCAST_ROWS:
                today = today.alias("a").join(F.broadcast(past.select(*cols)).alias("b"), same_event("a", "b", variant), "left_anti")
            else:
                today = today.join(repeats_of(today, past.select(*cols), ident, day, lookback_days, variant).select(ident), ident, "left_anti").select(*cols)
        chosen = select(today)
        out = today.join(chosen.drop(day), ident).select(*cols, *[c for c in chosen.columns if c not in (*cols, day)])
        schema = out.schema
        written = Observation()
        out.observe(written, F.count("*").alias("n")).write.mode("append").parquet(path)
        sizes[d] = written.get["n"]
    return spark.read.schema(schema).parquet(path) if schema is not None else items.limit(0)


def calendar_pages(df: DataFrame, day: str, per_page: int = 7) -> DataFrame:
    """Every calendar day from the first to the last of df, newest first, with what it has and its page."""
    per_day = df.where(F.col(day).isNotNull()).groupBy(F.to_date(day).alias("day")).agg(F.count("*").alias("records"))
    ends = per_day.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a IS NOT NULL")
    spine = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    dense = spine.join(per_day, "day", "left").fillna(0, ["records"])
    place = F.row_number().over(Window.orderBy(F.col("day").desc()))  # one row per calendar day
    return dense.withColumn("page", F.ceil(place / per_page).cast("int"))


def quality_problems(sections: DataFrame, day: str, section: str, least: dict[str, int], least_all: int) -> DataFrame:
    """(day, problem): sections with fewer records than they need, and issues with too few in all."""
    counts = sections.groupBy(day).agg(*[F.count_if(F.col(section) == s).alias(f"_{i}") for i, s in enumerate(least)], F.count("*").alias("_all"))
    found = F.array_compact(F.array(
        *[F.when(F.col(f"_{i}") < n, F.concat(F.lit(f"{s} has "), F.col(f"_{i}").cast("string"), F.lit(f" of {n}"))) for i, (s, n) in enumerate(least.items())],
        F.when(F.col("_all") < least_all, F.concat(F.lit("issue has "), F.col("_all").cast("string"), F.lit(f" of {least_all}"))),
    ))
    return counts.select(day, F.explode(found).alias("problem"))


def issue_problems(expected: DataFrame, log: DataFrame, day: str) -> DataFrame:
    """(day, problem) of each expected issue: it is missing, had no sources, had neither records fetched nor candidates, or is a placeholder.

    log has one row an issue: day, source_count, fetched_count, candidates, note; nulls count as nothing. expected has
    one row a day; so an issue without any row is found too.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    found = F.array_compact(F.array(
        F.when(F.col("_has").isNull(), F.lit("the issue is missing")).otherwise(F.when(zero("source_count") <= 0, F.lit("no source was loaded"))),
        F.when(F.col("_has") & (zero("fetched_count") <= 0) & (zero("candidates") <= 0), F.lit("nothing was fetched")),
        F.when(F.contains(F.lower(F.coalesce("note", F.lit(""))), F.lit("placeholder")), F.concat(F.lit("a placeholder: "), "note")),
    ))
    return expected.select(day).join(log.withColumn("_has", F.lit(True)), day, "left").select(day, F.explode(found).alias("problem"))


def told_before(published: DataFrame, day: str, lookback_days: int) -> DataFrame:
    """What each day's issue may not repeat: a row of published for each of the lookback_days days after its own."""
    return published.withColumn(day, F.explode(F.sequence(F.date_add(day, 1), F.date_add(day, lookback_days))))


def latest_reports(paths: DataFrame, path: str, kinds: list[str], pattern: str) -> DataFrame:
    """(kind, path): of each kind the report whose name is the greatest, null if there is none.

    A report of a kind lies in a folder of that name; pattern is matched with the file's name, which begins with its date.
    """
    name, folder = F.substring_index(path, "/", -1), F.element_at(F.split(path, "/"), -2)
    mine = paths.where(name.rlike(pattern)).groupBy(folder.alias("kind")).agg(F.max_by(path, name).alias("path"))
    every = paths.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return every.join(F.broadcast(mine.where(F.col("kind").isin(kinds))), "kind", "left")  # one row a kind


def duplicate_problems(items: DataFrame, ident: str, day: str, lookback_days: int, variant: Variant = BUILDER) -> DataFrame:
    """(ident, other, kind): pairs within one issue, and per record its first repeat of an earlier issue."""
    pairs = same_event_pairs(items, ident, [day], variant)
    within = pairs.select(F.col("left").alias(ident), F.col("right").alias("other"), F.lit("issue").alias("kind"))
    past = repeats_of(items, items, ident, day, lookback_days, variant)
    return within.union(past.select(ident, F.col("earlier").alias("other"), F.lit("history").alias("kind")))


def without_earlier_sections(items: DataFrame, ident: str, group: list[str], section_ord: str, variant: Variant = BUILDER) -> DataFrame:
    """The records that tell of no event which a record kept in an earlier section of their group tells of.

    Sections are gone through in order, so a record left out of one keeps nothing out of the next; one round
    for each section. items comes from event_columns and has one row per ident.
    """
    orders = [r[0] for r in items.select(section_ord).distinct().orderBy(section_ord).collect()]  # one a section
    pairs = cut(same_event_pairs(items.select(*group, ident, "_tok", "_url", "_key", "_src"), ident, group, variant).select("left", "right"))
    both = pairs.union(pairs.select("right", "left")).toDF("mine", "other")
    kept = items.where(F.col(section_ord) == orders[0]) if orders else items
    for o in orders[1:]:
        hit = both.join(kept.select(F.col(ident).alias("other")), "other", "left_semi").select(F.col("mine").alias(ident))
        kept = cut(kept.union(items.where(F.col(section_ord) == o).join(hit, ident, "left_anti").select(*items.columns)))
    return kept


def issues(spark: SparkSession, path: str, day: str = "issue_date") -> DataFrame:
    """The days of a partitioned table of issues, newest first; read from its folders' names."""
    return spark.read.parquet(path).select(day).distinct().orderBy(F.col(day).desc())
