"""Growth ranking over snapshots."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.scores import TREND, safe_norm
from quillspan.functions.times import activity
from quillspan.session import cut

CARRIED = ("full_name", "author", "category", "matched_categories", "language", "pushed_at", "last_update", "stars_gained_hint", "forks_gained_hint", "source")


def as_of(rows: DataFrame, key: Column, days: dict[str, date]) -> DataFrame:
    """Per key the last delivered row on or before each of the given days, as structs, in one aggregation.

    The last ingested row of a date stands. Keys without any row by a day have null there.
    """
    at = F.struct("snapshot_date", "ingest_ord")
    row = F.struct("snapshot_date", F.coalesce("stars", F.lit(0)).alias("stars"), F.coalesce("forks", F.lit(0)).alias("forks"), *CARRIED)
    last = max(days.values())
    # No row after the last day matters: the filter reaches the scan and prunes row groups.
    return (
        rows.where(F.col("snapshot_date") <= F.lit(last))
        .groupBy(key.alias("repo"))
        .agg(*[F.max_by(F.when(F.col("snapshot_date") <= F.lit(d), row), F.when(F.col("snapshot_date") <= F.lit(d), at)).alias(name) for name, d in days.items()])
    )


def growth(rows: DataFrame, start: date, end: date) -> DataFrame:
    """Stars and forks gained from start to end per repository, with the carried columns of its latest row.

    Without an earlier row the hints of the source stand; losses count as 0.
    """
    both = as_of(rows, F.lower("full_name"), {"now": end, "base": start}).where("now IS NOT NULL")
    fresh = F.col("base").isNull() | (F.col("base.snapshot_date") == F.col("now.snapshot_date"))

    def gained(c: str) -> Column:
        hint = F.coalesce(F.col(f"now.{c}_gained_hint"), F.lit(0))
        return F.when(fresh, hint).otherwise(F.greatest(F.lit(0), F.col(f"now.{c}") - F.col(f"base.{c}"))).alias(f"{c}_gained")

    return both.select(
        "repo", "now.snapshot_date", "now.stars", "now.forks", *[f"now.{c}" for c in CARRIED if c != "full_name" and not c.endswith("_hint")],
        gained("stars"), gained("forks"), F.when(fresh, "hint").otherwise("snapshot").alias("baseline_source"),
    )


def rank(rows: DataFrame, start: date, end: date) -> DataFrame:
    """growth with recent_activity and trend_score.

    The growth rows, one a repository, are kept in the shared folder: they are read for the maxima, one row
    that becomes constants, and again for the scores, and the snapshots are scanned once.
    """
    g = cut(growth(rows, start, end).withColumn("recent_activity", activity(F.lit(end), F.col("pushed_at"), F.col("last_update"), F.col("snapshot_date").cast("string"))))
    most = g.agg(*[F.coalesce(F.max(c), F.lit(1)).alias(c) for c in ("stars_gained", "stars", "forks_gained")]).first()
    score = (
        TREND["growth"] * safe_norm(F.col("stars_gained"), F.lit(most["stars_gained"]))
        + TREND["stars"] * safe_norm(F.col("stars"), F.lit(most["stars"]))
        + TREND["activity"] * F.col("recent_activity")
        + TREND["forks"] * safe_norm(F.col("forks_gained"), F.lit(most["forks_gained"]))
    )
    return g.withColumn("trend_score", F.round(score, 4))


def top(ranked: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows and their place from 1; ties go by repository."""
    first = ranked.orderBy(*order, "repo").limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order, "repo")))



def ordering(*names: str) -> list[Column]:
    """Columns in descending order, ascending where the name begins with a plus."""
    return [F.col(n[1:]).asc() if n[0] == "+" else F.col(n).desc() for n in names]


def in_categories(ranked: DataFrame) -> DataFrame:
    """A row per repository and category, its own or a matched one."""
    every = F.array_distinct(F.array_union(F.array("category"), F.coalesce("matched_categories", F.array().cast("array<string>"))))
    return ranked.withColumn("in_category", F.explode(F.array_compact(every)))


def top_per_category(ranked: DataFrame, order: list[Column], n: int = 10) -> DataFrame:
    w = Window.partitionBy("in_category").orderBy(*order, "repo")
    return in_categories(ranked).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def emerging(ranked: DataFrame, most_stars: int = 2500, least_growth: int = 5) -> DataFrame:
    return ranked.where((F.col("stars") <= most_stars) & (F.col("stars_gained") >= least_growth))


def author_rollup(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("author").agg(
        F.countDistinct("repo").alias("repos"),
        F.sum("stars").alias("stars"),
        F.sum("stars_gained").alias("stars_gained"),
        F.count("*").alias("appearances"),
        F.array_join(F.slice(F.array_sort(F.collect_set("category")), 1, 3), ", ").alias("categories"),
    )


def top_authors(rollup: DataFrame, n: int = 20) -> DataFrame:
    """The first n owners by stars gained, stars and repositories, with their place."""
    order = [*ordering("stars_gained", "stars", "repos"), F.col("author")]
    return rollup.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def growth_hint(stars: Column, ordinal: Column) -> Column:
    """An assumed growth of sample rows: a part of the stars that varies with the ordinal, 6 at least."""
    return F.greatest(F.lit(6), F.floor(stars * (F.lit(0.01) + (ordinal % 5) * F.lit(0.004)))).cast("long")


def latest_first_delivered(rows: DataFrame, key: Column) -> DataFrame:
    """Per key the row of its latest date; of several of that date the first delivered."""
    best = rows.groupBy(key.alias("_k")).agg(F.max_by(F.struct(*rows.columns), F.struct("snapshot_date", -F.col("ingest_ord"))).alias("r"))
    return best.select("r.*")
