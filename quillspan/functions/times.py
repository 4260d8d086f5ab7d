"""Dates, periods and recency."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tried in turn after the weekday is cut off: mail dates, then ISO forms without fractions.
FORMATS = (
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm:ss z",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ssXX",
    "yyyy-MM-dd",
)


@dataclass(frozen=True)
class Period:
    label: str
    start: date
    end: date
    top_n: int


def weekly(today: date, top_n: int = 20) -> Period:
    """The week that ends on the latest Sunday not after today."""
    end = today - timedelta(days=(today.weekday() + 1) % 7)
    return Period("weekly", end - timedelta(days=7), end, top_n)


def monthly(today: date, top_n: int = 30) -> Period:
    """The calendar month before today's."""
    end = today.replace(day=1) - timedelta(days=1)
    return Period("monthly", end.replace(day=1), end, top_n)


def week_end(d: Column) -> Column:
    return F.date_sub(d, (F.weekday(d) + 1) % 7)


def feed_time(c: Column) -> Column:
    """Feed dates as timestamps; forms with fractions of a second, and unknown ones, are null."""
    s = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in FORMATS])


def within_window(published: Column, now: Column, hours: Column) -> Column:
    """Whether a record is recent enough; unknown dates pass."""
    return published.isNull() | (published >= now - F.make_interval(hours=hours.cast("int")))


def recency(published: Column, now: Column, hours: Column) -> Column:
    """1 for new, falling to 0.25 at the window's end, 0 beyond, 0.15 at least within; 0.35 if unknown."""
    age = F.greatest((now.cast("double") - published.cast("double")) / 3600, F.lit(0.0))
    return F.when(published.isNull(), 0.35).when(age > hours, 0.0).otherwise(F.greatest(F.lit(0.15), 1 - age / hours * 0.75))


def activity(end: Column, *days: Column) -> Column:
    """How recently something moved, by the first of days that isn't empty; an unreadable date is 0."""
    first = F.coalesce(*[F.when(d != "", d) for d in days])
    age = F.datediff(end, F.try_to_date(F.substring(first, 1, 10), "yyyy-MM-dd"))  # below 0 for later days, which count as new
    return F.when(age.isNull(), 0.0).when(age <= 7, 1.0).when(age <= 30, 0.7).when(age <= 90, 0.4).otherwise(0.1)


def iso_time(t: Column) -> Column:
    """An instant in ISO form with its offset (UTC), with microseconds only where there are some; null stays null."""
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    rest = F.pmod(F.unix_micros(t), F.lit(1_000_000))
    return F.concat(whole, F.when(rest > 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def long_date(d: Column) -> Column:
    return F.date_format(d, "EEEE, MMMM dd, yyyy")


def widened(hours: Column, kind: Column, category: Column, matches: Column, ai: Column, wide: int) -> Column:
    """The wider window for records of searched sites whose words fit engineering though their source doesn't."""
    fits = (kind == "sitemap_or_search") & (F.coalesce(category, F.lit("")) != "engineering_ai") & matches & ai
    return F.when(fits, F.lit(wide)).otherwise(hours)


def is_weekday(d: Column, weekday: int) -> Column:
    """Whether a day is the given one, 0 for Monday."""
    return F.weekday(d) == weekday
