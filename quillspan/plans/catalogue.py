"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.plans import general, items, more, scalars, stated, trend

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**trend.QUERIES, **scalars.QUERIES, **items.QUERIES, **general.QUERIES, **more.QUERIES, **stated.QUERIES}
SQL: dict[str, str] = {**trend.SQL, **scalars.SQL, **items.SQL, **general.SQL, **more.SQL}
