"""Exact deduplication and per-source caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """One row per key, the first in order; an aggregate with map-side partials, so a hot key sends one row a partition.

    order must tell rows apart. Null keys are a key of their own.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], F.struct(*order, *[c for c in df.columns if c not in order]).alias("_row"))
    best = keyed.groupBy(*names).agg(F.min_by("_row", F.struct(*[F.col(f"_row.{c}") for c in order])).alias("_row"))
    return best.select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def last_wins(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """One row per key, the last in order."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], F.struct(*df.columns).alias("_row"))
    best = keyed.groupBy(*names).agg(F.max_by("_row", F.struct(*[F.col(f"_row.{c}") for c in order])).alias("_row"))
    return best.select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def first_rows(df: DataFrame, group: list[str], order: list[Column], n: Column | int, bound: int | None = None) -> DataFrame:
    """The first n rows of each group in order, with their place from 1.

    For a constant n Spark keeps n rows a group and partition before the shuffle (WindowGroupLimit), so a group
    with a third of all rows isn't sorted in one task. Where n is a column, bound, its greatest value, does that.
    """
    placed = df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    if bound is not None:
        placed = placed.where(F.col("place") <= bound)
    return placed.where(F.col("place") <= n)


def merge_sources(parts: list[DataFrame], key: Column, order: list[str]) -> DataFrame:
    """The first part's rows, last per key; of the others, in turn, rows whose key is still missing."""
    tagged = None
    for i, p in enumerate(parts):
        one = p.withColumn("_part", F.lit(i))
        tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)
    cols = [c for c in tagged.columns if c != "_part"]
    k = tagged.select(key.alias("_key"), F.struct(*cols).alias("_row"), F.struct((-F.col("_part")).alias("p"), *order).alias("_o"))
    return k.groupBy("_key").agg(F.max_by("_row", "_o").alias("_row")).select("_row.*")
