"""Mixing sources to target weights, by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.session import cut


def running_total(df: DataFrame, groups: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with the inclusive running total of value (whole numbers) per group in the given order, as column name.

    Distributed: rows are range-partitioned by group and order, each partition adds up its own, and the totals
    of earlier partitions of a group, one row per group and partition, are added. No group is brought together,
    so one with a third of all rows is spread like the others. The order must tell all rows apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        at, total = None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            for g in groups:
                codes = b.column(g).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            key = tuple(b.column(g)[0].as_py() for g in groups)
            v = b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(v)
            first = np.concatenate(([0], np.flatnonzero(new)))
            before = np.where(first > 0, sums[first - 1], -total if key == at else 0)
            sums = sums - np.repeat(before, np.diff(np.append(first, n)))
            at, total = tuple(b.column(g)[n - 1].as_py() for g in groups), int(sums[-1])
            yield b.append_column(pa.field("_own", pa.int64()), pa.array(sums))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    ranged = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    own = cut(ranged.mapInArrow(run, f"{fields}, _own bigint").withColumn("_part", F.spark_partition_id()))
    parts = own.groupBy(*groups, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    return own.join(offset, [*groups, "_part"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_part")


def _finish(sources: list[tuple[float, int]], size: int) -> float | None:
    """The finish time F at which sources of (weight, available) have size together, each min(weight * F, available); None if they never have."""
    left = list(sources)
    spent = 0
    while left:
        at = (size - spent) / sum(w for w, _ in left)
        out = [s for s in left if s[1] < s[0] * at]
        if not out:
            return at
        spent += sum(a for _, a in out)
        left = [s for s in left if s[1] >= s[0] * at]
    return None


def mixture(df: DataFrame, targets: DataFrame, ident: str, source: str, size: str, budget: int | str | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(mix, shares): the documents of a mixture in their order, and what each source's share became.

    targets has (source, target_share, max_repeats), one row per source, few enough for the driver; a share
    of null or 0 and below, and max_repeats of null or below 1, take a source out. mix has (mix_offset,
    source, ident, copy, n_tokens): mix_offset is the sum of all sizes before the row, copy counts the uses of
    a document from 0 and stays below max_repeats. shares has one row per target: source, target_share,
    documents, uses, most_repeats, n_tokens, actual_share, available_tokens (all its documents, repeats included),
    ran_out (all of that was used) and the budget; a source without documents is reported with 0.

    budget is the total size. None is the largest at which every source that has documents holds its share of the
    shares of these sources, which the smallest source sets; "held" is the size of all documents of the targets,
    each counted once. With a larger one than None's, small sources run out (after max_repeats uses) and the others
    go on in proportion, as the shares then report: within a document of each source, source s has the least of
    its available tokens and share * F, with F such that these add up to the budget. Rows with a null source, ident or size, or of no target,
    are left out; other columns are pruned; idents must be unique; empty tables give an empty mixture.

    Weighted fair queueing: documents are shuffled by a hash of seed and ident; a document's virtual finish
    time is the running total of its source's sizes (earlier uses of the source included) divided by the
    source's share. All are range-sorted by finish time and cut off where the running total passes budget.
    """
    spark = df.sparkSession
    named = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats >= 1").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").cast("long").alias("most"))
    docs = df.select(F.col(source).alias("source"), F.col(ident).alias("ident"), F.col(size).cast("long").alias("n")).where("ident IS NOT NULL AND n IS NOT NULL")
    docs = cut(docs.join(named.select("source"), "source", "left_semi"))
    # One row per target: as many as the configuration has.
    have = named.join(docs.groupBy("source").agg(F.sum("n").alias("total"), F.max("n").alias("largest")), "source").where("total > 0").collect()
    weight = sum(r["share"] for r in have)
    if budget is None:
        budget = int(min((r["total"] * r["most"] * weight / r["share"] for r in have), default=0))
    elif budget == "held":
        budget = sum(r["total"] for r in have)
    until = _finish([(r["share"] / weight, r["total"] * r["most"]) for r in have], budget + sum(r["largest"] for r in have))
    plan = spark.createDataFrame([(r["source"], r["share"] / weight, r["total"], r["most"]) for r in have], "source string, weight double, total long, most long")
    summed = running_total(docs.withColumn("_key", F.xxhash64(F.lit(seed), "ident")), ["source"], ["_key", "ident"], "n", "so_far")
    uses = summed.join(F.broadcast(plan), "source").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") - 1)))
    timed = uses.withColumn("finish", (F.col("copy") * F.col("total") + F.col("so_far")) / F.col("weight"))
    if until is not None:
        timed = timed.where(F.col("finish") <= until)
    whole = running_total(timed.select("source", "ident", "copy", "n", "finish"), [], ["finish", "source", "copy", "ident"], "n", "upto").where(F.col("upto") <= budget)
    mix = whole.select((F.col("upto") - F.col("n")).alias("mix_offset"), "source", F.col("ident").alias(ident), F.col("copy").cast("int").alias("copy"), F.col("n").alias("n_tokens"))
    per_document = mix.groupBy("source", ident).agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("n"))
    reached = per_document.groupBy("source").agg(F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_repeats"), F.sum("n").alias("n_tokens"))
    report = targets.where("source IS NOT NULL").select("source", "target_share").join(reached, "source", "left").fillna(0, ["documents", "uses", "most_repeats", "n_tokens"])
    whole_size = F.sum("n_tokens").over(Window.partitionBy())  # over one row per target
    shares = report.withColumn("actual_share", F.coalesce(F.try_divide(F.col("n_tokens"), whole_size), F.lit(0.0)))
    held = spark.createDataFrame([(r["source"], r["total"] * r["most"]) for r in have], "source string, available_tokens long")
    shares = shares.join(F.broadcast(held), "source", "left").fillna(0, ["available_tokens"])
    return mix, shares.withColumn("ran_out", F.col("n_tokens") >= F.col("available_tokens")).withColumn("budget", F.lit(budget).cast("long"))
