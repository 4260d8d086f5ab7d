"""Greedy selection under caps, in several passes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators.events import BUILDER, OF_SMALLER, OF_UNION, SAME_SOURCE, Variant


#: Stands in _taken for what was told before; the first record taken is 1.
KNOWN = 0


@dataclass(frozen=True)
class Pass:
    """One pass over the records in order.

    admit is a boolean column; caps say how often a value of a counter column may be taken at most; counts are
    the counters that a record taken in this pass raises. A null counter value is neither capped nor counted.
    """

    admit: str
    caps: dict[str, int] = field(default_factory=dict)
    counts: Sequence[str] = ()


def _alike(a: dict, b: dict, variant: Variant) -> bool:
    if variant.url and a["_url"] and a["_url"] == b["_url"]:
        return True
    if variant.event_key and a["_key"] and a["_key"] == b["_key"]:
        return True
    both = len(a["tok"] & b["tok"])
    if not both:
        return False
    smaller, either = min(len(a["tok"]), len(b["tok"])), len(a["tok"] | b["tok"])
    rules = [(OF_SMALLER, smaller), (OF_UNION, either)]
    if variant.same_source and a["_src"] == b["_src"]:
        rules.append((SAME_SOURCE, smaller))
    return any(both >= least and both >= part * of for (least, part), of in rules)


def _pass(group: Sequence[str], p: Pass, counters: Sequence[str], limit: int, variant: Variant):
    """Stream the rows of each group, those taken before first, and take more; only taken rows are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        taken: list[dict] = []
        known: list[dict] = []
        tally: dict[tuple[str, object], int] = {}
        for b in batches:
            keys = list(zip(*(b.column(g).to_pylist() for g in group), strict=True))
            was = b.column("_taken").to_pylist()
            admitted = b.column(p.admit).to_pylist()
            now = list(was)
            for i, key in enumerate(keys):
                if key != at:
                    at, taken, known, tally = key, [], [], {}
                if was[i] is None and (not admitted[i] or len(taken) >= limit):
                    continue
                row = {c: b.column(c)[i].as_py() for c in ("_url", "_key", "_src", "_tok", *counters)}
                row["tok"] = frozenset(row["_tok"] or ())
                if was[i] == KNOWN:
                    known.append(row)
                    continue
                if was[i] is None:
                    if any(tally.get((c, row[c]), 0) >= most for c, most in p.caps.items() if row[c] is not None):
                        continue
                    if any(_alike(row, t, variant) for t in (*known, *taken)):
                        continue
                    now[i] = len(taken) + 1
                    for c in p.counts:
                        tally[c, row[c]] = tally.get((c, row[c]), 0) + 1
                else:
                    for c in b.column("_counted")[i].as_py() or ():
                        tally[c, row[c]] = tally.get((c, row[c]), 0) + 1
                taken.append(row)
            counted = [list(p.counts) if w is None and n is not None else c for w, n, c in zip(was, now, b.column("_counted").to_pylist(), strict=True)]
            cols = {c: b.column(c) for c in b.schema.names} | {"_taken": pa.array(now, pa.int32()), "_counted": pa.array(counted, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([cols[c] for c in b.schema.names], names=b.schema.names)

    return run


def select_greedily(df: DataFrame, group: Sequence[str], ident: str, order: list[str], passes: Sequence[Pass], limit: int, variant: Variant = BUILDER, known: DataFrame | None = None) -> DataFrame:
    """(group, ident, place): up to limit records per group, in the order in which they are taken.

    known holds what each group has told of before (group and the columns of event_columns), such as history or other
    sections: nothing that tells of one of these events is taken, and they count for no cap or limit.

    df comes from event_columns, with the admit and counter columns of the passes. In each pass the records
    not yet taken are gone through in order; one is taken if it is admitted, is under all caps and tells of
    no event already taken. The fold depends on its order, so a group is one stream; it is shuffled once, and
    each pass is a sort within partitions and a stream that holds the taken records only.
    """
    counters = sorted({c for p in passes for c in (*p.caps, *p.counts)})
    flags = sorted({p.admit for p in passes})
    any_flag: Column = F.lit(False)
    for f in flags:
        any_flag = any_flag | F.coalesce(F.col(f), F.lit(False))
    rows = df.where(any_flag).select(*group, ident, *[c for c in (o.lstrip('-') for o in order) if c not in (*group, ident)], "_tok", "_url", "_key", "_src", *[c for c in counters if c not in (*group, "_src")], *flags)
    rows = rows.withColumn("_taken", F.lit(None).cast("int")).withColumn("_counted", F.lit(None).cast("array<string>"))
    if known is not None:
        rows = rows.unionByName(known.select(*group, "_tok", "_url", "_key", "_src", F.lit(KNOWN).alias("_taken")), allowMissingColumns=True)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = rows.repartition(*group)
    for p in passes:
        rows = rows.sortWithinPartitions(*group, F.col("_taken").asc_nulls_last(), *[F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c) for c in order])
        rows = rows.mapInArrow(_pass(group, p, counters, limit, variant), fields)
    return rows.where(F.col("_taken") > KNOWN).select(*group, ident, F.col("_taken").alias("place"))
