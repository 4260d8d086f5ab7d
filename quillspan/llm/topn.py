"""Top N items within every group, by secondary sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _codes(c: pa.Array) -> np.ndarray:
    """Equal values as equal numbers; null is -1."""
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
    return c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _starts(cols: list[pa.Array], n: int) -> np.ndarray:
    """Where a new group begins within a batch of sorted rows."""
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in cols:
        codes = _codes(c)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _emit(groups: list[str], ident: str, n: int):
    """Stream sorted batches; of each group the first n rows with different identifiers pass.

    Only the identifiers already passed of the group at hand are held, n at most.
    """

    def first_ones(b: pa.RecordBatch, lo: int, hi: int, passed: set) -> list[int]:
        """One row after the other, for a group whose rows lie in several batches or whose identifiers recur."""
        take = []
        for k, x in enumerate(b.column(ident).slice(lo, hi - lo).to_pylist(), lo):
            if len(passed) == n:
                break
            if x not in passed:
                passed.add(x)
                take.append(k)
        return take

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, passed = None, set()
        for b in batches:
            if not b.num_rows:
                continue
            starts = _starts([b.column(g) for g in groups], b.num_rows)
            ends = np.append(starts[1:], b.num_rows)
            key = lambda i, b=b: tuple(b.column(g)[int(i)].as_py() for g in groups)
            take: list[np.ndarray] = []
            begin = 0
            if key(0) == at:  # the group goes on from the batch before
                take.append(np.array(first_ones(b, 0, int(ends[0]), passed), dtype=np.int64))
                begin = 1
            if begin < len(starts):
                lo = int(starts[begin])
                size = ends[begin:] - starts[begin:]
                group = np.repeat(np.arange(len(size)), size)
                ids = _codes(b.column(ident))[lo:]
                new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (group[1:] != group[:-1])))  # repeats beside each other
                count = np.cumsum(new)
                place = count - np.repeat(count[starts[begin:] - lo] - 1, size)
                k = np.flatnonzero(new & (place <= n))
                pair = group[k].astype(np.int64) * (int(ids.max()) + 1) + ids[k]
                whole, times = np.unique(pair, return_counts=True)
                again = np.unique(whole[times > 1] // (int(ids.max()) + 1))  # identifiers that recur with another score
                take.append(k[~np.isin(group[k], again)] + lo)
                take += [np.array(first_ones(b, int(starts[begin + g]), int(ends[begin + g]), set()), dtype=np.int64) for g in again.tolist()]
                passed = set()
            rows = np.sort(np.concatenate(take))
            at = key(b.num_rows - 1)
            passed |= set(b.column(ident).take(pa.array(rows[rows >= starts[-1]])).to_pylist())
            if len(rows):
                yield b.take(pa.array(rows))

    return run


def top_n(df: DataFrame, groups: list[str], score: str, ident: str, n: int) -> DataFrame:
    """The n best rows of every group: score descending, null and NaN last, then identifier ascending.

    Returns columns groups, ident and score, with no order; other columns of df are pruned. A group column
    that is null, and an identifier that is null, keep a row out. Repeats of an identifier within a group
    count once, at their best place. n below 1 gives no row.

    Two sorts, neither of which buffers a group. First every input partition is sorted where it is and
    passes at most n rows a group, so that a group with a third of all rows sends n rows a partition and not
    all its rows. Then rows are hash-partitioned by group, sorted by score and identifier, and read as a
    stream of Arrow batches that again passes n rows a group.
    """
    if score in groups or ident in groups:
        raise ValueError("score and ident can't be group columns")
    spark_score = F.when(~F.isnan(score), F.col(score)) if dict(df.dtypes)[score] in ("double", "float") else F.col(score)
    rows = df.select(*groups, ident, spark_score.alias(score))
    for c in [*groups, ident]:
        rows = rows.where(F.col(c).isNotNull())
    order = [*groups, F.col(score).desc_nulls_last(), F.col(ident).asc()]
    step = _emit(groups, ident, n)
    if n < 1:
        return rows.limit(0)
    first = rows.sortWithinPartitions(*order).mapInArrow(step, rows.schema)
    return first.repartition(*groups).sortWithinPartitions(*order).mapInArrow(step, rows.schema)
