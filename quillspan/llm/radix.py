"""Capping the records of each contributor by radix selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.session import cut

TOP = -(1 << 63)  # the sign bit of a signed 64-bit number


@F.pandas_udf(T.LongType())
def descending_bits(score: pd.Series) -> pd.Series:
    """Signed numbers whose ascending order is the descending order of the scores; null and NaN come last."""
    import numpy as np

    x = score.to_numpy(dtype=np.float64, na_value=np.nan) + 0.0
    bits = x.view(np.int64)
    ascending = bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
    return pd.Series(np.where(np.isnan(x), np.int64(0x7FFFFFFFFFFFFFFF), ~ascending))


def _digits(key: Column, first: int, count: int) -> Column:
    """Bytes first .. first+count-1 (0 the highest) of a signed key as one number that keeps their order."""
    unsigned = key.bitwiseXOR(F.lit(TOP).cast("long"))
    return F.shiftrightunsigned(unsigned, 64 - 8 * (first + count)).bitwiseAND((1 << (8 * count)) - 1)


def _spread(active: DataFrame, keys: tuple[str, str]) -> list[tuple[str, int, int]]:
    """The byte positions still open: (key, first byte, bytes), leading bytes that all rows share left out."""
    lo_hi = active.agg(*[f(k).alias(f"{k}_{n}") for k in keys for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    for k in keys:
        a, b = lo_hi[f"{k}_lo"], lo_hi[f"{k}_hi"]
        if a is None:
            continue
        same = (64 - (a ^ b).bit_length()) // 8 if (a < 0) == (b < 0) else 0
        pos = same
        while pos < 8:
            width = min(2, 8 - pos)
            out.append((k, pos, width))
            pos += width
    return out


def over_cap(df: DataFrame, contributor: list[str], score: str, ident: str, cap: str) -> DataFrame:
    """The rows that go when every contributor keeps its cap best rows.

    df has one row per (contributor, ident); ident is a whole number, cap an integer column that is the same
    for all rows of a contributor (null or below 0 counts as 0). Best is score descending, null and NaN last,
    then ident ascending, so ties are cut in one way only; rows that repeat an ident count as rows and, where
    the cap falls on them, stay together. Rows with a null in a contributor column or ident don't count and
    never go. Returns df's rows with its columns unchanged, whatever their names. An empty df gives no rows.

    Radix selection: score and ident become two order-preserving 8-byte keys. Contributors above their cap
    stay open; for them rows are counted per contributor and digit (map-side first, so a contributor with a
    third of all rows sends one count per digit and partition), the digit in which the cap falls is fixed,
    and only rows that carry it go on to the next digit. Two bytes are counted a pass. At the end each row
    is compared with its contributor's cutoff; no contributor's rows are ever brought together.
    """
    cs = [f"_c{i}" for i in range(len(contributor))]
    rows = df.where(F.col(ident).isNotNull())
    for c in contributor:
        rows = rows.where(F.col(c).isNotNull())
    base = cut(rows.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[F.col(c).alias(n) for c, n in zip(contributor, cs, strict=True)],
        descending_bits(F.col(score).cast("double")).alias("_k1"), F.col(ident).cast("long").alias("_k2"), F.col(cap).cast("long").alias("_cap"),
    ))
    sizes = base.groupBy(*cs).agg(F.count("*").alias("_n"), F.greatest(F.lit(0), F.coalesce(F.max("_cap"), F.lit(0))).alias("_need"))
    state = cut(sizes.where("_n > _need"))
    low = F.lit(TOP).cast("long")
    done = state.where("_need = 0").select(*cs, low.alias("_cut1"), low.alias("_cut2"), F.lit(True).alias("_all"))
    state = state.where("_need > 0").select(*cs, "_need")
    active = cut(base.select(*cs, "_k1", "_k2").join(state, cs, "left_semi"))
    todo = _spread(active, ("_k1", "_k2"))
    open_from = {k: min((p for key, p, _ in todo if key == k), default=8) for k in ("_k1", "_k2")}

    def prefix(col: str, first: int) -> Column:
        """The leading bytes that all keys share, as bits of the unsigned form."""
        u = F.col(col).bitwiseXOR(low)
        return F.lit(0).cast("long") if first == 0 else F.shiftleft(F.shiftrightunsigned(u, 64 - 8 * first), 64 - 8 * first) if first < 8 else u

    least = active.groupBy(*cs).agg(F.min("_k1").alias("_m1"), F.min("_k2").alias("_m2"))
    # A cutoff is built from its high bytes; an early end takes the whole digit, so the bytes below are all ones.
    fixed = cut(state.join(least, cs).select(*cs, "_need", prefix("_m1", open_from["_k1"]).alias("_cut1"), prefix("_m2", open_from["_k2"]).alias("_cut2")))
    by = Window.partitionBy(*cs).orderBy("_d")
    for key, first, width in todo:
        shift = 64 - 8 * (first + width)
        digits = active.withColumn("_d", _digits(F.col(key), first, width))
        counts = digits.groupBy(*cs, "_d").agg(F.count("*").alias("_n"))
        hit = counts.withColumn("_sum", F.sum("_n").over(by)).join(fixed, cs).where("_sum >= _need AND _sum - _n < _need")
        grown = {c: F.col(c).bitwiseOR(F.shiftleft(F.col("_d"), shift)) if c[-1] == key[-1] else F.col(c) for c in ("_cut1", "_cut2")}
        step = cut(hit.select(*cs, "_d", (F.col("_need") - F.col("_sum") + F.col("_n")).alias("_need"), F.col("_n").alias("_in"), *[v.alias(k) for k, v in grown.items()]))
        ones = F.lit((1 << shift) - 1).cast("long")
        ended = (F.col("_cut1").bitwiseOR(ones), F.lit(-1).cast("long")) if key == "_k1" else (F.col("_cut1"), F.col("_cut2").bitwiseOR(ones))
        done = done.union(step.where("_in = _need").select(*cs, *ended, F.lit(False)))
        still = step.where("_in > _need")
        fixed = still.select(*cs, "_need", "_cut1", "_cut2")
        if still.isEmpty():
            break
        active = cut(digits.join(still.select(*cs, "_d"), [*cs, "_d"], "left_semi").drop("_d"))
    else:
        # every byte is fixed: rows equal in both keys are repeats of one ident and stay together
        done = done.union(fixed.select(*cs, "_cut1", "_cut2", F.lit(False)))
    cutoff = done.select(*cs, F.col("_cut1").bitwiseXOR(low).alias("_cut1"), F.col("_cut2").bitwiseXOR(low).alias("_cut2"), "_all")
    beyond = F.col("_all") | (F.col("_k1") > F.col("_cut1")) | ((F.col("_k1") == F.col("_cut1")) & (F.col("_k2") > F.col("_cut2")))
    return base.join(cutoff, cs).where(beyond).select("_row.*")
