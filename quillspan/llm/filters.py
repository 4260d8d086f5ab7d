"""A filter of a fixed size that keeps rows without a partner out of a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter, a megabyte whatever the data; with far more keys it lets all rows pass.
FILTER_BITS = 1 << 23


def only_keys_of(keys: DataFrame, key: str, df: DataFrame, of: str) -> DataFrame:
    """The rows of df whose column `of` may be a key of keys: all that are, and few others. No shuffle of df.

    The bits of the keys are put together on the executors; FILTER_BITS / 64 numbers come to the driver at most.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    words = keys.select(bit(key).alias("bit")).groupBy(F.expr("cast(bit div 64 AS int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("bits"))
    held = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in words.toLocalIterator():
        held[r["w"]] = r["bits"]
    cols = df.columns
    shared = df.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            k = b.column("_bit").to_numpy()
            yield b.filter(pa.array((bits[k >> 6] >> (k & 63)) & 1 == 1)).select(cols)

    return df.withColumn("_bit", bit(of)).mapInArrow(run, df.schema)
