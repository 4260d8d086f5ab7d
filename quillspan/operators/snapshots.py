"""What changed between full snapshots, by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.session import cut

#: A key begins a chunk when its hash is a multiple of this: the mean rows of a chunk.
CHUNK_ROWS = 64


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the chunks of rows sorted by (_idx, _key): each begins at a marked row or with a new snapshot.

    A chunk is named by the hash of the key it begins with, 0 for the part before the first mark.
    """
    import numpy as np

    idx, name = None, 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        at = b.column("_idx").to_numpy(zero_copy_only=False)
        h = b.column("_h").to_numpy(zero_copy_only=False)
        mark = h % CHUNK_ROWS == 0
        fresh = np.concatenate(([idx is None or at[0] != idx], at[1:] != at[:-1]))
        begins = mark | fresh
        begins[0] = True
        where = np.flatnonzero(begins)
        names = np.where(mark[where], h[where], 0)
        if not mark[0] and not fresh[0]:
            names[0] = name
        chunk = np.repeat(names, np.diff(np.append(where, n)))
        idx, name = at[-1], chunk[-1]
        yield b.append_column(pa.field("_chunk", pa.int64()), pa.array(chunk))


def snapshot_changes(df: DataFrame, date: str, key: str, values: list[str], order: str) -> DataFrame:
    """The keys added, removed or changed in each snapshot against the previous delivered one.

    Returns (date, key, change_type) for every date but the first. Of several rows of a key and date the one
    with the highest order stands (rows equal in order too: the greatest values). Two values differ when one
    is null and the other isn't, or both are set and unequal. Rows with a null date or key are left out;
    other columns are pruned. One date only, or an empty table, gives no rows.

    Rows are first reduced to one per key and date (map-side, so one key with a third of all rows sends one
    row a partition). The keys are then partitioned by their hash without regard to the date, so a task has the
    same keys of every snapshot; there rows are sorted by date and key and cut into chunks where the hash of a
    key says so, which gives the same cuts in every snapshot wherever the keys are the same. Chunks whose
    digest and row count equal those of the same chunk one snapshot before hold no change and are dropped,
    on both sides. Only rows of the other chunks are brought together by key. A digest is the pair of a sum
    and an exclusive or of 64-bit row hashes.
    """
    rows = (
        df.select(F.col(date).alias("_date"), F.col(key).alias("_key"), F.struct(F.col(order).alias("o"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)]).alias("_row"))
        .where("_date IS NOT NULL AND _key IS NOT NULL")
        .groupBy("_date", "_key")
        .agg(F.max("_row").alias("_row"))
    )
    # One row per delivered date; the count of snapshots, not of rows.
    delivered = df.where(F.col(key).isNotNull() & F.col(date).isNotNull()).select(F.col(date).alias("_date")).distinct()
    dates = cut(delivered.withColumn("_idx", F.row_number().over(Window.orderBy("_date")).cast("int")))
    vs = [f"v{i}" for i in range(len(values))]
    flat = rows.join(dates, "_date").select("_idx", "_key", *[f"_row.{v}" for v in vs], F.xxhash64("_key").alias("_h"))
    flat = flat.withColumn("_digest", F.xxhash64("_key", *[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in vs], *[F.col(v).isNull() for v in vs]))
    placed = flat.repartition("_key").sortWithinPartitions("_idx", "_key")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    chunked = cut(placed.mapInArrow(_chunks, f"{fields}, _chunk bigint").withColumn("_part", F.spark_partition_id()))
    at = Window.partitionBy("_part", "_chunk").orderBy("_idx")
    digest = F.struct("_sum", "_xor", "_n")
    sums = chunked.groupBy("_part", "_chunk", "_idx").agg(
        F.sum(F.col("_digest").cast("decimal(20,0)")).alias("_sum"), F.bit_xor("_digest").alias("_xor"), F.count("*").alias("_n")
    )

    def equal(of, step: int) -> Column:
        return F.coalesce((of("_idx").over(at) == F.col("_idx") + step) & (of(digest).over(at) == digest), F.lit(False))

    flags = sums.select("_part", "_chunk", "_idx", equal(F.lag, -1).alias("_as_before"), equal(F.lead, 1).alias("_as_after")).where("NOT (_as_before AND _as_after)")
    open_rows = chunked.join(flags, ["_part", "_chunk", "_idx"])
    now = open_rows.where("NOT _as_before").select("_idx", "_key", F.struct(*vs).alias("now"))
    now = now.withColumn("was", F.lit(None).cast(now.schema["now"].dataType))
    was = open_rows.where("NOT _as_after").select((F.col("_idx") + 1).alias("_idx"), "_key", F.struct(*vs).alias("was"))
    was = was.withColumn("now", F.lit(None).cast(was.schema["was"].dataType)).select("_idx", "_key", "now", "was")
    both = now.unionByName(was).groupBy("_idx", "_key").agg(F.max("now").alias("now"), F.max("was").alias("was"))
    kind = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("now").isNull(), "removed")
        .when(~F.col("now").eqNullSafe(F.col("was")), "changed")
    )
    return (
        both.where("_idx > 1")
        .withColumn("change_type", kind)
        .where("change_type IS NOT NULL")
        .join(dates, "_idx")
        .select(F.col("_date").alias(date), F.col("_key").alias(key), "change_type")
    )
