"""Continuous ingestion of landed records (an extension: the batch pipeline has no streams)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillspan.operators.dedup import first_wins


def stream_records(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def unique_within(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """The first of equal keys within the watermark; state older than delay is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, by: str, width: str, delay: str) -> DataFrame:
    """Records per window and value of by; late ones count until the watermark passes."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), by).agg(F.count("*").alias("n")).select("window.start", by, "n")


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str, order: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Add records whose key target lacks, batch by batch; each batch is written under its number, so a
    batch that runs again after a failure replaces itself."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = first_wins(prepare(batch), [F.col(key)], [order])
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            have = spark.read.parquet(target).where(F.col("batch") != number).select(key)
            new = new.join(have, key, "left_anti").select(*new.columns)
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
