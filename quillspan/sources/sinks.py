"""Sinks: partitioned issues, append-only snapshots, audit rows, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAPSHOT = T.StructType(
    [T.StructField("snapshot_date", T.DateType()), *[T.StructField(n, T.StringType()) for n in ("full_name", "url", "description", "language")]]
    + [T.StructField(n, T.LongType()) for n in ("stars", "forks", "open_issues")]
    + [T.StructField(n, T.StringType()) for n in ("last_update", "created_at", "pushed_at", "author", "category")]
    + [T.StructField("matched_categories", T.ArrayType(T.StringType())), T.StructField("topics", T.ArrayType(T.StringType())), T.StructField("source", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ("stars_gained_hint", "forks_gained_hint")]
    + [T.StructField("source_notes", T.ArrayType(T.StringType()))]
)


def write_issue(df: DataFrame, path: str, day: str = "issue_date") -> None:
    """Replace the issues of the days in df and keep all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def payload(sections: DataFrame, day: str, section: str, place: str) -> DataFrame:
    """One JSON object per issue, its sections as ordered lists. For sections of bounded length."""
    item = F.struct(place, *[c for c in sections.columns if c not in (day, section, place)])
    per = sections.groupBy(day, section).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return per.groupBy(day).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(section, "items")))).alias("s")).select(day, F.to_json("s").alias("payload"))


ITEM = "place int, id string, title string, url string, source string, source_kind string, category string, published_at string, text string, score double, score_reasons array<string>, source_tags array<string>"


def read_payload(payloads: DataFrame, day: str, item: str = ITEM) -> DataFrame:
    """(day, section, and the fields of item) of issues written as JSON objects of ordered lists; the inverse of payload.

    What isn't a list of records in them, such as a run log, gives no row; a place that is missing is that in the list.
    """
    one = payloads.select(day, "payload", F.explode(F.json_object_keys("payload")).alias("section")).withColumn("list", F.expr("get_json_object(payload, concat('$.', section))")).where("startswith(ltrim(list), '[')")
    rows = one.select(day, "section", F.posexplode(F.from_json("list", f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in item.split(', '))}>>")).alias("n", "r")).where("r IS NOT NULL")
    flat = rows.select(day, "section", "n", "r.*")
    return flat.withColumn("place", F.coalesce("place", F.col("n") + 1)).drop("n")


RUN_LOG = "struct<generated_at:string,fetched_count:bigint,filtered_count:bigint,duplicate_count:bigint,source_count:bigint,note:string,failures:array<struct<source:string,error:string>>>"


def run_logs(payloads: DataFrame, day: str) -> DataFrame:
    """The run log of each issue, nulls where it has none."""
    return payloads.select(day, F.from_json(F.get_json_object("payload", "$.run_log"), RUN_LOG).alias("l")).select(day, "l.*")


def append_snapshots(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines, a folder per date; nothing written before is touched."""
    df.withColumn("day", F.col("snapshot_date")).write.mode("append").partitionBy("day").json(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Rows of append_snapshots; no rows where nothing has been written."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], SNAPSHOT)
    return spark.read.schema(SNAPSHOT).json(path)


def write_guarded(df: DataFrame, path: str, least: int) -> bool:
    """Write df as JSON only if it has at least `least` rows."""
    if len(df.limit(least).collect()) < least:
        return False
    df.write.mode("overwrite").json(path)
    return True


def merge_cache(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new over old, one row per key."""
    every = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    cols = old.columns
    return every.groupBy(key).agg(F.max_by(F.struct(*cols), "_n").alias("r")).select("r.*")
