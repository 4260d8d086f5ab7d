"""The pN_ queries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.snapshots import snapshot_changes
from quillspan.operators.timestamps import utc_instants
from quillspan.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories added, removed or changed in stars or forks, per snapshot date."""
    rows = table(spark, sf_dir, "repo_snapshots").select("snapshot_date", F.lower("full_name").alias("full_name"), "stars", "forks", "ingest_ord")
    found = snapshot_changes(rows, "snapshot_date", "full_name", ["stars", "forks"], "ingest_ord")
    return found.select(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), "full_name", "change_type")


P2_SQL = """
WITH r AS (SELECT snapshot_date, lower(full_name) AS full_name, stars, forks,
                  row_number() OVER (PARTITION BY snapshot_date, lower(full_name) ORDER BY ingest_ord DESC) AS rn
           FROM repo_snapshots WHERE full_name IS NOT NULL AND snapshot_date IS NOT NULL),
l AS (SELECT * FROM r WHERE rn = 1),
d AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) AS i FROM (SELECT DISTINCT snapshot_date FROM l)),
x AS (SELECT l.*, d.i FROM l JOIN d USING (snapshot_date)),
j AS (SELECT coalesce(n.i, w.i + 1) AS i, coalesce(n.full_name, w.full_name) AS full_name,
             CASE WHEN w.i IS NULL THEN 'added' WHEN n.i IS NULL THEN 'removed' ELSE 'changed' END AS change_type
      FROM x n FULL JOIN x w ON n.full_name = w.full_name AND n.i = w.i + 1
      WHERE w.i IS NULL OR n.i IS NULL OR n.stars IS DISTINCT FROM w.stars OR n.forks IS DISTINCT FROM w.forks)
SELECT strftime(d.snapshot_date, '%Y-%m-%d') AS snapshot_date, j.full_name, j.change_type FROM j JOIN d ON d.i = j.i WHERE j.i > 1
"""


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The UTC instant of every record whose published_at names one."""
    # feed_clocks is a fixed registry of sources; the join is broadcast where Spark finds it small.
    clocks = table(spark, sf_dir, "feed_clocks").groupBy("source").agg(F.first("tz_name").alias("tz_name"), F.first("day_first").alias("day_first"))
    raw = table(spark, sf_dir, "raw_candidates").select("rec_id", "published_at", "source")
    return utc_instants(raw.join(clocks, "source", "left"), "rec_id", "published_at", "tz_name", "day_first")


QUERIES = {"p2_found": p2_found, "p3_found": p3_found}
SQL = {"p2_found": P2_SQL}
