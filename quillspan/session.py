"""Session, shared folder and table access."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes from which a size is none: the optimizer's guess for data without statistics.
UNKNOWN = 1e17
_MADE: dict[str, SparkSession] = {}


def local_session(app: str = "quillspan", cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUILLSPAN_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Only where the session names none and runs locally (tests) is a temporary one made, and set as
    checkpoint directory so that it is made once. On a cluster a folder must be named.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    now = jsc.getCheckpointDir()
    if named:
        if not now.isDefined():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if now.isDefined():
        return now.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspan-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: computed once and kept in the shared folder, so it outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder; what is still there when the driver ends is deleted."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_remove_all)
    _MADE[path] = spark
    return path


def _remove_all() -> None:
    for path, spark in list(_MADE.items()):
        try:
            remove(spark, path)
        except Exception:  # the session is gone
            return


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of scratch()."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _MADE.pop(path, None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_mb(df: DataFrame, row_bytes: int = 256) -> float:
    """Megabytes of df's sources by the optimizer's statistics, or by a count of rows where it has none.

    Decides only how finely work is divided.
    """
    size = float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return (size if size < UNKNOWN else df.count() * row_bytes) / 1e6


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
