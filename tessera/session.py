"""Session defaults, and materialising through the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # What ``materialised`` wrote goes when nothing refers to it any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(app: str = "tessera", **conf: str) -> SparkSession:
    """A session with these defaults; keyword ``spark_sql_x`` stands for ``spark.sql.x``."""
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where none is named, a
    local one stands in if all tasks run in this process; else that is an error."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder and read back: computed once,
    and safe when executors are lost."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Fixed value: how many rows a task of costly work on each row gets.
TASK_ROWS = 4096


def spread(df: DataFrame, *keys, rows: int | None = None) -> DataFrame:
    """A table for costly work on each row: dealt out in tasks of about TASK_ROWS rows, however many there are, and to
    all cores if there are few; by ``keys`` where rows with equal ones should meet. ``rows``: the table's number of
    rows, if it isn't a stored one, whose files tell it."""
    n = df.count() if rows is None else rows
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), *keys)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table by its path's own file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
