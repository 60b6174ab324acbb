"""Intermediate tables in the folder that all machines share, to cut lineage and to survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only where it is unset and all runs in one process (tests), a new temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="patchloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def forget(spark: SparkSession) -> None:
    """Deletes all tables that this application has saved. Results that are still to be computed from them can't be any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _at_exit() -> None:
    for spark in _folders.values():
        with contextlib.suppress(Exception):  # the session may have ended before
            forget(spark)


def _with_batches(frame: DataFrame, rows: int):
    """The JVM's ``frame`` in a session of its own, whose Arrow batches hold ``rows`` rows; nothing changes for the caller's session."""
    spark = frame.sparkSession
    own = spark._jsparkSession.cloneSession()
    own.conf().set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own, frame._jdf.queryExecution().logical())


def kept_folder(spark: SparkSession, name: str) -> str:
    """A folder of this application below the shared one, which goes when the application's tables go."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    _folders[folder] = spark
    return f"{folder}/{name}"


def saved_by(frame: DataFrame, name: str, key: list[str], buckets: int = 64) -> DataFrame:
    """``saved`` in buckets of ``key``: joins and groupings by it, as often as they come, don't exchange these rows again."""
    spark = frame.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    frame.repartition(buckets, *key).write.bucketBy(buckets, *key).option("path", kept_folder(spark, table)).saveAsTable(table)
    return spark.table(table)


def saved(frame: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """``frame``, written as Parquet under the shared folder and read again.

    ``batch_rows`` holds for the Arrow batches of this one writing: fewer rows where each is large. The table stays until
    ``forget`` or until the application's Python process ends, as results are computed from it later.
    """
    spark = frame.sparkSession
    path = kept_folder(spark, f"{name}-{uuid.uuid4().hex}")
    if batch_rows:
        _with_batches(frame, batch_rows).write().parquet(path)
    else:
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
