"""Stage tables: written once, read by later stages; resumable intake by key; the dataset's stamp."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_CLEARED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset and all tasks run on this machine, a temporary one;
    on a cluster that is an error, as every executor would write to its own disk."""
    where, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if where:
        return where
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return _OWN[context.applicationId]


def new_path(spark: SparkSession, what: str) -> str:
    """A path that no other call has, in this application's part of the shared folder. That part is deleted when the
    driver's Python ends; cleared() does it earlier."""
    app = spark.sparkContext.applicationId
    if app not in _CLEARED:
        _CLEARED.add(app)
        atexit.register(_at_exit, spark)
    return f"{shared_folder(spark)}/{app}/{what}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cleared(spark: SparkSession) -> None:
    """Delete all tables at new paths of this application."""
    delete(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # a session that was stopped, a folder that is gone
        cleared(spark)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that stored() made."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: what several parts of a plan use is worked out once."""
    path = new_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def versions(spark: SparkSession, folder: str, stage: str) -> list[str]:
    """The versions of a stage that are whole, the oldest first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{stage}")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(p.getName() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def save(df: DataFrame, folder: str, stage: str) -> DataFrame:
    """Write a stage's table as a new version beside the earlier one, and read it again. So a reader of the version before
    is not disturbed; versions before that one are deleted."""
    spark = df.sparkSession
    before = versions(spark, folder, stage)
    number = int(before[-1].removeprefix("v")) + 1 if before else 0
    df.write.mode("overwrite").parquet(f"{folder}/{stage}/v{number:06d}")
    for old in before[:-1]:
        delete(spark, f"{folder}/{stage}/{old}")
    return load(spark, folder, stage)


def load(spark: SparkSession, folder: str, stage: str) -> DataFrame:
    """The newest whole version of a stage's table."""
    return spark.read.parquet(f"{folder}/{stage}/{versions(spark, folder, stage)[-1]}")


def unprocessed(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The items whose key no earlier run has handled. Resuming by key, a changed item list cannot misalign."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def resume(items: DataFrame, key: str, fetch, path: str) -> DataFrame:
    """Apply fetch (DataFrame to DataFrame, keeping key) to the items that the table at path lacks and append the result."""
    spark = items.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        items = unprocessed(items, spark.read.parquet(path), key)
    fetch(items).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def stamp(df: DataFrame) -> DataFrame:
    """The date of the newest file that df reads."""
    return df.select(F.max("_metadata.file_modification_time").cast("date").alias("built"))


def dry_run(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key, for a trial."""
    return df.orderBy(key).limit(n)
