"""Helpers that several operators share: reading tables, shared storage, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what bytes.split() splits at, and the complement of the word class [^\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: Regular expressions of the same class, for Spark's functions.
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: Keys (one or two integers each) that may be broadcast once they are counted; with more, the join shuffles.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where it is unset and all tasks run on this
    machine (a local master), a temporary folder of this application; on a cluster that is an error, as executors would
    write to their own disks."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return _OWN[context.applicationId]


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that stored() made."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Shared:
    """A broadcast value, and what a worker makes of it once: made(value), kept in the worker while this, or another one
    of its group, is in use. Of a group KEPT are held at a time."""

    KEPT = 3
    _made: dict = {}

    def __init__(self, spark: SparkSession, value, group: str | None = None):
        self.key, self.sent = uuid.uuid4().hex, spark.sparkContext.broadcast(value)
        self.group = group or self.key

    def get(self, make):
        if (self.group, self.key) not in Shared._made:
            if any(g != self.group for g, _ in Shared._made):
                Shared._made.clear()
            while len(Shared._made) >= Shared.KEPT:
                del Shared._made[next(iter(Shared._made))]
            Shared._made[self.group, self.key] = make(self.sent.value)
        return Shared._made[self.group, self.key]


def trimmed(run):
    """run for mapInArrow that, once a task's batches are done, returns freed memory to the system: Python workers are
    kept for later tasks, of whatever operator, and would hold on to their peak."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not the GNU library
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def let(value: Column, body) -> Column:
    """body(value) with value computed once: optimisers may copy a projected expression into every use."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, an empty array for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RUN))
