"""A table that grows by numbered batches, each of which counts once.

A batch is written to its own folder and then entered in a manifest; readers take the batches of the manifest alone. A
job that is lost between the two leaves a folder that no reader sees and that the same number replaces when it is run
again, so no row is there twice and none of a half-written batch is ever read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterly.sources.stages import delete, unprocessed


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def entered(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches in the manifest."""
    fs, where = _fs(spark, f"{path}/_manifest")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(where)) if fs.exists(where) else []


def folder(path: str, number: int) -> str:
    return f"{path}/batch-{number:09d}"


def enter(spark: SparkSession, path: str, number: int) -> None:
    """Put a batch whose folder is written into the manifest: the creation of one empty file."""
    fs, where = _fs(spark, f"{path}/_manifest/{number}")
    fs.create(where, True).close()


def write(df: DataFrame, path: str, number: int) -> bool:
    """Write a batch and enter it. A number that is entered already changes nothing and gives False."""
    spark = df.sparkSession
    if number in entered(spark, path):
        return False
    df.write.mode("overwrite").parquet(folder(path, number))
    enter(spark, path, number)
    return True


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all entered batches."""
    own = [folder(path, n) for n in entered(spark, path)]
    return spark.read.schema(schema).parquet(*own) if own else spark.createDataFrame([], schema)


def resume(items: DataFrame, key: str, fetch, path: str, schema: str, parts: int = 1) -> DataFrame:
    """Apply fetch (DataFrame to DataFrame, keeping key) to the items whose key no entered batch has, in `parts` batches by a
    hash of the key, and give all rows. Keys decide what is left, not places, so a changed list of items cannot misalign;
    the next free number is taken for each batch, so what a lost run left is written over."""
    spark = items.sparkSession
    todo = unprocessed(items, read(spark, path, schema), key)
    first = (entered(spark, path) or [-1])[-1] + 1
    plans = [fetch(todo.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k)) for k in range(parts)]  # todo reads what is entered now
    for k, plan in enumerate(plans):
        write(plan, path, first + k)
    return read(spark, path, schema)


def compacted(spark: SparkSession, path: str, to: str, schema) -> DataFrame:
    """The batches as one batch at another path, for a table that many small ones have made slow to list."""
    write(read(spark, path, schema), to, 0)
    return read(spark, to, schema)


def forget(spark: SparkSession, path: str, number: int) -> None:
    """Take a batch out of the manifest, then delete its folder."""
    delete(spark, f"{path}/_manifest/{number}")
    delete(spark, folder(path, number))
