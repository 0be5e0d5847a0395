"""Landed files picked up as they arrive: each file once, however often the job is started."""

from __future__ import annotations

from pyspark.sql import SparkSession


def append_new_files(spark: SparkSession, schema: str, landed: str, target: str, progress: str, transform=lambda df: df):
    """Append to the table at target what transform makes of the files in landed that no earlier run has taken. Returns
    the query, which ends when all present files are done; progress is kept in its checkpoint folder."""
    rows = transform(spark.readStream.schema(schema).json(landed))
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", progress).trigger(availableNow=True).outputMode("append").start()
