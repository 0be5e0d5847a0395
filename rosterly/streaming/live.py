"""Live runs as a stream: the events of a run are kept until its day is over, then the run is settled once.

A run is one day's, so its events are an aggregation by day and run in append mode: a set, in which an event that comes
twice, or in another micro-batch than the one before it, does no harm. When the watermark passes the end of the day, the
run's events leave the state together. All of it is worked out in the JVM, with no call a run or event to Python. What a
run comes to is worked out by the same expressions as in a batch job, and each micro-batch of settled runs is entered in
the table of runs by its number, once, however often it is run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterly.operators import playlog
from rosterly.sources import batches

EVENT = "run_id string, user_id bigint, date date, ts timestamp, seq bigint, kind string, member_id bigint"
RUN = "run_id string, stage int, lives int, wrong int, skipped int, done boolean, won boolean, solved int, user_id bigint, date date"
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def closed_runs(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The events of runs whose day is over, from a stream of EVENT rows; the session's time zone is UTC. Events that are not
    of their run's day, and those that come after their day's runs were settled, are left out; of several events of a run
    with one number the last in order of its columns counts."""
    own = events.where(F.to_date("ts") == F.col("date")).withWatermark("ts", late)
    held = own.groupBy(F.window("ts", "1 day"), "run_id").agg(F.collect_set(F.struct("seq", "user_id", "date", "ts", "kind", "member_id")).alias("e"))
    last = lambda x, i: ~F.coalesce(F.get("e", i + 1)["seq"] == x["seq"], F.lit(False))
    each = held.withColumn("e", F.sort_array("e")).select("run_id", F.explode(F.filter("e", last)).alias("x"))
    return each.select(*("run_id" if c == "run_id" else f"x.{c}" for c in (f.split()[0] for f in EVENT.split(", "))))


def settled(events: DataFrame) -> DataFrame:
    """What each run of EVENT rows comes to."""
    of = events.groupBy("run_id").agg(F.first("user_id").alias("user_id"), F.min("date").alias("date"))
    return playlog.solved(playlog.fold(events)).join(of, "run_id").select(*(c.split()[0] for c in RUN.split(", ")))


def settle(events: DataFrame, path: str, progress: str, late: str = "10 minutes", before_entering=lambda number: None):
    """Start the stream that puts settled runs into the table of batches at path; it ends when what is there has been read.
    progress: the folder of its checkpoint. before_entering is called with the number of each batch that is written but
    not entered yet."""
    spark = events.sparkSession

    def put(rows: DataFrame, number: int) -> None:
        if number not in batches.entered(spark, path):
            held = rows.persist()  # read twice; without it so is the state
            settled(held).write.mode("overwrite").parquet(batches.folder(path, number))
            held.unpersist()
            before_entering(number)
            batches.enter(spark, path, number)

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # state beside the heap
    try:
        return closed_runs(events, late).writeStream.foreachBatch(put).option("checkpointLocation", progress).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The runs that are settled so far."""
    return batches.read(spark, path, RUN)


def stats(spark: SparkSession, path: str) -> DataFrame:
    """playlog.streaks of the settled runs: every run counts once."""
    return playlog.streaks(runs(spark, path).select("user_id", "date", "won"))
