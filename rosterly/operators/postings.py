"""Postings: what is known of a member at a team; and dense ids without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterly.sources.stages import checkpointed

#: Up to so many rows of shifts (partitions and their groups) are broadcast.
BROADCAST_SHIFTS = 1_000_000


def posting_table(spells: DataFrame) -> DataFrame:
    """Per team and member: first and last year, summed tallies (unknown only if all are). Pairs of which nothing is
    known are left out."""
    per = spells.groupBy("team_id", "member_id").agg(F.min("start_year").alias("first_year"), F.max("end_year").alias("last_year"), F.sum("apps").alias("apps"), F.sum("goals").alias("goals"))
    return per.where(F.coalesce("first_year", "last_year", "apps", "goals").isNotNull())


def membership_pool(members: DataFrame, spells: DataFrame) -> DataFrame:
    """Distinct (team_id, member_id) of both sources."""
    return members.select("team_id", "member_id").union(spells.select("team_id", "member_id")).distinct()


def dropped_count(pool: DataFrame, kept: DataFrame) -> DataFrame:
    """Members of the pool, members that have a posting, and their difference, in one row."""
    p, k = pool.agg(F.count_distinct("member_id").alias("pool")), kept.agg(F.count_distinct("member_id").alias("kept"))
    return p.crossJoin(k).withColumn("dropped", F.col("pool") - F.col("kept"))


def numbered(rows: DataFrame, within: list[str], order: list, name: str) -> DataFrame:
    """rows with `name`, their number from 0 in order among the rows that agree in the columns `within`, and _of, how many
    those are, without a window over rows: sorted by range (once: the sorted rows are checkpointed), placed inside each
    partition, and shifted by what the partitions before it hold of the same group. So a group that holds all rows is
    spread over all tasks; the table of shifts has a row for each partition and group in it."""
    ordered = checkpointed(rows.sort(*within, *order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    keys = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(within)]
    sizes = ordered.groupBy("_part", *within).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*within)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.withColumn("_before", before).withColumn("_of", F.sum("_n").over(group)).select(F.col("_part").alias("_p"), "_first", "_before", "_of", *(F.col(c).alias(f"_k{i}") for i, c in enumerate(within)))
    small = sizes.count() <= BROADCAST_SHIFTS
    joined = ordered.join(F.broadcast(shifts) if small else shifts, [F.col("_part") == F.col("_p"), *keys])
    return joined.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_p", "_first", "_before", *(f"_k{i}" for i in range(len(within))))


def dense_ids(rows: DataFrame, order: list, name: str = "dense_id") -> DataFrame:
    """rows numbered from 0 in order."""
    return numbered(rows, [], order, name).drop("_of")
