"""Rosters as a stored table of blocks, and intersections that read only blocks which can hold a common member.

A block is the part of a team's roster in one range of WIDTH member ids: its first and last id, the steps of its ids from
the first, and their tallies in arrays of the same order. Ranges are the same for all teams, so two blocks can share a
member only if they are of one range (bucket), and rosters are intersected by equi-joins on it. The table is sorted by
team and bucket, so that a reader of a few teams, or of a few buckets of them, skips the other row groups by their
statistics; the ids alone are read until it is known which blocks matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterly.operators import solve

WIDTH = 1024
#: Up to so many buckets are named in the filter that the scan gets; more are semi-joined.
NAMED = 500
#: Up to so many blocks of the shortest roster are broadcast to the next one.
BROADCAST_BLOCKS = 2_000


def blocked(posting: DataFrame, width: int = WIDTH) -> DataFrame:
    """team_id, bucket, first_id, last_id, n, steps, apps, goals: the blocks of postings (one row a team and member). A
    block has at most `width` members, whatever the size of the roster."""
    row = F.struct("member_id", "apps", "goals")
    per = posting.groupBy("team_id", F.floor(F.col("member_id") / width).alias("bucket")).agg(F.sort_array(F.collect_list(row)).alias("r"))
    first = F.col("r")[0]["member_id"]
    part = lambda c: F.transform("r", lambda x: x[c]).alias(c)
    return per.select("team_id", "bucket", first.alias("first_id"), F.element_at("r", -1)["member_id"].alias("last_id"), F.size("r").alias("n"), F.transform("r", lambda x: (x["member_id"] - first).cast("int")).alias("steps"), part("apps"), part("goals"))


def write(blocks: DataFrame, path: str, files: int | None = None, row_group_mb: int = 1) -> DataFrame:
    """Write blocks sorted by team and bucket, in small row groups, and read them again."""
    by = ["team_id", "bucket"]
    dealt = blocks.repartitionByRange(*([files] if files else []), *by).sortWithinPartitions(*by)
    dealt.write.option("parquet.block.size", row_group_mb << 20).parquet(path)
    return blocks.sparkSession.read.schema(blocks.schema).parquet(path)


def ids() -> Column:
    """The member ids of a block."""
    return F.transform("steps", lambda s: F.col("first_id") + s)


def rows(blocks: DataFrame) -> DataFrame:
    """The postings of blocks: team_id, member_id, apps, goals."""
    each = blocks.select("team_id", "first_id", F.explode(F.arrays_zip("steps", "apps", "goals")).alias("r"))
    return each.select("team_id", (F.col("first_id") + F.col("r.steps")).alias("member_id"), "r.apps", "r.goals")


def heads(index: DataFrame, team_ids: list[int]) -> DataFrame:
    """The blocks of some teams without their arrays, which are not read."""
    return index.where(F.col("team_id").isin(team_ids)).select("team_id", "bucket", "first_id", "last_id", "n")


def shortest_first(index: DataFrame, team_ids: list[int]) -> list[tuple[int, int]]:
    """(team, blocks) of the chosen teams by members, fewest first; a team without blocks has none here."""
    sizes = heads(index, team_ids).groupBy("team_id").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).collect()  # a row a chosen team
    return [(r.team_id, r.blocks) for r in sorted(sizes, key=lambda r: (r.n, r.team_id))]


def meeting(index: DataFrame, team_ids: list[int]) -> DataFrame:
    """The buckets in which every chosen team has a block and the blocks' spans of ids have a part in common."""
    k = len(set(team_ids))
    spans = heads(index, team_ids).groupBy("bucket").agg(F.count("*").alias("k"), F.max("first_id").alias("lo"), F.min("last_id").alias("hi"))
    return spans.where((F.col("k") == k) & (F.col("lo") <= F.col("hi"))).select("bucket")


def meeting_blocks(index: DataFrame, team_ids: list[int]) -> DataFrame:
    """The blocks of the chosen teams in buckets where all meet. Few buckets go into the scan's own filter."""
    own, where = index.where(F.col("team_id").isin(team_ids)), meeting(index, team_ids)
    few = [r.bucket for r in where.limit(NAMED + 1).collect()]
    return own.where(F.col("bucket").isin(few)) if len(few) <= NAMED else own.join(where, "bucket", "left_semi")


def common_ids(index: DataFrame, team_ids: list[int]) -> DataFrame:
    """The members of all chosen teams (member_id), the shortest roster first; what has become empty is joined no more.
    A team without a block ends it at once."""
    chosen = list(dict.fromkeys(team_ids))
    order = shortest_first(index, chosen)
    if not chosen or len(order) < len(chosen):
        return index.where(F.lit(False)).select(F.col("first_id").alias("member_id"))
    blocks = meeting_blocks(index, chosen).select("team_id", "bucket", ids().alias("ids"))
    left = blocks.where(F.col("team_id") == order[0][0]).select("bucket", "ids")
    few = order[0][1] <= BROADCAST_BLOCKS
    for team, _ in order[1:]:
        own = blocks.where(F.col("team_id") == team).select("bucket", F.col("ids").alias("_more"))
        left = own.join(F.broadcast(left) if few else left, "bucket").select("bucket", F.array_intersect("ids", "_more").alias("ids")).where(F.size("ids") > 0)
    return left.select(F.explode("ids").alias("member_id"))


def common_members(index: DataFrame, member: DataFrame, team_ids: list[int]) -> DataFrame:
    """What solve.common_members gives, from blocks: tallies are read only where blocks meet, and for common members."""
    chosen = list(dict.fromkeys(team_ids))
    found = common_ids(index, chosen)
    tallies = rows(meeting_blocks(index, chosen)) if chosen else rows(index.where(F.lit(False)))
    return solve.common_members(tallies.join(found, "member_id", "left_semi"), member, chosen)
