"""Duplicate teams: the merge map, canonical names, and what a merged line inherits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterly.functions.names import core_name


def merge_map(team: DataFrame, roster: DataFrame, never: DataFrame | None = None, curated: DataFrame | None = None) -> DataFrame:
    """(team_id, canonical): teams of one country whose core names agree go to the one with the largest roster (ties: the
    least id). never: (cc, core) that are not merged; curated: (team_id, canonical), which a computed merge overrides.
    Both ends must be in the universe; the map is one hop."""
    sized = team.join(roster.groupBy("team_id").agg(F.count("*").alias("n")), "team_id", "left").withColumn("core", core_name(F.col("name"))).withColumn("n", F.coalesce("n", F.lit(0)))
    if never is not None:
        sized = sized.join(F.broadcast(never), ["cc", "core"], "left_anti")
    w = Window.partitionBy("cc", "core")
    best = F.first("team_id").over(w.orderBy(F.desc("n"), "team_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    computed = sized.withColumn("canonical", best).where("team_id <> canonical").select("team_id", "canonical")
    if curated is None:
        return computed
    known = team.select("team_id")
    ends = curated.join(known, "team_id", "left_semi").join(known.withColumnRenamed("team_id", "canonical"), "canonical", "left_semi")
    return computed.unionByName(ends.join(computed, "team_id", "left_anti").select("team_id", "canonical"))


def canonical(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """rows with team_id replaced by its canonical one, one hop."""
    return rows.join(merges, "team_id", "left").withColumn("team_id", F.coalesce("canonical", "team_id")).drop("canonical")


def display_names(team: DataFrame, outside: DataFrame, merges: DataFrame) -> DataFrame:
    """(team_id, name) of every id that is a team, an outside team or merged: a merged one shows the canonical team's own
    name, others their outside label, else their own name; unknown is "". Of several labels of an id the greatest counts."""
    own = team.select("team_id", F.col("name").alias("own"))
    label = outside.groupBy("team_id").agg(F.max("name").alias("label"))
    shown = merges.join(team.select(F.col("team_id").alias("canonical"), F.col("name").alias("shown")), "canonical", "left").select("team_id", "shown")
    return own.join(label, "team_id", "full").join(shown, "team_id", "full").select("team_id", F.coalesce("shown", "label", "own", F.lit("")).alias("name"))


def lineage(team: DataFrame, merges: DataFrame, leagues: DataFrame) -> DataFrame:
    """Per canonical team: league_mask (a bit for each known league of the line), dissolved (the last year if every part
    of the line is dissolved and none plays in a league now). leagues: (team_id, idx)."""
    group = canonical(team.select("team_id", "dissolved", "cur_league"), merges)
    mask = canonical(leagues.select("team_id", "idx"), merges).groupBy("team_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("idx"))).alias("league_mask"))
    per = group.groupBy("team_id").agg(F.max("cur_league").alias("cur_league"), F.when(F.count("dissolved") == F.count("*"), F.max("dissolved")).alias("d"))
    return per.join(mask, "team_id", "left").select("team_id", F.coalesce("league_mask", F.lit(0)).alias("league_mask"), "cur_league", F.when(F.col("cur_league").isNull(), F.col("d")).alias("dissolved"))


def stray_current(current: DataFrame, team: DataFrame) -> DataFrame:
    """Curated current members of leagues that the universe lacks."""
    return current.join(team.select("team_id"), "team_id", "left_anti")


def with_current(team: DataFrame, current: DataFrame, merges: DataFrame) -> DataFrame:
    """team with the league (current_idx) in which a curated list says it plays, merged ids taken as their canonical
    ones; the least of several, null for none."""
    now = canonical(current.select("team_id", "idx"), merges).groupBy("team_id").agg(F.min("idx").alias("current_idx"))
    return team.join(now, "team_id", "left")


def with_attributes(members: DataFrame, attributes: DataFrame) -> DataFrame:
    """members (member_id) with their attributes; unknown ones are null, and the name of a member without one is its id."""
    return members.join(attributes, "member_id", "left").withColumn("name", F.coalesce("name", F.col("member_id").cast("string")))
