"""Data-quality gate and build metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterly.sources import stages


def metrics(team: DataFrame, member: DataFrame, posting: DataFrame) -> DataFrame:
    """One row: counts, shares of known attributes, coverage of tallies, the longest roster."""
    share = lambda c: F.avg(c.cast("int").cast("double"))
    m = member.agg(F.count("*").alias("members"), share(F.coalesce("gk", F.lit(False))).alias("gk_share"), share(F.col("birth").isNotNull()).alias("birth_share"), share(F.col("img").isNotNull()).alias("img_share"), share(F.col("nat").isNotNull()).alias("nat_share"))
    p = posting.agg(F.count("*").alias("postings"), F.coalesce(share(F.col("apps").isNotNull()), F.lit(0.0)).alias("apps_coverage"), F.coalesce(share(F.col("goals").isNotNull()), F.lit(0.0)).alias("goals_coverage"))
    r = posting.groupBy("team_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("longest_roster"))
    return team.agg(F.count("*").alias("teams")).crossJoin(m).crossJoin(p).crossJoin(r)


def thinnest(posting: DataFrame, team: DataFrame, least: int = 30, n: int = 12) -> DataFrame:
    """The n rosters of at least `least` members with the lowest coverage of appearances."""
    cov = posting.groupBy("team_id").agg(F.avg(F.col("apps").isNotNull().cast("int").cast("double")).alias("coverage"), F.count("*").alias("n")).where(F.col("n") >= least)
    return cov.join(team.select("team_id", "name"), "team_id").orderBy("coverage", "n", "name").limit(n)


def league_counts(league: DataFrame, team: DataFrame) -> DataFrame:
    """Teams that play in each league now, leagues without one included."""
    return league.join(team.where("dissolved IS NULL"), league.idx == team.cur_league, "left").groupBy("idx", league.name.alias("league")).agg(F.count("team_id").alias("n"))


def leagues_by_country(league: DataFrame) -> DataFrame:
    """(cc, leagues): league names in league order, countries by their first league."""
    per = league.groupBy("cc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda x: x["name"]), ", ").alias("leagues"), F.min("idx").alias("first_idx"))
    return per.orderBy("first_idx")


def top_divisions(league: DataFrame) -> DataFrame:
    """The first league of each country."""
    return league.groupBy("cc").agg(F.min("idx").alias("idx"))


def violations(team: DataFrame, member: DataFrame, posting: DataFrame, league: DataFrame, sizes: tuple[int, int] = (17, 24), coverage_floor: float = 0.85) -> DataFrame:
    """(check, detail) of everything wrong with a set of tables; empty when they may be published."""
    row = lambda d, check, detail: d.select(F.lit(check).alias("check"), detail.cast("string").alias("detail"))
    n_league = league.agg(F.max("idx").alias("top"))
    checks = [
        row(team.agg(F.count("*").alias("n")).where("n = 0"), "no teams", F.col("n")), row(member.agg(F.count("*").alias("n")).where("n = 0"), "no members", F.col("n")),
        row(team.groupBy("team_id").agg(F.count("*").alias("n")).where("n > 1"), "team id repeats", F.col("team_id")),
        row(posting.groupBy("team_id", "member_id").agg(F.count("*").alias("n")).where("n > 1"), "posting repeats", F.concat_ws("-", "team_id", "member_id")),
        row(posting.join(team, "team_id", "left_anti"), "posting without team", F.col("team_id")), row(posting.join(member, "member_id", "left_anti"), "posting without member", F.col("member_id")),
        row(team.join(posting, "team_id", "left_anti"), "team without posting", F.col("team_id")), row(member.where(F.col("img_key").isNotNull() & ~F.col("img_key").rlike(r"^[0-9a-f]{2}\S+$")) if "img_key" in member.columns else member.where(F.lit(False)), "image key", F.col("member_id")),
        row(team.crossJoin(F.broadcast(n_league)).where("cur_league < 0 OR cur_league > top"), "league out of range", F.col("team_id")),
        row(league_counts(league, team).where(~F.col("n").between(*sizes)), "league size", F.concat_ws(":", "league", "n")),
        row(posting.where("apps < 0 OR goals < 0"), "negative tally", F.concat_ws("-", "team_id", "member_id")),
        row(posting.agg(F.coalesce(F.avg(F.col("apps").isNotNull().cast("int").cast("double")), F.lit(0.0)).alias("c")).where(F.col("c") < coverage_floor), "apps coverage", F.round("c", 4)),
    ]
    return reduce(DataFrame.unionByName, checks)


def export_violations(rosters: DataFrame, n_members: int) -> DataFrame:
    """(check, detail) of what is wrong with exported rosters: arrays of unequal length, a first step under 0, later
    steps that are not positive, ids past the last member, tallies under -1."""
    later = F.slice("delta", 2, F.greatest(F.size("delta"), F.lit(1)))
    checks = [
        ("arrays differ in length", (F.size("delta") != F.size("apps")) | (F.size("delta") != F.size("goals"))), ("steps", (F.get("delta", F.lit(0)) < 0) | F.exists(later, lambda x: x <= 0)),
        ("id out of range", F.aggregate("delta", F.lit(0).cast("bigint"), lambda a, x: a + x) >= n_members), ("tally under -1", F.exists("apps", lambda x: x < -1) | F.exists("goals", lambda x: x < -1)),
    ]
    return reduce(DataFrame.unionByName, [rosters.where(bad).select(F.lit(name).alias("check"), F.col("team_id").cast("string").alias("detail")) for name, bad in checks])


def block_violations(blocks: DataFrame, n_members: int, width: int) -> DataFrame:
    """(check, detail) of what is wrong with blocks of rosters, or of the list of goalkeepers as a roster of its own: arrays
    of unequal length, a first id that is negative or not the block's, steps that do not rise, a last id that the steps
    do not give or that is past the last member, an id outside the block's range, a block that is there twice."""
    steps, name = F.col("steps"), F.concat_ws("-", "team_id", "bucket")
    falls = F.exists(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.get(steps, i) <= F.get(steps, i - 1))
    checks = [
        ("arrays differ in length", (F.size("steps") != F.size("apps")) | (F.size("steps") != F.size("goals")) | (F.size("steps") != F.col("n"))),
        ("steps", (F.col("first_id") < 0) | (F.get(steps, F.lit(0)) != 0) | F.when(F.size(steps) > 1, falls).otherwise(False) | (F.col("first_id") + F.element_at(steps, -1) != F.col("last_id"))),
        ("id out of range", (F.col("last_id") >= n_members) | (F.floor(F.col("first_id") / width) != F.col("bucket")) | (F.floor(F.col("last_id") / width) != F.col("bucket"))),
    ]
    wrong = [blocks.where(bad).select(F.lit(check).alias("check"), name.alias("detail")) for check, bad in checks]
    twice = blocks.groupBy("team_id", "bucket").agg(F.count("*").alias("k")).where("k > 1").select(F.lit("block repeats").alias("check"), name.alias("detail"))
    return reduce(DataFrame.unionByName, [*wrong, twice])


def missing_shards(shards: DataFrame, n: int) -> DataFrame:
    every = shards.sparkSession.range(n).select(F.col("id").cast("int").alias("shard"))
    return every.join(shards.select("shard").distinct(), "shard", "left_anti")


def regressions(now: DataFrame, baseline: DataFrame, count_share: float = 0.97, coverage_points: float = 0.02) -> DataFrame:
    """(check, detail) where one-row metrics fell against a baseline's."""
    b = baseline.select(*(F.col(c).alias(f"b_{c}") for c in ("teams", "members", "apps_coverage")))
    j = now.crossJoin(b)
    bad = [(f"fewer {c}", F.col(c) < F.col(f"b_{c}") * count_share, F.col(c)) for c in ("teams", "members")] + [("apps coverage fell", F.col("apps_coverage") < F.col("b_apps_coverage") - coverage_points, F.round("apps_coverage", 4))]
    return reduce(DataFrame.unionByName, [j.where(w).select(F.lit(k).alias("check"), d.cast("string").alias("detail")) for k, w, d in bad])


def against_stored(now: DataFrame, folder: str, stage: str = "metrics") -> DataFrame:
    """(check, detail) where one-row metrics fell against the baseline that the last accepted build left in a shared
    folder. A build without a regression, the first one too, becomes the next baseline; a regressed one leaves the
    baseline as it is."""
    spark = now.sparkSession
    fixed = stages.stored(now)
    baseline = stages.load(spark, folder, stage) if stages.versions(spark, folder, stage) else fixed
    found = stages.stored(regressions(fixed, baseline))
    if found.isEmpty():
        stages.save(fixed, folder, stage)
    stages.dropped(fixed)
    return found


def report(found: DataFrame, shown: int = 20) -> DataFrame:
    """The first failures of a gate, by check and detail, with the number of all."""
    total = found.agg(F.count("*").alias("failures"))
    return found.orderBy("check", "detail").limit(shown).join(F.broadcast(total), F.lit(True))


def enforce(found: DataFrame, shown: int = 20) -> None:
    """Raise with the first failures of a gate, if there are any."""
    first = found.limit(shown).collect()
    if first:
        raise ValueError("; ".join(f"{r['check']}: {r['detail']}" for r in first))
