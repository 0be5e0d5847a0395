"""Both directions of the co-membership question: members whom all chosen teams had, teams that all chosen members had."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def common_members(posting: DataFrame, member: DataFrame, team_ids: list[int]) -> DataFrame:
    """The members that have a posting at every chosen team, with combined tallies.

    apps and goals add what is known and are null where nothing is; goals of goalkeepers do not count. has_zero tells
    of a known 0 apps at a chosen team; zero_goals that goals are known at every chosen team and add up to 0.
    """
    k = len(set(team_ids))
    own = posting.where(F.col("team_id").isin(list(set(team_ids))))
    if k == 0:
        own = own.where(F.lit(False))
    per = own.groupBy("member_id").agg(F.count_distinct("team_id").alias("k"), F.sum("apps").alias("apps"), F.sum("goals").alias("goals"), F.count("goals").alias("known_goals"), F.coalesce(F.bool_or(F.col("apps") == 0), F.lit(False)).alias("has_zero")).where(F.col("k") == k)
    out = per.join(member, "member_id")
    keeper = F.coalesce("gk", F.lit(False))
    return out.select("member_id", "name", "birth", "nat", "img", "gk", "apps", F.when(~keeper, F.col("goals")).alias("goals"), "has_zero", (~keeper & (F.col("known_goals") == k) & (F.col("goals") == 0)).alias("zero_goals"))


def common_members_by_semi_joins(posting: DataFrame, team_ids: list[int]) -> DataFrame:
    """The member ids of common_members, by one semi-join a team; for few teams over a table bucketed by member."""
    first, *rest = list(dict.fromkeys(team_ids))
    out = posting.where(F.col("team_id") == first).select("member_id").distinct()
    for t in rest:
        out = out.join(posting.where(F.col("team_id") == t), "member_id", "left_semi")
    return out


def bulk_common_members(posting: DataFrame, wanted: DataFrame) -> DataFrame:
    """Many questions at once: wanted (query_id, team_id) gives (query_id, member_id, apps, goals). A relational
    division: one join, one aggregation."""
    size = wanted.distinct().groupBy("query_id").agg(F.count("*").alias("k"))
    per = wanted.distinct().join(posting, "team_id").groupBy("query_id", "member_id").agg(F.count("*").alias("n"), F.sum("apps").alias("apps"), F.sum("goals").alias("goals"))
    return per.join(size, "query_id").where("n = k").select("query_id", "member_id", "apps", "goals")


def keep(born_from: int | None = None, born_to: int | None = None, no_zero: bool = False) -> Column:
    """The filter before the facet: a bound on birth leaves unknown births out; no_zero those with a known 0 apps."""
    out = F.lit(True)
    if born_from is not None:
        out = out & F.coalesce(F.col("birth") >= born_from, F.lit(False))
    if born_to is not None:
        out = out & F.coalesce(F.col("birth") <= born_to, F.lit(False))
    return out & ~F.col("has_zero") if no_zero else out


def nationality_facet(filtered: DataFrame) -> DataFrame:
    """(nat, n) after all filters but that by nationality; unknown is the empty text. Order: most first."""
    return filtered.groupBy(F.coalesce("nat", F.lit("")).alias("nat")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "nat")


def without_nationalities(filtered: DataFrame, off: list[str]) -> DataFrame:
    return filtered.where(~F.coalesce("nat", F.lit("")).isin(off)) if off else filtered


def result_order(by: str, descending: bool = True) -> list[Column]:
    """Order by apps or goals (unknown as 0) or birth (unknown last either way), then name, then id."""
    if by == "birth":
        first = F.col("birth").desc_nulls_last() if descending else F.col("birth").asc_nulls_last()
    else:
        value = F.coalesce(F.col(by), F.lit(0))
        first = value.desc() if descending else value.asc()
    return [first, F.col("name").asc(), F.col("member_id").asc()]


def page(result: DataFrame, order: list[Column], start: int = 0, size: int = 50) -> DataFrame:
    """Rows start .. start + size - 1 of the order with their rank, from 1, and how many follow the page. Every task keeps
    its first start + size rows; the total reads the same shuffle as the page."""
    ranked = result.orderBy(*order).offset(start).limit(size)
    rank = F.row_number().over(Window.orderBy(*order)) + start  # over one page
    total = result.agg(F.count("*").alias("_total"))
    return ranked.withColumn("rank", rank.cast("bigint")).crossJoin(F.broadcast(total)).withColumn("remaining", F.greatest(F.col("_total") - start - size, F.lit(0))).drop("_total")


def solve(posting, member, team_ids, born_from=None, born_to=None, no_zero=False, nats_off=(), by="apps", descending=True) -> tuple[DataFrame, DataFrame]:
    """(results in order, nationality facet)."""
    filtered = common_members(posting, member, team_ids).where(keep(born_from, born_to, no_zero))
    return without_nationalities(filtered, list(nats_off)).orderBy(*result_order(by, descending)), nationality_facet(filtered)


def effective_end(spells: DataFrame, build_year: int) -> DataFrame:
    """spells with eff: the end; for an open spell the start of the member's next spell, by seq, that is no loan and starts
    no earlier; else the build year; null where the start is unknown.

    In a career listed by start that is the next known start, so a row looks at one value. Only for members whose list
    goes back in time are later starts gathered, which costs the square of such a career's length.
    """
    start = F.when(~F.coalesce("loan", F.lit(False)), F.col("start_year"))
    by = Window.partitionBy("member_id").orderBy(F.desc("seq"))
    after = by.rowsBetween(Window.unboundedPreceding, -1)
    back = F.coalesce(F.col("start_year") > F.min(start).over(after), F.lit(False))  # some later spell starts earlier
    marked = spells.withColumn("_start", start).withColumn("_back", back)
    marked = marked.withColumn("_any", F.max("_back").over(Window.partitionBy("member_id")))
    nearest = F.last("_start", ignorenulls=True).over(after)
    later = F.collect_list(F.when(F.col("_any"), F.col("_start"))).over(after)  # nearest last; empty for careers in order
    found = marked.withColumns({"_nearest": nearest, "_later": later})
    following = F.when(F.col("_any"), F.get(F.reverse(F.filter("_later", lambda y: y >= F.col("start_year"))), F.lit(0))).otherwise(F.col("_nearest"))
    opened = F.col("start_year").isNotNull() & F.col("end_year").isNull()
    eff = F.when(opened, F.coalesce(following, F.lit(build_year))).when(F.col("start_year").isNotNull(), F.col("end_year"))
    return found.withColumn("eff", eff).drop("_start", "_back", "_any", "_nearest", "_later")


def shared_teams(spells: DataFrame, member_ids: list[int]) -> DataFrame:
    """Teams, by name, at which every chosen member had a spell: team_name, first_start, apps, goals (known ones added)."""
    ids = list(set(member_ids))
    own = spells.where(F.col("member_id").isin(ids) & (F.length("team_name") > 0))
    return own.groupBy("team_name").agg(F.count_distinct("member_id").alias("k"), F.min("start_year").alias("first_start"), F.sum("apps").alias("apps"), F.sum("goals").alias("goals")).where(F.col("k") == len(ids)).drop("k")


def teammate_years(spells: DataFrame, k: int, build_year: int) -> DataFrame:
    """Runs of years in which k members provably were at a team together: team_name, from_year, to_year, still (the run
    reaches the build year). spells: member_id, team_name, start_year, eff of the chosen members.

    A team at which one of them has no dated spell claims nothing; spells that end before they start hold no year. A
    sweep over ends and beginnings: a member's spells that touch are made one, each then adds 1 in its first year and
    takes 1 off after its last, and where the running sum is k all are there. No year is written out.
    """
    dated = spells.where(F.col("start_year").isNotNull() & F.col("eff").isNotNull())
    claim = dated.groupBy("team_name").agg(F.count_distinct("member_id").alias("n")).where(F.col("n") == k).select("team_name")
    own = dated.join(claim, "team_name", "left_semi").where("start_year <= eff").select("team_name", "member_id", "start_year", "eff")
    by = Window.partitionBy("team_name", "member_id").orderBy("start_year", "eff")
    apart = F.coalesce(F.col("start_year") > F.max("eff").over(by.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    stays = own.withColumn("_apart", apart).withColumn("_stay", F.sum(F.col("_apart").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("team_name", "member_id", "_stay").agg(F.min("start_year").alias("a"), F.max("eff").alias("b"))
    step = lambda year, n: F.struct(year.alias("year"), F.lit(n).alias("step"))
    steps = stays.select("team_name", F.explode(F.array(step(F.col("a"), 1), step(F.col("b") + 1, -1))).alias("x")).groupBy("team_name", "x.year").agg(F.sum("x.step").alias("step")).where("step <> 0")
    time = Window.partitionBy("team_name").orderBy("year")
    there = steps.withColumn("n", F.sum("step").over(time.rowsBetween(Window.unboundedPreceding, 0))).withColumn("to_year", F.lead("year").over(time) - 1).where(F.col("n") == k)
    return there.select("team_name", F.col("year").alias("from_year"), "to_year", (F.col("to_year") >= build_year).alias("still"))


def shared_totals(spells: DataFrame, member_ids: list[int]) -> DataFrame:
    """Tallies over shared teams by team and member, by team, by member and overall; level tells which. Null totals stay
    null. Goals of goalkeepers (gk) do not count. The overall row is there even if no team is shared (a grouping set of no
    columns has no row over no rows in Spark)."""
    ids = list(set(member_ids))
    shared = shared_teams(spells, ids).select("team_name")
    own = spells.where(F.col("member_id").isin(ids)).join(shared, "team_name", "left_semi").withColumn("goals", F.when(~F.coalesce("gk", F.lit(False)), F.col("goals")))
    sums = [F.sum("apps").alias("apps"), F.sum("goals").alias("goals"), F.count("*").alias("n_spells")]
    parts = own.groupingSets([["team_name", "member_id"], ["team_name"], ["member_id"]], "team_name", "member_id").agg(*sums, F.grouping_id().alias("level"))
    overall = own.agg(*sums).select(F.lit(None).cast("string").alias("team_name"), F.lit(None).cast(dict(own.dtypes)["member_id"]).alias("member_id"), "*", F.lit(3).cast("bigint").alias("level"))
    return parts.unionByName(overall)


def team_records(shared: DataFrame, team: DataFrame, league: DataFrame) -> DataFrame:
    """shared (team_name ...) with the record of the team of that name: team_id, cc and current league ("Others" where it
    plays in none now). Of several teams with one name the greatest id counts; an unknown name has nulls."""
    idx = F.when(F.col("dissolved").isNull(), F.col("cur_league"))
    one = team.groupBy(F.col("name").alias("team_name")).agg(F.max_by(F.struct("team_id", "cc", idx.alias("idx")), "team_id").alias("t")).select("team_name", "t.*")
    known = one.join(league.select("idx", F.col("name").alias("league")), "idx", "left").select("team_name", "team_id", "cc", F.coalesce("league", F.lit("Others")).alias("league"))
    return shared.join(known, "team_name", "left")
