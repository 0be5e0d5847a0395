"""Search and browsing of teams and members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterly.functions.names import initials, search_name, sort_name


def with_keys(rows: DataFrame) -> DataFrame:
    """rows with the keys that searches compare; made once, when the table is built."""
    return rows.withColumns({"search": search_name(F.col("name")), "sort": sort_name(F.col("name")), "initials": initials(F.col("name"))})


def team_matches(team: DataFrame, query: str, n: int = 8) -> DataFrame:
    """The n best teams for a typed text. team: team_id, name, search, sort, initials, n (roster), cur_league, dissolved,
    and aliases if it has any. Prefix of the name or sort name first, then parts; what is neither may match by initials
    or an alias' prefix. Ties: teams of a current league, alive ones, larger ones."""
    q = search_name(F.lit(query))
    alias = F.exists("aliases", lambda a: F.startswith(a, q)) if "aliases" in team.columns else F.lit(False)
    rank = F.when(F.startswith("search", q) | F.startswith("sort", q), 0).when(F.contains("search", q), 1).when((F.col("initials") == F.replace(q, F.lit(" "), F.lit(""))) | alias, 0)
    alive, current = F.col("dissolved").isNull(), F.col("dissolved").isNull() & F.col("cur_league").isNotNull()
    hit = team.where(q != "").withColumn("rank", rank).where(F.col("rank").isNotNull())
    return hit.orderBy("rank", (~current).cast("int"), (~alive).cast("int"), F.desc("n"), "team_id").limit(n)


def member_matches(member: DataFrame, query: str, n: int = 8) -> DataFrame:
    """The n best members: the text starts the name or one of its words, then parts of it; those with a photo first."""
    q = search_name(F.lit(query))
    rank = F.when(F.startswith("search", q) | F.contains("search", F.concat(F.lit(" "), q)), 0).when(F.contains("search", q), 1)
    return member.where(q != "").withColumn("rank", rank).where(F.col("rank").isNotNull()).orderBy("rank", F.col("img").isNull().cast("int"), "name", "member_id").limit(n)


def browse(team: DataFrame, league: DataFrame, cc: str, others: bool = False, idx: int | None = None) -> DataFrame:
    """Teams of a league, or of a country; with others, those that play in none now but once did in the country's."""
    cur = F.when(F.col("dissolved").isNull(), F.col("cur_league"))
    shown = team.withColumn("cur", cur)
    if others:
        mask = league.where(F.col("cc") == cc).agg(F.coalesce(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("idx"))), F.lit(0)).alias("_mask"))
        return shown.crossJoin(F.broadcast(mask)).where(F.col("cur").isNull() & (F.col("league_mask").bitwiseAND(F.col("_mask")) != 0)).drop("_mask").orderBy("sort", "team_id")
    own = shown.where(F.col("cur") == idx) if idx is not None else shown.join(F.broadcast(league.where(F.col("cc") == cc).select(F.col("idx").alias("cur"))), "cur", "left_semi")
    return own.orderBy("sort", "team_id")


def league_names(team: DataFrame, league: DataFrame) -> DataFrame:
    """(team_id, league) for each bit of a team's mask. The league list is short and broadcast."""
    bit = F.call_function("shiftleft", F.lit(1), F.col("idx"))
    return team.select("team_id", "league_mask").join(F.broadcast(league.select("idx", F.col("name").alias("league"))), F.col("league_mask").bitwiseAND(bit) != 0).select("team_id", "league")


def restore(link, team: DataFrame) -> DataFrame:
    """The teams of shared links (link_id, ids: comma-separated), unknown ones dropped, in the link's order."""
    each = link.select("link_id", F.posexplode(F.split("ids", ",")).alias("pos", "qid"))
    return each.join(team.select(F.col("team_id").cast("string").alias("qid"), "team_id"), "qid").select("link_id", "pos", "team_id")
