"""From statement rows to clean spells, teams and members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEARS = (1850, 2035)
FACTS = ("start_year", "end_year", "apps", "goals")
#: Fixed patterns: names of reserve, youth and women's sides; names of national sides.
RESERVE = r"(?U)(\s(II|III|IV|B|C)|U-?\d{2}|Under-?\d{2}|[Yy]outh|Primavera|Castilla|Atl[eè]tic\b|[Rr]eserves?|[Aa]cademy|[Ww]omen|[Ff]emen|[Ff]rauen|[Ff]éminin|[Ff]emminile)$|Castilla|\bU-?\d{2}\b"
NATIONAL = r"(?iU)\bnational\b.*\bteam\b|nationalmannschaft|\bolympic (football|soccer) team|\bunder-\d+.*\bteam\b"


def last_segment(uri: Column) -> Column:
    """The part of a URI after the last slash."""
    return F.element_at(F.split(uri, "/"), -1)


def as_int(text: Column) -> Column:
    """An integer, or null for anything else, placeholders included."""
    return text.try_cast("int")


def year_of(iso: Column) -> Column:
    """The year that an ISO date text starts with; null for years before ours and for other text."""
    return F.regexp_extract(iso, r"^(\d{4,5})", 1).try_cast("int")


def sane_year(year: Column, lo: int = YEARS[0], hi: int = YEARS[1]) -> Column:
    return F.when(year.between(lo, hi), year)


def is_bare() -> Column:
    """Nothing is known of the spell: neither years nor tallies."""
    return F.coalesce(*(F.col(c).cast("bigint") for c in FACTS)).isNull()


def collapse_statements(rows: DataFrame, of: list[str] = []) -> DataFrame:  # noqa: B006
    """One spell per statement: least start, greatest end and tallies (never under 0), a loan if any row says so. of: columns
    in which a statement's rows agree; rows that are already dealt out by these are put together where they are."""
    at_least_0 = lambda c: F.when(F.max(c).isNotNull(), F.greatest(F.max(c), F.lit(0))).alias(c)
    return rows.groupBy("st", *of).agg(F.min("member_id").alias("member_id"), F.min("team_id").alias("team_id"), F.min("start_year").alias("start_year"), F.max("end_year").alias("end_year"), at_least_0("apps"), at_least_0("goals"), F.bool_or("loan").alias("loan")).drop(*of)


def with_sequence(spells: DataFrame) -> DataFrame:
    """seq: the place of a spell in its member's career, by start, then end, unknown last, then statement."""
    w = Window.partitionBy("member_id").orderBy(F.col("start_year").asc_nulls_last(), F.col("end_year").asc_nulls_last(), "st")
    return spells.withColumn("seq", F.row_number().over(w).cast("bigint"))


def without_national(spells: DataFrame, name_col: str = "team_name") -> DataFrame:
    """Career spells without national sides and bare spells."""
    return spells.where(~F.coalesce(F.col(name_col).rlike(NATIONAL), F.lit(False)) & ~is_bare())


def usable_teams(teams: DataFrame, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) teams of (qid, name): dropped are reserve sides, names that are missing or the id, blocked ids."""
    name = F.col("name")
    named = name.isNotNull() & (name != F.col("qid"))
    good = named & ~F.coalesce(name.rlike(RESERVE), F.lit(False))
    kept = teams.where(good).join(blocked.select("qid"), "qid", "left_anti")
    return kept, teams.join(kept.select("qid"), "qid", "left_anti")


def collapse_teams(rows: DataFrame) -> DataFrame:
    """One row per team: least name, least non-empty country, sorted league set, latest dissolution."""
    return rows.groupBy("qid").agg(F.min("name").alias("name"), F.min(F.nullif("cc", F.lit(""))).alias("cc"), F.sort_array(F.collect_set("league")).alias("leagues"), F.max("dissolved").alias("dissolved"))


def collapse_attributes(rows: DataFrame) -> DataFrame:
    """One row per member from a bag of (member, lang, label, birth, img, cc, sport_cc, citizenship, gk)."""
    label = lambda ok: F.min(F.when(ok, F.col("label")))
    return rows.groupBy("member").agg(F.coalesce(label(F.col("lang") == "en"), label(F.col("lang") == "mul")).alias("name"), F.min("birth").alias("birth"), F.min("img").alias("img"), F.collect_set("cc").alias("ccs"), F.collect_set("sport_cc").alias("sport_ccs"), F.collect_set("citizenship").alias("citizenships"), F.bool_or("gk").alias("gk"))


def nationality(members: DataFrame, obsolete: DataFrame, curated: DataFrame) -> DataFrame:
    """members (member, ccs, sport_ccs, citizenships) with nat: the one sport country if it is current; else the least
    current code; else the least successor of an obsolete code; else the least curated code of a citizenship.

    obsolete: (cc, successor); curated: (citizenship, cc). Both are curated lists and so small enough to broadcast.
    """
    old = F.broadcast(obsolete.select(F.col("cc").alias("code"), "successor", F.lit(True).alias("old")))
    codes = members.select("member", F.explode(F.array_union("ccs", "sport_ccs")).alias("code")).join(old, "code", "left")
    of = members.select("member", "ccs", (F.size("sport_ccs") == 1).alias("single"), F.get("sport_ccs", F.lit(0)).alias("sport")).join(codes, "member", "left")
    current = F.col("old").isNull() & F.array_contains("ccs", F.col("code"))
    picked = of.groupBy("member").agg(F.min(F.when(F.col("single") & (F.col("code") == F.col("sport")) & F.col("old").isNull(), F.col("code"))).alias("a"), F.min(F.when(current, F.col("code"))).alias("b"), F.min(F.when(F.array_contains("ccs", F.col("code")), F.col("successor"))).alias("c"))
    hand = members.select("member", F.explode("citizenships").alias("citizenship")).join(F.broadcast(curated), "citizenship").groupBy("member").agg(F.min("cc").alias("d"))
    return members.join(picked, "member", "left").join(hand, "member", "left").withColumn("nat", F.coalesce("a", "b", "c", "d")).drop("a", "b", "c", "d")
