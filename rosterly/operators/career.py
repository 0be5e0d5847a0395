"""One member's career: inferred loans, the view with marks, the best-known other teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def year_span(start: Column, end: Column) -> Column:
    """"2001–2004", "2001" for one year, "2001–" while open, "?–2004" without a start, "?" if nothing is known."""
    s, e = start.cast("string"), end.cast("string")
    return F.when(start.isNull() & end.isNull(), "?").when(start == end, s).otherwise(F.concat(F.coalesce(s, F.lit("?")), F.lit("–"), F.coalesce(e, F.lit(""))))


def inferred_loans(spells: DataFrame) -> DataFrame:
    """spells with is_loan: flagged, or inside the years of an earlier-listed spell of the member and shorter than it.

    Careers are listed by start as a rule. Then one sweep answers it, in time linear in the career: of the spells so far
    that with the greatest end, the earliest such one, contains a spell if any does and is not shorter. Only for members
    whose list goes back in time, as some page lists do, are all spells so far looked at, one row at a time.
    """
    dated = F.col("start_year").isNotNull() & F.col("end_year").isNotNull()
    before = Window.partitionBy("member_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    widest = F.max(F.when(dated, F.struct(F.col("end_year").alias("e"), (-F.col("start_year")).alias("s")))).over(before)
    back = F.coalesce(dated & (F.col("start_year") < F.max(F.when(dated, F.col("start_year"))).over(before)), F.lit(False))
    marked = spells.withColumns({"_widest": widest, "_back": back}).withColumn("_any", F.max("_back").over(Window.partitionBy("member_id")))
    so_far = F.collect_list(F.when(F.col("_any") & dated, F.struct(F.col("start_year").alias("s"), F.col("end_year").alias("e")))).over(before)
    found = marked.withColumn("_so_far", so_far)
    swept = (F.col("_widest.e") > F.col("end_year")) | ((F.col("_widest.e") == F.col("end_year")) & (-F.col("_widest.s") < F.col("start_year")))
    contains = lambda b: (b["s"] <= F.col("start_year")) & (F.col("end_year") <= b["e"]) & (b["e"] - b["s"] > F.col("end_year") - F.col("start_year"))
    inside = dated & F.when(F.col("_any"), F.exists("_so_far", contains)).otherwise(swept)
    return found.withColumn("is_loan", F.coalesce("loan", F.lit(False)) | F.coalesce(inside, F.lit(False))).drop("_widest", "_back", "_any", "_so_far")


def career_view(spells: DataFrame, gk: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """The lines of careers in order: seq, team_name, span, apps, goals (not of goalkeepers), is_loan, selected.
    selected: (team_name) of the chosen teams; gk: (member_id, gk). Spells without a team name are left out."""
    named = inferred_loans(spells).where(F.length("team_name") > 0).join(gk.select("member_id", "gk"), "member_id", "left")
    marked = named.withColumn("selected", F.lit(False))
    if selected is not None:
        marked = named.join(F.broadcast(selected.select("team_name").distinct().withColumn("_sel", F.lit(True))), "team_name", "left").withColumn("selected", F.col("_sel").isNotNull())
    return marked.select("member_id", "seq", "team_name", year_span(F.col("start_year"), F.col("end_year")).alias("span"), "apps", F.when(~F.coalesce("gk", F.lit(False)), F.col("goals")).alias("goals"), "is_loan", "selected")


def other_teams(spells: DataFrame, pair: list[str], n: int = 2) -> DataFrame:
    """The n best-known other teams of each member: the first spell at each, permanent before loan, then more apps, then
    the later start."""
    first = F.row_number().over(Window.partitionBy("member_id", "team_name").orderBy("seq"))
    own = spells.where(~F.col("team_name").isin(pair)).withColumn("_f", first).where("_f = 1")
    rank = F.row_number().over(Window.partitionBy("member_id").orderBy(F.coalesce("loan", F.lit(False)), F.greatest(F.coalesce("apps", F.lit(0)), F.lit(0)).desc(), F.col("start_year").desc_nulls_last(), "seq"))
    return own.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= n).select("member_id", "rank", "team_name")


def years_at(spells: DataFrame) -> DataFrame:
    """member_id, team_name, spans: the ranges with both ends known, in order, one year as one number, never merged."""
    known = spells.where("start_year IS NOT NULL AND end_year IS NOT NULL")
    each = F.struct("seq", year_span(F.col("start_year"), F.col("end_year")).alias("s"))
    return known.groupBy("member_id", "team_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["s"]), ", ").alias("spans"))
