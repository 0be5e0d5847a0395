"""The star schema of the test data seen as members, teams and spells, in DataFrames and in SQL.

A line item is a statement that a customer (member) spent a spell with a supplier (team); one statement may have
several rows. ADAPTER is the same as common table expressions for DuckDB.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterly.operators import clean, postings

BUILD_YEAR = 2002
#: Line items that a task joins with their orders and puts together to spells and postings.
TASK_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tasks(line: DataFrame) -> int:
    """Into how many parts line items are dealt: parts hold TASK_ROWS rows, however many there are."""
    return max(line.sparkSession.sparkContext.defaultParallelism, ceil(line.count() / TASK_ROWS))


def _statements(spark: SparkSession, sf_dir: str, bare: bool = False, teams: list[int] | DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """statements() with l_orderkey, by which they are dealt out into `tasks` parts if that is given."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("oy"))
    line = table(spark, sf_dir, "lineitem")
    if isinstance(teams, DataFrame):
        line = line.join(F.broadcast(teams.select(F.col("team_id").alias("l_suppkey"))), "l_suppkey", "left_semi")
    elif teams is not None:
        line = line.where(F.col("l_suppkey").isin(teams))
    known = F.lit(True) if not bare else F.col("l_quantity") > 5
    n = F.col("l_linenumber")
    line = line.select(
        "l_orderkey", "l_suppkey", (known & (n != 5)).alias("starts"), F.when(known, F.year("l_shipdate")).alias("sy"),
        F.when(known & (n != 7), F.when(F.col("l_quantity") == 1, 0).otherwise(F.col("l_quantity").cast("int"))).alias("apps"),
        F.when(known & (n != 6), F.round(F.col("l_discount") * 100).cast("int")).alias("goals"), (F.col("l_returnflag") == "R").alias("loan"),
    )
    line = line if tasks is None else line.repartition(tasks, "l_orderkey")
    return line.join(o, line.l_orderkey == o.o_orderkey).select(
        F.concat_ws("-", "l_orderkey", "l_suppkey").alias("st"), F.col("o_custkey").alias("member_id"), F.col("l_suppkey").alias("team_id"),
        F.when(F.col("starts"), F.col("oy")).alias("start_year"), F.when(F.col("sy") >= F.col("oy"), F.col("sy")).alias("end_year"), "apps", "goals", "loan", "l_orderkey",
    )


def statements(spark: SparkSession, sf_dir: str, bare: bool = False, teams: list[int] | None = None) -> DataFrame:
    """st, member_id, team_id, start_year, end_year, apps, goals, loan; with bare, small quantities know nothing. With teams
    their statements alone: a statement's rows agree in the team, so the scan can leave out the others."""
    return _statements(spark, sf_dir, bare, teams).drop("l_orderkey")


def _collapsed(spark, sf_dir, bare: bool, tasks: int, teams: DataFrame | None = None) -> DataFrame:
    """Spells without their order. Line items are dealt out by order once, joined and put together there: hardly any two
    are of one statement, so putting them together before they are dealt out would only hold a whole part of the scan."""
    return clean.collapse_statements(_statements(spark, sf_dir, bare, teams, tasks), ["l_orderkey"])


def spells(spark, sf_dir, bare: bool = False) -> DataFrame:
    return clean.with_sequence(_collapsed(spark, sf_dir, bare, _tasks(table(spark, sf_dir, "lineitem"))))


def posting(spark, sf_dir, teams: list[int] | DataFrame | None = None) -> DataFrame:
    """All postings, or those of some teams: a short list, or a table (team_id) of any length. Postings do not need the order
    of spells. All postings and those of a table's teams are dealt out by member, so what puts careers together finds them
    together. Line items of other teams are left out before anything is dealt out."""
    if isinstance(teams, list):
        return postings.posting_table(clean.collapse_statements(_statements(spark, sf_dir, teams=teams), ["l_orderkey"]))
    tasks = _tasks(table(spark, sf_dir, "lineitem"))
    return postings.posting_table(_collapsed(spark, sf_dir, False, tasks, teams).repartition(tasks, "member_id"))


def member(spark, sf_dir) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("c_custkey")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
        k.alias("member_id"), F.col("c_name").alias("name"), F.when(k % 11 != 0, (1940 + k % 65).cast("int")).alias("birth"), F.when(k % 13 != 0, F.col("n_name")).alias("nat"),
        F.when(k % 3 != 0, F.concat(F.lit("photo "), k.cast("string"), F.lit(".jpg"))).alias("img"), (F.col("c_mktsegment") == "MACHINERY").alias("gk"),
    )


def team(spark, sf_dir) -> DataFrame:
    """team_id, name, cc, cur_league, dissolved; every tenth team is a re-founded double of the one before it."""
    s = table(spark, sf_dir, "supplier")
    n, r = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), table(spark, sf_dir, "region")
    own = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("team_id"), "s_name", F.col("r_name").alias("cc"), F.col("r_regionkey").alias("rk"))
    before = own.select((F.col("team_id") + 1).alias("team_id"), F.col("s_name").alias("p_name"), F.col("cc").alias("p_cc"))
    double = F.col("team_id") % 10 == 9
    k = F.col("team_id")
    return own.join(before, "team_id", "left").select(
        "team_id", F.when(double, F.concat(F.lit("FC "), "p_name", F.lit(" 1909"))).otherwise(F.col("s_name")).alias("name"), F.when(double, F.col("p_cc")).otherwise(F.col("cc")).alias("cc"),
        F.when(k % 5 != 4, (2 * F.col("rk") + k % 2).cast("int")).alias("cur_league"), F.when(k % 17 == 0, 1999).cast("int").alias("dissolved"),
    )


def league(spark, sf_dir) -> DataFrame:
    """idx, name, tier, cc: two leagues a region."""
    r = table(spark, sf_dir, "region")
    return r.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("tier"), "r_regionkey", "r_name").select((2 * F.col("r_regionkey") + F.col("tier") - 1).cast("int").alias("idx"), F.concat_ws(" ", "r_name", F.col("tier").cast("string")).alias("name"), "tier", F.col("r_name").alias("cc"))


def marquee(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("team_id")).where(F.col("team_id") % 7 == 0)


def _statements_sql(name: str, known: str) -> str:
    return f"""{name} AS (SELECT l_orderkey || '-' || l_suppkey AS st, o_custkey AS member_id, l_suppkey AS team_id,
  CASE WHEN {known} AND l_linenumber <> 5 THEN CAST(year(o_orderdate) AS INT) END AS start_year,
  CASE WHEN {known} AND year(l_shipdate) >= year(o_orderdate) THEN CAST(year(l_shipdate) AS INT) END AS end_year,
  CASE WHEN {known} AND l_linenumber <> 7 THEN CASE WHEN l_quantity = 1 THEN 0 ELSE CAST(l_quantity AS INT) END END AS apps,
  CASE WHEN {known} AND l_linenumber <> 6 THEN CAST(round(l_discount * 100) AS INT) END AS goals, l_returnflag = 'R' AS loan
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _spells_sql(name: str, source: str) -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY start_year NULLS LAST, end_year NULLS LAST, st) AS seq FROM (
  SELECT st, min(member_id) AS member_id, min(team_id) AS team_id, min(start_year) AS start_year, max(end_year) AS end_year,
  CASE WHEN max(apps) < 0 THEN 0 ELSE max(apps) END AS apps, CASE WHEN max(goals) < 0 THEN 0 ELSE max(goals) END AS goals, bool_or(loan) AS loan FROM {source} GROUP BY st))"""


ADAPTER = ",\n".join([
    _statements_sql("statements", "true"), _statements_sql("bare_statements", "l_quantity > 5"), _spells_sql("spells", "statements"), _spells_sql("bare_spells", "bare_statements"),
    """posting AS (SELECT team_id, member_id, min(start_year) AS first_year, max(end_year) AS last_year, CAST(sum(apps) AS BIGINT) AS apps, CAST(sum(goals) AS BIGINT) AS goals
  FROM spells GROUP BY ALL HAVING coalesce(min(start_year), max(end_year), sum(apps), sum(goals)) IS NOT NULL)""",
    """member AS (SELECT c_custkey AS member_id, c_name AS name, CASE WHEN c_custkey % 11 <> 0 THEN CAST(1940 + c_custkey % 65 AS INT) END AS birth, CASE WHEN c_custkey % 13 <> 0 THEN n_name END AS nat,
  CASE WHEN c_custkey % 3 <> 0 THEN 'photo ' || c_custkey || '.jpg' END AS img, c_mktsegment = 'MACHINERY' AS gk FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "team0 AS (SELECT s_suppkey AS team_id, s_name, r_name AS cc, r_regionkey AS rk FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    """team AS (SELECT a.team_id, CASE WHEN a.team_id % 10 = 9 THEN 'FC ' || b.s_name || ' 1909' ELSE a.s_name END AS name, CASE WHEN a.team_id % 10 = 9 THEN b.cc ELSE a.cc END AS cc,
  CASE WHEN a.team_id % 5 <> 4 THEN CAST(2 * a.rk + a.team_id % 2 AS INT) END AS cur_league, CASE WHEN a.team_id % 17 = 0 THEN CAST(1999 AS INT) END AS dissolved FROM team0 a LEFT JOIN team0 b ON b.team_id = a.team_id - 1)""",
    "league AS (SELECT CAST(2 * r_regionkey + tier - 1 AS INT) AS idx, r_name || ' ' || tier AS name, CAST(tier AS INT) AS tier, r_name AS cc FROM region, (VALUES (1), (2)) t(tier))",
    "marquee AS (SELECT s_suppkey AS team_id FROM supplier WHERE s_suppkey % 7 = 0)",
])


def oracle(body: str) -> str:
    """SQL over the adapter's tables: further expressions and a SELECT, or a SELECT alone."""
    return f"WITH {ADAPTER}\n{'' if body.lstrip().upper().startswith('SELECT') else ','}{body}"
