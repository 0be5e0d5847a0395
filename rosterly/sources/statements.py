"""Landed statements: explicit schemas, patterns over properties, and page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterly.operators.clean import as_int, last_segment, sane_year, year_of

STATEMENTS = "st string, s string, p string, o string, start string, end string, apps string, goals string, loan string"
TRUTHY = "s string, p string, o string"
LABELS = "s string, lang string, label string"
SITELINKS = "s string, site string, title string"
TITLES = "normalized array<struct<`from`: string, to: string>>, redirects array<struct<`from`: string, to: string>>, pages array<struct<title: string, item: string>>"
PAGES = "pages array<struct<title: string, revisions: array<struct<content: string>>>>"


def read(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    return getattr(spark.read.schema(schema), kind)(path)


def career_rows(statements: DataFrame, member_of: str) -> DataFrame:
    """st, member_id, team_id, start_year, end_year, apps, goals, loan from raw text: ids are last URI segments,
    placeholders and years out of range are null."""
    seg = lambda c: last_segment(F.col(c))
    return statements.where(F.col("p") == member_of).select("st", seg("s").alias("member_id"), seg("o").alias("team_id"), sane_year(year_of(F.col("start"))).alias("start_year"), sane_year(year_of(F.col("end"))).alias("end_year"), as_int(F.col("apps")).alias("apps"), as_int(F.col("goals")).alias("goals"), F.coalesce(F.col("loan") == "1", F.lit(False)).alias("loan"))


def objects(truthy: DataFrame, prop: str, subject: str = "s", value: str = "o") -> DataFrame:
    """The (subject, value) pairs of one property, with names for both: a step of a path."""
    return truthy.where(F.col("p") == prop).select(F.col("s").alias(subject), F.col("o").alias(value))


def path(truthy: DataFrame, first: str, second: str) -> DataFrame:
    """(s, o) over two properties in a row."""
    return objects(truthy, first, "s", "_m").join(objects(truthy, second, "_m", "o"), "_m").select("s", "o")


def of_class(rows: DataFrame, truthy: DataFrame, prop: str, cls: str, key: str) -> DataFrame:
    """rows whose key is of a class."""
    return rows.join(truthy.where((F.col("p") == prop) & (F.col("o") == cls)).select(F.col("s").alias(key)).distinct(), key, "left_semi")


def restricted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of a batch of keys, of any size: Spark broadcasts the keys if they turn out to be few."""
    return rows.join(keys.select(key), key, "left_semi")


def excluded(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def team_universe(truthy: DataFrame, direct: str, season_of: str, participant: str, instance: str, club: str, country: str, code: str, aliases: DataFrame) -> DataFrame:
    """(qid, league, cc): teams with a direct league statement that are clubs, and participants of a league's seasons;
    aliased leagues collapse; the country code is optional."""
    straight = of_class(objects(truthy, direct, "qid", "league"), truthy, instance, club, "qid")
    seasons = objects(truthy, season_of, "_season", "league").join(objects(truthy, participant, "_season", "qid"), "_season").select("qid", "league")
    both = straight.unionByName(seasons).distinct()
    named = both.join(F.broadcast(aliases), "league", "left").select("qid", F.coalesce("canonical", "league").alias("league"))
    return named.join(path(truthy, country, code).select(F.col("s").alias("qid"), F.col("o").alias("cc")), "qid", "left").distinct()


def outside(careers: DataFrame, teams: DataFrame) -> DataFrame:
    """Teams of careers that the universe lacks."""
    return careers.select("team_id").distinct().join(teams, "team_id", "left_anti")


def labels_of(items: DataFrame, labels: DataFrame, languages: list[str], key: str = "team_id") -> DataFrame:
    """(key, name): the least label of the first language that has one; items without a label are left out."""
    per = labels.join(items.select(F.col(key).alias("s")), "s", "left_semi").groupBy("s").agg(*(F.min(F.when(F.col("lang") == x, F.col("label"))).alias(f"_{i}") for i, x in enumerate(languages)))
    return per.select(F.col("s").alias(key), F.coalesce(*(F.col(f"_{i}") for i in range(len(languages)))).alias("name")).where("name IS NOT NULL")


def page_titles(members: DataFrame, sitelinks: DataFrame, site: str) -> DataFrame:
    """(member_id, title); members without a page drop out."""
    return members.join(sitelinks.where(F.col("site") == site).select(F.col("s").alias("member_id"), "title"), "member_id")


def page_in(members: DataFrame, sitelinks: DataFrame, site: str, other: str) -> DataFrame:
    """The page of each member on one site, else on the other, else null."""
    one = lambda x, c: sitelinks.where(F.col("site") == x).groupBy(F.col("s").alias("member_id")).agg(F.min("title").alias(c))
    return members.join(one(site, "_a"), "member_id", "left").join(one(other, "_b"), "member_id", "left").select("member_id", F.coalesce("_a", "_b").alias("title"))


def page_text(responses: DataFrame) -> DataFrame:
    """(title, content) of landed responses; pages without a revision are skipped."""
    p = responses.select(F.explode("pages").alias("p"))
    return p.where(F.size("p.revisions") > 0).select("p.title", F.get("p.revisions", F.lit(0))["content"].alias("content"))


def pages_of(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(member_id, content): page texts by exact title; of several members with one title the greatest id has the page."""
    owner = members.groupBy("title").agg(F.max("member_id").alias("member_id"))
    return texts.join(owner, "title").select("member_id", "content")


def title_maps(responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(from, to) of normalised titles, (from, to) of redirects, (title, qid) of pages with an item, from landed responses
    of the schema TITLES. A title that several responses tell of counts once."""
    pairs = lambda c: responses.select(F.explode(c).alias("p")).select("p.from", "p.to").groupBy("from").agg(F.min("to").alias("to"))
    items = responses.select(F.explode("pages").alias("p")).where("p.item IS NOT NULL").groupBy("p.title").agg(F.min("p.item").alias("qid"))
    return pairs("normalized"), pairs("redirects"), items
