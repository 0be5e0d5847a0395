"""Blocked rosters and the index of letter triples against scans, and what they read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rosterly.operators import blocks, search, solve, triples


@pytest.fixture(scope="module")
def rosters(spark):
    rng = random.Random(2)
    sizes = {1: 3000, 2: 400, 3: 9000, 4: 50, 5: 1}
    rows = [(t, m, rng.choice([None, 0, 3, 9]), rng.choice([None, 0, 2])) for t, n in sizes.items() for m in rng.sample(range(40_000), n)]
    rows += [(6, m, 1, 1) for m in range(100)] + [(7, m, 1, 1) for m in range(30_000, 30_100)]  # never meet
    rows += [(8, m, 2, 0) for m in (*range(30_050, 30_060), 5)]
    posting = spark.createDataFrame(rows, "team_id long, member_id long, apps long, goals long").cache()
    member = spark.range(40_000).select(F.col("id").alias("member_id"), F.format_string("m%d", "id").alias("name"), F.lit(1980).alias("birth"), F.lit("x").alias("nat"), F.lit(None).cast("string").alias("img"), (F.col("id") % 7 == 0).alias("gk"))
    return posting, member


def rows_read(df) -> int:
    """Rows that the scans of df gave out, of those that read the index."""
    df.collect()
    return sum(int(m.replace(",", "")) for m in scans(df._jdf.queryExecution().executedPlan(), "numOutputRows"))


def scans(plan, metric: str):
    """A metric of every file scan of an executed plan, adaptive stages included."""
    name, out = plan.getClass().getSimpleName(), []
    if name == "AdaptiveSparkPlanExec":
        return scans(plan.executedPlan(), metric)
    if name.endswith("QueryStageExec"):
        return scans(plan.plan(), metric)
    if name == "FileSourceScanExec":
        out.append(str(plan.metrics().apply(metric).value()))
    children = plan.children()
    for i in range(children.size()):
        out += scans(children.apply(i), metric)
    return out


@pytest.mark.parametrize("named, few", [(500, 2000), (0, 0)])
def test_blocks_give_what_a_scan_gives(spark, rosters, tmp_path, monkeypatch, named, few):
    monkeypatch.setattr(blocks, "NAMED", named)
    monkeypatch.setattr(blocks, "BROADCAST_BLOCKS", few)
    posting, member = rosters
    index = blocks.write(blocks.blocked(posting), str(tmp_path / "b"), 3)
    assert sorted(blocks.rows(index).collect(), key=str) == sorted(posting.collect(), key=str)
    for teams in ([3, 1, 2], [2, 2, 4], [6, 7], [7, 8], [1, 99], []) if named else ([3, 1, 2], [6, 8]):
        want = sorted(solve.common_members(posting, member, teams).collect(), key=str)
        assert sorted(blocks.common_members(index, member, teams).collect(), key=str) == want
        assert sorted(r.member_id for r in blocks.common_ids(index, teams).collect()) == sorted(r.member_id for r in want)


def test_blocks_that_cannot_meet_are_not_read(spark, rosters, tmp_path):
    posting, _ = rosters
    index = blocks.write(blocks.blocked(posting, 64), str(tmp_path / "b"), 1, 0)
    assert [t for t, _ in blocks.shortest_first(index, [3, 1, 4])] == [4, 1, 3]
    assert blocks.meeting(index, [6, 7]).count() == 0 and blocks.meeting(index, [7, 8]).count() == 1
    assert {(r.team_id, r.bucket) for r in blocks.meeting_blocks(index, [7, 8]).collect()} == {(7, 469), (8, 469)}
    assert {(r.team_id, r.bucket) for r in blocks.meeting_blocks(index, [6, 8]).collect()} == {(6, 0), (8, 0)}
    everything = index.count()
    assert rows_read(blocks.meeting_blocks(index, [7, 8])) < everything / 3
    heads = blocks.heads(index, [1, 3])._jdf.queryExecution().executedPlan().toString()
    assert "steps" not in re.search(r"ReadSchema: \S+", heads)[0] and "In(team_id" in heads


NAMES = ["Anna Berg", "Annabel Lee", "Jo", "Susanna Ann", "Đorđe Łódź", "", None, "Hanna  Öst", "Bo An", "Nan An Na"]


def people(spark):
    rng = random.Random(5)
    rows = [(i, n, "p" if i % 3 else None) for i, n in enumerate(NAMES + ["".join(rng.choice("anbe ") for _ in range(rng.randint(0, 14))) for _ in range(300)])]
    return search.with_keys(spark.createDataFrame(rows, "member_id long, name string, img string"))


@pytest.mark.parametrize("few", [200_000, 0])
def test_a_search_by_triples_finds_what_a_scan_finds(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(triples, "BROADCAST_IDS", few)
    member = people(spark).cache()
    index = triples.write(triples.postings(member, "member_id", ["search"]), str(tmp_path / "t"), 2)
    for text in ("ann", "Anna", "", "an", "n an", "dord", "zzz") if few else ("anna",):
        scan = search.member_matches(member, text, 50).select("member_id", "rank").collect()
        assert search.member_matches(triples.candidates(index, member, "member_id", text), text, 50).select("member_id", "rank").collect() == scan
    assert triples.candidates(index, member, "member_id", "dord").count() < 5


def test_team_searches_by_triples_know_sort_names_aliases_and_initials(spark, tmp_path):
    rows = [(1, "FC Real Union", ["the reals"], 9), (2, "Realta", None, 3), (3, "Great Union Side", [], 7), (4, "Surreal", ["old ones"], 2), (5, "Real", [None, "x"], 5)]
    team = search.with_keys(spark.createDataFrame(rows, "team_id long, name string, aliases array<string>, n long")).withColumns({"cur_league": F.lit(1), "dissolved": F.lit(None).cast("int")}).cache()
    index = triples.write(triples.postings(team, "team_id", ["search", "sort"], ("aliases",), ["initials"]), str(tmp_path / "t"))
    for text in ("real", "union", "gus", "fru", "the re", "old", "real u", "nothing", "re"):
        assert search.team_matches(triples.candidates(index, team, "team_id", text), text).collect() == search.team_matches(team, text).collect()


def test_a_search_opens_a_part_of_the_index(spark, tmp_path):
    member = people(spark)
    index = triples.write(triples.postings(member, "member_id", ["search"]), str(tmp_path / "t"))
    some = triples.having(index, ["dor", "ord"])
    some.collect()
    assert sum(int(n) for n in scans(some._jdf.queryExecution().executedPlan(), "numFiles")) <= 2 < len(index.inputFiles()) / 4
