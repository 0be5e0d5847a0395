"""Cases that a review found wrong or too costly."""

from __future__ import annotations

import datetime
import itertools
import random
import re
from hashlib import md5 as digest

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rosterly.operators import gate, overlay, pairs, schedule, solve, triples
from rosterly.plans import catalogue, puzzles
from rosterly.sources import adapter, stages
from rosterly.streaming import live


def test_totals_of_members_without_a_shared_team(spark):
    """As in SQL, the overall row is there though it sums up no row."""
    own = spark.createDataFrame([(1, "A", 3, 1, False), (2, "B", 4, 2, False)], "member_id long, team_name string, apps int, goals int, gk boolean").withColumn("start_year", F.lit(2000))
    assert [tuple(r) for r in solve.shared_totals(own, [1, 2]).collect()] == [(None, None, None, None, 0, 3)]


def _random_postings(spark, members=300, teams=40, seed=5):
    rng = random.Random(seed)
    rows = [(t, m, rng.choice([None, 0, 1, 7, 200]), rng.choice([None, 0, 3]), rng.choice([None, 2001, 2002])) for m in range(members) for t in rng.sample(range(1, teams), rng.randrange(0, 9))]
    rows += [(0, m, 2, 1, 2000) for m in range(members)] + [(900, m, 2, 1, 2000) for m in range(0, members, 2)]
    return rows, spark.createDataFrame(rows, "team_id long, member_id long, apps long, goals long, last_year int")


@pytest.mark.parametrize("most", [2_000_000, 50])
def test_pairs_are_written_out_where_they_are_grouped(spark, monkeypatch, most):
    """Sizes of all pairs without a shuffle of a row a pair, also when large teams have several tasks."""
    monkeypatch.setattr(pairs, "PART_ROWS", most)
    rows, posting = _random_postings(spark)
    got = pairs.pair_sizes(posting)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate posexplode(_team_ids") < plan.index("Exchange")  # from the last step down
    by, want = {}, {}
    for t, m, a, g, _ in rows:
        by.setdefault(m, []).append((t, a, g))
    for own in by.values():
        for x, y in itertools.combinations(sorted(own), 2):
            n, a, g = want.get((x[0], y[0]), (0, None, None))
            add = lambda old, v: old if v is None else (old or 0) + v
            want[x[0], y[0]] = (n + 1, add(a, x[1]), add(g, y[2]))
    assert {(r.team_a, r.team_b): (r.n, r.apps_a, r.goals_b) for r in got.collect()} == want
    teams = spark.createDataFrame([(t, t % 3) for t in range(30)], "team_id long, cc long")
    assert {(r.team_a, r.team_b): r.n for r in pairs.pair_counts(posting, teams).collect()} == {k: v[0] for k, v in want.items() if max(k) < 30 and k[0] % 3 == k[1] % 3}


@pytest.mark.parametrize("most", [100_000, 60])
def test_answers_are_ranked_in_their_task(spark, monkeypatch, most):
    """Facts, ranks and nationalities of pairs agree with a plain join, with pairs above and below the size that is dealt out."""
    monkeypatch.setattr(pairs, "SALTED_ROWS", most)
    monkeypatch.setattr(pairs, "PART_ROWS", 400)
    _, posting = _random_postings(spark)
    member = spark.range(300).select(F.col("id").alias("member_id"), F.when(F.col("id") % 5 != 0, (1930 + F.col("id") % 75).cast("int")).alias("birth"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("N"), (F.col("id") % 7).cast("string"))).alias("nat"), F.when(F.col("id") % 3 != 0, F.lit("x")).alias("img"), (F.col("id") % 6 == 0).alias("gk"))
    statures = spark.createDataFrame([(t, [0.66, 0.82, 1.0, 1.15][t % 4]) for t in [*range(40), 900]], "team_id long, stature double")
    marquee = statures.where("team_id % 7 = 0").select("team_id")
    answer = pairs.answers(posting, member, statures, marquee, 2002)
    assert ("_salts" in answer.columns) == (most == 60)
    rows = [r.asDict() for r in answer.collect()]
    p = posting.where("apps IS NULL OR apps <> 0").select("team_id", "member_id")
    both = p.withColumnRenamed("team_id", "a").join(p.withColumnRenamed("team_id", "b"), "member_id").where("a < b")
    assert sorted((r["team_a"], r["team_b"], r["member_id"]) for r in rows) == sorted((r.a, r.b, r.member_id) for r in both.collect())
    of = {}
    for r in rows:
        of.setdefault((r["team_a"], r["team_b"]), []).append(r)
    first = lambda own: sorted(own, key=lambda r: (-r["fame"], r["member_id"]))
    want = sorted((*k, r["member_id"], i + 1, len(own) - 1) for k, own in of.items() for i, r in enumerate(first(own)[:3]))
    assert sorted((r.team_a, r.team_b, r.member_id, r["rank"], r.others) for r in pairs.ranked(answer, 3).collect()) == want
    facts = pairs.pair_facts(answer, statures.select("team_id", F.lit("X").alias("league_cc")), [])
    assert {(r.team_a, r.team_b): (r.n, r.representative, r.birth_known) for r in facts.collect()} == {k: (len(own), first(own)[0]["member_id"], min((r["member_id"], r["birth"] is not None) for r in own)[1]) for k, own in of.items()}
    assert sum(r.n for r in pairs.pair_nationalities(answer).collect()) == len(rows)
    asked = statures.where("team_id < 6").select("team_id")
    some = pairs.answers(posting, member, statures, marquee, 2002, asked).drop("_part", "_salts")
    key = lambda r: (r["team_a"], r["team_b"], r["member_id"], r["fame"], r["nat"], r["n_marquee"])
    assert sorted(map(str, map(key, some.collect()))) == sorted(str(key(r)) for r in rows if r["team_b"] < 6)
    if most == 100_000:
        plan = pairs.ranked(answer, 3)._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Generate posexplode(_team_ids") < plan.index("Exchange")


def test_live_runs_are_held_without_python(spark, tmp_path):
    """Runs of a day are held by an aggregation: no row or run goes to a Python worker; equal numbers count once."""
    ts = lambda d, h: datetime.datetime(2024, 1, d, h, tzinfo=datetime.timezone.utc)
    row = lambda run, d, h, seq, kind: (run, 1, datetime.date(2024, 1, d), ts(d, h), seq, kind, 3)
    rows = [row("a", 1, 3, 1, "right"), row("a", 1, 3, 1, "right"), row("a", 1, 4, 2, "wrong"), row("b", 2, 1, 3, "hint"), row("end", 5, 1, 4, "hint")]
    spark.createDataFrame(rows, live.EVENT).write.parquet(str(tmp_path / "in"))
    stream = live.closed_runs(spark.readStream.schema(live.EVENT).parquet(str(tmp_path / "in")))
    assert "Python" not in stream._jdf.queryExecution().analyzed().toString()
    live.settle(spark.readStream.schema(live.EVENT).parquet(str(tmp_path / "in")), str(tmp_path / "runs"), str(tmp_path / "progress")).awaitTermination()
    assert sorted((r.run_id, r.stage, r.wrong, r.done) for r in live.runs(spark, str(tmp_path / "runs")).collect()) == [("a", 1, 1, False), ("b", 0, 0, False)]


def test_triples_of_single_rows_are_not_held_to_find_equal_ones(spark):
    """Rows of one id are put together first; only ids with several different rows need their triples compared."""
    rows = spark.createDataFrame([(1, "abcd"), (1, "bcde"), (1, "abcd"), (2, "abcabc"), (3, "ab")], "id long, t string")
    found = triples.postings(rows, "id", ["t"])
    assert sorted(map(tuple, found.collect())) == [("abc", 1), ("abc", 2), ("bca", 2), ("bcd", 1), ("cab", 2), ("cde", 1)]
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_figures_of_a_build_are_worked_out_once(spark, monkeypatch):
    """Builds that are held against the baseline again have their figures as a stored row."""
    seen = []
    monkeypatch.setattr(gate, "against_stored", lambda m, folder: seen.append(m) or spark.createDataFrame([], "check string, detail string"))
    catalogue.QUERIES["regressions_of_builds"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 4 and all("Join" not in m._jdf.queryExecution().optimizedPlan().toString() for m in seen)


def test_fields_of_pages_are_looked_for_once(spark):
    """The text is cut at bars and the pattern of a field met once a part; what is found agrees with the pattern over the
    whole text."""
    rng = random.Random(7)
    parts = ["|", "|", " ", "\n", " ", "years1", "clubs2", "caps3", "goals1", "goals", "caps99999999999", "=", "=", "[[A|x]]", "2001–2003", "7"]
    texts = ["".join(rng.choice(parts) for _ in range(60)) for _ in range(400)] + ["", None, "years1 = 3"]
    pages = spark.createDataFrame(list(enumerate(texts)), "page long, content string")
    found = overlay.career_fields(pages)
    want = {}
    for page, text in enumerate(texts):
        for kind, number, value in re.findall(r"\|\s*(years|clubs|caps|goals)(\d+)\s*=\s*([^|\n]*)", text or ""):
            want.setdefault((page, int(number) if len(number) < 11 else None), {})[kind] = value
    assert {(r.page, r.idx): {k: r[k] for k in ("years", "clubs", "caps", "goals") if r[k] is not None} for r in found.collect()} == want and len(want) > 50
    assert found._jdf.queryExecution().optimizedPlan().toString().count("years|clubs|caps|goals") == 1


def test_what_is_known_of_a_team_is_not_sent_with_every_pair(spark):
    """A pair and member sends the second team's id and tallies; its stature is looked up where pairs are written out."""
    _, posting = _random_postings(spark, 50, 20)
    member = spark.range(50).select(F.col("id").alias("member_id"), F.lit(1980).alias("birth"), F.lit("N").alias("nat"), F.lit("x").alias("img"), F.lit(False).alias("gk"))
    statures = posting.select("team_id").distinct().withColumn("stature", F.lit(1.0))
    answer = pairs.answers(posting, member, statures, statures.select("team_id").where("team_id % 7 = 0"), 2002)
    plan = answer._jdf.queryExecution().optimizedPlan().toString()
    assert "_goalss" in plan and "_statures" not in plan and "_mqs" not in plan


def test_line_items_are_dealt_out_by_order_once(spark, monkeypatch):
    """Statements are put together where they were joined with their orders, in tasks of TASK_ROWS line items, and postings
    by member: nothing is dealt out by statement, and no part of the scan is held to find equal statements."""
    sf = "/root/testdata/sf0.001"
    few = {f.__name__: sorted(map(str, f(spark, sf).collect())) for f in (adapter.spells, adapter.posting)}
    monkeypatch.setattr(adapter, "TASK_ROWS", 100)
    for f in (adapter.spells, adapter.posting):
        got = f(spark, sf)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(st" not in plan and "hashpartitioning(l_orderkey" in plan and ", 60)" in plan
        assert plan.index("partial_min(start_year") < plan.index("hashpartitioning(l_orderkey")  # from the last step down
        assert sorted(map(str, got.collect())) == few[f.__name__]


def test_a_career_is_sent_once_a_cell_of_teams(spark):
    """Careers whose teams have near ids send one row to the task of these teams, not one for each team; outliers among the
    ids change nothing."""
    rows = [(10 * (m % 3) + k + (10**12 if m == 5 and k == 9 else 0), m) for m in range(60) for k in range(10)]
    posting = spark.createDataFrame(rows, "team_id long, member_id long")
    got = pairs.pair_counts(posting)
    want = {}
    for m in range(60):
        for p in itertools.combinations(sorted(t for t, x in rows if x == m), 2):
            want[p] = want.get(p, 0) + 1
    assert {(r.team_a, r.team_b): r.n for r in got.collect()} == want
    pair = pairs.dealt_pairs(posting, [])
    plan = pair._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(_team_id_as" in plan and "_from" in plan


def test_identikits_shuffle_postings_once(spark):
    """Pairs of a career are written out where its postings were put together: no join of postings with postings."""
    plan = puzzles.QUERIES["identikits"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 2 and plan.count("Exchange hashpartitioning(member_id") == 1


def test_candidates_are_made_with_the_facts_of_pairs(spark):
    """Neither facts nor candidates of all pairs are stored to give the candidates; a career is not dealt out with what is
    known of its teams."""
    plan = puzzles.QUERIES["puzzle_candidates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(_team_ids" in plan and "_stature_as" not in plan and "_mq_as" not in plan


def test_postings_are_put_together_to_careers_where_they_are_made(spark, monkeypatch):
    """Careers are stored once, without dealing postings out again; team sizes and answers are taken from them."""
    kept = []
    monkeypatch.setattr(puzzles, "stored", lambda df: kept.append(df) or stages.stored(df))
    monkeypatch.setattr(pairs, "stored", lambda df: kept.append(df) or stages.stored(df))
    puzzles.QUERIES["pair_ease"](spark, "/root/testdata/sf0.001")
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in kept if "_s" in df.columns]
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning(member_id") + plans[0].count("Exchange hashpartitioning(o_custkey") == 1
    assert not any("first_year" in df.columns for df in kept)


def test_draws_sort_no_candidates(spark):
    """The draw of each day and stage is that of drawn(), without a sort of all candidates of all days."""
    rng = random.Random(3)
    rows = [(s, t, a, b, f"C{a % 4}") for s in range(4) for t in (1, 2) for a, b in itertools.combinations(range(30), 2) if rng.random() < 0.2 and not (s == 2 and t == 1)]
    cands = stages.stored(spark.createDataFrame(rows, "stage int, tier int, team_a long, team_b long, _cc string"))
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-01-09')) AS date, 0 AS z").drop("z")
    steps = days.crossJoin(spark.range(4).selectExpr("CAST(id AS INT) AS stage"))
    got = schedule.draws(cands, steps)
    want = schedule.drawn(cands.crossJoin(days), ["date", "stage"], ["date", "stage"])
    assert sorted(map(tuple, got.collect())) == sorted((r.date, r.stage, r.tier, r.team_a, r.team_b) for r in want.collect())
    assert got.count() == 36 and {r.tier for r in got.where("stage = 2").collect()} == {2}
    least = cands.groupBy("stage", "tier", "_cc").count()
    assert least.count() > 0 and "hashpartitioning(date" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "partial_min(_head" in plan


def test_lowest_tiers_are_counted_in_one_pass(spark):
    """Candidates are read once, without a join, and agree with first_tier."""
    cands = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (1, 3), (2, 0), (2, 0), (2, 5)], "stage int, tier int")
    got = schedule.tier_sizes(cands, ["stage"])
    assert sorted(map(tuple, got.collect())) == [(0, 1, 2), (1, 3, 1), (2, 0, 2)]
    assert {r.stage: r["count"] for r in schedule.first_tier(cands, ["stage"]).groupBy("stage").count().collect()} == {r.stage: r.n for r in got.collect()}
    plan = puzzles.QUERIES["puzzle_first_tier"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(_team_ids" in plan and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_line_items_of_other_teams_are_left_out_first(spark):
    """The postings of a table's teams are those of all teams, and only their line items are dealt out."""
    sf = "/root/testdata/sf0.001"
    teams = spark.createDataFrame([(2,), (5,), (9,)], "team_id long")
    got = adapter.posting(spark, sf, teams)
    assert sorted(map(str, got.collect())) == sorted(map(str, adapter.posting(spark, sf).where("team_id IN (2, 5, 9)").select(got.columns).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(l_orderkey") < plan.index("LeftSemi")  # from the last step down
    random_pair = catalogue.QUERIES["random_pair"]
    seen, whole = [], adapter.posting
    try:
        adapter.posting = lambda s, d, teams=None: seen.append(teams) or whole(s, d, teams)
        random_pair(spark, sf)
    finally:
        adapter.posting = whole
    assert len(seen) == 1 and seen[0] is not None


def _many_cands(spark, seed=4):
    rng = random.Random(seed)
    rows = [(s, t, a, b, f"C{a % 3}") for s in range(4) for t in (1, 2) for a, b in itertools.combinations(range(40), 2) if rng.random() < 0.3 and not (s == 3 and a > 1)]
    return rows, stages.stored(spark.createDataFrame(rows, "stage int, tier int, team_a long, team_b long, _cc string"))


@pytest.mark.parametrize("below", [None, "0", "1"])
def test_only_hashes_below_a_bound_are_put_in_order(spark, monkeypatch, below):
    """The first candidates of days and stages are those of a whole sort, also where a bound leaves too few; what is sorted
    is a stored table of a few times as many, not every candidate of every day."""
    if below:
        monkeypatch.setattr(schedule, "_below", lambda need, n: F.lit(below))
    else:
        monkeypatch.setattr(schedule, "SPARE", 5)
    rows, cands = _many_cands(spark)
    days = [datetime.date(2024, 1, k) for k in range(1, 7)]
    steps = spark.createDataFrame([(d, s) for d in days for s in range(4)], "date date, stage int")
    md5 = lambda *p: digest("|".join(map(str, p)).encode()).hexdigest()
    for most in (1, 5, 500):
        got = schedule.heaps(cands, steps, most)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "md5" not in plan and "Join" not in plan.split("Window")[0]
        want = set()
        for d, s in itertools.product(days, range(4)):
            own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], md5(d, s, r[4]), r[4], md5(d, s, r[2], r[3]), r[2], r[3]))
            want |= {(d, s, k, r[1], r[2], r[3]) for k, r in enumerate(own[:most], 1)}
        assert set(map(tuple, got.collect())) == want
        if most == 1:
            assert sorted(map(tuple, schedule.draws(cands, steps).collect())) == sorted((d, s, *r) for d, s, _, *r in want)


def test_schedules_store_no_facts_of_pairs(spark, monkeypatch):
    """A schedule stores candidates alone; fallbacks are made only when a day asks for them, and give what they gave."""
    kept = []
    for m in (puzzles, stages):
        monkeypatch.setattr(m, "stored", lambda df, put=stages.stored: kept.append(df.columns) or put(df))
    catalogue.QUERIES["puzzle_schedule"](spark, "/root/testdata/sf0.001")
    assert ["stage", "tier", "team_a", "team_b"] in kept and not any({"ease", "n"} & set(c) and "team_b" in c for c in kept)
    rows, cands = _many_cands(spark)
    cc = spark.createDataFrame([(t, f"C{t % 3}") for t in range(40)], "team_id long, league_cc string")
    made, spare = [], spark.createDataFrame([(-1, 5, 6), (-1, 7, 8)], "tier int, team_a long, team_b long")
    schedule.schedule_block(cands.where("stage < 3").drop("_cc"), "2024-01-01", 1, cc, lambda: made.append(1) or spare)
    assert made == [1]
    few = schedule.schedule_block(cands.drop("_cc"), "2024-01-01", 1, cc, lambda: made.append(2) or spare, heap=2)
    assert made == [1] and few.count() == 4


@pytest.mark.parametrize("far", [1, 10**12])
def test_answers_are_ordered_by_one_number(spark, far):
    """Rows of a task by pair, fame and member, also where fames differ by less than the number tells, or not at all, and where
    ids are too far apart for one number; no window and no sort of whole rows is left in the facts of pairs."""
    rng = np.random.default_rng(8)
    n = 5000
    a, b, member = rng.integers(0, 7, n) * far, rng.integers(7, 20, n) * far, rng.permutation(n)
    fame = rng.integers(0, 40, n) / 10**9 + rng.integers(0, 3, n) * 500.0
    rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, fame, member)], names=["team_a", "team_b", "fame", "member_id"])
    table, order, starts = pairs._ordering()(iter([rows.slice(0, 2000), rows.slice(2000)]))
    assert table.num_rows == n and order.tolist() == sorted(range(n), key=lambda i: (a[i], b[i], -fame[i], member[i]))
    assert starts.tolist() == [i for i in range(n) if i == 0 or (a[order[i]], b[order[i]]) != (a[order[i - 1]], b[order[i - 1]])]
    assert pairs._ordering()(iter([rows.slice(0, 0)])) is None
    if far == 1:
        plan = puzzles.QUERIES["pair_ease"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and plan.index("posexplode(_team_ids") > plan.index("MapInArrow")
        assert "Window" not in plan.split("posexplode(_team_ids")[0] and "Sort" not in plan.split("posexplode(_team_ids")[0]


def test_facts_of_drawn_pairs_are_those_of_all_pairs(spark, monkeypatch):
    """A calibration works out the facts of its few pairs again; they are the same, and no table of all facts is stored."""
    sf, kept = "/root/testdata/sf0.001", []
    monkeypatch.setattr(puzzles, "stored", lambda df, put=stages.stored: kept.append(df.columns) or put(df))
    careers, sizes = puzzles._careers_and_sizes(spark, sf)
    drawn = spark.createDataFrame([(3, 1), (2, 7)], "team_a long, team_b long")
    some = puzzles._facts_of_drawn(spark, sf, drawn, careers, sizes)
    every = puzzles._facts_of(spark, sf, careers, sizes).withColumn("ease", pairs.digits(F.col("ease"), 2))
    of = lambda facts: sorted(map(tuple, facts.where("(team_a = 1 AND team_b = 3) OR (team_a = 2 AND team_b = 7)").collect()))
    assert of(some) == of(every) and len(of(some)) == 2
    assert some.count() == 6 and not any("ease" in c for c in kept)


def test_pair_keys_are_written_in_order(spark):
    """Keys of a task are in order of the pair, by one sorted number, without another shuffle."""
    got = catalogue.QUERIES["pair_keys"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Sort [") < plan.index("Exchange")
    rows = [(r.p, *map(int, r.pair.split("-"))) for r in got.select("pair", F.spark_partition_id().alias("p")).collect()]
    assert rows == sorted(rows) and len(rows) == len(set(rows)) == 45
