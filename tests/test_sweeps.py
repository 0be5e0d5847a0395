"""Sweeps over careers, ranks in large groups and bounded top answers against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from rosterly.operators import career, pairs, postings, solve

SPELL = "member_id long, seq long, team_name string, start_year int, end_year int, apps int, goals int, loan boolean"


def careers(seed, listed):
    """Careers of many members, by start or, not listed, in any order."""
    rng, rows = random.Random(seed), []
    for m in range(60):
        spells = []
        for _ in range(rng.randint(1, 9)):
            a = rng.choice([None, *range(1990, 2004)])
            spells.append((a, rng.choice([None, (a or 1995) + rng.randint(-1, 6)]), rng.random() < 0.2))
        if listed or m % 2:
            spells.sort(key=lambda s: (s[0] is None, s[0] or 0, s[1] is None, s[1] or 0))
        rows += [(m, k, rng.choice("ABC"), a, b, 1, 1, loan) for k, (a, b, loan) in enumerate(spells)]
    return rows


def by_member(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("seed, listed", [(1, True), (2, False)])
def test_loans_and_ends_by_sweep_equal_brute_force(spark, seed, listed):
    rows = careers(seed, listed)
    frame = spark.createDataFrame(rows, SPELL).repartition(5)
    want_loan, want_end = {}, {}
    for m, own in by_member(rows).items():
        for _, k, _, a, b, _, _, loan in own:
            inside = a is not None and b is not None and any(x[3] is not None and x[4] is not None and x[3] <= a and b <= x[4] and x[4] - x[3] > b - a for x in own if x[1] < k)
            want_loan[m, k] = loan or inside
            later = [x[3] for x in own if x[1] > k and not x[7] and x[3] is not None and a is not None and x[3] >= a]
            want_end[m, k] = None if a is None else b if b is not None else (later + [2010])[0]
    assert {(r.member_id, r.seq): r.is_loan for r in career.inferred_loans(frame).collect()} == want_loan
    eff = solve.effective_end(frame, 2010)
    assert {(r.member_id, r.seq): r.eff for r in eff.collect()} == want_end
    chosen = [3, 4]
    years = {}
    for m in chosen:
        for r in by_member(rows)[m]:
            if r[3] is not None and want_end[m, r[1]] is not None:
                years.setdefault(r[2], {}).setdefault(m, set()).update(range(r[3], want_end[m, r[1]] + 1))
    together = {(t, y) for t, by in years.items() if len(by) == 2 for y in by[3] & by[4]}
    got = solve.teammate_years(eff.where(F.col("member_id").isin(chosen)), 2, 2010).collect()
    assert {(r.team_name, y) for r in got for y in range(r.from_year, r.to_year + 1)} == together
    assert all((r.team_name, r.from_year - 1) not in together and (r.team_name, r.to_year + 1) not in together for r in got)
    assert all(r.still == (r.to_year >= 2010) for r in got)


def test_a_career_of_a_hundred_thousand_spells(spark):
    frame = spark.range(100_000).select(F.lit(1).cast("long").alias("member_id"), F.col("id").alias("seq"), F.lit("A").alias("team_name"), (1000 + F.col("id") / 50).cast("int").alias("start_year"), F.when(F.col("id") % 3 != 0, (1000 + F.col("id") / 50 + F.col("id") % 3 - 1).cast("int")).alias("end_year"), F.lit(1).alias("apps"), F.lit(1).alias("goals"), F.lit(False).alias("loan"))
    assert career.inferred_loans(frame).where("is_loan").count() > 30_000
    assert solve.effective_end(frame, 4000).where("eff IS NULL").count() == 0
    assert [(r.from_year, r.to_year) for r in solve.teammate_years(solve.effective_end(frame, 4000), 1, 4000).collect()] == [(1000, 4000)]


def test_ranks_in_one_country_and_in_many(spark):
    rng = random.Random(3)
    for countries in (["X"], ["X", "Y", None]):
        rows = [(t, rng.randrange(100, 160), rng.choice(countries)) for t in range(400)]
        got = {r.team_id: (r.place, r._of) for r in postings.numbered(spark.createDataFrame(rows, "team_id long, n long, cc string").repartition(7), ["cc"], ["n", "team_id"], "place").collect()}
        for cc in countries:
            own = sorted((n, t) for t, n, c in rows if c == cc)
            assert [got[t] for _, t in own] == [(k, len(own)) for k in range(len(own))]
        sizes = spark.createDataFrame(rows, "team_id long, n long, cc string")
        statures = {r.team_id: r.stature for r in pairs.stature(sizes, spark.createDataFrame([(5,)], "team_id long")).collect()}
        for cc in countries:
            big = sorted((n, t) for t, n, c in rows if c == cc and n >= 120)
            for k, (_, t) in enumerate(big):
                pct = k / (len(big) - 1)
                assert statures[t] == (1.15 if t == 5 else 1.0 if pct >= 0.6 else 0.82 if pct >= 0.3 else 0.66)
        assert all(statures[t] == 0.66 for t, n, _ in rows if n < 120)


@pytest.mark.parametrize("salts", [None, 1, 4])
def test_top_answers_in_two_steps(spark, salts):
    rng = random.Random(6)
    rows = [(a, b, m, rng.choice([None, 1980]), rng.randrange(3), float(rng.randrange(6))) for a, b, n in ((1, 2, 1), (1, 3, 4), (2, 3, 90), (5, 6, 300)) for m in rng.sample(range(1000), n)]
    answer = spark.createDataFrame(rows, "team_a long, team_b long, member_id long, birth int, n_marquee int, fame double").repartition(6)
    if salts:
        answer = answer.withColumn("_salts", F.lit(salts))
    for k in (1, 4, 10):
        got = pairs.ranked(answer, k).collect()
        for pair in ((1, 2), (1, 3), (2, 3), (5, 6)):
            own = sorted((-f, m) for a, b, m, _, _, f in rows if (a, b) == pair)
            assert sorted((r.rank, r.member_id, r.others) for r in got if (r.team_a, r.team_b) == pair) == [(i + 1, m, len(own) - 1) for i, (_, m) in enumerate(own[:k])]
    parts = pairs.topped(answer, 4).groupBy("team_a", "team_b").agg(F.sum("n_part").alias("n"), F.max("most").alias("most"), F.min("least").alias("least")).collect()
    for r in parts:
        own = [x for x in rows if x[:2] == (r.team_a, r.team_b)]
        assert (r.n, r.most, tuple(r.least)) == (len(own), max(x[4] for x in own), min(x[2:4] for x in own))


def test_a_pair_with_a_million_answers(spark):
    answer = spark.range(1_000_000).select(F.lit(1).cast("long").alias("team_a"), F.lit(2).cast("long").alias("team_b"), F.col("id").alias("member_id"), F.lit(1980).alias("birth"), F.lit(1).alias("n_marquee"), (F.col("id") % 1009).cast("double").alias("fame"), F.lit(10).alias("_salts"))
    team = spark.createDataFrame([(1, "X"), (2, "Y")], "team_id long, league_cc string")
    facts = pairs.pair_facts(answer, team, [])
    assert "collect_list" not in facts._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.n, r.birth_known) for r in facts.collect()] == [(1_000_000, True)]
