"""Edge cases from hand-written rows."""

import datetime
import unicodedata

import pytest
from pyspark.sql import functions as F

from rosterly.functions import names
from rosterly.operators import career, clean, entity, gate, overlay, pairs, playlog, postings, schedule, solve
from rosterly.sources import export, stages, statements
from rosterly.streaming import intake

SPELL = "member_id long, seq long, team_name string, start_year int, end_year int, apps int, goals int, loan boolean"


def one(spark, expr, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(expr.alias("x")).first().x


def test_collapse_takes_extremes_and_never_goes_below_zero(spark):
    rows = [("s", 1, 2, 1990, 1995, -3, None, False), ("s", 1, 2, 1989, None, -1, None, True), ("t", 1, 2, None, None, None, None, False)]
    got = clean.collapse_statements(spark.createDataFrame(rows, "st string, member_id long, team_id long, start_year int, end_year int, apps int, goals int, loan boolean"))
    assert {tuple(r) for r in got.collect()} == {("s", 1, 2, 1989, 1995, 0, None, True), ("t", 1, 2, None, None, None, None, False)}


def test_years_and_integers_from_text(spark):
    text = ["1985-01-01T00:00:00Z", "-0044-03-15", "http://x/unknown", "1849-01-01", "2036-01-01", None]
    got = spark.createDataFrame([(t,) for t in text], "t string").select(clean.year_of(F.col("t")).alias("y"), clean.sane_year(clean.year_of(F.col("t"))).alias("s")).collect()
    assert [(r.y, r.s) for r in got] == [(1985, 1985), (None, None), (None, None), (1849, None), (2036, None), (None, None)]


def test_unknown_is_not_zero_in_postings(spark):
    rows = [(1, 1, None, None, None, None), (1, 2, None, None, 0, None), (1, 3, 2000, None, None, None)]
    got = postings.posting_table(spark.createDataFrame(rows, "team_id long, member_id long, start_year int, end_year int, apps int, goals int"))
    assert {(r.member_id, r.apps, r.first_year) for r in got.collect()} == {(2, 0, None), (3, None, 2000)}


def test_dense_ids_follow_the_order(spark):
    got = postings.dense_ids(spark.createDataFrame([(f"n{i % 7}", i) for i in range(200)], "name string, id long").repartition(9), ["name", "id"])
    assert [r.dense_id for r in got.orderBy("name", "id").collect()] == list(range(200))


def test_effective_end_and_teammates(spark):
    rows = [(1, 1, "A", 2000, None, 1, 1, False), (1, 2, "B", 2001, 2002, 1, 1, True), (1, 3, "C", 2003, None, 1, 1, False), (2, 1, "A", 2002, 2001, 1, 1, False), (2, 2, "C", 2004, None, 1, 1, False), (2, 3, "D", None, 2009, 1, 1, False)]
    eff = solve.effective_end(spark.createDataFrame(rows, SPELL), 2006)
    assert {(r.member_id, r.seq): r.eff for r in eff.collect()} == {(1, 1): 2003, (1, 2): 2002, (1, 3): 2006, (2, 1): 2001, (2, 2): 2006, (2, 3): None}
    assert [tuple(r) for r in solve.teammate_years(eff, 2, 2006).collect()] == [("C", 2004, 2006, True)]


def test_inferred_loans_need_an_earlier_longer_spell(spark):
    rows = [(1, 1, "A", 2000, 2005, None, None, False), (1, 2, "B", 2001, 2002, None, None, False), (1, 3, "C", 2000, 2005, None, None, False), (1, 4, "D", 2004, None, None, None, None)]
    got = career.inferred_loans(spark.createDataFrame(rows, SPELL))
    assert {r.seq: r.is_loan for r in got.collect()} == {1: False, 2: True, 3: False, 4: False}


def test_common_members_zero_rules(spark):
    posting = spark.createDataFrame([(1, 1, 0, 0), (2, 1, 5, 0), (1, 2, None, None), (2, 2, 3, 0), (1, 3, 4, 2)], "team_id long, member_id long, apps long, goals long")
    member = spark.createDataFrame([(i, f"m{i}", None, None, None, False) for i in (1, 2, 3)], "member_id long, name string, birth int, nat string, img string, gk boolean")
    got = {r.member_id: (r.apps, r.goals, r.has_zero, r.zero_goals) for r in solve.common_members(posting, member, [1, 2]).collect()}
    assert got == {1: (5, 0, True, True), 2: (3, 0, False, False)}
    assert solve.common_members(posting, member, []).count() == 0


def test_stature_of_one_team_and_of_small_marquee_teams(spark):
    sizes = spark.createDataFrame([(1, 150, "X"), (2, 20, "X"), (3, 200, "Y"), (4, 130, "Y")], "team_id long, n long, cc string")
    got = {r.team_id: r.stature for r in pairs.stature(sizes, spark.createDataFrame([(2,), (3,)], "team_id long")).collect()}
    assert got == {1: 1.0, 2: 0.66, 3: 1.15, 4: 0.66}


def test_marked_letters_map_to_their_plain_ones():
    assert len(names.MARKED) == len(names.PLAIN)
    for a, b in zip(names.MARKED, names.PLAIN):
        base = unicodedata.normalize("NFD", a)[0]
        assert base == b or (a, b) == ("ı", "i")


def test_names(spark):
    assert one(spark, names.search_name(F.col("n")), n="Đorđe Łódź-Straße  Æ") == "dorde lodz strasse ae"
    assert one(spark, names.core_name(F.col("n")), n="Bologna F.C. 1909") == "bologna f c"
    assert one(spark, names.sort_name(F.col("n")), n="AC Milan") == "milan"
    assert one(spark, names.sort_name(F.col("n")), n="FC") == "fc"
    assert one(spark, names.core_display(F.col("n")), n="Bologna F.C. 1909") == "Bologna"
    assert one(spark, names.core_display(F.col("n")), n="Athletic Club") == "Athletic Club"
    assert one(spark, names.image_key(F.col("n")), n="A+B%20c.svg")[2:] == "A+B_c.svg"


def test_merge_map_ties_and_exceptions(spark):
    team = spark.createDataFrame([(1, "FC Roma", "IT"), (2, "Roma 1927", "IT"), (3, "Bastia", "FR"), (4, "Bastia SC", "FR"), (5, "X", "IT"), (6, "Y", "IT")], "team_id long, name string, cc string")
    roster = spark.createDataFrame([(2, 1), (1, 1), (4, 1)], "team_id long, member_id long")
    never = spark.createDataFrame([("FR", "bastia")], "cc string, core string")
    curated = spark.createDataFrame([(5, 6), (2, 6), (6, 99)], "team_id long, canonical long")
    assert {tuple(r) for r in entity.merge_map(team, roster, never, curated).collect()} == {(2, 1), (5, 6)}


def test_infobox(spark):
    text = "| years1 = 1935–1936 | clubs1 = [[Bury]] | caps1 = {{0}}12 | goals1 = 5<ref>7</ref>\n| years2 = 1940\n| clubs2 = → [[A B#x|C]] (loan)\n| clubs3 = no link\n| caps2 = 3\n| caps2 = 4\n| youthclubs1 = [[Z]]"
    got = overlay.infobox_spells(spark.createDataFrame([("p", text)], "page string, content string")).orderBy("seq").collect()
    assert [tuple(r)[1:] for r in got] == [(1, "Bury", 1935, 1936, 12, 5, False), (2, "A B", 1940, None, 4, None, True)]


def test_guard_and_replacement(spark):
    base = spark.createDataFrame([(1, 1, "A", 2000, 2001, 5, 5, False), (2, 1, "A", 2000, 2001, 5, 5, False)], SPELL)
    over = spark.createDataFrame([(1, 1, "B", 2000, 2001, 5, None, False), (2, 1, "B", 2000, 2001, 5, 5, False), (3, 1, "B", None, None, None, None, False)], SPELL)
    ok = overlay.accepted(base, over)
    assert {tuple(r) for r in ok.collect()} == {(1, False), (2, True), (3, True)}
    got = overlay.replaced(base, over.join(ok.where("ok"), "member_id", "left_semi"))
    assert {(r.member_id, r.team_name) for r in got.collect()} == {(1, "A"), (2, "B"), (3, "B")}


def test_fold_of_a_run(spark):
    def run(*kinds):
        rows = [("r", i, k, i) if isinstance(k, str) else ("r", i, *k) for i, k in enumerate(kinds)]
        return tuple(playlog.fold(spark.createDataFrame(rows, "run_id string, seq long, kind string, member_id long")).first())[1:]

    assert run("right", "right", "right", "right", "wrong") == (3, 5, 0, 0, True, True)
    assert run("wrong", "wrong", "wrong", "wrong", "wrong", "right") == (0, 0, 5, 0, True, False)
    assert run("skip", "hint", "right", "skip", "skip", "resign") == (3, 5, 0, 2, True, False)
    assert run(("wrong", 7), ("wrong", 7), ("wrong", 8), ("right", 9), ("wrong", 7)) == (1, 2, 3, 0, False, False)  # a repeated guess is free, in its stage


def test_streak_breaks_on_a_gap_and_a_loss(spark):
    days = [(1, "2024-01-01", True), (1, "2024-01-02", True), (1, "2024-01-04", True), (1, "2024-01-05", False), (2, "2024-01-01", False), (3, "2024-01-03", True)]
    got = playlog.streaks(spark.createDataFrame(days, "user_id long, date string, won boolean").withColumn("date", F.to_date("date")))
    assert {tuple(r) for r in got.collect()} == {(1, 4, 3, 2, 0), (2, 1, 0, 0, 0), (3, 1, 1, 1, 1)}


@pytest.mark.parametrize("heap", [64, 1, 5])
def test_schedule_keeps_its_rules(spark, heap):
    """Days of a block by brute force: lowest tier left, seeded country and pair, cool-down, fallbacks; heaps run dry."""
    import hashlib

    cands = [(s, 0 if (a + b) % 3 else 1, a, b) for s in range(4) for a in range(22) for b in range(22) if a < b and (a + b + s) % 4 == 0]
    spare = [(-1, a, b) for a in range(30, 36) for b in range(36, 40)]
    country = {t: f"C{t % 3}" for t in range(40)}
    frame = spark.createDataFrame(cands, "stage int, tier int, team_a long, team_b long")
    other = spark.createDataFrame(spare, "tier int, team_a long, team_b long")
    got = [tuple(r) for r in schedule.schedule_block(frame, "2024-01-01", 5, spark.createDataFrame(list(country.items()), "team_id long, league_cc string"), other, heap).orderBy("date", "stage").collect()]
    md5, want = lambda *p: hashlib.md5("|".join(map(str, p)).encode()).hexdigest(), []
    for k in range(5):
        date = datetime.date(2024, 1, 1 + k)
        used = {t for r in want if 1 <= (date - r[0]).days <= 2 for t in r[3:]}
        banned = {frozenset(r[3:]) for r in want if 1 <= (date - r[0]).days <= 10}
        for stage in range(4):
            for pool in ([c[1:] for c in cands if c[0] == stage], spare):
                left = [c for c in pool if not {c[1], c[2]} & used and frozenset(c[1:]) not in banned]
                if left:
                    tier, a, b = min(left, key=lambda c: (c[0], md5(date, stage, country[c[1]]), md5(date, stage, c[1], c[2]), c[1], c[2]))
                    want.append((date, stage, tier, a, b))
                    used |= {a, b}
                    break
    assert got == want and any(r[2] == -1 for r in got) and any(r[2] == 0 for r in got)


def test_cooled_is_the_same_rule_on_tables(spark):
    cands = spark.createDataFrame([(1, 2), (1, 3), (4, 5), (6, 7)], "team_a long, team_b long")
    plan = spark.createDataFrame([("2024-01-01", 2, 1), ("2024-01-08", 4, 9), ("2024-01-07", 6, 8)], "date string, team_a long, team_b long").withColumn("date", F.to_date("date"))
    assert {tuple(r) for r in schedule.cooled(cands, plan, "2024-01-09").collect()} == {(1, 3)}
    assert {tuple(r) for r in schedule.cooled(cands, plan, "2024-01-12").collect()} == {(1, 3), (4, 5), (6, 7), (1, 2)}


def test_effective_end_skips_earlier_starts(spark):
    """Careers taken from pages are in page order, which need not be that of years."""
    rows = [(1, 1, 2005, None, False), (1, 2, 2001, 2002, False), (1, 3, 2009, 2010, True), (1, 4, 2008, 2010, False), (2, 1, 2005, None, False), (2, 2, 2001, 2002, False)]
    got = solve.effective_end(spark.createDataFrame(rows, "member_id long, seq long, start_year int, end_year int, loan boolean"), 2020)
    assert {(r.member_id, r.seq): r.eff for r in got.collect()} == {(1, 1): 2008, (1, 2): 2002, (1, 3): 2010, (1, 4): 2010, (2, 1): 2020, (2, 2): 2002}


def test_one_shard_is_read_for_one_career(spark, tmp_path):
    spells = spark.createDataFrame([(m, m % 3, 2000, 2001, 1, 1, False, 1) for m in range(300)], "member_id long, team_id long, start_year int, end_year int, apps int, goals int, loan boolean, seq long")
    export.write_careers(export.career_shards(spells), str(tmp_path / "c"), 2)
    plan = export.read_career(spark, str(tmp_path / "c"), 130)
    assert plan.count() == 1 and len(plan.inputFiles()) > 1
    assert "PartitionFilters: [isnotnull(shard" in plan._jdf.queryExecution().executedPlan().toString()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        stages.shared_folder(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs:///x"}
    assert stages.shared_folder(Session()) == "hdfs:///x"


def test_a_gate_raises_with_its_first_failures(spark):
    found = spark.createDataFrame([("b", str(i)) for i in range(30)] + [("a", "x")], "check string, detail string")
    assert [(r.check, r.failures) for r in gate.report(found, 2).orderBy("check").collect()] == [("a", 31), ("b", 31)]
    gate.enforce(found.where("false"))
    with pytest.raises(ValueError):
        gate.enforce(found)


def test_rosters_and_shards_round_trip(spark, tmp_path):
    spells = spark.createDataFrame([(130, 1, 7, 2001, None, 3, None, True), (130, 2, 8, None, None, None, 1, False), (2, 1, 7, 1999, 2000, 1, 1, False)], "member_id long, seq long, team_id long, start_year int, end_year int, apps int, goals int, loan boolean")
    export.write_careers(export.career_shards(spells), str(tmp_path / "c"))
    got = export.read_career(spark, str(tmp_path / "c"), 130).first()
    assert [s.team_id for s in got.spells] == [7, 8] and got.spells[1].loan is None
    assert export.read_career(spark, str(tmp_path / "c"), 258).count() == 0


def test_resume_takes_each_key_once(spark, tmp_path):
    items = spark.createDataFrame([(1,), (2,)], "k long")
    stages.resume(items, "k", lambda d: d.withColumn("v", F.lit("a")), str(tmp_path / "t"))
    got = stages.resume(spark.createDataFrame([(3,), (2,)], "k long"), "k", lambda d: d.withColumn("v", F.lit("b")), str(tmp_path / "t"))
    assert {tuple(r) for r in got.collect()} == {(1, "a"), (2, "a"), (3, "b")}


def test_intake_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / "in" / f"{name}.json").write_text(f'{{"s": "{name}", "p": "x", "o": "y"}}\n')
        q = intake.append_new_files(spark, statements.TRUTHY, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    assert sorted(r.s for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_page_text_skips_pages_without_revisions(spark):
    rows = [([("T", [("body",)]), ("U", [])],)]
    got = statements.page_text(spark.createDataFrame(rows, statements.PAGES))
    assert [tuple(r) for r in got.collect()] == [("T", "body")]
