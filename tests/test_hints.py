"""Hints and boards from hand-written rows, and blocks with faults."""

from pyspark.sql import functions as F

from rosterly.operators import blocks, gate, hints


def test_hints_of_a_run(spark):
    events = spark.createDataFrame([("r", 1, "hint", 2, "first"), ("r", 2, "hint", 2, "second"), ("r", 3, "hint", 3, "second"), ("s", 1, "hint", 0, "second"), ("s", 2, "hint", 1, "first"), ("s", 3, "hint", 1, "nationalities"), ("s", 4, "wrong", 1, None), ("s", 5, "hint", 1, "retired")], "run_id string, seq long, kind string, stage int, hint string")
    slots = hints.spent(events)
    assert {(r.run_id, r.hint): (r.stage, r.reveals) for r in slots.collect()} == {("r", "first"): (2, 1), ("r", "second"): (2, 2), ("s", "second"): (0, 1), ("s", "first"): (1, 1), ("s", "nationalities"): (1, None)}
    question = spark.createDataFrame([("r", 2, 1, 2), ("s", 0, 1, 2), ("s", 1, 3, 4)], "run_id string, stage int, team_a long, team_b long")
    answer = spark.createDataFrame([(1, 2, 7, "FR"), (3, 4, 8, "IT"), (3, 4, 9, None), (3, 4, 10, "IT"), (5, 6, 1, "DE")], "team_a long, team_b long, member_id long, nat string")
    kits = spark.createDataFrame([(1, 2, 1, 7, 0, "A. B.", "Rovers · Town"), (3, 4, 1, 8, 2, "C.", None)], "team_a long, team_b long, rank long, member_id long, others long, kit string, story string")
    got = {(r.run_id, r.hint): r.text for r in hints.texts(slots, question, kits, answer).collect()}
    assert got == {("r", "first"): "A. B.", ("r", "second"): "Rovers · Town", ("s", "second"): "A. B.", ("s", "first"): "C.", ("s", "nationalities"): "2 IT · 1 ?"}
    assert {r.text for r in hints.texts(slots, question.limit(0), kits, answer).collect()} == {"…"}


def test_what_is_told_of_an_answer(spark):
    spells = spark.createDataFrame([
        (7, 1, 1, "One", 2000, 2002, 5, False), (7, 2, 9, "Nine", 2002, 2003, 50, True), (7, 3, 8, "Eight", 2003, 2003, 4, False), (7, 4, 8, "Eight", 2004, 2004, 90, False), (7, 5, 6, "Six", 2005, None, 9, False), (7, 6, 5, "Five", 1999, 2000, None, False),
        (8, 1, 2, "Two", 2001, 2001, 1, False), (8, 2, 1, "One", 2002, 2004, 1, False), (8, 3, 2, "Two", 2005, 2006, 1, False), (8, 4, 2, "Two", 2007, None, 1, False)],
        "member_id long, seq long, team_id long, team_name string, start_year int, end_year int, apps int, loan boolean")
    top = spark.createDataFrame([(1, 2, 7, 1, 2), (1, 2, 8, 2, 2), (1, 2, 9, 3, 2)], "team_a long, team_b long, member_id long, rank long, others long")
    posting = spark.createDataFrame([(1, 7, 5, None), (2, 7, None, -1), (1, 8, 1, 2), (2, 8, 2, 3), (1, 9, 0, 0), (2, 9, None, None)], "team_id long, member_id long, apps long, goals long")
    member = spark.createDataFrame([(7, "Ann Lee", 1981, "FR", False), (8, "Bo", None, None, False), (9, "Cy", 1979, None, True)], "member_id long, name string, birth int, nat string, gk boolean")
    got = {r.member_id: (r.kit, r.story) for r in hints.described(top, posting, member, hints.notes(spells, top)).collect()}
    assert got[7] == ("A. L. 1980s · FR · 5 apps · still active", "Six · Eight")
    assert got[8] == ("B. · 3 apps · 5 goals · still there", "Two 2001, 2005–2006 · One 2002–2004")
    assert got[9] == ("C. 1970s", "born 1979")


def test_what_a_board_shows(spark):
    states = spark.createDataFrame([("r", k, s) for k, s in enumerate(["done", "hinted", "skipped", "failed", "revealed", "current", "to do"])], "run_id string, stage_at int, state string")
    guesses = spark.createDataFrame([("r", 0, 5), ("r", 2, 6), ("r", 5, 6)], "run_id string, stage int, member_id long")
    question = spark.createDataFrame([("r", k, 1, 2) for k in range(7) if k != 3], "run_id string, stage int, team_a long, team_b long")
    faces = spark.createDataFrame([(1, 2, 77, 3)], "team_a long, team_b long, member_id long, others long")
    got = {r.stage_at: (r.member_id, r.others) for r in hints.board(states, guesses, question, faces).collect()}
    assert got == {0: (5, 3), 1: (None, 3), 2: (77, 3), 3: (None, None), 4: (77, 3), 5: (None, None), 6: (None, None)}


def test_blocks_with_faults(spark):
    posting = spark.createDataFrame([(t, m, 1, None) for t in (0, 1) for m in (3, 9, 70, 130)], "team_id long, member_id long, apps long, goals long")
    good = blocks.blocked(posting, 64)
    assert gate.block_violations(good, 131, 64).collect() == [] and gate.block_violations(good, 130, 64).count() == 2
    first = good.where("team_id = 1 AND bucket = 0")
    faults = {"arrays differ in length": first.withColumn("apps", F.array().cast("array<bigint>")), "steps": first.withColumn("steps", F.reverse("steps")), "id out of range": first.withColumns({"bucket": F.lit(7).cast("bigint")}), "block repeats": first.unionByName(first)}
    for check, wrong in faults.items():
        assert check in {r.check for r in gate.block_violations(wrong, 131, 64).collect()}
