"""Stored baselines, streaks day by day, share lines and addresses of images."""

import random
from datetime import date, timedelta
from urllib.parse import quote

from pyspark.sql import functions as F

from rosterly.functions.names import image_key, thumbnail
from rosterly.operators import entity, gate, playlog
from rosterly.sources import stages


def metrics(spark, teams, members, coverage):
    return spark.createDataFrame([(teams, members, coverage)], "teams long, members long, apps_coverage double")


def test_a_regressed_build_leaves_the_baseline(spark):
    folder = stages.new_path(spark, "builds")
    checks = lambda *m: sorted(r.check for r in gate.against_stored(metrics(spark, *m), folder).collect())
    assert checks(100, 1000, 0.9) == []
    assert checks(90, 990, 0.85) == ["apps coverage fell", "fewer teams"]
    assert checks(96, 1000, 0.9) == ["fewer teams"]  # against 100, not 90
    assert checks(98, 1000, 0.89) == [] and checks(96, 1000, 0.88) == []  # 98 is the baseline now, each step being small
    assert stages.load(spark, folder, "metrics").collect()[0].teams == 96


def test_streaks_of_days_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(u, date(2024, 1, 1) + timedelta(days=k), rng.choice([True, True, True, False, None])) for u in range(30) for k in range(60) if rng.random() < 0.8 for _ in range(rng.randint(1, 2))]
    won, want = {}, {}
    for u, day, w in rows:
        won[u, day] = won.get((u, day), False) or bool(w)
    for u, day in sorted(won):
        want[u, day] = want.get((u, day - timedelta(days=1)), 0) + 1 if won[u, day] else 0
    df = spark.createDataFrame(rows, "user_id long, date date, won boolean")
    got = {(r.user_id, r.date): r.streak for r in playlog.streak_days(df).collect()}
    assert got == want and len(got) == playlog.streak_days(df).count()
    last = {u: want[u, max(d for v, d in want if v == u)] for u in {u for u, _ in want}}
    assert {r.user_id: r.current for r in playlog.streaks(df).collect()} == last
    assert playlog.streak_days(df.limit(0)).count() == 0


def test_lines_of_won_runs_carry_the_streak(spark):
    runs = spark.createDataFrame([(1, True, 3), (2, True, 1), (3, True, 0), (4, False, 3)], "n int, won boolean, streak long")
    line = playlog.share_text(F.col("n"), F.array(F.lit(0), F.lit(2)), F.col("won"), F.lit(0), F.lit(0), F.col("streak"))
    assert [r.line for r in runs.select("n", line.alias("line")).orderBy("n").collect()] == ["#1 🟩🟥 · won · streak 3", "#2 🟩🟥 · won · streak 1", "#3 🟩🟥 · won", "#4 🟩🟥 · lost"]


def test_addresses_of_images_are_coded_as_in_browsers(spark):
    names = ["John Smith (cropped).jpg", "a'b!c~d*e.SVG", "Ünï&co+1.tif", "x.TIFF", "y z.pdf", "50%.png"]
    df = spark.createDataFrame([(n, quote(n)) for n in names], "name string, tail string")
    for r in df.select("name", image_key("tail").alias("key"), thumbnail(image_key("tail"), "b").alias("link")).collect():
        f = r.name.replace(" ", "_")
        low, sized = f.lower(), f"120px-{f}"
        sized = sized + ".png" if low.endswith(".svg") else f"page1-{sized}.jpg" if low.endswith(".pdf") else f"lossy-page1-{sized}.jpg" if low.endswith((".tif", ".tiff")) else sized
        coded = lambda t: quote(t, safe="!'()*~")
        assert r.key[2:] == f and r.link == f"b/{r.key[0]}/{r.key[:2]}/{coded(f)}/{coded(sized)}"


def test_names_shown_take_canonical_then_outside_then_own(spark):
    team = spark.createDataFrame([(1, "One"), (2, "Two"), (3, None), (4, "Four"), (5, None)], "team_id long, name string")
    outside = spark.createDataFrame([(2, "Two abroad"), (4, "Four abroad"), (9, "Nine"), (9, "Nina"), (7, "Seven")], "team_id long, name string")
    merges = spark.createDataFrame([(4, 1), (7, 2), (8, 1), (5, 3)], "team_id long, canonical long")
    got = {r.team_id: r.name for r in entity.display_names(team, outside, merges).collect()}
    assert got == {1: "One", 2: "Two abroad", 3: "", 4: "One", 5: "", 7: "Two", 8: "One", 9: "Nine"}
