"""Play logs of many users: runs folded from events, streaks, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIVES, STAGES = 5, 4


def first_guesses(events: DataFrame) -> DataFrame:
    """events (run_id, seq, kind, stage, member_id ...) with dup: the member was guessed in this stage before."""
    w = Window.partitionBy("run_id", "stage", "member_id").orderBy("seq")
    return events.withColumn("dup", F.row_number().over(w) > 1)


def fold(events: DataFrame) -> DataFrame:
    """The final state of each run of (run_id, seq, kind, member_id): kind is right, wrong, skip, resign or hint.

    A right guess moves on and wins at the fourth stage; a wrong one costs one of five lives, the last of which loses;
    a guess of a member that was guessed in this stage before changes nothing; a skip leaves a stage that is not the
    last unsolved; a resignation loses. After the end nothing changes. One fold over the ordered events of a run, which
    are few.
    """
    none = F.array().cast("array<bigint>")
    state = F.struct(F.lit(0).alias("stage"), F.lit(LIVES).alias("lives"), F.lit(0).alias("wrong"), F.lit(0).alias("skipped"), F.lit(False).alias("done"), F.lit(False).alias("won"), none.alias("guessed"))

    def step(s: Column, e: Column) -> Column:
        k, last = e["kind"], s["stage"] == STAGES - 1
        guess = k.isin("right", "wrong")
        again = guess & F.array_contains(s["guessed"], e["member_id"])
        right, wrong, skip, out = k == "right", k == "wrong", (k == "skip") & ~last, k == "resign"
        on = (right & ~last) | skip
        new = F.struct(
            (s["stage"] + on.cast("int")).alias("stage"), (s["lives"] - wrong.cast("int")).alias("lives"), (s["wrong"] + wrong.cast("int")).alias("wrong"),
            (s["skipped"] + skip.cast("int")).alias("skipped"), ((right & last) | (wrong & (s["lives"] == 1)) | out).alias("done"), (right & last).alias("won"),
            F.when(on, none).when(guess, F.array_append(s["guessed"], e["member_id"])).otherwise(s["guessed"]).alias("guessed"),
        )
        return F.when(s["done"] | F.coalesce(again, F.lit(False)), s).otherwise(new)

    runs = events.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", F.col("member_id").cast("bigint").alias("member_id")))).alias("e"))
    return runs.select("run_id", F.aggregate("e", state, step).alias("s")).select("run_id", "s.*").drop("guessed")


def solved(runs: DataFrame) -> DataFrame:
    """runs with the stages that were solved."""
    return runs.withColumn("solved", F.when(F.col("won"), STAGES).otherwise(F.col("stage")) - F.col("skipped"))


def hint_stages(events: DataFrame) -> DataFrame:
    """(run_id, hint, stage): each hint once, at the stage where it was first asked for."""
    return events.where("kind = 'hint'").groupBy("run_id", "hint").agg(F.min_by("stage", "seq").alias("stage"))


def outcome_codes(runs: DataFrame) -> DataFrame:
    """Per run the code of each stage: 0 clean, 1 with a hint, 2 missed, 3 not reached. runs: stage, won, skipped_stages
    and hinted_stages (arrays)."""
    code = lambda i: F.when(F.array_contains("skipped_stages", i), 2).when(F.col("won") | (i < F.col("stage")), F.when(F.array_contains("hinted_stages", i), 1).otherwise(0)).when(i == F.col("stage"), 2).otherwise(3)
    return runs.withColumn("codes", F.transform(F.sequence(F.lit(0), F.lit(STAGES - 1)), code))


def share_line(codes: Column) -> Column:
    """The codes as symbols in a line."""
    return F.array_join(F.transform(codes, lambda c: F.element_at(F.array(*map(F.lit, "🟩🟨🟥⬜")), c + 1)), "")


def live_only(events: DataFrame) -> DataFrame:
    """Events of live runs on their own day: replays and what comes after midnight are left out."""
    return events.where((F.col("mode") == "live") & (F.to_date("ts") == F.col("date")))


def _islands(day: DataFrame) -> DataFrame:
    """The days won of (user_id, date, won), one row a day, with a number that neighbouring days share."""
    return day.where("won").withColumn("island", F.datediff("date", F.lit("2000-01-01").cast("date")) - F.row_number().over(Window.partitionBy("user_id").orderBy("date")))


def streak_days(days: DataFrame) -> DataFrame:
    """(user_id, date, streak) of each day played: the days won in a row up to and with it, 0 for a day lost."""
    day = days.groupBy("user_id", "date").agg(F.bool_or("won").alias("won"))
    won = _islands(day).select("user_id", "date", F.row_number().over(Window.partitionBy("user_id", "island").orderBy("date")).cast("bigint").alias("streak"))
    return won.unionByName(day.where("NOT coalesce(won, false)").select("user_id", "date", F.lit(0).cast("bigint").alias("streak")))


def streaks(days: DataFrame) -> DataFrame:
    """Per user of (user_id, date, won): played, wins, best streak of days won in a row, and the current one, which ends
    with the last day played. A day lost and a day left out both break it."""
    day = days.groupBy("user_id", "date").agg(F.bool_or("won").alias("won"))
    runs = _islands(day).groupBy("user_id", "island").agg(F.count("*").alias("len"), F.max("date").alias("last_day"))
    best = runs.groupBy("user_id").agg(F.max("len").alias("best"), F.max_by("len", "last_day").alias("last_len"), F.max("last_day").alias("last_win"))
    played = day.groupBy("user_id").agg(F.count("*").alias("played"), F.count_if("won").alias("wins"), F.max("date").alias("last_played"))
    return played.join(best, "user_id", "left").select("user_id", "played", "wins", F.coalesce("best", F.lit(0)).alias("best"), F.when(F.col("last_win") == F.col("last_played"), F.col("last_len")).otherwise(0).alias("current"))


def stage_histogram(runs: DataFrame) -> DataFrame:
    """Per user of (user_id, solved): runs and how many cleared 0 to 4 stages."""
    return runs.groupBy("user_id").agg(F.count("*").alias("played"), *(F.count_if(F.col("solved") == i).alias(f"cleared_{i}") for i in range(STAGES + 1)))


def latest(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last row written for each key."""
    kept = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), seq).alias("r")).select(*keys, "r.*")


def calendar(archive: DataFrame, users: DataFrame, first: str, last: str) -> DataFrame:
    """Every day from first to last for every user of `users`, with the archived outcome or null."""
    days = users.select("user_id", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    return days.join(archive, ["user_id", "date"], "left")


def board_source(days: DataFrame, replays: DataFrame, archive: DataFrame, generated: DataFrame) -> DataFrame:
    """Where a past day's board comes from: a saved replay, else archived ids, else a new draw; all by (user_id, date)."""
    tag = lambda d, t: d.select("user_id", "date", F.lit(t).alias(t)).distinct()
    out = days
    for d, t in ((replays, "replay"), (archive, "archive"), (generated, "generated")):
        out = out.join(tag(d, t), ["user_id", "date"], "left")
    return out.select("user_id", "date", F.coalesce("replay", "archive", "generated").alias("source"))


def gated(saved: DataFrame, resolved: DataFrame) -> DataFrame:
    """The saved days of (user_id, date) that may be shown again: those whose teams are all known still."""
    return saved.join(resolved.select("user_id", "date").distinct(), ["user_id", "date"], "left_semi")


def backfilled(archive: DataFrame, runs: DataFrame) -> DataFrame:
    """The archive (user_id, date, won) with finished runs (user_id, date, done, won) of days that it lacks."""
    missing = runs.where("done").groupBy("user_id", "date").agg(F.bool_or("won").alias("won")).join(archive, ["user_id", "date"], "left_anti")
    return archive.select("user_id", "date", "won").unionByName(missing)


def share_text(number: Column, codes: Column, won: Column, wrong: Column, hints: Column, streak: Column) -> Column:
    """The line to share: puzzle number, symbols, misses and hints where there were any, and of a run
    that is won the streak that it belongs to."""
    some = lambda n, word: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}")))
    return F.concat_ws(" · ", F.concat(F.lit("#"), number.cast("string"), F.lit(" "), share_line(codes)), F.when(won, "won").otherwise("lost"), some(wrong, "missed"), some(hints, "hints"), F.when(won & (streak > 0), F.concat(F.lit("streak "), streak.cast("string"))))


def resolved_days(stored: DataFrame, team: DataFrame) -> DataFrame:
    """Days of (user_id, date, qid) whose teams are all known still; others must be drawn again."""
    j = stored.join(team.select("qid", F.lit(True).alias("known")), "qid", "left")
    return j.groupBy("user_id", "date").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("ok")).where("ok").select("user_id", "date")


def hint_ranks(events: DataFrame, first_kind: str) -> DataFrame:
    """Hint events with the rank of the answer that each reveals: as many stages' identikits as were spent before on the
    same stage by hints of a kind that goes first. events: run_id, seq, stage, hint."""
    w = Window.partitionBy("run_id", "stage").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("reveals", F.coalesce(F.count(F.when(F.col("hint") == first_kind, 1)).over(w), F.lit(0)) + 1)


def solving_guesses(events: DataFrame) -> DataFrame:
    """(run_id, stage, member_id): the first right guess of each stage, which its board shows."""
    return first_guesses(events.where("kind IN ('right', 'wrong')")).where("kind = 'right' AND NOT dup").groupBy("run_id", "stage").agg(F.min_by("member_id", "seq").alias("member_id"))


def hint_texts(hints: DataFrame, answers: DataFrame, member: DataFrame, by: str) -> DataFrame:
    """hints (run_id, seq, by, reveals) with text: what may be told of the answer (by, member_id) whose place by id the hint
    reveals: initial, decade of birth and nationality; else its year of birth; else that none is left. by names the
    column of the question, whose answers are few."""
    ranked = answers.select(by, "member_id", F.row_number().over(Window.partitionBy(by).orderBy("member_id")).cast("bigint").alias("reveals"))
    kit = F.concat(F.substr("name", F.lit(1), F.lit(1)), F.lit("., "), (F.floor(F.col("birth") / 10) * 10).cast("string"), F.lit(", "), F.coalesce("nat", F.lit("?")))
    told = hints.drop("member_id").join(ranked, [by, "reveals"], "left").join(member.select("member_id", "name", "birth", "nat"), "member_id", "left")
    return told.withColumn("text", F.coalesce(kit, F.concat(F.lit("born "), F.col("birth").cast("string")), F.lit("no more answers")))


def stage_board(runs: DataFrame) -> DataFrame:
    """One row per run and stage with its state: skipped, hinted or done before the current stage, current or failed at
    it, to do or revealed after it. runs: run_id, stage, done, won, skipped_stages, hinted_stages."""
    each = runs.select("*", F.explode(F.sequence(F.lit(0), F.lit(STAGES - 1))).alias("stage_at"))
    passed = F.col("won") | (F.col("stage_at") < F.col("stage"))
    state = F.when(F.array_contains("skipped_stages", F.col("stage_at")), "skipped").when(passed & F.array_contains("hinted_stages", F.col("stage_at")), "hinted").when(passed, "done").when(F.col("stage_at") == F.col("stage"), F.when(F.col("done"), "failed").otherwise("current")).otherwise(F.when(F.col("done"), "revealed").otherwise("to do"))
    return each.select("run_id", "stage_at", state.alias("state"))


def upgraded(stored: DataFrame, schema: str, current_hints: list[str]) -> DataFrame:
    """Saved states (run_id, json) read with the current schema: missing lists are empty, hints that are no longer in use
    are dropped. The schema names skipped (array) and hints (map)."""
    s = stored.select("run_id", F.from_json("json", schema).alias("s")).select("run_id", "s.*")
    return s.withColumn("skipped", F.coalesce("skipped", F.array().cast(s.schema["skipped"].dataType))).withColumn("hints", F.map_filter(F.coalesce("hints", F.create_map().cast(s.schema["hints"].dataType)), lambda k, v: k.isin(current_hints)))
