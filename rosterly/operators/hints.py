"""What the hints of a run tell, and what its board shows once a stage is closed.

A hint is spent once a run: "nationalities" counts the answers of the stage's pair by nationality; "first" and "second"
describe an answer. The first describes the most famous answer; the second the next one if the first was spent on the
same stage, else the most famous. Where no answer is left to describe, the second tells of the most famous answer's
career: its two best-known other teams, else its years at the pair, else its year of birth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterly.functions.names import dotted_initials
from rosterly.operators import career, playlog

FIRST, SECOND, NATIONALITIES = "first", "second", "nationalities"
SEPARATOR = " · "


def spent(events: DataFrame) -> DataFrame:
    """(run_id, hint, stage, reveals): each hint of a run at the stage where it was first asked for, and the rank of the
    answer that it describes (null for nationalities). events: run_id, seq, kind, stage, hint."""
    own = playlog.hint_stages(events).where(F.col("hint").isin(FIRST, SECOND, NATIONALITIES))
    same = F.max(F.when(F.col("hint") == FIRST, F.col("stage"))).over(Window.partitionBy("run_id")) == F.col("stage")
    rank = F.when(F.col("hint") == FIRST, 1).when(F.col("hint") == SECOND, 1 + F.coalesce(same, F.lit(False)).cast("int"))
    return own.select("run_id", "hint", "stage", rank.cast("bigint").alias("reveals"))


def notes(spells: DataFrame, asked: DataFrame) -> DataFrame:
    """(team_a, team_b, member_id, at_pair, active, others, spans) for the members of asked: whether a spell with a known start
    is open at the pair, or anywhere; the two best-known other teams; the years at the pair with both ends known. spells:
    member_id, seq, team_id, team_name, start_year, end_year, apps, loan."""
    pair = asked.select("team_a", "team_b", "member_id").distinct()
    own = spells.join(pair, "member_id").withColumn("here", (F.col("team_id") == F.col("team_a")) | (F.col("team_id") == F.col("team_b")))
    keys = ["team_a", "team_b", "member_id"]
    opened = F.col("start_year").isNotNull() & F.col("end_year").isNull()
    state = own.groupBy(*keys).agg(F.bool_or(opened & F.col("here")).alias("at_pair"), F.bool_or(opened).alias("active"))
    first = F.row_number().over(Window.partitionBy(*keys, "team_name").orderBy("seq"))
    elsewhere = own.where("NOT here").withColumn("_f", first).where("_f = 1")
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.coalesce("loan", F.lit(False)), F.greatest(F.coalesce("apps", F.lit(0)), F.lit(0)).desc(), F.col("start_year").desc_nulls_last(), "seq"))
    two = elsewhere.withColumn("_r", best).where("_r <= 2").groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "team_name"))), lambda x: x["team_name"]), SEPARATOR).alias("others"))
    known = own.where("here AND start_year IS NOT NULL AND end_year IS NOT NULL")
    each = known.groupBy(*keys, "team_name").agg(F.min("seq").alias("at"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", career.year_span(F.col("start_year"), F.col("end_year")).alias("s")))), lambda x: x["s"]), ", ").alias("years"))
    spans = each.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.concat_ws(" ", "team_name", "years").alias("t")))), lambda x: x["t"]), SEPARATOR).alias("spans"))
    return state.join(two, keys, "left").join(spans, keys, "left")


def described(top: DataFrame, posting: DataFrame, member: DataFrame, note: DataFrame) -> DataFrame:
    """(team_a, team_b, rank, others, kit, story) for ranked answers: kit is dotted initials and decade of birth, nationality,
    tallies at the two teams where there are any (goals not of goalkeepers), and whether the member is still there or
    active; story is the career to tell instead, null if nothing is known."""
    keys = ["team_a", "team_b", "member_id"]
    both = top.select(*keys, F.explode(F.array("team_a", "team_b")).alias("team_id"))
    plus = lambda c: F.sum(F.when(F.col(c) > 0, F.col(c)).otherwise(0))
    told = both.join(posting.select("team_id", "member_id", "apps", "goals"), ["team_id", "member_id"]).groupBy(*keys).agg(plus("apps").alias("_apps"), plus("goals").alias("_goals"))
    m = member.select("member_id", "name", F.col("birth").alias("_birth"), F.col("nat").alias("_nat"), F.coalesce("gk", F.lit(False)).alias("_gk"))
    full = top.select(*keys, "rank", F.col("others").alias("n_others")).join(told, keys, "left").join(m, "member_id", "left").join(note, keys, "left")
    some = lambda n, word: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}")))
    decade = F.when(F.col("_birth").isNotNull(), F.concat((F.floor(F.col("_birth") / 10) * 10).cast("int").cast("string"), F.lit("s")))
    kit = F.concat_ws(SEPARATOR, F.concat_ws(" ", dotted_initials(F.col("name")), decade), "_nat", some(F.col("_apps"), "apps"), some(F.when(~F.col("_gk"), F.col("_goals")), "goals"), F.when(F.col("at_pair"), "still there").when(F.col("active"), "still active"))
    story = F.coalesce("others", "spans", F.concat(F.lit("born "), F.col("_birth").cast("string")))
    return full.select("team_a", "team_b", "rank", "member_id", F.col("n_others").alias("others"), kit.alias("kit"), story.alias("story"))


def texts(slots: DataFrame, question: DataFrame, kits: DataFrame, answer: DataFrame) -> DataFrame:
    """slots (of spent) with text. question: (run_id, stage, team_a, team_b); kits: of described, ranks 1 and 2 at least;
    answer: all answers of the questions' pairs with nat. A stage without a question, or a pair without answers, has "…"."""
    asked = slots.join(question, ["run_id", "stage"], "left")
    pair = ["team_a", "team_b"]
    counted = answer.join(question.select(*pair).distinct(), pair, "left_semi").groupBy(*pair, F.coalesce("nat", F.lit("?")).alias("nat")).agg(F.count("*").alias("n"))
    listed = counted.groupBy(*pair).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "nat"))), lambda x: F.concat((-x["n"]).cast("string"), F.lit(" "), x["nat"])), SEPARATOR).alias("counts"))
    own = kits.select(*pair, F.col("rank").alias("reveals"), "kit")
    face = kits.where("rank = 1").select(*pair, "story")
    full = asked.join(own, [*pair, "reveals"], "left").join(face, pair, "left").join(listed, pair, "left")
    text = F.when(F.col("hint") == NATIONALITIES, F.col("counts")).otherwise(F.coalesce("kit", F.when(F.col("hint") == SECOND, F.col("story"))))
    return full.select("run_id", "hint", "stage", "reveals", F.coalesce(text, F.lit("…")).alias("text"))


def board(states: DataFrame, guesses: DataFrame, question: DataFrame, faces: DataFrame) -> DataFrame:
    """states (run_id, stage_at, state) with the answer that a closed stage shows (member_id) and how many others there were:
    the right guess of a cleared stage, the most famous answer of one that was skipped, failed or revealed; nothing of
    one that is current or to do. guesses: (run_id, stage, member_id); faces: (team_a, team_b, member_id, others) of rank 1."""
    hit = guesses.select("run_id", F.col("stage").alias("stage_at"), F.col("member_id").alias("_hit"))
    face = question.join(faces, ["team_a", "team_b"], "left").select("run_id", F.col("stage").alias("stage_at"), F.col("member_id").alias("_face"), F.col("others").alias("_others"))
    full = states.join(hit, ["run_id", "stage_at"], "left").join(face, ["run_id", "stage_at"], "left")
    cleared, closed = F.col("state").isin("done", "hinted"), ~F.col("state").isin("current", "to do")
    return full.select("run_id", "stage_at", "state", F.when(cleared, F.col("_hit")).when(closed, F.col("_face")).alias("member_id"), F.when(closed, F.col("_others")).alias("others"))
