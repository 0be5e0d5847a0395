"""Queries: facts of pairs of teams, candidates and draws of the puzzle, play logs, page text and graph patterns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rosterly.functions.names import flag, image_key, thumbnail
from rosterly.operators import clean, gate, overlay, pairs, playlog, schedule, solve
from rosterly.plans import solving
from rosterly.sources import adapter as A
from rosterly.sources import export
from rosterly.sources import statements as S
from rosterly.sources.stages import stored

QUERIES, SQL = {}, {}
LESSER = ["AFRICA", "ASIA"]
EPOCH = "2024-01-01"


def _digits(sql: str) -> str:
    """dgK(x) written out as pairs.digits does it; dg64 is six digits and then four."""
    while (at := sql.find("dg")) >= 0 and sql[at + 2].isdigit():
        opening = sql.index("(", at)
        depth, end = 1, opening + 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[opening + 1 : end - 1]
        for k in sql[at + 2 : opening]:
            inner = f"(floor(({inner}) * 1e{k} + 0.5001) / 1e{k})"
        sql = sql[:at] + inner + sql[end:]
    return sql


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = A.oracle(_digits(sql))
        return f

    return keep


def _sizes(spark, d, posting=None):
    """team_id, n, cc of the league (of the team where it has none), cur_league, dissolved."""
    n = (A.posting(spark, d) if posting is None else posting).groupBy("team_id").agg(F.count("*").alias("n"))
    league = F.broadcast(A.league(spark, d).select(F.col("idx").alias("cur_league"), F.col("cc").alias("l_cc")))
    return A.team(spark, d).join(n, "team_id").join(league, "cur_league", "left").select("team_id", "n", F.coalesce("l_cc", "cc").alias("cc"), "cur_league", "dissolved")


SIZES = "sizes AS (SELECT t.team_id, n, coalesce(l.cc, t.cc) AS cc, cur_league, dissolved FROM team t JOIN (SELECT team_id, count(*) AS n FROM posting GROUP BY 1) USING (team_id) LEFT JOIN league l ON l.idx = t.cur_league)"
STATURE = f"""{SIZES}, st0 AS (SELECT s.team_id, CASE WHEN count(*) OVER (PARTITION BY cc) > 1 THEN CAST(row_number() OVER (PARTITION BY cc ORDER BY n, s.team_id) - 1 AS DOUBLE) / CAST(count(*) OVER (PARTITION BY cc) - 1 AS DOUBLE) ELSE 1.0 END AS pct, m.team_id IS NOT NULL AS mq
  FROM sizes s LEFT JOIN marquee m USING (team_id) WHERE n >= 120), stature AS (SELECT team_id, CAST(coalesce(CASE WHEN mq THEN 1.15 WHEN pct >= 0.6 THEN 1.0 WHEN pct >= 0.3 THEN 0.82 ELSE 0.66 END, 0.66) AS DOUBLE) AS stature FROM sizes LEFT JOIN st0 USING (team_id))"""


@query("stature", STATURE + " SELECT * FROM stature")
def _(spark, d):
    return pairs.stature(_sizes(spark, d), A.marquee(spark, d))


def _pools(spark, d):
    return pairs.pools(_sizes(spark, d), star=500, sub=120, obs=520)


POOLS = """pools AS (SELECT team_id, cc, n, dissolved IS NULL AND cur_league IS NOT NULL AND n >= 500 AS star, dissolved IS NULL AND cur_league IS NOT NULL AND n >= 120 AND n < 500 AS sub,
  dissolved IS NULL AND cur_league IS NOT NULL AND n >= 120 AS field, dissolved IS NULL AND n < 520 AND n >= 100 AS obs, n >= 300 AS any300, n >= 100 AS any100 FROM sizes WHERE n >= 30)"""


@query("pools", f"{SIZES}, {POOLS} SELECT * FROM pools")
def _(spark, d):
    return _pools(spark, d)


TALLIES = """tallies AS (SELECT member_id, sum(CASE WHEN apps > 0 THEN stature * apps ELSE 0 END) AS m_apps, sum(CASE WHEN NOT gk AND goals > 0 THEN stature * goals ELSE 0 END) AS m_goals
  FROM posting JOIN marquee USING (team_id) JOIN stature USING (team_id) JOIN member USING (member_id) GROUP BY 1)"""


@query("marquee_tallies", f"{STATURE}, {TALLIES} SELECT member_id, round(m_apps, 6) AS m_apps, round(m_goals, 6) AS m_goals FROM tallies")
def _(spark, d):
    t = pairs.marquee_tallies(A.posting(spark, d), pairs.stature(_sizes(spark, d), A.marquee(spark, d)), A.marquee(spark, d), A.member(spark, d))
    return t.select("member_id", F.round("m_apps", 6).alias("m_apps"), F.round("m_goals", 6).alias("m_goals"))


@query("pair_sizes", "SELECT a.team_id AS team_a, b.team_id AS team_b, count(*) AS n, CAST(sum(a.apps) AS BIGINT) AS apps_a, CAST(sum(b.goals) AS BIGINT) AS goals_b FROM posting a JOIN posting b ON a.member_id = b.member_id AND a.team_id < b.team_id GROUP BY 1, 2")
def _(spark, d):
    return pairs.pair_sizes(A.posting(spark, d))


def _posting_careers(spark, d):
    """All postings, put together to careers where they are made and stored so."""
    return stored(pairs.careers_of(A.posting(spark, d).select("team_id", "member_id", "apps", "goals")))


def _answers(spark, d, posting=None, sizes=None, teams=None, careers=None):
    """The answers of all pairs, or of the pairs of some teams; postings (as careers) and team sizes are worked out once and
    stored."""
    if posting is None:
        careers = _posting_careers(spark, d) if careers is None else careers
        posting = pairs.postings_of(careers)
    sizes = stored(_sizes(spark, d, posting)) if sizes is None else sizes
    marquee = A.marquee(spark, d)
    return pairs.answers(posting, A.member(spark, d), stored(pairs.stature(sizes, marquee)), marquee, A.BUILD_YEAR, teams, careers)


def _side(x: str) -> str:
    pos = lambda c: f"CASE WHEN {c} > 0 THEN stature * {c} ELSE 0 END"
    goals = f"CASE WHEN NOT gk THEN {pos('goals')} ELSE 0 END"
    mq = "q.team_id IS NOT NULL"
    return f"{x} AS (SELECT p.team_id, member_id, coalesce(apps = 0, false) AS zero, {pos('apps')} AS wa, {goals} AS wg, CASE WHEN {mq} THEN {pos('apps')} ELSE 0 END AS qa, CASE WHEN {mq} THEN {goals} ELSE 0 END AS qg, CAST({mq} AS INT) AS mq FROM posting p JOIN stature USING (team_id) JOIN member USING (member_id) LEFT JOIN marquee q USING (team_id))"


ANSWERS = f"""{STATURE}, {TALLIES}, {_side('side')}, ans AS (SELECT a.team_id AS team_a, b.team_id AS team_b, member_id, birth, nat, a.mq + b.mq AS n_marquee, dg6(
  CASE WHEN {A.BUILD_YEAR} - coalesce(birth, {A.BUILD_YEAR} - 99) <= 28 THEN 200 WHEN {A.BUILD_YEAR} - coalesce(birth, {A.BUILD_YEAR} - 99) <= 32 THEN 150 WHEN {A.BUILD_YEAR} - coalesce(birth, {A.BUILD_YEAR} - 99) <= 36 THEN 90 WHEN {A.BUILD_YEAR} - coalesce(birth, {A.BUILD_YEAR} - 99) <= 41 THEN 45 ELSE 10 END
  * least(1.0::DOUBLE, (CASE WHEN a.wa + b.wa = 0 THEN 12 ELSE a.wa + b.wa END) / 25) + (CASE WHEN birth >= 1970 THEN 1.0::DOUBLE WHEN birth >= 1955 THEN 0.85 WHEN birth >= 1940 THEN 0.65 ELSE 0.45 END)
  * (0.75 * least(a.wa + b.wa, 260) + 3 * least(a.wg + b.wg, 70) + 0.4 * (0.75 * least(greatest(coalesce(m_apps, 0) - (a.qa + b.qa), 0), 260) + 3 * least(greatest(coalesce(m_goals, 0) - (a.qg + b.qg), 0), 70))) + CASE WHEN img IS NOT NULL THEN 20 ELSE 0 END) AS fame
  FROM side a JOIN side b USING (member_id) JOIN member USING (member_id) LEFT JOIN tallies USING (member_id) WHERE a.team_id < b.team_id AND NOT a.zero AND NOT b.zero),
ranked AS (SELECT *, row_number() OVER (PARTITION BY team_a, team_b ORDER BY dg4(fame) DESC, member_id) AS rank, count(*) OVER (PARTITION BY team_a, team_b) - 1 AS others FROM ans)"""


def _ranked(spark, d, k: int):
    """Ranked by fame rounded to four digits, so that engines agree on near-ties."""
    answer = _answers(spark, d).withColumn("fame", pairs.digits(F.col("fame"), 4))
    return pairs.ranked(answer if "_salts" in answer.columns else answer.drop("birth", "nat", "n_marquee"), k)


@query("fame_top_answers", ANSWERS + " SELECT team_a, team_b, member_id, dg3(dg4(fame)) AS fame, rank, others FROM ranked WHERE rank <= 3")
def _(spark, d):
    return _ranked(spark, d, 3).select("team_a", "team_b", "member_id", pairs.digits(F.col("fame"), 3).alias("fame"), "rank", "others")


FACTS = f"""facts0 AS (SELECT team_a, team_b, count(*) AS n, max(n_marquee) AS nm, coalesce(max(CASE WHEN rank = 1 THEN fame END), 0) AS f1, coalesce(max(CASE WHEN rank = 2 THEN fame END), 0) AS f2, coalesce(max(CASE WHEN rank = 3 THEN fame END), 0) AS f3, coalesce(max(CASE WHEN rank = 4 THEN fame END), 0) AS f4,
  arg_min(coalesce(birth, -1), member_id) <> -1 AS birth_known, max(CASE WHEN rank = 1 THEN member_id END) AS representative FROM ranked GROUP BY 1, 2),
facts1 AS (SELECT f.*, dg6((f1 + 0.3 * greatest(f2 - 250, 0) + 0.18 * greatest(f3 - 250, 0) + 0.1 * greatest(f4 - 250, 0) + 2 * least(f.n, 25) - CASE WHEN nm < 2 AND f2 < 430 THEN least((430 - f2) * 1.5, 150) ELSE 0 END)
  * (CASE WHEN a.cc IN ('AFRICA', 'ASIA') THEN 0.93 ELSE 1.0 END)::DOUBLE * (CASE WHEN b.cc IN ('AFRICA', 'ASIA') THEN 0.93 ELSE 1.0 END)::DOUBLE) AS e FROM facts0 f JOIN sizes a ON a.team_id = team_a JOIN sizes b ON b.team_id = team_b),
facts AS (SELECT team_a, team_b, n, dg6(e + CASE WHEN e >= 500 THEN CASE WHEN nm = 2 THEN 35 ELSE -45 * (2 - nm) END ELSE 0 END) AS ease, birth_known, representative FROM facts1)"""


def _facts_and_sizes(spark, d):
    """The facts of pairs, and the sizes of teams; the latter are stored."""
    careers, sizes = _careers_and_sizes(spark, d)
    return _facts_of(spark, d, careers, sizes), sizes


def _careers_and_sizes(spark, d):
    """Postings as careers, and the sizes of teams, both stored."""
    careers = _posting_careers(spark, d)
    return careers, stored(_sizes(spark, d, pairs.postings_of(careers)))


def _facts_of(spark, d, careers, sizes, teams=None):
    """The facts of all pairs, or of those of some teams (team_id)."""
    answer = _answers(spark, d, sizes=sizes, careers=careers, teams=teams).withColumn("fame", pairs.digits(F.col("fame"), 4))
    return pairs.pair_facts(answer, sizes.select("team_id", F.col("cc").alias("league_cc")), LESSER)


@query("pair_ease", f"{ANSWERS.replace('AS n_marquee, dg6(', 'AS n_marquee, dg64(')}, {FACTS} SELECT team_a, team_b, n, dg2(ease) AS ease, birth_known FROM facts")
def _(spark, d):
    return _facts_and_sizes(spark, d)[0].select("team_a", "team_b", "n", pairs.digits(F.col("ease"), 2).alias("ease"), "birth_known")


LADDER = [(0, 0, "star", "field", 2, 10**9, 545.0, 1e9, False), (0, 1, "star", "field", 2, 10**9, 470.0, 1e9, False), (1, 0, "star", "field", 3, 10**9, 425.0, 545.0, False), (1, 1, "star", "field", 2, 10**9, 350.0, 570.0, False), (2, 0, "field", "field", 2, 180, 140.0, 370.0, False), (2, 1, "field", "field", 2, 250, 0.0, 700.0, False), (3, 0, "obs", "any300", 1, 150, -1e9, 560.0, True), (3, 1, "obs", "any100", 1, 300, -1e9, 1000.0, False)]


def _ladder(spark):
    return spark.createDataFrame(LADDER, "stage int, tier int, pool_a string, pool_b string, min_n long, max_n long, ease_lo double, ease_hi double, need_birth boolean")


def _cands_of(spark, facts, sizes):
    return schedule.candidates(facts, pairs.pools(sizes, star=500, sub=120, obs=520), _ladder(spark))


def _cands(spark, d):
    """Candidates, made in the tasks that put the facts of pairs together, of which nothing is stored; and the sizes of teams."""
    facts, sizes = _facts_and_sizes(spark, d)
    return _cands_of(spark, facts.withColumn("ease", pairs.digits(F.col("ease"), 2)), sizes), sizes


def _kept_cands(spark, d):
    """Candidates (stage, tier, team_a, team_b), stored without the facts of pairs; postings as careers, and the sizes of teams."""
    careers, sizes = _careers_and_sizes(spark, d)
    facts = _facts_of(spark, d, careers, sizes).withColumn("ease", pairs.digits(F.col("ease"), 2))
    return stored(_cands_of(spark, facts, sizes).select("stage", "tier", "team_a", "team_b")), careers, sizes


def _facts_of_drawn(spark, d, drawn, careers, sizes):
    """The facts of the pairs of drawn (team_a, team_b; few rows): worked out again for their teams instead of stored for all."""
    teams = stored(drawn.select(F.explode(F.array("team_a", "team_b")).alias("team_id")).distinct())
    return _facts_of(spark, d, careers, sizes, F.broadcast(teams)).withColumn("ease", pairs.digits(F.col("ease"), 2))


_PICK = lambda side, col: "CASE " + col + " " + " ".join(f"WHEN '{p}' THEN {side}.{p}" for p in ("star", "sub", "field", "obs", "any300", "any100")) + " END"
CANDS = f"""{ANSWERS.replace('AS n_marquee, dg6(', 'AS n_marquee, dg64(')}, {FACTS}, {POOLS}, ladder(stage, tier, pool_a, pool_b, min_n, max_n, ease_lo, ease_hi, need_birth) AS (VALUES {', '.join(str(x).replace('True', 'true').replace('False', 'false') for x in LADDER)}),
c0 AS (SELECT CAST(stage AS INT) AS stage, CAST(tier AS INT) AS tier, f.team_a AS lo, f.team_b AS hi, f.n, dg2(ease) AS ease, ({_PICK('a', 'pool_a')}) AND ({_PICK('b', 'pool_b')}) AS straight, ({_PICK('b', 'pool_a')}) AND ({_PICK('a', 'pool_b')}) AS turned
  FROM facts f JOIN pools a ON a.team_id = team_a JOIN pools b ON b.team_id = team_b JOIN ladder l ON f.n BETWEEN min_n AND max_n AND dg2(ease) >= ease_lo AND dg2(ease) < ease_hi AND (NOT need_birth OR birth_known)),
cands AS (SELECT stage, tier, CASE WHEN straight THEN lo ELSE hi END AS team_a, CASE WHEN straight THEN hi ELSE lo END AS team_b, n, ease FROM c0 WHERE straight OR turned)"""


@query("puzzle_candidates", CANDS + " SELECT * FROM cands")
def _(spark, d):
    return _cands(spark, d)[0]


@query("puzzle_first_tier", CANDS + " SELECT stage, min(tier) AS tier, count(*) FILTER (tier = low) AS n FROM (SELECT *, min(tier) OVER (PARTITION BY stage) AS low FROM cands) GROUP BY 1")
def _(spark, d):
    return schedule.tier_sizes(_cands(spark, d)[0], ["stage"])


@query("puzzle_draws", CANDS + """, days AS (SELECT CAST(range AS DATE) AS date FROM range(DATE '2024-01-01', DATE '2024-01-15', INTERVAL 1 DAY)), f AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY stage) AS low FROM cands) WHERE tier = low)
SELECT date, stage, tier, team_a, team_b FROM (SELECT *, row_number() OVER (PARTITION BY date, stage ORDER BY md5(concat_ws('|', date, stage, cc)), md5(concat_ws('|', date, stage, team_a, team_b)), team_a, team_b) AS r FROM days, f JOIN (SELECT team_id, cc FROM sizes) s ON s.team_id = f.team_a) WHERE r = 1""")
def _(spark, d):
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-01-14')) AS date")
    cands, _, sizes = _kept_cands(spark, d)
    return _draws(cands, sizes, days)


def _draws(cands, sizes, days):
    """A draw of each day and stage that has candidates. cands: a stored table."""
    steps = days.crossJoin(days.sparkSession.range(schedule.STAGES).select(F.col("id").cast("int").alias("stage")))
    return schedule.draws(schedule.with_country(cands, F.broadcast(sizes.select("team_id", F.col("cc").alias("league_cc")))), steps)


@query("pair_nationalities", ANSWERS + " SELECT team_a, team_b, coalesce(nat, '') AS nat, count(*) AS n FROM ans GROUP BY 1, 2, 3")
def _(spark, d):
    return pairs.pair_nationalities(_answers(spark, d))


@query("same_generation", """own AS (SELECT team_id, member_id, birth FROM posting JOIN member USING (member_id) WHERE img IS NOT NULL AND birth IS NOT NULL)
SELECT a.member_id AS anchor_id, a.team_id, b.member_id FROM own a JOIN own b ON a.team_id = b.team_id AND abs(a.birth - b.birth) <= 2 AND a.member_id <> b.member_id""")
def _(spark, d):
    m = A.member(spark, d)
    return schedule.same_generation(A.posting(spark, d), m, m)


@query("puzzle_numbers", "SELECT event_id, CAST(date_diff('day', DATE '2024-01-05', CAST(ts AS DATE)) + 1 AS INT) AS puzzle, CAST(((date_diff('day', DATE '2024-01-05', CAST(ts AS DATE))) // 90) * 90 + 1 AS INT) AS block FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-05'")
def _(spark, d):
    e = A.table(spark, d, "events").withColumn("date", F.to_date("ts"))
    return schedule.started(e, "date", "2024-01-05").select("event_id", "puzzle", schedule.block_start(F.col("puzzle")).alias("block"))


KINDS = {"purchase": "right", "click": "wrong", "view": "wrong", "signup": "hint", "error": "skip"}


def _events(spark, d):
    """Runs of a user and week: run_id, seq, kind, stage, member_id, hint."""
    e = A.table(spark, d, "events")
    week = F.floor(F.datediff(F.to_date("ts"), F.lit(EPOCH).cast("date")) / 7)
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("event_type"))
    return e.select("user_id", F.concat_ws("-", "user_id", week.cast("string")).alias("run_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.to_date("ts").alias("date"), F.pmod("event_id", F.lit(7)).alias("member_id"), F.pmod("event_id", F.lit(4)).cast("int").alias("stage"), F.pmod("event_id", F.lit(3)).cast("string").alias("hint"))


EVENTS = f"""ev AS (SELECT user_id, user_id || '-' || (date_diff('day', DATE '{EPOCH}', CAST(ts AS DATE)) // 7) AS run_id, event_id AS seq, CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items())} END AS kind, CAST(ts AS DATE) AS date, event_id % 7 AS member_id, CAST(event_id % 4 AS INT) AS stage, CAST(event_id % 3 AS VARCHAR) AS hint FROM events)"""


FOLD = EVENTS + """, o AS (SELECT run_id, kind, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS i FROM ev)
"""
FOLD_SQL = "WITH RECURSIVE " + A.ADAPTER + ",\n" + FOLD.replace("SELECT run_id, kind, row", "SELECT run_id, kind, member_id, row") + """, runs AS (SELECT run_id, 0 AS i, 0 AS stage, 5 AS lives, 0 AS wrong, 0 AS skipped, false AS done, false AS won, CAST([] AS BIGINT[]) AS guessed FROM (SELECT DISTINCT run_id FROM o)
UNION ALL SELECT run_id, i, CASE WHEN still THEN stage WHEN moves THEN stage + 1 ELSE stage END, CASE WHEN NOT still AND kind = 'wrong' THEN lives - 1 ELSE lives END, CASE WHEN NOT still AND kind = 'wrong' THEN wrong + 1 ELSE wrong END,
CASE WHEN NOT still AND kind = 'skip' AND stage < 3 THEN skipped + 1 ELSE skipped END, done OR (NOT still AND ((kind = 'right' AND stage = 3) OR (kind = 'wrong' AND lives = 1))), won OR (NOT still AND kind = 'right' AND stage = 3),
CASE WHEN still THEN guessed WHEN moves THEN CAST([] AS BIGINT[]) WHEN kind IN ('right', 'wrong') THEN list_append(guessed, member_id) ELSE guessed END
FROM (SELECT r.* EXCLUDE (i), o.i, o.kind, o.member_id, done OR (kind IN ('right', 'wrong') AND list_contains(guessed, member_id)) AS still, kind IN ('right', 'skip') AND stage < 3 AS moves FROM runs r JOIN o ON o.run_id = r.run_id AND o.i = r.i + 1))
SELECT run_id, CAST(stage AS INT) AS stage, CAST(lives AS INT) AS lives, CAST(wrong AS INT) AS wrong, CAST(skipped AS INT) AS skipped, done, won, CAST(CASE WHEN won THEN 4 ELSE stage END - skipped AS INT) AS solved FROM runs QUALIFY i = max(i) OVER (PARTITION BY run_id)"""


@query("run_states")
def _(spark, d):
    return playlog.solved(playlog.fold(_events(spark, d)))


SQL["run_states"] = FOLD_SQL


@query("duplicate_guesses", EVENTS + " SELECT run_id, seq, row_number() OVER (PARTITION BY run_id, stage, member_id ORDER BY seq) > 1 AS dup FROM ev WHERE kind IN ('right', 'wrong')")
def _(spark, d):
    return playlog.first_guesses(_events(spark, d).where("kind IN ('right', 'wrong')")).select("run_id", "seq", "dup")


@query("hint_stages", EVENTS + " SELECT run_id, hint, arg_min(stage, seq) AS stage FROM ev WHERE kind = 'hint' GROUP BY 1, 2")
def _(spark, d):
    return playlog.hint_stages(_events(spark, d))


DAYS = EVENTS + ", dy AS (SELECT user_id, date, bool_or(kind = 'right') AS won FROM ev GROUP BY 1, 2)"


@query("streaks", DAYS + """, i AS (SELECT user_id, date, date_diff('day', DATE '2000-01-01', date) - row_number() OVER (PARTITION BY user_id ORDER BY date) AS g FROM dy WHERE won), r AS (SELECT user_id, count(*) AS len, max(date) AS last FROM i GROUP BY user_id, g), b AS (SELECT user_id, max(len) AS best, arg_max(len, last) AS ll, max(last) AS lw FROM r GROUP BY 1),
p AS (SELECT user_id, count(*) AS played, count(*) FILTER (won) AS wins, max(date) AS lp FROM dy GROUP BY 1) SELECT user_id, played, wins, coalesce(best, 0) AS best, CASE WHEN lw = lp THEN ll ELSE 0 END AS current FROM p LEFT JOIN b USING (user_id)""")
def _(spark, d):
    return playlog.streaks(_events(spark, d).select("user_id", "date", (F.col("kind") == "right").alias("won")))


@query("stage_histogram", None)
def _(spark, d):
    return playlog.stage_histogram(playlog.solved(playlog.fold(_events(spark, d))).withColumn("user_id", F.substring_index("run_id", "-", 1).cast("bigint")))


SQL["stage_histogram"] = f"SELECT CAST(split_part(run_id, '-', 1) AS BIGINT) AS user_id, count(*) AS played, {', '.join(f'count(*) FILTER (solved = {i}) AS cleared_{i}' for i in range(5))} FROM ({FOLD_SQL}) GROUP BY 1"


@query("archive_calendar", DAYS + " SELECT u.user_id, CAST(r.day AS DATE) AS date, won FROM (SELECT DISTINCT user_id FROM ev) u CROSS JOIN (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS day FROM ev) r LEFT JOIN dy ON dy.user_id = u.user_id AND dy.date = CAST(r.day AS DATE)")
def _(spark, d):
    e = _events(spark, d)
    days = e.groupBy("user_id", "date").agg(F.bool_or(F.col("kind") == "right").alias("won"))
    span = e.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    return playlog.calendar(days, e.select("user_id").distinct(), str(span.a), str(span.b))


@query("latest_play", EVENTS + " SELECT user_id, date, arg_max(kind, seq) AS kind, max(seq) AS seq FROM ev GROUP BY 1, 2")
def _(spark, d):
    return playlog.latest(_events(spark, d).select("user_id", "date", "seq", "kind"), ["user_id", "date"]).select("user_id", "date", "kind", "seq")


def _pages(spark, d, spells=None):
    """Page text of all members but those of one segment, who have no page; every fifth lacks its last spell."""
    team = A.team(spark, d).select("team_id", F.replace("name", F.lit("#"), F.lit(" ")).alias("team_name"))
    paged = A.table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("member_id"))
    s = (A.spells(spark, d) if spells is None else spells).join(paged, "member_id", "left_semi")
    s = s.withColumn("top", F.max("seq").over(Window.partitionBy("member_id"))).where("NOT (member_id % 5 = 0 AND seq = top)").join(team, "team_id")
    n, text = F.col("seq").cast("string"), lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    field = lambda k, v: F.concat(F.lit(f"| {k}"), n, F.lit(" = "), v)
    years = F.when(F.col("end_year").isNull(), text("start_year")).otherwise(F.concat(text("start_year"), F.lit("–"), text("end_year")))
    line = F.concat_ws("\n", field("years", years), field("clubs", F.concat(F.when(F.col("loan"), "→ ").otherwise(""), F.lit("[["), "team_name", F.lit("|x]]"))), field("caps", text("apps")), field("goals", F.concat(F.lit("{{0}}"), text("goals"), F.lit("<ref>9</ref>"))))
    return s.groupBy(F.col("member_id").alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x["l"]), "\n").alias("content"))


PAGED = "pg AS (SELECT s.*, max(seq) OVER (PARTITION BY member_id) AS top FROM spells s SEMI JOIN (SELECT c_custkey AS member_id FROM customer WHERE c_mktsegment <> 'BUILDING') USING (member_id)), ov AS (SELECT member_id, seq, team_id, CASE WHEN start_year IS NULL THEN end_year ELSE start_year END AS start_year, CASE WHEN start_year IS NOT NULL THEN end_year END AS end_year, apps, goals, loan FROM pg WHERE NOT (member_id % 5 = 0 AND seq = top))"


@query("infobox_spells", PAGED + " SELECT member_id AS page, CAST(seq AS INT) AS seq, replace(t.name, '#', ' ') AS title, start_year, end_year, apps, goals, loan FROM ov JOIN team t USING (team_id)")
def _(spark, d):
    return overlay.infobox_spells(_pages(spark, d))


def _titles(spark, d):
    t = A.team(spark, d).select("team_id", F.replace("name", F.lit("#"), F.lit(" ")).alias("title"))
    norm = t.select(F.replace("title", F.lit(" "), F.lit("_")).alias("from"), F.col("title").alias("to"))
    old = t.where("team_id % 4 = 0").select(F.concat(F.lit("Old "), "title").alias("from"), F.col("title").alias("to"))
    return t, norm, old


@query("titles_resolved", "t AS (SELECT team_id, replace(name, '#', ' ') AS name FROM team) SELECT v.title, t.team_id AS qid FROM t, LATERAL (VALUES (t.name), (replace(t.name, ' ', '_')), ('Old ' || t.name)) v(title) WHERE NOT (v.title LIKE 'Old %' AND team_id % 4 <> 0) GROUP BY 1, 2 UNION ALL SELECT 'Old ' || name, NULL FROM t WHERE team_id % 4 <> 0")
def _(spark, d):
    t, norm, old = _titles(spark, d)
    asked = t.select("title").union(norm.select("from")).union(t.select(F.concat(F.lit("Old "), "title"))).union(t.select(F.concat(F.lit(":fr:"), "title")))
    return overlay.resolve_titles(asked, norm, old, t.select("title", F.col("team_id").alias("qid")))


def _overlay(spark, d, spells, pages=_pages):
    t, norm, old = _titles(spark, d)
    sp = stored(overlay.infobox_spells(pages(spark, d, spells)))
    ids = overlay.resolve_titles(sp.select("title"), norm, old, t.select("title", F.col("team_id").alias("qid"))).where("qid IS NOT NULL")
    over = sp.join(ids, "title").select(F.col("page").alias("member_id"), F.col("seq").cast("bigint").alias("seq"), F.col("qid").alias("team_id"), "start_year", "end_year", "apps", "goals", "loan")
    return stored(over)


GUARD = PAGED + f""", o AS (SELECT member_id, count(*) AS os, sum(CAST(apps IS NOT NULL AS INT) + CAST(goals IS NOT NULL AS INT)) AS ot FROM ov GROUP BY 1), bb AS (SELECT member_id, count(*) AS q, sum(CAST(apps IS NOT NULL AS INT) + CAST(goals IS NOT NULL AS INT)) AS t FROM spells WHERE coalesce(start_year, end_year, apps, goals) IS NOT NULL GROUP BY 1),
acc AS (SELECT member_id, os >= coalesce(q, 0) AND ot >= coalesce(t, 0) AS ok FROM o LEFT JOIN bb USING (member_id))"""


@query("overlay_guard", GUARD + " SELECT * FROM acc")
def _(spark, d):
    base = stored(A.spells(spark, d))
    return overlay.accepted(base, _overlay(spark, d, base))


CAREERS = GUARD + """, w AS (SELECT ov.* FROM ov JOIN acc USING (member_id) WHERE ok), careers AS (SELECT member_id, seq, team_id, start_year, end_year, apps, goals, loan FROM w
UNION ALL SELECT member_id, seq, team_id, start_year, end_year, apps, goals, loan FROM spells ANTI JOIN w USING (member_id))"""


def _careers(spark, d, pages=_pages):
    base = stored(A.spells(spark, d))
    over = _overlay(spark, d, base, pages)
    ok = stored(overlay.accepted(base, over).where("ok").select("member_id"))
    return overlay.replaced(base, over.join(ok, "member_id", "left_semi")).select("member_id", "seq", "team_id", "start_year", "end_year", "apps", "goals", "loan")


def _titled_pages(spark, d, spells=None):
    """Page texts by title, matched with the members that name the title. Every tenth member names the page of the member
    before: that page goes to the greater id, and the own page of such a member to nobody."""
    title = lambda c: F.concat(F.lit("Page "), c.cast("string"))
    texts = _pages(spark, d, spells).select(title(F.col("page")).alias("title"), "content")
    named = A.member(spark, d).select("member_id", title(F.when(F.col("member_id") % 10 == 3, F.col("member_id") - 1).otherwise(F.col("member_id"))).alias("title"))
    return S.pages_of(named, texts).withColumnRenamed("member_id", "page")


BY_TITLE = CAREERS.replace("ov AS (SELECT member_id", "ov0 AS (SELECT member_id", 1).replace(", o AS (", """, pt AS (SELECT CASE WHEN member_id % 10 = 3 THEN member_id - 1 ELSE member_id END AS page, max(member_id) AS member_id FROM member GROUP BY 1),
ov AS (SELECT pt.member_id, ov0.* EXCLUDE (member_id) FROM ov0 JOIN pt ON pt.page = ov0.member_id), o AS (""", 1)


@query("careers_of_titled_pages", BY_TITLE + " SELECT * FROM careers")
def _(spark, d):
    return _careers(spark, d, _titled_pages)


@query("overlaid_careers", CAREERS + " SELECT * FROM careers")
def _(spark, d):
    return _careers(spark, d)


@query("overlaid_ends", CAREERS + ", " + solving._eff_sql("careers") + " SELECT member_id, seq, CAST(eff AS INT) AS eff FROM eff")
def _(spark, d):
    return solve.effective_end(_careers(spark, d), A.BUILD_YEAR).select("member_id", "seq", "eff")


def _truthy(spark, d):
    """Statements of suppliers: a league, an instance and a country, which has a code; orders' priorities as seasons."""
    s, n = A.table(spark, d, "supplier"), A.table(spark, d, "nation")
    q = F.concat(F.lit("T"), F.col("s_suppkey").cast("string"))
    row = lambda df, a, p, b: df.select(a.alias("s"), F.lit(p).alias("p"), b.alias("o"))
    nat = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    league = lambda c: F.concat(F.lit("L"), c.cast("string"))
    k = F.col("s_suppkey")
    return row(s.where(k % 3 == 0), q, "league", league(k % 4)).union(row(s.where(k % 6 == 0), q, "instance", F.lit("club"))).union(row(s.where(k % 5 == 0), F.concat(F.lit("S"), (k % 7).cast("string")), "team", q)).union(row(s, F.concat(F.lit("S"), (k % 7).cast("string")), "season_of", league(k % 7 % 4)).distinct()).union(row(s, q, "country", nat("s_nationkey"))).union(row(n.where("n_nationkey % 2 = 0"), nat("n_nationkey"), "code", F.col("n_name")))


@query("team_universe", """al AS (SELECT CASE WHEN l = 'L3' THEN 'L1' ELSE l END AS league, team_id FROM (SELECT s_suppkey AS team_id, 'L' || s_suppkey % 4 AS l FROM supplier WHERE s_suppkey % 6 = 0 UNION SELECT a.s_suppkey, 'L' || b.s_suppkey % 7 % 4 FROM supplier a JOIN supplier b ON a.s_suppkey % 7 = b.s_suppkey % 7 WHERE a.s_suppkey % 5 = 0))
SELECT DISTINCT 'T' || team_id AS qid, league, CASE WHEN s_nationkey % 2 = 0 THEN n_name END AS cc FROM al JOIN supplier ON s_suppkey = team_id JOIN nation ON n_nationkey = s_nationkey""")
def _(spark, d):
    alias = spark.createDataFrame([("L3", "L1")], "league string, canonical string")
    return S.team_universe(_truthy(spark, d), "league", "season_of", "team", "instance", "club", "country", "code", alias).select("qid", "league", "cc")


@query("teams_collapsed", """al AS (SELECT CASE WHEN l = 'L3' THEN 'L1' ELSE l END AS league, team_id FROM (SELECT s_suppkey AS team_id, 'L' || s_suppkey % 4 AS l FROM supplier WHERE s_suppkey % 6 = 0 UNION SELECT a.s_suppkey, 'L' || b.s_suppkey % 7 % 4 FROM supplier a JOIN supplier b ON a.s_suppkey % 7 = b.s_suppkey % 7 WHERE a.s_suppkey % 5 = 0))
SELECT 'T' || team_id AS qid, min(CASE WHEN s_nationkey % 2 = 0 THEN n_name END) AS cc, array_to_string(list_sort(list(DISTINCT league)), ',') AS leagues FROM al JOIN supplier ON s_suppkey = team_id JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""")
def _(spark, d):
    alias = spark.createDataFrame([("L3", "L1")], "league string, canonical string")
    u = S.team_universe(_truthy(spark, d), "league", "season_of", "team", "instance", "club", "country", "code", alias)
    return clean.collapse_teams(u.withColumns({"name": F.col("qid"), "dissolved": F.lit(None).cast("int")})).select("qid", "cc", F.array_join("leagues", ",").alias("leagues"))


@query("raw_statements", """SELECT l_orderkey || '-' || l_suppkey AS st, 'Q' || o_custkey AS member_id, 'Q' || l_suppkey AS team_id, CASE WHEN l_linenumber <> 5 AND year(o_orderdate) BETWEEN 1850 AND 2035 THEN CAST(year(o_orderdate) AS INT) END AS start_year,
CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity AS INT) END AS apps, l_returnflag = 'R' AS loan FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(spark, d):
    o, line = A.table(spark, d, "orders"), A.table(spark, d, "lineitem")
    uri = lambda c: F.concat(F.lit("http://example.org/entity/Q"), F.col(c).cast("string"))
    unknown = F.lit("http://example.org/.well-known/unknown")
    raw = line.join(o, line.l_orderkey == o.o_orderkey).select(
        F.concat_ws("-", "l_orderkey", "l_suppkey").alias("st"), uri("o_custkey").alias("s"), F.lit("member of").alias("p"), uri("l_suppkey").alias("o"), F.when(F.col("l_linenumber") != 5, F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'")).otherwise(unknown).alias("start"), F.lit(None).cast("string").alias("end"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("int").cast("string")).otherwise(unknown).alias("apps"), F.lit(None).cast("string").alias("goals"), F.when(F.col("l_returnflag") == "R", "1").alias("loan"))
    return S.career_rows(raw, "member of").select("st", "member_id", "team_id", "start_year", "apps", "loan")


@query("outside_teams", "SELECT DISTINCT team_id FROM statements WHERE team_id % 4 = 3")
def _(spark, d):
    return S.outside(A.statements(spark, d), A.team(spark, d).where("team_id % 4 <> 3"))


@query("labels_picked", "SELECT member_id, CASE WHEN member_id % 3 = 0 THEN name WHEN member_id % 3 = 1 THEN 'mul ' || name END AS name FROM member WHERE member_id % 3 <> 2")
def _(spark, d):
    m = A.member(spark, d)
    en, mul = m.where("member_id % 3 = 0").select("member_id", F.lit("en"), "name"), m.where("member_id % 3 <> 2").select("member_id", F.lit("mul"), F.concat(F.lit("mul "), "name"))
    labels = en.union(mul).union(m.select("member_id", F.lit("xx"), "name")).toDF("s", "lang", "label")
    return S.labels_of(m.select("member_id"), labels, ["en", "mul"], "member_id")


@query("nationality_picked", "SELECT c_custkey AS member, CASE WHEN c_custkey % 4 = 0 THEN 'S' || c_nationkey % 5 WHEN c_nationkey % 3 = 0 THEN 'C' || c_nationkey WHEN c_nationkey % 3 = 1 THEN 'NEW' WHEN c_custkey % 2 = 1 THEN 'FIX' END AS nat FROM customer")
def _(spark, d):
    c = A.table(spark, d, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    one = lambda cond, v: F.when(cond, F.array(v)).otherwise(F.array().cast("array<string>"))
    ccs = one(n % 3 == 0, F.concat(F.lit("C"), n.cast("string")))
    rows = c.select(k.alias("member"), F.when(n % 3 == 1, F.array(F.lit("DD"))).otherwise(ccs).alias("ccs"), one(k % 4 == 0, F.concat(F.lit("S"), (n % 5).cast("string"))).alias("sport_ccs"), one(k % 2 == 1, F.lit("Q1")).alias("citizenships"))
    return clean.nationality(rows, spark.createDataFrame([("DD", "NEW"), ("YU", None)], "cc string, successor string"), spark.createDataFrame([("Q1", "FIX")], "citizenship string, cc string")).select("member", "nat")


@query("identikits", ANSWERS + f""", t AS (SELECT team_a, team_b, a.member_id, CAST(sum(apps) AS BIGINT) AS apps, CAST(sum(goals) AS BIGINT) AS goals, coalesce(bool_or(last_year >= {A.BUILD_YEAR}), false) AS still_there FROM ans a JOIN posting p ON p.member_id = a.member_id AND p.team_id IN (a.team_a, a.team_b) GROUP BY 1, 2, 3)
SELECT team_a, team_b, member_id, name[1:1] || '.' AS initials, CAST(birth // 10 * 10 AS INT) AS decade, nat, apps, CASE WHEN NOT gk THEN goals END AS goals, still_there FROM t JOIN member USING (member_id)""")
def _(spark, d):
    return pairs.identikits(A.posting(spark, d), A.member(spark, d), A.BUILD_YEAR)


@query("export_violations", """x AS (SELECT team_id, max(member_id) AS top FROM posting GROUP BY 1) SELECT 'id out of range' AS "check", CAST(team_id AS VARCHAR) AS detail FROM x WHERE top >= (SELECT count(*) FROM member) - 5""")
def _(spark, d):
    rosters, members = export.roster_export(A.posting(spark, d)), A.table(spark, d, "customer").count()
    return gate.export_violations(rosters, members - 5)


@query("hint_ranks", EVENTS + ", hh AS (SELECT * FROM ev WHERE kind = 'hint') SELECT run_id, seq, coalesce(count(*) FILTER (hint = '0') OVER (PARTITION BY run_id, stage ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS reveals FROM hh")
def _(spark, d):
    return playlog.hint_ranks(_events(spark, d).where("kind = 'hint'"), "0").select("run_id", "seq", "reveals")


def _run_lists(spark, d):
    """Final states of runs with the stages that hints were spent on; skipped stages are taken as the first ones."""
    e = _events(spark, d)
    hinted = playlog.hint_stages(e).groupBy("run_id").agg(F.collect_set("stage").alias("hinted_stages"))
    none = F.array().cast("array<int>")
    skipped = F.when(F.col("skipped") > 0, F.sequence(F.lit(0), F.col("skipped") - 1)).otherwise(none)
    return playlog.fold(e).join(hinted, "run_id", "left").withColumns({"hinted_stages": F.coalesce("hinted_stages", none), "skipped_stages": skipped})


RUN_LISTS = f"""fr AS ({FOLD_SQL}), hs AS (SELECT run_id, list(DISTINCT stage) AS h FROM (SELECT run_id, hint, arg_min(stage, seq) AS stage FROM ev2 WHERE kind = 'hint' GROUP BY 1, 2) GROUP BY 1),
bd AS (SELECT fr.*, CAST(r.range AS INT) AS stage_at, r.range < skipped AS sk, coalesce(list_contains(h, CAST(r.range AS INT)), false) AS hi FROM fr LEFT JOIN hs USING (run_id) CROSS JOIN range(4) r)"""
EV2 = EVENTS.replace("ev AS (", "ev2 AS (", 1)


@query("stage_board", None)
def _(spark, d):
    return playlog.stage_board(_run_lists(spark, d))


SQL["stage_board"] = f"WITH {EV2}, {RUN_LISTS} SELECT run_id, stage_at, CASE WHEN sk THEN 'skipped' WHEN (won OR stage_at < stage) AND hi THEN 'hinted' WHEN won OR stage_at < stage THEN 'done' WHEN stage_at = stage THEN CASE WHEN done THEN 'failed' ELSE 'current' END ELSE CASE WHEN done THEN 'revealed' ELSE 'to do' END END AS state FROM bd"


@query("outcome_codes", None)
def _(spark, d):
    return playlog.outcome_codes(_run_lists(spark, d)).select("run_id", F.array_join(F.transform("codes", lambda c: c.cast("string")), "").alias("codes"), playlog.share_line(F.col("codes")).alias("line"))


SQL["outcome_codes"] = f"WITH {EV2}, {RUN_LISTS} SELECT run_id, string_agg(c, '' ORDER BY stage_at) AS codes, string_agg(CASE c WHEN 0 THEN '🟩' WHEN 1 THEN '🟨' WHEN 2 THEN '🟥' ELSE '⬜' END, '' ORDER BY stage_at) AS line FROM (SELECT run_id, stage_at, CASE WHEN sk THEN 2 WHEN won OR stage_at < stage THEN CASE WHEN hi THEN 1 ELSE 0 END WHEN stage_at = stage THEN 2 ELSE 3 END AS c FROM bd) GROUP BY 1"


@query("resolved_days", "u AS (SELECT user_id, CAST(ts AS DATE) AS date, event_id % 40 AS q FROM events) SELECT user_id, date FROM u LEFT JOIN team ON team_id = q AND q % 9 <> 0 GROUP BY 1, 2 HAVING count(*) = count(team_id)")
def _(spark, d):
    e = A.table(spark, d, "events").select("user_id", F.to_date("ts").alias("date"), (F.col("event_id") % 40).alias("qid"))
    return playlog.resolved_days(e, A.team(spark, d).where("team_id % 9 <> 0").select(F.col("team_id").alias("qid")))


@query("flags", "SELECT n_nationkey, chr(CAST(127462 + n_nationkey % 26 AS INT)) || chr(127462 + 1) AS flag FROM nation")
def _(spark, d):
    cc = F.concat(F.char(F.col("n_nationkey") % 26 + 65), F.lit("b"))
    return A.table(spark, d, "nation").select("n_nationkey", flag(cc).alias("flag"))


@query("thumbnails", "k AS (SELECT member_id, substr(md5('photo_' || member_id || '.jpg'), 1, 2) AS p FROM member WHERE img IS NOT NULL) SELECT member_id, 'base/' || p[1:1] || '/' || p || '/photo_' || member_id || '.jpg/120px-photo_' || member_id || '.jpg' AS link FROM k")
def _(spark, d):
    return A.member(spark, d).where("img IS NOT NULL").select("member_id", thumbnail(image_key(F.replace("img", F.lit(" "), F.lit("%20"))), "base").alias("link"))
