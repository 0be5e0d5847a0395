"""Queries: spells, postings, both directions of the co-membership question, careers, search. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterly.functions.names import MARKED, PLAIN, STOP, WRITTEN, core_display, core_name, dotted_initials, image_key, initials, search_name, sort_name
from rosterly.operators import blocks, career, clean, entity, gate, overlay, postings, search, solve, triples
from rosterly.sources import adapter as A
from rosterly.sources import export, stages

QUERIES, SQL = {}, {}
TEAMS, MEMBERS = [1, 2, 3], [5, 8]


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = A.oracle(sql)
        return f

    return keep


@query("spells_collapsed", "SELECT st, member_id, team_id, start_year, end_year, apps, goals, loan, seq FROM spells")
def _(spark, d):
    return A.spells(spark, d)


@query("postings", "SELECT * FROM posting")
def _(spark, d):
    return A.posting(spark, d)


BARE = "coalesce(start_year, end_year, apps, goals) IS NULL"


@query("bare_spells", f"SELECT st, member_id, team_id FROM bare_spells WHERE {BARE}")
def _(spark, d):
    return A.spells(spark, d, True).where(clean.is_bare()).select("st", "member_id", "team_id")


@query("richness", f"SELECT member_id, count(*) AS qualified, CAST(sum(CAST(apps IS NOT NULL AS INT) + CAST(goals IS NOT NULL AS INT)) AS BIGINT) AS stats FROM bare_spells WHERE NOT ({BARE}) GROUP BY 1")
def _(spark, d):
    return overlay.richness(A.spells(spark, d, True))


@query("membership_dropped", f"""SELECT pool, kept, pool - kept AS dropped FROM (SELECT count(DISTINCT member_id) AS pool FROM bare_statements), (SELECT count(DISTINCT member_id) AS kept FROM (SELECT team_id, member_id FROM bare_spells WHERE NOT ({BARE})))""")
def _(spark, d):
    st, sp = A.statements(spark, d, True), A.spells(spark, d, True)
    return postings.dropped_count(postings.membership_pool(st, sp), postings.posting_table(sp))


@query("team_sizes_distinct", "SELECT team_id, count(DISTINCT member_id) AS n FROM statements GROUP BY 1")
def _(spark, d):
    return A.statements(spark, d).groupBy("team_id").agg(F.count_distinct("member_id").alias("n"))


@query("member_ids", "SELECT member_id, name, row_number() OVER (ORDER BY name, member_id) - 1 AS dense_id FROM member")
def _(spark, d):
    return postings.dense_ids(A.member(spark, d).select("member_id", "name"), [F.coalesce("name", F.lit("￿")), "member_id"])


_T = ", ".join(map(str, TEAMS))
SOLVE = f"""c AS (SELECT p.member_id, m.name, birth, nat, img IS NOT NULL AS photo, gk, CAST(sum(apps) AS BIGINT) AS apps, CASE WHEN NOT gk THEN CAST(sum(goals) AS BIGINT) END AS goals,
  coalesce(bool_or(apps = 0), false) AS has_zero, NOT gk AND count(goals) = {len(TEAMS)} AND coalesce(sum(goals), -1) = 0 AS zero_goals
  FROM posting p JOIN member m USING (member_id) WHERE team_id IN ({_T}) GROUP BY p.member_id, m.name, birth, nat, img, gk HAVING count(DISTINCT team_id) = {len(TEAMS)})"""


def _common(spark, d):
    return solve.common_members(A.posting(spark, d, TEAMS), A.member(spark, d), TEAMS)


@query("solve_teams", SOLVE + " SELECT member_id, name, apps, goals, has_zero, zero_goals, row_number() OVER (ORDER BY coalesce(apps, 0) DESC, name, member_id) AS rank FROM c QUALIFY rank <= 50")
def _(spark, d):
    out = solve.page(_common(spark, d), solve.result_order("apps"))
    return out.select("member_id", "name", "apps", "goals", "has_zero", "zero_goals", "rank")


@query("solve_filtered", SOLVE + " SELECT member_id, apps, goals, birth FROM c WHERE birth BETWEEN 1950 AND 1990 AND NOT has_zero AND coalesce(nat, '') NOT IN ('NATION_1', 'NATION_2', '')")
def _(spark, d):
    return solve.without_nationalities(_common(spark, d).where(solve.keep(1950, 1990, True)), ["NATION_1", "NATION_2", ""]).select("member_id", "apps", "goals", "birth")


@query("solve_page_by_birth", SOLVE + " SELECT member_id, birth, row_number() OVER (ORDER BY birth DESC NULLS LAST, name, member_id) AS rank, greatest((SELECT count(*) FROM c) - 10, 0) AS remaining FROM c QUALIFY rank BETWEEN 6 AND 10")
def _(spark, d):
    return solve.page(_common(spark, d), solve.result_order("birth"), 5, 5).select("member_id", "birth", "rank", "remaining")


@query("nationality_facet", SOLVE + " SELECT coalesce(nat, '') AS nat, count(*) AS n FROM c WHERE birth >= 1950 AND NOT has_zero GROUP BY 1")
def _(spark, d):
    return solve.nationality_facet(_common(spark, d).where(solve.keep(1950, None, True)))


@query("solve_semi_joins", f"SELECT member_id FROM posting WHERE team_id IN ({_T}) GROUP BY 1 HAVING count(DISTINCT team_id) = {len(TEAMS)}")
def _(spark, d):
    return solve.common_members_by_semi_joins(A.posting(spark, d, TEAMS), TEAMS)


@query("solve_blocks", SOLVE + " SELECT member_id, name, apps, goals, has_zero, zero_goals FROM c")
def _(spark, d):
    index = blocks.write(blocks.blocked(A.posting(spark, d)), stages.new_path(spark, "rosters"))
    return blocks.common_members(index, A.member(spark, d), TEAMS).select("member_id", "name", "apps", "goals", "has_zero", "zero_goals")


@query("roster_blocks", f"""SELECT team_id, member_id // {blocks.WIDTH} AS bucket, min(member_id) AS first_id, max(member_id) AS last_id, count(*) AS n, string_agg(member_id - low, ',' ORDER BY member_id) AS steps
FROM (SELECT *, min(member_id) OVER (PARTITION BY team_id, member_id // {blocks.WIDTH}) AS low FROM posting) GROUP BY 1, 2""")
def _(spark, d):
    b = blocks.blocked(A.posting(spark, d))
    return b.select("team_id", "bucket", "first_id", "last_id", F.col("n").cast("bigint").alias("n"), F.array_join(F.transform("steps", lambda x: x.cast("string")), ",").alias("steps"))


@query("solve_bulk", """w AS (SELECT team_id // 3 AS query_id, team_id FROM team), s AS (SELECT query_id, count(*) AS k FROM w GROUP BY 1)
SELECT query_id, member_id, CAST(sum(apps) AS BIGINT) AS apps, CAST(sum(goals) AS BIGINT) AS goals FROM posting JOIN w USING (team_id) JOIN s USING (query_id) GROUP BY query_id, member_id, k HAVING count(*) = k""")
def _(spark, d):
    wanted = A.team(spark, d).select(F.floor(F.col("team_id") / 3).alias("query_id"), "team_id")
    return solve.bulk_common_members(A.posting(spark, d), wanted)


def _eff_sql(source: str) -> str:
    return f"""eff AS (SELECT * EXCLUDE (later), CASE WHEN start_year IS NOT NULL AND end_year IS NULL THEN coalesce(list_filter(later, lambda y: y >= start_year)[1], {A.BUILD_YEAR}) WHEN start_year IS NOT NULL THEN end_year END AS eff
  FROM (SELECT *, list(CASE WHEN NOT loan THEN start_year END) OVER (PARTITION BY member_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM {source}))"""


EFF = _eff_sql("spells")


@query("effective_end", EFF + " SELECT member_id, seq, CAST(eff AS INT) AS eff FROM eff")
def _(spark, d):
    return solve.effective_end(A.spells(spark, d), A.BUILD_YEAR).select("member_id", "seq", "eff")


_M = ", ".join(map(str, MEMBERS))
OWN = f"own AS (SELECT e.*, t.name AS team_name, m.gk FROM eff e JOIN team t USING (team_id) JOIN member m USING (member_id) WHERE member_id IN ({_M}))"
SHARED = f"shared AS (SELECT team_name FROM own GROUP BY 1 HAVING count(DISTINCT member_id) = {len(MEMBERS)})"


def _named(spark, d):
    eff = solve.effective_end(A.spells(spark, d), A.BUILD_YEAR)
    return eff.join(A.team(spark, d).select("team_id", F.col("name").alias("team_name")), "team_id").join(A.member(spark, d).select("member_id", "gk"), "member_id")


@query("shared_teams", f"{EFF}, {OWN} SELECT team_name, min(start_year) AS first_start, CAST(sum(apps) AS BIGINT) AS apps, CAST(sum(goals) AS BIGINT) AS goals FROM own GROUP BY 1 HAVING count(DISTINCT member_id) = {len(MEMBERS)}")
def _(spark, d):
    return solve.shared_teams(_named(spark, d), MEMBERS).orderBy(F.col("first_start").asc_nulls_last(), "team_name")


@query("teammate_window", f"""{EFF}, {OWN}, claim AS (SELECT team_name FROM own WHERE start_year IS NOT NULL AND eff IS NOT NULL GROUP BY 1 HAVING count(DISTINCT member_id) = {len(MEMBERS)}),
y AS (SELECT team_name, member_id, unnest(range(start_year, eff + 1)) AS year FROM own JOIN claim USING (team_name) WHERE start_year <= eff), t AS (SELECT team_name, year FROM y GROUP BY 1, 2 HAVING count(DISTINCT member_id) = {len(MEMBERS)}),
i AS (SELECT *, year - row_number() OVER (PARTITION BY team_name ORDER BY year) AS g FROM t)
SELECT team_name, CAST(min(year) AS INT) AS from_year, CAST(max(year) AS INT) AS to_year, max(year) >= {A.BUILD_YEAR} AS still FROM i GROUP BY team_name, g""")
def _(spark, d):
    return solve.teammate_years(_named(spark, d).where(F.col("member_id").isin(MEMBERS)), len(MEMBERS), A.BUILD_YEAR)


@query("shared_totals", f"""{EFF}, {OWN}, {SHARED} SELECT team_name, member_id, CAST(sum(apps) AS BIGINT) AS apps, CAST(sum(CASE WHEN NOT gk THEN goals END) AS BIGINT) AS goals, count(*) AS n_spells, CAST(grouping(team_name, member_id) AS BIGINT) AS level
FROM own JOIN shared USING (team_name) GROUP BY GROUPING SETS ((team_name, member_id), (team_name), (member_id), ())""")
def _(spark, d):
    return solve.shared_totals(_named(spark, d), MEMBERS)


LOANS = """l AS (SELECT s.*, coalesce(loan, false) OR EXISTS (SELECT 1 FROM spells b WHERE b.member_id = s.member_id AND b.seq < s.seq AND b.start_year <= s.start_year AND s.end_year <= b.end_year AND b.end_year - b.start_year > s.end_year - s.start_year) AS is_loan FROM spells s)"""


@query("inferred_loans", LOANS + " SELECT member_id, seq, is_loan FROM l")
def _(spark, d):
    return career.inferred_loans(A.spells(spark, d)).select("member_id", "seq", "is_loan")


SPAN = "CASE WHEN start_year IS NULL AND end_year IS NULL THEN '?' WHEN start_year = end_year THEN CAST(start_year AS VARCHAR) ELSE coalesce(CAST(start_year AS VARCHAR), '?') || '–' || coalesce(CAST(end_year AS VARCHAR), '') END"


@query("career_view", f"{LOANS} SELECT member_id, seq, t.name AS team_name, {SPAN} AS span, apps, CASE WHEN NOT gk THEN goals END AS goals, is_loan, team_id IN ({_T}) AS selected FROM l JOIN team t USING (team_id) JOIN member USING (member_id)")
def _(spark, d):
    team = A.team(spark, d).select("team_id", F.col("name").alias("team_name"))
    return career.career_view(A.spells(spark, d).join(team, "team_id"), A.member(spark, d), team.where(F.col("team_id").isin(TEAMS)))


@query("other_teams", f"""f AS (SELECT *, row_number() OVER (PARTITION BY member_id, team_id ORDER BY seq) AS f FROM spells WHERE team_id NOT IN (1, 2)), r AS (SELECT member_id, team_id, row_number() OVER (PARTITION BY member_id ORDER BY loan, greatest(coalesce(apps, 0), 0) DESC, start_year DESC NULLS LAST, seq) AS rank FROM f WHERE f = 1)
SELECT member_id, rank, t.name AS team_name FROM r JOIN team t USING (team_id) WHERE rank <= 2""")
def _(spark, d):
    team = A.team(spark, d).select("team_id", F.col("name").alias("team_name"))
    pair = ["Supplier#000000001", "Supplier#000000002"]
    return career.other_teams(A.spells(spark, d).join(team, "team_id"), pair)


@query("years_at_teams", f"SELECT member_id, t.name AS team_name, string_agg({SPAN}, ', ' ORDER BY seq) AS spans FROM spells JOIN team t USING (team_id) WHERE start_year IS NOT NULL AND end_year IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return career.years_at(A.spells(spark, d).join(A.team(spark, d).select("team_id", F.col("name").alias("team_name")), "team_id"))




def _fold_sql(x: str) -> str:
    return f"translate(lower({x}), '{MARKED}', '{PLAIN}')"


def _search_sql(x: str) -> str:
    out = f"lower({x})"
    for a, b in WRITTEN.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace(regexp_replace({_fold_sql(out)}, '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


NAMES = """n AS (SELECT doc_id, replace(text, chr(10), ' ') AS name FROM documents)"""


def _doc_names(spark, d):
    """Whole texts as names, for their letters."""
    return A.table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("name"))


@query("search_names", f"{NAMES} SELECT doc_id, {_search_sql('name')} AS search, array_to_string(list_transform(list_filter(string_split({_search_sql('name')}, ' '), lambda x: length(x) > 2), lambda x: x[1:1]), '') AS initials FROM n")
def _(spark, d):
    return _doc_names(spark, d).select("doc_id", search_name(F.col("name")).alias("search"), initials(F.col("name")).alias("initials"))


_STOP = ", ".join(f"'{x}'" for x in STOP)
CORE = f"array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace({_fold_sql('name')}, '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda x: x NOT IN ({_STOP}) AND NOT regexp_full_match(x, '(18|19|20)[0-9]{{2}}')), ' ')"


@query("core_names", f"SELECT team_id, {CORE} AS core FROM team")
def _(spark, d):
    return A.team(spark, d).select("team_id", core_name(F.col("name")).alias("core"))


@query("display_names", "SELECT team_id, CASE WHEN team_id % 10 = 9 THEN regexp_replace(regexp_replace(name, '^FC ', ''), ' 1909$', '') ELSE name END AS display, CASE WHEN team_id % 10 = 9 THEN 'supplier ' || printf('%09d', team_id - 1) || ' 1909' ELSE replace(lower(name), '#', ' ') END AS sort FROM team")
def _(spark, d):
    return A.team(spark, d).select("team_id", core_display(F.col("name")).alias("display"), sort_name(F.col("name")).alias("sort"))


@query("image_keys", "SELECT member_id, substr(md5(replace(img, ' ', '_')), 1, 2) || replace(img, ' ', '_') AS img_key, CASE WHEN name <> '' THEN name[1:1] || '.' END AS dots FROM member WHERE img IS NOT NULL")
def _(spark, d):
    m = A.member(spark, d).where("img IS NOT NULL")
    return m.select("member_id", image_key(F.replace("img", F.lit(" "), F.lit("%20"))).alias("img_key"), dotted_initials(F.col("name")).alias("dots"))


MERGES = f"""sized AS (SELECT t.*, {CORE} AS core, coalesce(n, 0) AS n FROM team t LEFT JOIN (SELECT team_id, count(*) AS n FROM posting GROUP BY 1) USING (team_id)),
merges AS (SELECT team_id, canonical FROM (SELECT team_id, first_value(team_id) OVER (PARTITION BY cc, core ORDER BY n DESC, team_id) AS canonical FROM sized) WHERE team_id <> canonical)"""


@query("merge_map", MERGES + " SELECT * FROM merges")
def _(spark, d):
    return entity.merge_map(A.team(spark, d), A.posting(spark, d))


@query("merged_postings", MERGES + """ SELECT coalesce(canonical, team_id) AS team_id, member_id, min(start_year) AS first_year, max(end_year) AS last_year, CAST(sum(apps) AS BIGINT) AS apps, CAST(sum(goals) AS BIGINT) AS goals
FROM spells LEFT JOIN merges USING (team_id) GROUP BY 1, 2 HAVING coalesce(min(start_year), max(end_year), sum(apps), sum(goals)) IS NOT NULL""")
def _(spark, d):
    return postings.posting_table(entity.canonical(A.spells(spark, d), entity.merge_map(A.team(spark, d), A.posting(spark, d))))


@query("lineages", MERGES + """, g AS (SELECT coalesce(canonical, team_id) AS c, t.* FROM team t LEFT JOIN merges USING (team_id)), p AS (SELECT c AS team_id, CAST(coalesce(bit_or(CASE WHEN cur_league IS NOT NULL THEN 1 << cur_league END), 0) AS INT) AS league_mask, max(cur_league) AS cur_league,
  CASE WHEN count(dissolved) = count(*) THEN max(dissolved) END AS dd FROM g GROUP BY 1) SELECT team_id, league_mask, cur_league, CASE WHEN cur_league IS NULL THEN dd END AS dissolved FROM p""")
def _(spark, d):
    team = A.team(spark, d)
    return entity.lineage(team, entity.merge_map(team, A.posting(spark, d)), team.where("cur_league IS NOT NULL").select("team_id", F.col("cur_league").alias("idx")))


@query("shown_names", MERGES + " SELECT t.team_id, coalesce(c.name, t.name, '') AS name FROM team t LEFT JOIN merges m USING (team_id) LEFT JOIN team c ON c.team_id = m.canonical")
def _(spark, d):
    team = A.team(spark, d)
    return entity.display_names(team, team.select("team_id", "name").where("false"), entity.merge_map(team, A.posting(spark, d)))


@query("shown_names_outside", MERGES + """, outs AS (SELECT team_id, 'Label ' || team_id AS name FROM team WHERE team_id % 4 = 3 UNION ALL SELECT team_id + 1000000, name FROM team WHERE team_id % 5 = 0)
SELECT team_id, coalesce(c.name, o.name, t.name, '') AS name FROM team t FULL JOIN outs o USING (team_id) LEFT JOIN merges m USING (team_id) LEFT JOIN team c ON c.team_id = m.canonical""")
def _(spark, d):
    """Some teams have a label from outside too, and some outside teams are no teams here."""
    team = A.team(spark, d)
    labels = team.where("team_id % 4 = 3").select("team_id", F.concat(F.lit("Label "), F.col("team_id").cast("string")).alias("name"))
    others = team.where("team_id % 5 = 0").select((F.col("team_id") + 1000000).alias("team_id"), "name")
    return entity.display_names(team, labels.unionByName(others), entity.merge_map(team, A.posting(spark, d)))


def _search_team(spark, d):
    n = A.posting(spark, d).groupBy("team_id").agg(F.count("*").alias("n"))
    return search.with_keys(A.team(spark, d)).join(n, "team_id").withColumn("league_mask", F.coalesce(F.call_function("shiftleft", F.lit(1), F.col("cur_league")), F.lit(0)))


@query("team_search", f"""k AS (SELECT t.*, n, {_search_sql('name')} AS search FROM team t JOIN (SELECT team_id, count(*) AS n FROM posting GROUP BY 1) USING (team_id)), r AS (SELECT *, CASE WHEN starts_with(search, 'supplier 00000000') THEN 0 WHEN contains(search, 'supplier 00000000') THEN 1 END AS rank FROM k)
SELECT team_id, rank FROM (SELECT *, CASE WHEN team_id % 10 = 9 AND starts_with(search[4:], 'supplier 00000000') THEN 0 ELSE rank END AS rank2 FROM r) WHERE rank2 IS NOT NULL
ORDER BY rank2, CASE WHEN dissolved IS NULL AND cur_league IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN dissolved IS NULL THEN 0 ELSE 1 END, n DESC, team_id LIMIT 8""".replace("SELECT team_id, rank FROM (SELECT *,", "SELECT team_id, rank2 AS rank FROM (SELECT *,"))
def _(spark, d):
    return search.team_matches(_search_team(spark, d), "Supplier#00000000").select("team_id", "rank")


@query("member_search", f"k AS (SELECT *, {_search_sql('name')} AS search FROM member) SELECT member_id FROM k WHERE contains(search, '00000012') ORDER BY CASE WHEN starts_with(search, '00000012') OR contains(search, ' 00000012') THEN 0 ELSE 1 END, CASE WHEN img IS NULL THEN 1 ELSE 0 END, name, member_id LIMIT 8")
def _(spark, d):
    return search.member_matches(search.with_keys(A.member(spark, d)), "00000012").select("member_id")


def _names_sql(table: str) -> str:
    return f"k AS (SELECT *, {_search_sql('name')} AS search FROM {table})"


@query("member_search_index", f"""{_names_sql('member')} SELECT member_id, CAST(CASE WHEN starts_with(search, '0012') OR contains(search, ' 0012') THEN 0 ELSE 1 END AS INT) AS rank FROM k WHERE contains(search, '0012')
ORDER BY rank, CASE WHEN img IS NULL THEN 1 ELSE 0 END, name, member_id LIMIT 8""")
def _(spark, d):
    member = search.with_keys(A.member(spark, d))
    index = triples.write(triples.postings(member, "member_id", ["search"]), stages.new_path(spark, "triples"))
    return search.member_matches(triples.candidates(index, member, "member_id", "0012"), "0012").select("member_id", "rank")


@query("team_search_index", f"""{_names_sql('team')}, s AS (SELECT k.*, n, CASE WHEN team_id % 10 = 9 THEN search[4:] ELSE search END AS sort FROM k JOIN (SELECT team_id, count(*) AS n FROM posting GROUP BY 1) USING (team_id)),
r AS (SELECT *, CAST(CASE WHEN starts_with(search, 'supplier 00000001') OR starts_with(sort, 'supplier 00000001') THEN 0 WHEN contains(search, 'supplier 00000001') THEN 1 END AS INT) AS rank FROM s)
SELECT team_id, rank FROM r WHERE rank IS NOT NULL ORDER BY rank, CASE WHEN dissolved IS NULL AND cur_league IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN dissolved IS NULL THEN 0 ELSE 1 END, n DESC, team_id LIMIT 8""")
def _(spark, d):
    team = _search_team(spark, d)
    index = triples.write(triples.postings(team, "team_id", ["search", "sort"], whole=["initials"]), stages.new_path(spark, "triples"))
    return search.team_matches(triples.candidates(index, team, "team_id", "Supplier#00000001"), "Supplier#00000001").select("team_id", "rank")


@query("letter_triples", f"""{_names_sql('member')} SELECT g AS triple, count(*) AS n FROM (SELECT DISTINCT member_id, substr(search, CAST(i AS INT), 3) AS g FROM (SELECT member_id, search, unnest(range(1, length(search) - 1)) AS i FROM k)) GROUP BY 1""")
def _(spark, d):
    return triples.postings(search.with_keys(A.member(spark, d)), "member_id", ["search"]).groupBy("triple").agg(F.count("*").alias("n"))


@query("browse_country", "SELECT team_id FROM team JOIN league ON dissolved IS NULL AND cur_league = idx WHERE league.cc = 'ASIA'")
def _(spark, d):
    return search.browse(_search_team(spark, d), A.league(spark, d), "ASIA").select("team_id")


@query("browse_others", "SELECT team_id FROM team JOIN league ON cur_league = idx WHERE league.cc IN ('ASIA', 'EUROPE') AND dissolved IS NOT NULL")
def _(spark, d):
    t, league = _search_team(spark, d), A.league(spark, d)
    return search.browse(t, league, "ASIA", others=True).select("team_id").union(search.browse(t, league, "EUROPE", others=True).select("team_id"))


@query("league_names", "SELECT team_id, league.name AS league FROM team JOIN league ON cur_league = idx")
def _(spark, d):
    return search.league_names(_search_team(spark, d), A.league(spark, d))


@query("links_restored", "SELECT s_suppkey AS link_id, CAST(pos AS INT) AS pos, t.team_id FROM supplier, (VALUES (0), (2)) v(pos), team t WHERE t.team_id = CASE pos WHEN 0 THEN s_suppkey ELSE s_suppkey - 1 END")
def _(spark, d):
    k = F.col("s_suppkey")
    link = A.table(spark, d, "supplier").select(k.alias("link_id"), F.concat_ws(",", k.cast("string"), F.lit("x"), (k - 1).cast("string")).alias("ids"))
    return search.restore(link, A.team(spark, d))


@query("rosters_round_trip", "SELECT team_id, member_id, apps, goals FROM posting")
def _(spark, d):
    return export.roster_import(export.roster_export(A.posting(spark, d)))


@query("roster_json", """x AS (SELECT team_id, member_id, apps, goals, member_id - lag(member_id, 1, 0) OVER (PARTITION BY team_id ORDER BY member_id) AS delta FROM posting)
SELECT team_id, '{"delta":[' || string_agg(delta, ',' ORDER BY member_id) || '],"apps":[' || string_agg(coalesce(apps, -1), ',' ORDER BY member_id) || '],"goals":[' || string_agg(coalesce(goals, -1), ',' ORDER BY member_id) || ']}' AS json FROM x GROUP BY 1""")
def _(spark, d):
    return export.index_json(export.roster_export(A.posting(spark, d)))


@query("career_shards", "SELECT CAST(member_id % 128 AS INT) AS shard, member_id, count(*) AS n, string_agg(team_id, ',' ORDER BY coalesce(start_year, 2147483647), coalesce(end_year, 2147483647), seq) AS teams FROM spells GROUP BY 1, 2")
def _(spark, d):
    c = export.career_shards(A.spells(spark, d))
    return c.select("shard", "member_id", F.size("spells").cast("bigint").alias("n"), F.array_join(F.transform("spells", lambda s: s["team_id"].cast("string")), ",").alias("teams"))


_AVG = "avg(CASE WHEN {} THEN 1.0::DOUBLE ELSE 0 END)".format


@query("build_metrics", f"""SELECT teams, members, round(gk_share, 9) AS gk_share, round(birth_share, 9) AS birth_share, postings, round(apps_coverage, 9) AS apps_coverage, longest_roster FROM (SELECT count(*) AS teams FROM team), (SELECT count(*) AS members, {_AVG('gk')} AS gk_share, {_AVG('birth IS NOT NULL')} AS birth_share FROM member),
(SELECT count(*) AS postings, {_AVG('apps IS NOT NULL')} AS apps_coverage FROM posting), (SELECT max(n) AS longest_roster FROM (SELECT count(*) AS n FROM posting GROUP BY team_id))""")
def _(spark, d):
    m = gate.metrics(A.team(spark, d), A.member(spark, d), A.posting(spark, d))
    r = lambda c: F.round(c, 9).alias(c)
    return m.select("teams", "members", r("gk_share"), r("birth_share"), "postings", r("apps_coverage"), "longest_roster")


@query("thinnest_rosters", f"SELECT team_id, round(coverage, 9) AS coverage, n, name FROM (SELECT team_id, {_AVG('apps IS NOT NULL')} AS coverage, count(*) AS n FROM posting GROUP BY 1 HAVING count(*) >= 30) JOIN team USING (team_id) ORDER BY round(coverage, 12), n, name LIMIT 12")
def _(spark, d):
    return gate.thinnest(A.posting(spark, d), A.team(spark, d)).select("team_id", F.round("coverage", 9).alias("coverage"), "n", "name")


@query("league_counts", "SELECT idx, l.name AS league, count(team_id) AS n FROM league l LEFT JOIN team t ON t.cur_league = l.idx AND dissolved IS NULL GROUP BY 1, 2")
def _(spark, d):
    return gate.league_counts(A.league(spark, d), A.team(spark, d))


@query("leagues_by_country", "SELECT cc, string_agg(name, ', ' ORDER BY idx) AS leagues, min(idx) AS first_idx FROM league GROUP BY 1")
def _(spark, d):
    return gate.leagues_by_country(A.league(spark, d))


@query("top_divisions", "SELECT cc, min(idx) AS idx FROM league GROUP BY 1")
def _(spark, d):
    return gate.top_divisions(A.league(spark, d))


@query("gate_violations", f"""SELECT 'league size' AS "check", league || ':' || n AS detail FROM (SELECT l.name AS league, count(team_id) AS n FROM league l LEFT JOIN team t ON t.cur_league = l.idx AND dissolved IS NULL GROUP BY 1) WHERE n NOT BETWEEN 17 AND 24
UNION ALL SELECT 'team without posting', CAST(team_id AS VARCHAR) FROM team ANTI JOIN posting USING (team_id) UNION ALL SELECT 'apps coverage', CAST(round(c, 4) AS VARCHAR) FROM (SELECT {_AVG('apps IS NOT NULL')} AS c FROM posting) WHERE c < 0.85""")
def _(spark, d):
    return gate.violations(A.team(spark, d), A.member(spark, d), A.posting(spark, d), A.league(spark, d))
