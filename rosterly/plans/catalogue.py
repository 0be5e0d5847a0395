"""Queries: landed pages and titles, attributes, exclusions, stage tables and shards, baselines, schedules, play archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterly.functions.names import image_key, thumbnail
from rosterly.operators import blocks, clean, entity, gate, hints, overlay, pairs, playlog, postings, schedule, search, solve
from rosterly.plans import puzzles, solving
from rosterly.sources import adapter as A
from rosterly.sources import batches, export, stages
from rosterly.sources import statements as S
from rosterly.streaming import live

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = A.oracle(puzzles._digits(sql))
        return f

    return keep


# Attributes and names.


@query("attributes_collapsed", """b AS (SELECT o_custkey AS member, CASE o_orderkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'mul' ELSE 'xx' END AS lang, o_orderstatus || o_orderkey AS label, CAST(year(o_orderdate) AS INT) AS birth, CAST(o_orderdate AS VARCHAR) AS img, o_orderstatus AS cc FROM orders)
SELECT member, coalesce(min(CASE WHEN lang = 'en' THEN label END), min(CASE WHEN lang = 'mul' THEN label END)) AS name, min(birth) AS birth, min(img[1:10]) AS img, array_to_string(list_sort(list(DISTINCT cc)), ',') AS ccs, bool_or(cc = 'P') AS gk FROM b GROUP BY 1""")
def _(spark, d):
    o = A.table(spark, d, "orders")
    lang = F.element_at(F.array(F.lit("en"), F.lit("mul"), F.lit("xx")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    none = F.lit(None).cast("string")
    bag = o.select(F.col("o_custkey").alias("member"), lang.alias("lang"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("label"), F.year("o_orderdate").alias("birth"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("img"), F.col("o_orderstatus").alias("cc"), none.alias("sport_cc"), none.alias("citizenship"), (F.col("o_orderstatus") == "P").alias("gk"))
    return clean.collapse_attributes(bag).select("member", "name", "birth", "img", F.array_join(F.sort_array("ccs"), ",").alias("ccs"), "gk")


@query("attributes_with_defaults", "SELECT s.member_id, coalesce(m.name, CAST(s.member_id AS VARCHAR)) AS name, birth, nat FROM (SELECT DISTINCT member_id FROM statements) s LEFT JOIN (SELECT * FROM member WHERE nat IS NOT NULL) m USING (member_id)")
def _(spark, d):
    known = A.member(spark, d).where("nat IS NOT NULL").select("member_id", "name", "birth", "nat")
    return entity.with_attributes(A.statements(spark, d).select("member_id").distinct(), known)


def _raw_teams(spark, d):
    """Teams by id and name: reserve, youth and women's sides among them, some named by their id or not at all."""
    tail = F.element_at(F.array(*map(F.lit, ["", " II", "", " U-19", "", " Women", "", " Academy"])), (F.col("s_nationkey") % 8 + 1).cast("int"))
    qid = F.concat(F.lit("Q"), F.col("s_suppkey").cast("string"))
    name = F.when(F.col("s_acctbal") < -500, qid).when(F.col("s_acctbal") > 9000, F.lit(None).cast("string")).otherwise(F.concat("s_name", tail))
    return A.table(spark, d, "supplier").select(qid.alias("qid"), name.alias("name"), "s_acctbal")


RAW_TEAMS = "rt AS (SELECT 'Q' || s_suppkey AS qid, s_acctbal, s_nationkey % 8 IN (1, 3, 5, 7) AS reserve FROM supplier)"


@query("usable_teams", RAW_TEAMS + " SELECT qid, NOT reserve AND s_acctbal >= -500 AND s_acctbal <= 9000 AND NOT (s_acctbal BETWEEN 0 AND 1000) AS kept FROM rt")
def _(spark, d):
    teams = _raw_teams(spark, d)
    kept, dropped = clean.usable_teams(teams.select("qid", "name"), teams.where("s_acctbal BETWEEN 0 AND 1000").select("qid"))
    return kept.select("qid", F.lit(True).alias("kept")).unionByName(dropped.select("qid", F.lit(False).alias("kept")))


@query("careers_without_national", f"SELECT st FROM bare_spells JOIN supplier ON s_suppkey = team_id WHERE NOT ({solving.BARE}) AND s_nationkey >= 5")
def _(spark, d):
    name = F.when(F.col("s_nationkey") < 5, F.concat("s_name", F.lit(" national under-21 team"))).otherwise(F.col("s_name"))
    team = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("team_id"), name.alias("team_name"))
    return clean.without_national(A.spells(spark, d, True).join(team, "team_id")).select("st")


# Joins of landed statements.


@query("restricted_batch", "SELECT st, team_id, apps FROM statements SEMI JOIN (SELECT member_id FROM member WHERE gk) USING (member_id)")
def _(spark, d):
    return S.restricted(A.statements(spark, d), A.member(spark, d).where("gk"), "member_id").select("st", "team_id", "apps")


@query("excluded_teams", "SELECT st, team_id FROM statements ANTI JOIN (SELECT team_id FROM team WHERE dissolved IS NOT NULL) USING (team_id)")
def _(spark, d):
    return S.excluded(A.statements(spark, d), A.team(spark, d).where("dissolved IS NOT NULL"), "team_id").select("st", "team_id")


@query("overlay_candidates", "SELECT DISTINCT member_id FROM spells SEMI JOIN (SELECT member_id FROM member WHERE birth >= 1970) USING (member_id)")
def _(spark, d):
    return overlay.overlay_candidates(A.spells(spark, d), A.member(spark, d).where("birth >= 1970"))


@query("current_leagues", solving.MERGES + ", cur AS (SELECT coalesce(canonical, t.team_id) AS team_id, min(cur_league) AS idx FROM team t LEFT JOIN merges USING (team_id) WHERE cur_league IS NOT NULL GROUP BY 1) SELECT team_id, CAST(idx AS INT) AS current_idx FROM team LEFT JOIN cur USING (team_id)")
def _(spark, d):
    team = A.team(spark, d)
    current = team.where("cur_league IS NOT NULL").select("team_id", F.col("cur_league").alias("idx"))
    return entity.with_current(team.select("team_id"), current, entity.merge_map(team, A.posting(spark, d)))


@query("stray_current", "SELECT c_custkey AS team_id FROM customer ANTI JOIN supplier ON s_suppkey = c_custkey")
def _(spark, d):
    return entity.stray_current(A.table(spark, d, "customer").select(F.col("c_custkey").alias("team_id")), A.team(spark, d))


# Pages and titles.


def _sitelinks(spark, d):
    """Members have a page in one language, the other, both or neither, by segment."""
    c = A.table(spark, d, "customer")
    one = lambda site, segments: c.where(F.col("c_mktsegment").isin(segments)).select(F.col("c_custkey").alias("s"), F.lit(site).alias("site"), F.concat(F.lit(f"{site}:"), "c_name").alias("title"))
    return one("en", ["BUILDING", "MACHINERY"]).union(one("de", ["MACHINERY", "HOUSEHOLD"]))


@query("page_titles", "SELECT c_custkey AS member_id, 'en:' || c_name AS title FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(spark, d):
    return S.page_titles(A.member(spark, d).select("member_id"), _sitelinks(spark, d), "en").select("member_id", "title")


@query("page_links", "SELECT c_custkey AS member_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'en:' || c_name WHEN c_mktsegment = 'HOUSEHOLD' THEN 'de:' || c_name END AS title FROM customer")
def _(spark, d):
    return S.page_in(A.member(spark, d).select("member_id"), _sitelinks(spark, d), "en", "de")


def _landed(df, schema: str):
    """Rows as the JSON text in which they land, read with the explicit schema."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json")).select(F.from_json("json", schema).alias("r")).select("r.*")


@query("page_texts", "SELECT url AS title, html AS content FROM pages WHERE length(html) % 5 <> 0")
def _(spark, d):
    p = A.table(spark, d, "pages")
    version = F.when(F.length("html") % 5 != 0, F.array(F.struct(F.col("html").alias("content")))).otherwise(F.array().cast("array<struct<content: string>>"))
    landed = p.groupBy(F.xxhash64("url") % 16).agg(F.collect_list(F.struct(F.col("url").alias("title"), version.alias("revisions"))).alias("pages")).select("pages")
    return S.page_text(_landed(landed, S.PAGES))


@query("pages_of_members", "m AS (SELECT 'P' || n_nationkey || '-' || c_mktsegment AS title, max(c_custkey) AS member_id FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT member_id, 'about ' || title AS content FROM m")
def _(spark, d):
    title = F.concat(F.lit("P"), F.col("c_nationkey").cast("string"), F.lit("-"), F.col("c_mktsegment"))
    members = A.table(spark, d, "customer").select(F.col("c_custkey").alias("member_id"), title.alias("title"))
    texts = members.select("title").distinct().union(spark.sql("SELECT 'nobody'")).select("title", F.concat(F.lit("about "), "title").alias("content"))
    return S.pages_of(members, texts)


def _responses(spark, d):
    """What a title service answers: each team's title is asked for in its written form and by an old name."""
    t = A.team(spark, d).select("team_id", F.replace("name", F.lit("#"), F.lit(" ")).alias("title"))
    plain, old = F.replace("title", F.lit(" "), F.lit("_")), F.concat(F.lit("Old "), "title")
    hop = lambda a, b: F.array(F.struct(a.alias("from"), b.alias("to")))
    answer = t.select(hop(plain, F.col("title")).alias("normalized"), F.when(F.col("team_id") % 4 == 0, hop(old, F.col("title"))).alias("redirects"), F.array(F.struct("title", F.when(F.col("team_id") % 3 != 0, F.col("team_id").cast("string")).alias("item"))).alias("pages"))
    return t.select(F.explode(F.array(plain, old, F.col("title"))).alias("title")), _landed(answer, S.TITLES)


RESOLVED = "r AS (SELECT v.title, CASE WHEN team_id % 3 <> 0 AND (v.title NOT LIKE 'Old %' OR team_id % 4 = 0) THEN CAST(team_id AS VARCHAR) END AS qid FROM (SELECT team_id, replace(name, '#', ' ') AS name FROM team) t, LATERAL (VALUES (t.name), (replace(t.name, ' ', '_')), ('Old ' || t.name)) v(title))"


@query("titles_from_responses", RESOLVED + " SELECT DISTINCT title, qid FROM r")
def _(spark, d):
    asked, responses = _responses(spark, d)
    return overlay.resolve_titles(asked, *S.title_maps(responses))


@query("unresolved_titles", RESOLVED + " SELECT count(*) AS unresolved FROM (SELECT DISTINCT title, qid FROM r) WHERE qid IS NULL")
def _(spark, d):
    asked, responses = _responses(spark, d)
    return overlay.unresolved(overlay.resolve_titles(asked, *S.title_maps(responses)))


# Stage tables, shards, stamps.


def _folder(spark, name: str) -> str:
    """A folder of its own for each call."""
    return stages.new_path(spark, name)


@query("stage_round_trip", "SELECT * FROM posting")
def _(spark, d):
    folder = _folder(spark, "stages")
    stages.save(A.posting(spark, d), folder, "postings")
    return stages.load(spark, folder, "postings")


@query("resumed_stage", "SELECT member_id, count(*) AS n FROM spells GROUP BY 1")
def _(spark, d):
    """Two runs: the first is given some members, the second all, and takes only those that are missing."""
    spells, path = A.spells(spark, d), stages.new_path(spark, "resume")
    count = lambda keys: spells.join(keys.select("member_id"), "member_id", "left_semi").groupBy("member_id").agg(F.count("*").alias("n"))
    members = spells.select("member_id").distinct()
    stages.resume(members.where("member_id < 500"), "member_id", count, path)
    return stages.resume(members, "member_id", count, path)


@query("career_of_member", "SELECT member_id, unnest(list(team_id ORDER BY coalesce(start_year, 2147483647), coalesce(end_year, 2147483647), seq)) AS team_id FROM spells WHERE member_id = 130 GROUP BY 1")
def _(spark, d):
    path = _folder(spark, "careers")
    export.write_careers(export.career_shards(A.spells(spark, d)), path)
    return export.read_career(spark, path, 130).select("member_id", F.explode("spells.team_id").alias("team_id"))


@query("missing_shards", "SELECT CAST(range AS INT) AS shard FROM range(2048) ANTI JOIN (SELECT DISTINCT member_id % 2048 AS range FROM spells) USING (range)")
def _(spark, d):
    return gate.missing_shards(export.career_shards(A.spells(spark, d), 2048), 2048)


@query("dataset_stamp")
def _(spark, d):
    return stages.stamp(A.table(spark, d, "lineitem"))


@query("dry_run", "SELECT member_id, name FROM member ORDER BY member_id LIMIT 50")
def _(spark, d):
    return stages.dry_run(A.member(spark, d).select("member_id", "name"), "member_id", 50)


@query("whole_index", """SELECT 'team' AS part, team_id AS key, (SELECT count(*) FROM posting p WHERE p.team_id = t.team_id) AS n FROM team t UNION ALL SELECT 'member', member_id, 0 FROM member UNION ALL SELECT 'league', idx, 0 FROM league UNION ALL SELECT 'goalkeeper', member_id, 0 FROM member WHERE gk""")
def _(spark, d):
    index = export.whole_index(A.team(spark, d), A.member(spark, d), A.league(spark, d), export.roster_export(A.posting(spark, d)))
    return index.select("part", "key", F.coalesce(F.json_array_length(F.get_json_object("json", "$.delta")), F.lit(0)).cast("bigint").alias("n"))


@query("goalkeepers", "SELECT CAST(key AS BIGINT) AS member_id FROM (SELECT member_id AS key FROM member WHERE gk)")
def _(spark, d):
    index = export.whole_index(A.team(spark, d), A.member(spark, d), A.league(spark, d), export.roster_export(A.posting(spark, d)))
    return index.where("part = 'goalkeeper'").select(F.get_json_object("json", "$.member_id").cast("bigint").alias("member_id"))


# Gates against a baseline.


def _metrics_sql(name: str, team: str, posting: str) -> str:
    return f"{name} AS (SELECT (SELECT count(*) FROM {team}) AS teams, (SELECT count(*) FROM member) AS members, (SELECT avg(CASE WHEN apps IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) FROM {posting}) AS cov)"


@query("regressions", f"""alive AS (SELECT * FROM team WHERE dissolved IS NULL), bare_posting AS (SELECT team_id, member_id, sum(apps) AS apps FROM bare_spells GROUP BY 1, 2), {_metrics_sql('now', 'alive', 'bare_posting')}, {_metrics_sql('old', 'team', 'posting')}
SELECT 'fewer teams' AS "check", CAST(now.teams AS VARCHAR) AS detail FROM now, old WHERE now.teams < old.teams * 0.97 UNION ALL SELECT 'fewer members', CAST(now.members AS VARCHAR) FROM now, old WHERE now.members < old.members * 0.97
UNION ALL SELECT 'apps coverage fell', CAST(round(now.cov, 4) AS VARCHAR) FROM now, old WHERE now.cov < old.cov - 0.02""")
def _(spark, d):
    team, member = A.team(spark, d), A.member(spark, d)
    bare = A.spells(spark, d, True).groupBy("team_id", "member_id").agg(F.sum("apps").alias("apps"), F.sum("goals").alias("goals"))
    return gate.regressions(gate.metrics(team.where("dissolved IS NULL"), member, bare), gate.metrics(team, member, A.posting(spark, d)))


SQL["regressions_of_builds"] = f"""WITH f AS ({SQL['regressions']}) SELECT CAST(build AS INT) AS build, "check", detail FROM f, (VALUES (2), (3)) b(build)"""


@query("regressions_of_builds")
def _(spark, d):
    """Four builds against the stored baseline: whole, reduced, reduced again, whole."""
    team, member = A.team(spark, d), A.member(spark, d)
    bare = A.spells(spark, d, True).groupBy("team_id", "member_id").agg(F.sum("apps").alias("apps"), F.sum("goals").alias("goals"))
    whole, reduced = stages.stored(gate.metrics(team, member, A.posting(spark, d))), stages.stored(gate.metrics(team.where("dissolved IS NULL"), member, bare))  # a row each
    folder = stages.new_path(spark, "builds")
    found = [gate.against_stored(m, folder).withColumn("build", F.lit(k)) for k, m in enumerate((whole, reduced, reduced, whole), 1)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).select("build", "check", "detail")


@query("thumbnails_of_kinds", """k AS (SELECT member_id, 'photo_' || member_id || '_(a' AS f, ['.svg', '.TIFF', '.tif', '.pdf', '.PNG'][member_id % 5 + 1] AS ext FROM member WHERE img IS NOT NULL), h AS (SELECT *, md5(f || '&b)' || ext)[1:2] AS p, f || '%26b)' || ext AS c FROM k)
SELECT member_id, 'base/' || p[1:1] || '/' || p || '/' || c || '/' || CASE member_id % 5 WHEN 0 THEN '120px-' || c || '.png' WHEN 3 THEN 'page1-120px-' || c || '.jpg' WHEN 4 THEN '120px-' || c ELSE 'lossy-page1-120px-' || c || '.jpg' END AS link FROM h""")
def _(spark, d):
    """Images of all kinds that get another extension, with signs in their names that are coded and that are not."""
    kind = F.element_at(F.array(*map(F.lit, (".svg", ".TIFF", ".tif", ".pdf", ".PNG"))), (F.col("member_id") % 5 + 1).cast("int"))
    img = F.concat(F.regexp_replace(F.replace("img", F.lit(" "), F.lit("%20")), "[.]jpg$", "%20(a%26b)"), kind)
    return A.member(spark, d).where("img IS NOT NULL").select("member_id", thumbnail(image_key(img), "base").alias("link"))


@query("image_key_violations", """SELECT 'image key' AS "check", CAST(member_id AS VARCHAR) AS detail FROM member WHERE img IS NOT NULL AND birth IS NULL""")
def _(spark, d):
    key = F.when(F.col("birth").isNull(), F.col("img")).otherwise(image_key(F.replace("img", F.lit(" "), F.lit("%20"))))
    return gate.violations(A.team(spark, d), A.member(spark, d).withColumn("img_key", key), A.posting(spark, d), A.league(spark, d)).where("check = 'image key'")


@query("gate_report")
def _(spark, d):
    return gate.report(gate.violations(A.team(spark, d), A.member(spark, d), A.posting(spark, d), A.league(spark, d)))


SQL["gate_report"] = f"WITH g AS ({solving.SQL['gate_violations']}) SELECT \"check\", detail, (SELECT count(*) FROM g) AS failures FROM g ORDER BY \"check\", detail LIMIT 20"


# Records, orders and draws.


@query("shared_team_records", f"""{solving.EFF}, {solving.OWN}, {solving.SHARED}, x AS (SELECT name AS team_name, arg_max(team_id, team_id) AS team_id, arg_max(cc, team_id) AS cc, arg_max(CASE WHEN dissolved IS NULL THEN coalesce(cur_league, -1) ELSE -1 END, team_id) AS idx FROM team GROUP BY 1)
SELECT team_name, team_id, x.cc, coalesce(l.name, 'Others') AS league FROM shared LEFT JOIN x USING (team_name) LEFT JOIN league l USING (idx)""")
def _(spark, d):
    shared = solve.shared_teams(solving._named(spark, d), solving.MEMBERS).select("team_name")
    return solve.team_records(shared, A.team(spark, d), A.league(spark, d))


@query("team_records", """x AS (SELECT CASE WHEN s_nationkey < 12 THEN s_name ELSE 'One ' || cc END AS name, team_id, cc, CASE WHEN dissolved IS NULL THEN cur_league END AS idx FROM team JOIN supplier ON s_suppkey = team_id), y AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY team_id DESC) AS r FROM x)
SELECT y.name AS team_name, team_id, y.cc, coalesce(l.name, 'Others') AS league FROM y LEFT JOIN league l USING (idx) WHERE r = 1""")
def _(spark, d):
    own = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("team_id"), "s_name", "s_nationkey")
    team = A.team(spark, d).join(own, "team_id").withColumn("name", F.when(F.col("s_nationkey") < 12, F.col("s_name")).otherwise(F.concat(F.lit("One "), "cc")))
    return solve.team_records(team.select(F.col("name").alias("team_name")).distinct(), team, A.league(spark, d))


@query("names_collated", "SELECT member_id, name, row_number() OVER (ORDER BY name, member_id) - 1 AS dense_id FROM member")
def _(spark, d):
    return postings.dense_ids(A.member(spark, d).select("member_id", "name"), [F.collate("name", "UNICODE"), "member_id"])


@query("names_collated_accented", """k AS (SELECT member_id, ['e', 'É', 'f', 'Z', 'ö', 'z'][member_id % 6 + 1] AS head FROM member)
SELECT member_id, head || 'n ' || name AS name, row_number() OVER (ORDER BY lower(strip_accents(head)), name, strip_accents(head) <> head, head <> lower(head), member_id) - 1 AS dense_id FROM k JOIN member USING (member_id)""")
def _(spark, d):
    """Names that begin with accented, small and capital letters: a binary order would put capitals first, accents last."""
    head = F.element_at(F.array(*map(F.lit, ("e", "É", "f", "Z", "ö", "z"))), (F.col("member_id") % 6 + 1).cast("int"))
    named = A.member(spark, d).select("member_id", F.concat(head, F.lit("n "), "name").alias("name"))
    return postings.dense_ids(named, [F.collate("name", "UNICODE"), "member_id"])


@query("team_search_aliases", """k AS (SELECT t.*, n FROM team t JOIN (SELECT team_id, count(*) AS n FROM posting GROUP BY 1) USING (team_id))
SELECT team_id, CAST(0 AS INT) AS rank FROM k WHERE cc = 'AFRICA' ORDER BY CASE WHEN dissolved IS NULL AND cur_league IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN dissolved IS NULL THEN 0 ELSE 1 END, n DESC, team_id LIMIT 8""")
def _(spark, d):
    team = solving._search_team(spark, d).withColumn("aliases", F.array(F.concat(F.lit("pride of "), F.lower("cc"))))
    return search.team_matches(team, "Pride of Afri").select("team_id", "rank")


@query("team_search_initials", """k AS (SELECT t.*, n FROM team t JOIN (SELECT team_id, count(*) AS n FROM posting GROUP BY 1) USING (team_id))
SELECT team_id, CAST(0 AS INT) AS rank FROM k WHERE team_id % 10 = 9 ORDER BY CASE WHEN dissolved IS NULL AND cur_league IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN dissolved IS NULL THEN 0 ELSE 1 END, n DESC, team_id LIMIT 8""")
def _(spark, d):
    return search.team_matches(solving._search_team(spark, d), "s01").select("team_id", "rank")


PAIR_SIZES = "ps AS (SELECT a.team_id AS team_a, b.team_id AS team_b, count(*) AS n FROM posting a JOIN posting b ON a.member_id = b.member_id AND a.team_id < b.team_id GROUP BY 1, 2)"


def _pair_sizes(spark, d, teams=None):
    return pairs.pair_counts(A.posting(spark, d), teams)


@query("random_pair", PAIR_SIZES + """, top AS (SELECT min(idx) AS cur_league FROM league GROUP BY cc), good AS (SELECT team_id FROM team SEMI JOIN top USING (cur_league) WHERE dissolved IS NULL)
SELECT team_a, team_b, n FROM ps SEMI JOIN good a ON a.team_id = team_a SEMI JOIN good b ON b.team_id = team_b ORDER BY md5(concat_ws('|', 'seed 7', team_a, team_b)), team_a, team_b LIMIT 1""")
def _(spark, d):
    team, top = A.team(spark, d), gate.top_divisions(A.league(spark, d))
    good = stages.stored(schedule.askable(team, top))
    return schedule.random_pair(pairs.pair_counts(A.posting(spark, d, good)), team, top, "seed 7")


@query("reveal", puzzles.ANSWERS + " SELECT team_a, team_b, member_id, rank, greatest(others + 1 - 10, 0) AS more FROM ranked WHERE rank <= 10")
def _(spark, d):
    return pairs.reveal(puzzles._ranked(spark, d, 10)).select("team_a", "team_b", "member_id", "rank", "more")


@query("pair_keys", PAIR_SIZES + " SELECT team_a || '-' || team_b AS pair, n FROM ps")
def _(spark, d):
    """In order of the pair in each task, where pairs already are: neighbouring keys begin alike, so less is written. One number
    is sorted, which costs less than two; ids beyond 32 bits only make the order less good."""
    ordered = _pair_sizes(spark, d).sortWithinPartitions(F.shiftleft("team_a", 32).bitwiseOR(F.col("team_b")))
    return ordered.select(pairs.pair_key(F.col("team_b"), F.col("team_a")).alias("pair"), "n")


@query("puzzle_fallbacks", f"{puzzles.SIZES}, {puzzles.POOLS}, {PAIR_SIZES} SELECT team_a, team_b, CAST(-1 AS INT) AS tier, ps.n FROM ps JOIN pools a ON a.team_id = team_a JOIN pools b ON b.team_id = team_b WHERE a.star AND b.star AND a.cc = b.cc")
def _(spark, d):
    pools = stages.stored(puzzles._pools(spark, d))
    return schedule.fallbacks(_pair_sizes(spark, d, pools.where("star").select("team_id", "cc")), pools)


def _schedule(spark, d, days: int):
    """The first days of a block under cool-down rules, postings as careers, and the sizes of teams. No facts of pairs are
    stored; fallbacks are looked for only when a day is left with nothing else."""
    cands, careers, sizes = puzzles._kept_cands(spark, d)

    def spare():
        pools = stages.stored(pairs.pools(sizes, star=500, sub=120, obs=520))
        answering = pairs.postings_of(careers).where(~F.coalesce(F.col("apps") == 0, F.lit(False)))
        return schedule.fallbacks(pairs.pair_counts(answering, pools.where("star").select("team_id", "cc")), pools).select("tier", "team_a", "team_b")

    return schedule.schedule_block(cands, "2024-01-01", days, sizes.select("team_id", F.col("cc").alias("league_cc")), spare), careers, sizes


#: Step by step: the first candidate of a day and stage that the draws before leave free, rungs before fallbacks. Of each step
#: the first 1,000 are looked at: at most 22 teams and 40 pairs are forbidden at a time.
SCHEDULE = puzzles.CANDS + """, spare AS (SELECT f.team_a, f.team_b FROM facts f JOIN pools a ON a.team_id = f.team_a JOIN pools b ON b.team_id = f.team_b WHERE a.star AND b.star AND a.cc = b.cc),
pool AS (SELECT stage, tier, p.team_a, p.team_b, s.cc, false AS late FROM cands p JOIN sizes s ON s.team_id = p.team_a UNION ALL SELECT CAST(k.range AS INT), CAST(-1 AS INT), p.team_a, p.team_b, s.cc, true FROM spare p JOIN sizes s ON s.team_id = p.team_a, range(4) k),
steps AS (SELECT range AS step, CAST(range % 4 AS INT) AS stage, DATE '2024-01-01' + CAST(range // 4 AS INT) AS date FROM range(4 * {DAYS})),
ord AS (SELECT step, tier, team_a, team_b, row_number() OVER (PARTITION BY step ORDER BY late, tier, md5(concat_ws('|', date, stage, cc)), md5(concat_ws('|', date, stage, team_a, team_b)), team_a, team_b) AS r FROM pool JOIN steps USING (stage)),
lists AS MATERIALIZED (SELECT step, list({'tier': tier, 'a': team_a, 'b': team_b} ORDER BY r) AS l FROM ord WHERE r <= 1000 GROUP BY 1),
walk AS (SELECT CAST(-1 AS BIGINT) AS step, CAST(NULL AS STRUCT(tier INT, a BIGINT, b BIGINT)) AS x, CAST([] AS STRUCT(step BIGINT, a BIGINT, b BIGINT)[]) AS past
UNION ALL SELECT step, x, CASE WHEN x IS NULL THEN past ELSE list_append(past, {'step': step, 'a': x.a, 'b': x.b}) END FROM (
  SELECT step, past, list_filter(l, lambda c: NOT list_contains(used, c.a) AND NOT list_contains(used, c.b) AND NOT list_contains(banned, least(c.a, c.b) || '-' || greatest(c.a, c.b)))[1] AS x FROM (
    SELECT w.step + 1 AS step, w.past, l, flatten(list_transform(list_filter(w.past, lambda h: (w.step + 1) // 4 - h.step // 4 <= 2), lambda h: [h.a, h.b])) AS used,
      list_transform(list_filter(w.past, lambda h: (w.step + 1) // 4 - h.step // 4 BETWEEN 1 AND 10), lambda h: least(h.a, h.b) || '-' || greatest(h.a, h.b)) AS banned
    FROM walk w LEFT JOIN lists ON lists.step = w.step + 1 WHERE w.step < 4 * {DAYS} - 1))),
plan AS (SELECT CAST(DATE '2024-01-01' + CAST(step // 4 AS INT) AS DATE) AS date, CAST(step % 4 AS INT) AS stage, x.tier AS tier, x.a AS team_a, x.b AS team_b FROM walk WHERE x IS NOT NULL)"""


@query("puzzle_schedule")
def _(spark, d):
    """A block of 90 days."""
    return _schedule(spark, d, schedule.BLOCK_DAYS)[0]


SQL["puzzle_schedule"] = A.oracle(puzzles._digits(SCHEDULE.replace("{DAYS}", "90") + " SELECT * FROM plan")).replace("WITH ", "WITH RECURSIVE ", 1)


@query("schedule_calibration")
def _(spark, d):
    plan, careers, sizes = _schedule(spark, d, schedule.BLOCK_DAYS)
    return schedule.calibration(plan, puzzles._facts_of_drawn(spark, d, plan, careers, sizes)).withColumnsRenamed({str(k): f"stage_{k}" for k in range(4)})


SQL["schedule_calibration"] = A.oracle(puzzles._digits(SCHEDULE.replace("{DAYS}", "90") + """, tx AS (SELECT date, stage, printf('%d-%d n=%d ease=%.2f tier=%d best=%d', p.team_a, p.team_b, f.n, dg2(f.ease), tier, f.representative) AS t
FROM plan p JOIN facts f ON f.team_a = least(p.team_a, p.team_b) AND f.team_b = greatest(p.team_a, p.team_b))
SELECT date, """ + ", ".join(f"max(CASE WHEN stage = {k} THEN t END) AS stage_{k}" for k in range(4)) + " FROM tx GROUP BY 1")).replace("WITH ", "WITH RECURSIVE ", 1)


@query("puzzle_calibration", puzzles.CANDS + f""", days AS (SELECT CAST(range AS DATE) AS date FROM range(DATE '2024-01-01', DATE '2024-01-15', INTERVAL 1 DAY)), fd AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY stage) AS low FROM cands) WHERE tier = low),
dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, stage ORDER BY md5(concat_ws('|', date, stage, cc)), md5(concat_ws('|', date, stage, team_a, team_b)), team_a, team_b) AS r FROM days, fd JOIN (SELECT team_id, cc FROM sizes) s ON s.team_id = fd.team_a) WHERE r = 1),
tx AS (SELECT date, stage, printf('%d-%d n=%d ease=%.2f tier=%d best=%d', dr.team_a, dr.team_b, dr.n, dr.ease, tier, f.representative) AS t FROM dr JOIN facts f ON f.team_a = least(dr.team_a, dr.team_b) AND f.team_b = greatest(dr.team_a, dr.team_b))
SELECT date, {', '.join(f"max(CASE WHEN stage = {k} THEN t END) AS stage_{k}" for k in range(4))} FROM tx GROUP BY 1""")
def _(spark, d):
    cands, careers, sizes = puzzles._kept_cands(spark, d)
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-01-14')) AS date")
    drawn = stages.stored(puzzles._draws(cands, sizes, days).select("date", "stage", "tier", "team_a", "team_b"))  # few rows
    return schedule.calibration(drawn, puzzles._facts_of_drawn(spark, d, drawn, careers, sizes)).withColumnsRenamed({str(k): f"stage_{k}" for k in range(4)})


@query("random_question", """top AS (SELECT min(idx) AS cur_league FROM league GROUP BY cc), good AS (SELECT team_id FROM team SEMI JOIN top USING (cur_league) WHERE dissolved IS NULL),
d0 AS (SELECT size, draw, team_id FROM good, (VALUES (2), (3)) s(size), range(64) r(draw)),
p0 AS (SELECT size, draw, arg_min(team_id, md5(concat_ws('|', 'seed 9|' || size, draw, 0, team_id))) AS team_id FROM d0 GROUP BY 1, 2),
p1 AS (SELECT size, draw, arg_min(team_id, md5(concat_ws('|', 'seed 9|' || size, draw, 1, team_id))) AS team_id FROM d0 ANTI JOIN p0 USING (size, draw, team_id) GROUP BY 1, 2),
p2 AS (SELECT size, draw, arg_min(team_id, md5(concat_ws('|', 'seed 9|' || size, draw, 2, team_id))) AS team_id FROM d0 ANTI JOIN (SELECT * FROM p0 UNION ALL SELECT * FROM p1) USING (size, draw, team_id) WHERE size = 3 GROUP BY 1, 2),
dr AS (SELECT *, 0 AS place FROM p0 UNION ALL SELECT *, 1 FROM p1 UNION ALL SELECT *, 2 FROM p2),
ne AS (SELECT size, draw, count(*) AS n FROM (SELECT size, draw, member_id FROM dr JOIN posting USING (team_id) GROUP BY 1, 2, 3 HAVING count(*) = size) GROUP BY 1, 2),
one AS (SELECT * FROM ne ORDER BY size DESC, draw LIMIT 1)
SELECT team_id, CAST(place AS INT) AS place, n FROM dr JOIN one USING (size, draw)""")
def _(spark, d):
    posting = stages.stored(A.posting(spark, d))
    return schedule.random_question(posting, A.team(spark, d), gate.top_divisions(A.league(spark, d)), "seed 9")


@query("random_members", """fit AS (SELECT member_id, birth FROM member WHERE img IS NOT NULL AND birth IS NOT NULL), pl AS (SELECT a.member_id AS anchor, p.team_id, b.member_id, md5(concat_ws('|', 'seed 4', a.member_id)) AS h1, md5(concat_ws('|', 'seed 4', a.member_id, p.team_id)) AS h2, md5(concat_ws('|', 'seed 4', a.member_id, p.team_id, b.member_id)) AS h3
  FROM (SELECT * FROM fit ORDER BY md5(concat_ws('|', 'seed 4', member_id)), member_id LIMIT 64) a JOIN posting p USING (member_id) JOIN posting q USING (team_id) JOIN fit b ON b.member_id = q.member_id AND abs(b.birth - a.birth) <= 2 AND b.member_id <> a.member_id),
w AS (SELECT anchor, team_id FROM pl ORDER BY h1, anchor, h2, team_id LIMIT 1), f AS (SELECT pl.* FROM pl JOIN w USING (anchor, team_id) ORDER BY h3, member_id LIMIT 2)
SELECT DISTINCT team_id, unnest([anchor, member_id]) AS member_id FROM f""")
def _(spark, d):
    return schedule.random_members(stages.stored(A.posting(spark, d)), A.member(spark, d), "seed 4")


@query("block_violations", f"""b AS (SELECT team_id, member_id // {blocks.WIDTH} AS bucket, max(member_id) AS top FROM (SELECT team_id, member_id FROM posting UNION ALL SELECT -1, member_id FROM member WHERE gk) GROUP BY 1, 2)
SELECT 'id out of range' AS "check", team_id || '-' || bucket AS detail FROM b WHERE top >= (SELECT count(*) FROM member) - 5""")
def _(spark, d):
    none = F.lit(None).cast("bigint")
    keepers = A.member(spark, d).where("gk").select(F.lit(-1).cast("bigint").alias("team_id"), "member_id", none.alias("apps"), none.alias("goals"))
    every = A.posting(spark, d).select("team_id", "member_id", "apps", "goals").unionByName(keepers)
    return gate.block_violations(blocks.blocked(every), A.table(spark, d, "customer").count() - 5, blocks.WIDTH)


def _question(events):
    """The pair of each run and stage: one of five teams by the user, one of four by the stage."""
    runs = events.select("run_id", "user_id").distinct()
    return runs.select("run_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("stage"), (1 + F.pmod("user_id", F.lit(5))).cast("bigint").alias("team_a")).withColumn("team_b", (6 + F.col("stage")).cast("bigint"))


def _hinted(spark, d):
    """Events with named hints, the questions, the two most famous answers of their pairs, and all answers."""
    name = F.element_at(F.array(F.lit(hints.FIRST), F.lit(hints.SECOND), F.lit(hints.NATIONALITIES)), F.col("hint").cast("int") + 1)
    events = puzzles._events(spark, d).withColumn("hint", name)
    question = _question(events)
    posting = stages.stored(A.posting(spark, d))
    asked = F.broadcast(question.select("team_a", "team_b").distinct().limit(1000))  # 5 x 4 pairs
    teams = asked.select(F.explode(F.array("team_a", "team_b")).alias("team_id")).distinct()
    answer = stages.stored(puzzles._answers(spark, d, posting, teams=teams).withColumn("fame", pairs.digits(F.col("fame"), 4)).join(asked, ["team_a", "team_b"], "left_semi"))
    return events, question, posting, answer, stages.stored(pairs.ranked(answer, 2))


HINTED = puzzles.ANSWERS + ", " + puzzles.EVENTS + """, q AS (SELECT DISTINCT run_id, s.stage, 1 + user_id % 5 AS team_a, 6 + s.stage AS team_b FROM ev, (VALUES (0), (1), (2), (3)) s(stage)),
hs AS (SELECT run_id, CASE hint WHEN '0' THEN 'first' WHEN '1' THEN 'second' ELSE 'nationalities' END AS hint, arg_min(stage, seq) AS stage FROM ev WHERE kind = 'hint' GROUP BY 1, 2),
sp AS (SELECT a.*, CASE a.hint WHEN 'first' THEN 1 WHEN 'second' THEN 1 + CAST(coalesce(b.stage = a.stage, false) AS INT) END AS reveals FROM hs a LEFT JOIN hs b ON b.run_id = a.run_id AND b.hint = 'first')"""


@query("hint_chain", HINTED + """, op AS (SELECT member_id, list(team_id) AS opn FROM spells WHERE start_year IS NOT NULL AND end_year IS NULL GROUP BY 1),
kit AS (SELECT r.team_a, r.team_b, rank, concat_ws(' · ', concat_ws(' ', any_value(name)[1:1] || '.', CAST(any_value(m.birth) // 10 * 10 AS INT) || 's'), any_value(m.nat), CASE WHEN sum(greatest(coalesce(apps, 0), 0)) > 0 THEN sum(greatest(coalesce(apps, 0), 0)) || ' apps' END,
  CASE WHEN NOT any_value(gk) AND sum(greatest(coalesce(goals, 0), 0)) > 0 THEN sum(greatest(coalesce(goals, 0), 0)) || ' goals' END, CASE WHEN any_value(list_contains(opn, r.team_a) OR list_contains(opn, r.team_b)) THEN 'still there' WHEN any_value(len(opn)) > 0 THEN 'still active' END) AS kit
  FROM ranked r JOIN posting p ON p.member_id = r.member_id AND p.team_id IN (r.team_a, r.team_b) JOIN member m ON m.member_id = r.member_id LEFT JOIN op ON op.member_id = r.member_id WHERE rank <= 2 AND r.team_a <= 5 AND r.team_b BETWEEN 6 AND 9 GROUP BY 1, 2, 3),
ct AS (SELECT team_a, team_b, string_agg(n || ' ' || nat, ' · ' ORDER BY n DESC, nat) AS counts FROM (SELECT team_a, team_b, coalesce(nat, '?') AS nat, count(*) AS n FROM ans GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT sp.run_id, sp.hint, sp.stage, CAST(reveals AS BIGINT) AS reveals, coalesce(CASE WHEN hint = 'nationalities' THEN counts ELSE kit END, '…') AS text FROM sp JOIN q USING (run_id, stage) LEFT JOIN kit ON kit.team_a = q.team_a AND kit.team_b = q.team_b AND kit.rank = reveals LEFT JOIN ct ON ct.team_a = q.team_a AND ct.team_b = q.team_b""")
def _(spark, d):
    events, question, posting, answer, top = _hinted(spark, d)
    named = A.spells(spark, d).join(A.team(spark, d).select("team_id", F.col("name").alias("team_name")), "team_id")
    kits = hints.described(top, posting, A.member(spark, d), hints.notes(named, top))
    return hints.texts(hints.spent(events), question, kits, answer)


@query("stage_board_answers", None)
def _(spark, d):
    events, question, _, _, top = _hinted(spark, d)
    guesses = playlog.solving_guesses(puzzles._events(spark, d))
    return hints.board(playlog.stage_board(puzzles._run_lists(spark, d)), guesses, question, top.where("rank = 1"))


SQL["stage_board_answers"] = A.oracle(puzzles._digits(f"""{puzzles.ANSWERS}, face AS (SELECT team_a, team_b, member_id, others FROM ranked WHERE rank = 1), sb AS ({puzzles.SQL["stage_board"]}),
g0 AS (SELECT run_id, stage, member_id, seq, kind, row_number() OVER (PARTITION BY run_id, stage, member_id ORDER BY seq) AS r FROM ev3 WHERE kind IN ('right', 'wrong')), g AS (SELECT run_id, stage, arg_min(member_id, seq) AS hit FROM g0 WHERE kind = 'right' AND r = 1 GROUP BY 1, 2),
x AS (SELECT sb.*, 1 + CAST(split_part(run_id, '-', 1) AS BIGINT) % 5 AS team_a, 6 + stage_at AS team_b FROM sb)
SELECT x.run_id, stage_at, state, CASE WHEN state IN ('done', 'hinted') THEN hit WHEN state NOT IN ('current', 'to do') THEN f.member_id END AS member_id, CASE WHEN state NOT IN ('current', 'to do') THEN others END AS others
FROM x LEFT JOIN g ON g.run_id = x.run_id AND g.stage = x.stage_at LEFT JOIN face f ON f.team_a = x.team_a AND f.team_b = x.team_b""".replace(", face AS (", ", " + puzzles.EVENTS.replace("ev AS (", "ev3 AS (", 1) + ", face AS (")))


@query("resumed_batches", "SELECT member_id, count(*) AS n FROM spells GROUP BY 1")
def _(spark, d):
    """Three runs: one that is lost before its last batch is entered, one over fewer members, one over all."""
    spells, path, schema = stages.stored(A.spells(spark, d)), stages.new_path(spark, "batches"), "member_id bigint, n bigint"
    count = lambda todo: spells.join(todo, "member_id", "left_semi").groupBy("member_id").agg(F.count("*").alias("n"))
    members = spells.select("member_id").distinct()
    batches.resume(members.where("member_id % 3 = 0"), "member_id", count, path, schema, 2)
    count(members.where("member_id % 3 = 1")).write.parquet(batches.folder(path, 2))
    batches.resume(members.where("member_id % 2 = 0"), "member_id", count, path, schema)
    return batches.resume(members, "member_id", count, path, schema, 2)


@query("careers_of_members", "SELECT member_id, count(*) AS n FROM spells WHERE member_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY 1")
def _(spark, d):
    path = _folder(spark, "careers")
    export.write_careers(export.career_shards(A.spells(spark, d)), path)
    ids = A.table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("member_id"))
    return export.read_careers(spark, path, ids).select("member_id", F.size("spells").cast("bigint").alias("n"))


LIVE_EVENTS = puzzles.EVENTS.replace("user_id || '-' || (date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7) AS run_id", "user_id || '-' || date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS run_id")


def _live_events(spark, d):
    """Runs of a user and day."""
    e = puzzles._events(spark, d)
    ts = A.table(spark, d, "events").select(F.col("event_id").alias("seq"), "ts")
    day = F.datediff("date", F.lit(puzzles.EPOCH).cast("date")).cast("string")
    return e.join(ts, "seq").select(F.concat_ws("-", "user_id", day).alias("run_id"), "user_id", "date", F.col("ts").cast("timestamp").alias("ts"), "seq", "kind", "member_id")


@query("live_streaks")
def _(spark, d):
    """The events as a stream in three parts, each read by a start of its own; a last event closes the last day."""
    events, landed, path, progress = stages.stored(_live_events(spark, d)), *(stages.new_path(spark, x) for x in ("landed", "runs", "progress"))
    days = events.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    part = F.floor(F.datediff("date", F.lit(days.a)) * 3 / (F.datediff(F.lit(days.b), F.lit(days.a)) + 1))
    end = events.limit(1).select(F.lit("end").alias("run_id"), "user_id", F.date_add(F.lit(days.b), 2).alias("date"), F.date_add(F.lit(days.b), 2).cast("timestamp").alias("ts"), "seq", "kind", "member_id")
    for k in range(3):
        (events.where(part == k) if k < 2 else events.where(part == k).unionByName(end)).write.mode("append").parquet(landed)
        live.settle(spark.readStream.schema(live.EVENT).parquet(landed), path, progress).awaitTermination()
    return live.stats(spark, path)


_RUNS = puzzles.FOLD_SQL.replace(puzzles.EVENTS, LIVE_EVENTS)
SQL["live_streaks"] = f"""WITH r AS ({_RUNS}), dy AS (SELECT CAST(split_part(run_id, '-', 1) AS BIGINT) AS user_id, DATE '{puzzles.EPOCH}' + CAST(split_part(run_id, '-', 2) AS INT) AS date, won FROM r),
i AS (SELECT user_id, date, date_diff('day', DATE '2000-01-01', date) - row_number() OVER (PARTITION BY user_id ORDER BY date) AS g FROM dy WHERE won), s AS (SELECT user_id, count(*) AS len, max(date) AS last FROM i GROUP BY user_id, g), b AS (SELECT user_id, max(len) AS best, arg_max(len, last) AS ll, max(last) AS lw FROM s GROUP BY 1),
p AS (SELECT user_id, count(*) AS played, count(*) FILTER (won) AS wins, max(date) AS lp FROM dy GROUP BY 1) SELECT user_id, played, wins, coalesce(best, 0) AS best, CASE WHEN lw = lp THEN ll ELSE 0 END AS current FROM p LEFT JOIN b USING (user_id)"""


# Play archives.


@query("live_events", "SELECT event_id FROM events WHERE event_type <> 'error' AND CAST(ts AS DATE) = CAST(ts - INTERVAL 3 HOUR AS DATE)")
def _(spark, d):
    e = A.table(spark, d, "events").select("event_id", "ts", F.when(F.col("event_type") == "error", "replay").otherwise("live").alias("mode"), F.to_date(F.expr("ts - INTERVAL 3 HOURS")).alias("date"))
    return playlog.live_only(e).select("event_id")


@query("states_upgraded", "SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(event_id % 4 AS VARCHAR) ELSE '' END AS skipped, CASE WHEN event_type <> 'view' THEN 'photo' ELSE '' END AS hints FROM events")
def _(spark, d):
    e, kind = A.table(spark, d, "events"), F.col("event_type")
    old = F.struct(F.when(kind == "click", F.array(F.col("event_id") % 4)).alias("skipped"), F.when(kind != "view", F.create_map(F.lit("photo"), F.lit(1), F.lit("retired"), F.lit(2))).alias("hints"))
    up = playlog.upgraded(e.select(F.col("event_id").alias("run_id"), F.to_json(old).alias("json")), "skipped array<int>, hints map<string, int>", ["photo", "initials"])
    return up.select(F.col("run_id").alias("event_id"), F.array_join(F.transform("skipped", lambda x: x.cast("string")), ",").alias("skipped"), F.array_join(F.map_keys("hints"), ",").alias("hints"))


@query("archive_backfill", puzzles.DAYS + ", ar AS (SELECT user_id, date, bool_or(kind = 'right') AS won FROM ev WHERE kind <> 'skip' GROUP BY 1, 2), rn AS (SELECT user_id, date, bool_or(kind = 'right') AS won FROM ev WHERE kind = 'skip' GROUP BY 1, 2) SELECT * FROM ar UNION ALL SELECT * FROM rn ANTI JOIN ar USING (user_id, date)")
def _(spark, d):
    e = puzzles._events(spark, d).select("user_id", "date", "kind", (F.col("kind") == "right").alias("won"), (F.col("kind") == "skip").alias("done"))
    archive = e.where("NOT done").groupBy("user_id", "date").agg(F.bool_or("won").alias("won"))
    return playlog.backfilled(archive, e)


@query("board_sources", puzzles.EVENTS + """, q AS (SELECT user_id, CAST(ts AS DATE) AS date, event_id % 40 AS q FROM events), ok AS (SELECT user_id, date FROM q LEFT JOIN team ON team_id = q AND cc <> 'ASIA' GROUP BY 1, 2 HAVING count(*) = count(team_id)),
x AS (SELECT user_id, date, bool_or(kind = 'right') AS rp, bool_or(kind = 'hint') AS ar FROM ev GROUP BY 1, 2) SELECT user_id, date, CASE WHEN ok.user_id IS NOT NULL AND rp THEN 'replay' WHEN ok.user_id IS NOT NULL AND ar THEN 'archive' ELSE 'generated' END AS source FROM x LEFT JOIN ok USING (user_id, date)""")
def _(spark, d):
    e = puzzles._events(spark, d)
    days = e.select("user_id", "date").distinct()
    asked = A.table(spark, d, "events").select("user_id", F.to_date("ts").alias("date"), (F.col("event_id") % 40).alias("qid"))
    ok = playlog.resolved_days(asked, A.team(spark, d).where("cc <> 'ASIA'").select(F.col("team_id").alias("qid")))
    saved = lambda kind: playlog.gated(e.where(F.col("kind") == kind), ok)
    return playlog.board_source(days, saved("right"), saved("hint"), days)


DAY_STREAKS = """dy AS (SELECT user_id, date, bool_or(kind = 'right') AS won FROM {} GROUP BY 1, 2), wi AS (SELECT user_id, date, date_diff('day', DATE '2000-01-01', date) - row_number() OVER (PARTITION BY user_id ORDER BY date) AS g FROM dy WHERE won),
ws AS (SELECT user_id, date, row_number() OVER (PARTITION BY user_id, g ORDER BY date) AS streak FROM wi), sd AS (SELECT user_id, date, coalesce(streak, 0) AS streak FROM dy LEFT JOIN ws USING (user_id, date))"""


@query("day_streaks", puzzles.EVENTS + ", " + DAY_STREAKS.format("ev") + " SELECT user_id, date, streak FROM sd")
def _(spark, d):
    return playlog.streak_days(puzzles._events(spark, d).select("user_id", "date", (F.col("kind") == "right").alias("won")))


@query("share_texts")
def _(spark, d):
    """Lines of runs, a run's streak being that of its last day."""
    events = puzzles._events(spark, d)
    last = events.groupBy("run_id").agg(F.first("user_id").alias("user_id"), F.max("date").alias("date"))
    streak = last.join(playlog.streak_days(events.select("user_id", "date", (F.col("kind") == "right").alias("won"))), ["user_id", "date"]).select("run_id", "streak")
    runs = playlog.outcome_codes(puzzles._run_lists(spark, d)).join(streak, "run_id")
    number = F.substring_index("run_id", "-", -1).cast("int") + 1
    return runs.select("run_id", playlog.share_text(number, F.col("codes"), F.col("won"), F.col("wrong"), F.size("hinted_stages"), F.col("streak")).alias("line"))


SQL["share_texts"] = f"""WITH {puzzles.EV2}, {DAY_STREAKS.format('ev2')}, rs AS (SELECT run_id, streak FROM (SELECT run_id, any_value(user_id) AS user_id, max(date) AS date FROM ev2 GROUP BY 1) JOIN sd USING (user_id, date)), {puzzles.RUN_LISTS}, c AS (SELECT run_id, won, wrong, coalesce(len(any_value(h)), 0) AS hints, string_agg(CASE WHEN sk THEN '🟥' WHEN won OR stage_at < stage THEN CASE WHEN hi THEN '🟨' ELSE '🟩' END WHEN stage_at = stage THEN '🟥' ELSE '⬜' END, '' ORDER BY stage_at) AS line FROM bd LEFT JOIN hs USING (run_id) GROUP BY 1, 2, 3)
SELECT run_id, '#' || (CAST(split_part(run_id, '-', 2) AS INT) + 1) || ' ' || line || CASE WHEN won THEN ' · won' ELSE ' · lost' END || CASE WHEN wrong > 0 THEN ' · ' || wrong || ' missed' ELSE '' END || CASE WHEN hints > 0 THEN ' · ' || hints || ' hints' ELSE '' END || CASE WHEN won AND streak > 0 THEN ' · streak ' || streak ELSE '' END AS line FROM c JOIN rs USING (run_id)"""


@query("solving_guesses", puzzles.EVENTS + """, g AS (SELECT run_id, stage, member_id, seq, kind, row_number() OVER (PARTITION BY run_id, stage, member_id ORDER BY seq) AS r FROM ev WHERE kind IN ('right', 'wrong')) SELECT run_id, stage, arg_min(member_id, seq) AS member_id FROM g WHERE kind = 'right' AND r = 1 GROUP BY 1, 2""")
def _(spark, d):
    return playlog.solving_guesses(puzzles._events(spark, d))


@query("hint_texts", puzzles.EVENTS + """, hh AS (SELECT run_id, seq, seq % 40 AS team_id, coalesce(count(*) FILTER (hint = '0') OVER (PARTITION BY run_id, stage ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS reveals FROM ev WHERE kind = 'hint'),
an AS (SELECT team_id, member_id, row_number() OVER (PARTITION BY team_id ORDER BY member_id) AS reveals FROM posting WHERE apps >= 45)
SELECT run_id, seq, reveals, coalesce(m.name[1:1] || '., ' || CAST(birth // 10 * 10 AS INT) || ', ' || coalesce(nat, '?'), 'born ' || birth, 'no more answers') AS text FROM hh LEFT JOIN an USING (team_id, reveals) LEFT JOIN member m USING (member_id)""")
def _(spark, d):
    hints = playlog.hint_ranks(puzzles._events(spark, d).where("kind = 'hint'"), "0").withColumn("team_id", F.col("seq") % 40)
    return playlog.hint_texts(hints, A.posting(spark, d).where("apps >= 45"), A.member(spark, d), "team_id").select("run_id", "seq", "reveals", "text")
