"""Queries over whole tables: aggregates, worklists, progress, overlap."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import bots
from weftline.operators import aggregates as A
from weftline.operators import filters as Fi
from weftline.operators import graph as G
from weftline.operators import progress as P
from weftline.operators import search as S
from weftline.operators import worklists as U
from weftline.plans.registry import over, register

BOT = "owner_login NOT ILIKE '%[bot]'"
PAIRS = f"""SELECT a.repo_id AS src, b.repo_id AS dst, CAST(count(*) AS BIGINT) AS shared FROM contributions a JOIN contributions b
ON a.owner_login = b.owner_login AND a.repo_id < b.repo_id WHERE a.{BOT} GROUP BY 1, 2"""
CORE = """core AS (SELECT r.*, o.type AS owner_type FROM repos r LEFT JOIN owners o ON o.login = r.owner_login
 WHERE r.detailed = 1 OR r.id IN (SELECT repo_id FROM contributions))"""

register("s1_scan_orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000")(
    lambda t: t.table("orders").where("o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
)
register("g1_overlap_edges", over("contributions", PAIRS))(lambda t: G.overlap_edges(t.contributions))
register("g1_overlap_edges_2", over("contributions", f"SELECT * FROM ({PAIRS}) WHERE shared >= 2"))(lambda t: G.overlap_edges(t.contributions, 2))
register(
    "g1_overlap_stress",
    """WITH l AS (SELECT DISTINCT l_partkey AS repo_id, o_custkey AS owner_login FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 40)
SELECT a.repo_id AS src, b.repo_id AS dst, CAST(count(*) AS BIGINT) AS shared FROM l a JOIN l b ON a.owner_login = b.owner_login AND a.repo_id < b.repo_id GROUP BY 1, 2""",
)(
    lambda t: G.overlap_edges(
        t.table("lineitem").where("l_quantity >= 40").join(t.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .selectExpr("l_partkey AS repo_id", "CAST(o_custkey AS STRING) AS owner_login").distinct()
    )
)
register("g3_graph_nodes", over("repos", "SELECT id, full_name, primary_language, stars FROM repos"))(lambda t: G.graph_nodes(t.repos))
register(
    "a1_language_shares",
    over("repo_languages", """SELECT language, bytes, round(bytes / CASE WHEN sum(bytes) OVER () = 0 THEN 1 ELSE sum(bytes) OVER () END, 4) AS share FROM
(SELECT language, CAST(sum(bytes) AS BIGINT) AS bytes FROM repo_languages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12)"""),
)(lambda t: A.language_shares(t.repo_languages))
register("a2_category_shares", over("repo_topics", "SELECT topic, count(*) AS n FROM repo_topics GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"))(lambda t: A.category_shares(t.repo_topics))
register("a3_top_repos", over("repos", "SELECT id, full_name, stars, forks, primary_language FROM repos ORDER BY stars DESC NULLS LAST, id LIMIT 10"))(lambda t: A.top_repos(t.repos))
register(
    "a4_cross_project",
    over("contributions", f"""SELECT owner_login, count(DISTINCT repo_id) AS repos, CAST(sum(contributions) AS BIGINT) AS total FROM contributions
WHERE {BOT} GROUP BY 1 HAVING count(DISTINCT repo_id) >= 2 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20"""),
)(lambda t: A.cross_project_contributors(t.contributions))
register(
    "a5_summary_counts",
    over("repos contributions", f"""SELECT (SELECT count(*) FROM repos) AS repos, (SELECT CAST(coalesce(sum(stars), 0) AS BIGINT) FROM repos) AS stars,
(SELECT count(*) FROM owners) AS owners, (SELECT count(*) FROM contributions) AS contributions, (SELECT count(DISTINCT owner_login) FROM contributions WHERE {BOT}) AS contributors"""),
)(lambda t: A.summary_counts(t.repos, t.owners, t.contributions))
register(
    "a6_people",
    over("contributions", """SELECT owner_login AS login, o.type, repos, total FROM (SELECT owner_login, count(DISTINCT repo_id) AS repos, CAST(sum(contributions) AS BIGINT) AS total
FROM contributions GROUP BY 1) c LEFT JOIN owners o ON o.login = c.owner_login"""),
)(lambda t: A.people(t.contributions, t.owners))
register(
    "a7_universe_counts",
    over("repos owners snapshots", """SELECT (SELECT count(*) FROM repos) AS repos, (SELECT count(*) FROM repos WHERE detailed = 1) AS detailed,
(SELECT count(*) FROM owners) AS owners, (SELECT count(*) FROM snapshots) AS cached"""),
)(lambda t: A.universe_counts(t.repos, t.owners, t.snapshots))
register("f1_bots", over("owners", "SELECT login, login ILIKE '%[bot]' AS bot_sql, (ends_with(login, '[bot]') OR ends_with(login, '-bot')) AS bot_ui FROM owners"))(
    lambda t: t.owners.select("login", bots.is_bot_sql("login").alias("bot_sql"), bots.is_bot_ui("login").alias("bot_ui"))
)
register("f2_core_repos", over("repos contributions owners", "SELECT id, full_name, owner_login, stars, detailed, owner_type FROM core", CORE))(
    lambda t: Fi.core_repos(t.repos, t.contributions, t.owners).select("id", "full_name", "owner_login", "stars", "detailed", "owner_type")
)
register("f7_restrict_children", over("repos contributions owners repo_languages", "SELECT repo_id, language, bytes FROM repo_languages WHERE repo_id IN (SELECT id FROM core)", CORE))(
    lambda t: Fi.restrict_children(t.repo_languages, Fi.core_repos(t.repos, t.contributions, t.owners))
)
register(
    "u1_enrich_worklist",
    over("repos contributions owners", f"""SELECT owner_login AS login, min(rank) AS rank FROM (SELECT owner_login, 0::BIGINT AS rank FROM repos WHERE detailed = 1 UNION ALL SELECT owner_login, 1 FROM contributions)
WHERE {BOT} AND owner_login IN (SELECT login FROM owners WHERE enriched = 0) GROUP BY 1"""),
)(lambda t: U.enrich_worklist(t.repos, t.contributions, t.owners))
register(
    "u2_core_owner_count",
    over("repos contributions", f"SELECT count(*) AS n FROM (SELECT owner_login FROM repos WHERE detailed = 1 UNION SELECT owner_login FROM contributions) WHERE {BOT}"),
)(lambda t: U.core_owner_count(t.repos, t.contributions))
register("u3_pending_queue", over("repos", "SELECT id, full_name, attempts FROM repos WHERE detailed = 0 AND attempts < 5 ORDER BY id LIMIT 50"))(lambda t: U.pending_queue(t.repos))
register(
    "u4_chunk_progress",
    over("enum_chunks repos", """SELECT c.start, c.done, coalesce(n, 0) AS repos FROM enum_chunks c LEFT JOIN
(SELECT CAST(floor((id - 1) / 100.0) AS BIGINT) * 100 AS start, count(*) AS n FROM repos GROUP BY 1) r ON r.start = c.start"""),
)(lambda t: U.chunk_progress(t.enum_chunks, t.repos, 100))
register(
    "u4_chunk_totals",
    over("enum_chunks", """SELECT count(*) AS total, count_if(done = 0)::BIGINT AS open, count_if(done = 2)::BIGINT AS claimed, count_if(done = 1)::BIGINT AS finished,
round(100.0::DOUBLE * count_if(done = 1) / count(*), 4) AS pct FROM enum_chunks"""),
)(lambda t: U.chunk_totals(t.enum_chunks))
_STATUS = """SELECT r.*, (SELECT count(*) FROM owners) AS owners, (SELECT count(*) FROM contributions) AS contributions, (SELECT count(*) FROM releases) AS releases,
(SELECT count(*) FROM dependencies) AS dependencies, (SELECT count(*) FROM snapshots) AS cached, c.*, round(100.0::DOUBLE * chunks_done / chunks, 4) AS chunks_pct,
CASE WHEN chunks_done < chunks THEN 'ENUM' WHEN pending > 0 THEN 'DETAIL' ELSE 'DONE' END AS phase
FROM (SELECT count(*) AS discovered, count_if(detailed = 1)::BIGINT AS detailed, count_if(detailed = 0 AND attempts < 5)::BIGINT AS pending,
 count_if(detailed = 1 AND stars IS NULL)::BIGINT AS gone, count_if(detailed <> 1 AND attempts >= 5)::BIGINT AS failed FROM repos) r,
 (SELECT count(*) AS chunks, count_if(done = 1)::BIGINT AS chunks_done FROM enum_chunks) c"""
register("t1_status_counts", over("repos owners contributions releases dependencies snapshots enum_chunks", _STATUS))(
    lambda t: P.status_counts(t.repos, t.owners, t.contributions, t.releases, t.dependencies, t.snapshots, t.enum_chunks)
)
_FINISHING = (
    _STATUS.replace("FROM repos) r", "FROM (SELECT * REPLACE (CASE WHEN detailed = 0 THEN 3 ELSE detailed END AS detailed) FROM repos)) r")
    .replace("FROM enum_chunks) c", "FROM enum_chunks WHERE done = 1) c").replace("ELSE 'DONE'", "WHEN EXISTS (SELECT 1 FROM repos WHERE detailed = 0) THEN 'FINISHING' ELSE 'DONE'")
)
register("t1_status_finishing", over("repos owners contributions releases dependencies snapshots enum_chunks", _FINISHING))(
    lambda t: P.status_counts(
        t.repos.withColumn("detailed", F.when(F.col("detailed") == 0, 3).otherwise(F.col("detailed"))), t.owners, t.contributions, t.releases, t.dependencies, t.snapshots, t.enum_chunks.where("done = 1")
    )
)
register(
    "t2_ops_counts",
    over("repos owners contributions snapshots enum_chunks", f"""SELECT *, greatest(0, owners_core - owners_enriched) AS owners_pending FROM
(SELECT count_if(detailed = 1)::BIGINT AS repos_done, count_if(detailed = 0)::BIGINT AS repos_pending, count_if(detailed = 3)::BIGINT AS repos_claimed FROM repos),
(SELECT count_if(done = 1)::BIGINT AS chunks_done, count_if(done = 0)::BIGINT AS chunks_open, count_if(done = 2)::BIGINT AS chunks_claimed FROM enum_chunks),
(SELECT count(*) AS owners, count_if(enriched = 1)::BIGINT AS owners_enriched, 0::BIGINT AS owners_located FROM owners),
(SELECT count(*) AS owners_core FROM (SELECT owner_login FROM repos WHERE detailed = 1 UNION SELECT owner_login FROM contributions) WHERE {BOT}),
(SELECT count(*) AS cached FROM snapshots)"""),
)(lambda t: P.ops_counts(t.repos, t.owners, t.contributions, t.snapshots, t.enum_chunks))
_RATES = """points AS (SELECT k, epoch_us(ts) / 1e6 AS s, CAST(value AS DOUBLE) AS v, row_number() OVER (PARTITION BY k ORDER BY ts, value) AS i FROM snapshots),
ema(k, i, s, v, rate) AS (SELECT k, i, s, v, CAST(NULL AS DOUBLE) FROM points WHERE i = 1
 UNION ALL SELECT p.k, p.i, p.s, p.v, CASE WHEN e.rate IS NULL THEN greatest(0, (p.v - e.v) / (p.s - e.s)) ELSE e.rate + 0.25 * (greatest(0, (p.v - e.v) / (p.s - e.s)) - e.rate) END
 FROM ema e JOIN points p ON p.k = e.k AND p.i = e.i + 1),
rates AS (SELECT k, coalesce(max_by(rate, i), 0) AS rate, CAST(max_by(v, i) AS BIGINT) AS done FROM ema GROUP BY k)"""
register("t3_throughput", over("snapshots", "SELECT k, round(rate, 9) AS rate FROM rates", _RATES).replace("WITH", "WITH RECURSIVE", 1))(
    lambda t: P.throughput(t.snapshots).selectExpr("k", "round(rate, 9) AS rate")
)
register(
    "t4_eta",
    over("snapshots", """SELECT k, round(least(100.0::DOUBLE, 100.0::DOUBLE * done / total), 4) AS pct, total - done AS "left", round(rate * 60, 4) AS per_minute,
round(CASE WHEN total > done AND rate > 0 THEN (total - done) / rate END, 2) AS eta_s, CASE WHEN total = done THEN 'done' WHEN rate > 0 THEN 'running' ELSE 'stalled' END AS state
FROM (SELECT *, done + 1000 AS total FROM rates)""", _RATES).replace("WITH", "WITH RECURSIVE", 1),
)(
    lambda t: P.eta(
        P.throughput(t.snapshots).join(t.snapshots.groupBy("k").agg({"value": "max"}).withColumnRenamed("max(value)", "done"), "k").selectExpr("k", "rate", "done", "done + 1000 AS total")
    ).withColumn("eta_s", F.round("eta_s", 2))
)
#: Searches: shorter than a gram, frequent, rare, absent.
PATTERNS = ("7", "0001", "er", "ust", "42", "no such name")


def _searched(t):
    index = S.text_index(S.repo_texts(t.repos, t.contributions))
    found = [S.search(index, p).select(F.lit(p).alias("pattern"), "id") for p in PATTERNS]
    return functools.reduce(DataFrame.unionAll, found)


register(
    "f4_text_search",
    over("repos contributions", f"""SELECT DISTINCT p AS pattern, id FROM (SELECT id, full_name AS t FROM repos UNION ALL SELECT repo_id, owner_login FROM contributions)
JOIN (VALUES {", ".join(f"('{p}')" for p in PATTERNS)}) v(p) ON contains(lower(t), p) WHERE id IS NOT NULL"""),
)(_searched)
