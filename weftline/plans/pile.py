"""Queries over the pile: filters, folding, graph, patterns."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import aggregates as A
from weftline.operators import facets as Fa
from weftline.operators import filters as Fi
from weftline.operators import folded as N
from weftline.operators import graph as G
from weftline.operators import patterns as P
from weftline.operators import profiles as R
from weftline.operators.filters import FilterSpec
from weftline.plans.registry import Tables, over, register
from weftline.plans.tables import CORE

#: The settings of the pile that the queries below look at.
SPEC = FilterSpec(no_archived=True, min_forks=5, degree=2)


@dataclass(frozen=True)
class Pile:
    """Frames of one setting of the rack: nodes, strong links, folded edges, clusters; each built once, when it is asked for.

    Contributions, core, nodes, edges and clusters are used many times and by iterations, so they are written to the shared folder; ``shared_pile``
    lets all queries over the same files and setting read the same tables. Core and nodes are written as counted rows.
    """

    tables: Tables
    spec: FilterSpec = SPEC

    @cached_property
    def contributions(self) -> DataFrame:
        return G.written(self.tables.contributions, "contributions")

    @cached_property
    def counted_core(self) -> DataFrame:
        t = self.tables
        return G.written(Fi.ingest_defaults(Fi.core_repos(t.repos, self.contributions, t.owners, counted=True), self.contributions, t.repo_topics), "core")

    @property
    def core(self) -> DataFrame:
        return Fi.each(self.counted_core)

    @cached_property
    def counted_passing(self) -> DataFrame:
        t, spec = self.tables, self.spec
        kept = Fi.filter_repos(self.counted_core, spec, self.contributions, t.releases, t.dependencies)
        return G.written(kept, "passing") if spec.search or spec.has_releases or spec.has_deps else kept  # other filters are told at the scan of core

    @property
    def passing(self) -> DataFrame:
        return Fi.each(self.counted_passing)

    @cached_property
    def active(self) -> DataFrame:
        return Fi.active_people(self.contributions, self.spec)

    @cached_property
    def counted_nodes(self) -> DataFrame:
        return G.written(Fi.isolate_filter(self.counted_passing, self.edges), "nodes")

    @property
    def nodes(self) -> DataFrame:
        return Fi.each(self.counted_nodes)

    @cached_property
    def links(self) -> DataFrame:
        return Fi.pile_links(self.counted_passing, self.active)

    @cached_property
    def edges(self) -> DataFrame:
        return G.written(G.fold_edges(self.links, self.counted_passing), "edges")

    @cached_property
    def clusters(self) -> DataFrame:
        return G.written(G.number_clusters(G.label_propagation(self.nodes, self.edges)), "clusters")

    def under(self, spec: FilterSpec) -> Pile:
        """The pile of another setting over the same core."""
        other = replace(self, spec=spec)
        vars(other).update(contributions=self.contributions, counted_core=self.counted_core)
        return other


_PILES: dict[tuple, Pile] = {}


def shared_pile(t: Tables, spec: FilterSpec = SPEC) -> Pile:
    """The pile of these tables and setting; built once for an application and a state of the input files."""
    key = (t.spark.sparkContext.applicationId, t.state(), spec)
    made = _PILES.get(key)
    if made is None or not all(G.stands(f) for f in vars(made).values() if hasattr(f, "_folder")):
        made = _PILES[key] = Pile(t, spec)
    return made


_RELATIONS = "repos owners contributions repo_topics releases dependencies repo_languages"
FACTS = (
    CORE,
    "tags AS (SELECT repo_id AS id, array_to_string(list_sort(list(DISTINCT topic)), ',') AS topics, list(DISTINCT topic) AS tl FROM repo_topics GROUP BY 1)",
    "heads AS (SELECT repo_id AS id, count(*) AS n_contrib FROM contributions GROUP BY 1)",
    """facts AS (SELECT c.id, full_name, owner_login, primary_language, license, coalesce(stars, 0) AS stars, coalesce(forks, 0) AS forks,
 coalesce(open_issues, 0) AS open_issues, coalesce(size, 0) AS size, is_fork, archived, pushed_at, owner_type, coalesce(n_contrib, 0) AS n_contrib,
 coalesce(topics, '') AS topics, tl, CAST(year(pushed_at) AS BIGINT) AS year, split_part(full_name, '/', 2) AS short_name
 FROM core c LEFT JOIN heads h ON h.id = c.id LEFT JOIN tags t ON t.id = c.id)""",
)
PILE = (
    *FACTS,
    "passing AS (SELECT * FROM facts WHERE NOT archived AND forks >= 5)",
    "strong AS (SELECT * FROM contributions WHERE contributions >= 1)",
    "active AS (SELECT * FROM strong WHERE owner_login IN (SELECT owner_login FROM strong GROUP BY 1 HAVING count(*) >= 2))",
    "links AS (SELECT * FROM active WHERE repo_id IN (SELECT id FROM passing))",
    "spread AS (SELECT owner_login FROM links GROUP BY 1 HAVING count(*) BETWEEN 2 AND 400)",
    """edges AS (SELECT a.repo_id AS src, b.repo_id AS dst, count(*) AS shared, list_sort(list(a.owner_login))[1:12] AS who FROM links a JOIN links b
 ON a.owner_login = b.owner_login AND a.repo_id < b.repo_id WHERE a.owner_login IN (SELECT owner_login FROM spread) GROUP BY 1, 2)""",
    "ends AS (SELECT DISTINCT unnest([src, dst]) AS id FROM edges)",
    "nodes AS (SELECT * FROM passing WHERE id IN (SELECT id FROM ends))",
    "adj AS (SELECT src AS id, dst AS nbr, shared AS w FROM edges UNION ALL SELECT dst, src, shared FROM edges)",
    "deg AS (SELECT id, count(*) AS degree FROM adj GROUP BY 1)",
)


def _rounds(n: int = 9) -> tuple[str, ...]:
    """Synchronous label propagation as chained parts; a round without moves repeats the one before."""
    parts = ["l0 AS (SELECT id, id AS label FROM nodes)"]
    for k in range(n):
        parts.append(f"""l{k + 1} AS MATERIALIZED (SELECT l.id, coalesce(v.vote, l.label) AS label FROM l{k} l LEFT JOIN
 (SELECT id, vote FROM (SELECT s.id, s.vote, row_number() OVER (PARTITION BY s.id ORDER BY s.score DESC, s.vote = o.label DESC, s.vote) AS r FROM
  (SELECT a.id, n.label AS vote, sum(a.w) AS score FROM adj a JOIN l{k} n ON n.id = a.nbr GROUP BY 1, 2) s JOIN l{k} o ON o.id = s.id) WHERE r = 1) v ON v.id = l.id)""")
    return (
        *parts, f"sizes AS (SELECT label, count(*) AS n FROM l{n} GROUP BY 1)",
        "numbered AS (SELECT label, n, row_number() OVER (ORDER BY n DESC, label) - 1 AS cluster FROM sizes WHERE n > 1)",
        f"clusters AS (SELECT l.id, coalesce(cluster, -1) AS cluster, coalesce(b.n, 1) AS cluster_size FROM l{n} l LEFT JOIN numbered b ON b.label = l.label)",
    )


CLUSTERS = (*PILE, *_rounds())
REACH = (
    *PILE,
    """reach(id, root) AS (SELECT id, id FROM nodes UNION SELECT a.nbr, r.root FROM reach r JOIN adj a ON a.id = r.id WHERE r.root <= a.nbr)""",
    "comp AS (SELECT id, min(root) AS component FROM reach GROUP BY 1)",
)


def pile(select: str, parts: tuple[str, ...] = PILE) -> str:
    return over(_RELATIONS, select, *parts)


def recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


def query(name: str, select: str | None, parts: tuple[str, ...] = PILE, deep: bool = False):
    sql = pile(select, parts) if select else None
    add = register(name, recursive(sql) if sql and deep else sql)
    return lambda f: add(lambda t: f(shared_pile(t)))


query("f3_ingest_defaults", "SELECT id, stars, forks, open_issues, size, n_contrib, topics, year, short_name FROM facts", FACTS)(
    lambda p: p.core.select("id", "stars", "forks", "open_issues", "size", "n_contrib", "topics", "year", "short_name")
)
_RACK = FilterSpec(
    search="supplier#00000000", languages=frozenset(("Lang1", "Lang3", "Lang5", "—")), min_stars=30, percent=True, min_contributors=1, has_deps=True,
    owner_types=frozenset(("Organization", "User")), year_from=1996, year_to=2001, no_forks=True,
)
query(
    "f4_filter_repos",
    """SELECT id, full_name FROM facts WHERE (lower(full_name) LIKE '%supplier#00000000%' OR id IN (SELECT repo_id FROM contributions WHERE lower(owner_login) LIKE '%supplier#00000000%'))
AND coalesce(primary_language, '—') IN ('Lang1', 'Lang3', 'Lang5', '—') AND n_contrib >= 1 AND NOT is_fork AND coalesce(owner_type, 'User') IN ('Organization', 'User')
AND (year IS NULL OR year BETWEEN 1996 AND 2001) AND id IN (SELECT repo_id FROM dependencies)
AND stars >= (SELECT floor(pow(10.0, 0.3 * log10(greatest(1, max(stars)) + 1.0)) - 1 + 0.5) FROM facts)""",
    FACTS,
)(lambda p: p.under(_RACK).passing.select("id", "full_name"))
query(
    "f4_filter_facets",
    "SELECT id, full_name FROM facts WHERE license = 'Brand#11' AND list_contains(tl, 'Brand#11') AND open_issues >= 10 AND size >= 100 AND id IN (SELECT repo_id FROM releases)", FACTS,
)(lambda p: p.under(FilterSpec(license="Brand#11", topic="Brand#11", min_issues=10, min_size=100, has_releases=True)).passing.select("id", "full_name"))
query("f5_active_people", "SELECT * FROM active")(lambda p: p.active)
query(
    "f5_active_people_strict",
    """SELECT repo_id, owner_login, contributions FROM (SELECT *, count(*) OVER (PARTITION BY owner_login) AS n FROM contributions WHERE contributions >= 8
AND NOT (ends_with(owner_login, '[bot]') OR ends_with(owner_login, '-bot'))) WHERE n >= 3""",
)(lambda p: Fi.active_people(p.contributions, FilterSpec(weight=8, degree=3, no_bots=True)))
query("f6_pile_links", "SELECT * FROM links")(lambda p: p.links)
query("f8_isolate_filter", "SELECT id, full_name FROM nodes")(lambda p: p.nodes.select("id", "full_name"))
query("f9_cluster_filter", "SELECT e.src, e.dst, e.shared FROM edges e JOIN clusters a ON a.id = e.src AND a.cluster = 0 JOIN clusters b ON b.id = e.dst AND b.cluster = 0", CLUSTERS)(
    lambda p: Fi.cluster_filter(p.nodes, p.edges, p.clusters, 0)[1].select("src", "dst", "shared")
)
query("g2_fold_edges", "SELECT src, dst, shared, array_to_string(who, ',') AS who FROM edges")(lambda p: p.edges)
query("g4_adjacency", "SELECT * FROM adj")(lambda p: G.adjacency(p.edges))
query("g4_degree", "SELECT * FROM deg")(lambda p: G.degree(p.edges))
query("g5_label_propagation", "SELECT * FROM l9", CLUSTERS)(lambda p: G.label_propagation(p.nodes, p.edges))
query("g6_number_clusters", "SELECT * FROM clusters", CLUSTERS)(lambda p: p.clusters)
query("g7_component_labels", "SELECT * FROM comp", REACH, deep=True)(lambda p: G.component_labels(p.nodes, p.edges))
query("g7_connected_components", "SELECT count(*) AS components, max(n) AS largest FROM (SELECT count(*) AS n FROM comp GROUP BY component)", REACH, deep=True)(
    lambda p: G.connected_components(p.nodes, p.edges)
)
_RING = """SELECT id, min(ring) AS ring FROM ring GROUP BY 1"""
_RINGS = (*PILE, "ring(id, ring) AS (SELECT id, 0 FROM (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 1) UNION SELECT a.nbr, r.ring + 1 FROM ring r JOIN adj a ON a.id = r.id WHERE r.ring < 3)")
query("g9_ego_network", "SELECT id, CAST(min(ring) AS BIGINT) AS ring FROM ring GROUP BY 1", _RINGS, deep=True)(lambda p: G.ego_network(p.edges, G.default_center(p.edges)))


def _far_ends(p: Pile) -> tuple[DataFrame, int | None, int | None]:
    edges = p.edges
    a = edges.agg(F.min("src")).head()[0]
    b = edges.agg(F.max("dst")).head()[0]
    return edges, a, b


_HOPS = (*PILE, "walk(id, hop) AS (SELECT min(src), 0 FROM edges UNION SELECT a.nbr, w.hop + 1 FROM walk w JOIN adj a ON a.id = w.id WHERE w.hop < 12)")
query("g8_shortest_path_hops", "SELECT CAST(coalesce(min(hop), 0) AS BIGINT) AS hops FROM walk WHERE id = (SELECT max(dst) FROM edges)", _HOPS, deep=True)(
    lambda p: G.shortest_path(*_far_ends(p)).agg(F.count(F.lit(1)).alias("hops"))
)
_PATH = (
    *_HOPS, "dist AS (SELECT id, min(hop) AS hop FROM walk GROUP BY 1)",
    """path(hop, node) AS (SELECT hop, id FROM dist WHERE id = (SELECT max(dst) FROM edges)
 UNION SELECT p.hop - 1, min(a.nbr) FROM path p JOIN adj a ON a.id = p.node JOIN dist d ON d.id = a.nbr AND d.hop = p.hop - 1 WHERE p.hop > 0 GROUP BY 1)""",
)
query(
    "g8_shortest_path",
    """SELECT CAST(b.hop AS BIGINT) AS hop, a.node AS src, b.node AS dst, e.who[1] AS carrier FROM path a JOIN path b ON b.hop = a.hop + 1
JOIN edges e ON e.src = least(a.node, b.node) AND e.dst = greatest(a.node, b.node)""",
    _PATH, deep=True,
)(lambda p: G.shortest_path(*_far_ends(p)))
_STATS = """SELECT nodes, edges, round(100.0::DOUBLE * 2 * edges / (nodes * (nodes - 1)), 6) AS density_pct, round(2.0::DOUBLE * edges / nodes, 6) AS mean_degree, max_degree,
components, largest, round(100.0::DOUBLE * largest / nodes, 6) AS largest_pct, nodes - linked AS isolates, clusters, largest_cluster FROM
(SELECT count(*) AS nodes FROM nodes), (SELECT count(*) AS edges FROM edges), (SELECT count(*) AS linked, max(degree) AS max_degree FROM deg),
(SELECT count(*) AS components, max(n) AS largest FROM (SELECT count(*) AS n FROM comp GROUP BY component)),
(SELECT count(DISTINCT cluster) AS clusters, max(cluster_size) AS largest_cluster FROM clusters WHERE cluster >= 0)"""
_WHOLE = tuple(part.replace("HAVING count(*) BETWEEN 2 AND 400", "HAVING count(*) >= 2") for part in (*REACH, *_rounds()))  # nobody is left out for having many
query("g10_net_stats", _STATS, _WHOLE, deep=True)(lambda p: N.fold_stats(p.links, p.counted_passing))
_MATRIX = (
    *CLUSTERS,
    "top AS (SELECT d.id, degree, cluster FROM (SELECT * FROM deg ORDER BY degree DESC, id LIMIT 70) d JOIN clusters c ON c.id = d.id)",
    "place AS (SELECT id, row_number() OVER (ORDER BY cluster < 0, cluster, degree DESC, id) - 1 AS p FROM top)",
    "half AS (SELECT a.p AS row, b.p AS col, shared AS v FROM edges JOIN place a ON a.id = src JOIN place b ON b.id = dst)",
)
query("g11_adjacency_matrix", "SELECT row, col, v, round(v::DOUBLE / (SELECT max(v) FROM half), 6) AS share FROM (SELECT * FROM half UNION ALL SELECT col, row, v FROM half)", _MATRIX)(
    lambda p: G.adjacency_matrix(p.edges, p.clusters)
)

_FACETS = """SELECT 'language' AS facet, coalesce(primary_language, '—') AS value, count(*) AS n FROM facts GROUP BY 2
UNION ALL SELECT 'license', license, count(*) FROM facts WHERE license IS NOT NULL GROUP BY 2 UNION ALL SELECT 'topic', unnest(tl), count(*) FROM facts GROUP BY 2"""
query("a8_facet_counts", _FACETS, FACTS)(lambda p: A.facet_counts(p.core))
query(
    "a8_pile_facets",
    """SELECT facet, value, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS r FROM (
SELECT 'language' AS facet, primary_language AS value, count(*) AS n FROM nodes WHERE primary_language IS NOT NULL GROUP BY 2
UNION ALL SELECT 'license', license, count(*) FROM nodes WHERE license IS NOT NULL GROUP BY 2 UNION ALL SELECT 'topic', unnest(tl), count(*) FROM nodes GROUP BY 2)) WHERE r <= 12""",
)(lambda p: A.facet_counts(p.nodes, 12, None))
#: A choice of facet values: not archived, with releases, of two languages or none, pushed late or never.
_CHOICE = {"archived": ["false"], "releases": ["true"], "language": ["Lang1", "Lang4", "—"], "year": ["1996", "1997", "1998", "none"]}
query(
    "a8_bitmap_facets",
    """SELECT facet, value, count(*) AS n FROM (SELECT *, id IN (SELECT repo_id FROM dependencies) AS deps FROM facts WHERE NOT archived AND id IN (SELECT repo_id FROM releases)
 AND coalesce(primary_language, '—') IN ('Lang1', 'Lang4', '—') AND (year IS NULL OR year BETWEEN 1996 AND 1998)), LATERAL (SELECT unnest(
 [('language', coalesce(primary_language, '—')), ('license', license), ('owner_type', owner_type), ('year', coalesce(year::VARCHAR, 'none')), ('archived', 'false'), ('fork', is_fork::VARCHAR),
  ('releases', 'true'), ('dependencies', deps::VARCHAR)] || list_transform(coalesce(tl, []), lambda t: ('topic', t))) AS x) f(x), LATERAL (SELECT x[1] AS facet, x[2] AS value) WHERE value IS NOT NULL GROUP BY 1, 2""",
    FACTS,
)(lambda p: Fa.facets_of_chosen(Fa.facet_index(p.core, p.tables.releases, p.tables.dependencies), _CHOICE))
query(
    "a9_coverage_counts",
    """SELECT (SELECT count(*) FROM facts WHERE archived) AS archived, (SELECT count(*) FROM facts WHERE is_fork) AS forks,
(SELECT count(DISTINCT repo_id) FROM releases WHERE repo_id IN (SELECT id FROM core)) AS with_releases, (SELECT count(DISTINCT repo_id) FROM dependencies WHERE repo_id IN (SELECT id FROM core)) AS with_deps""",
    FACTS,
)(lambda p: A.coverage_counts(p.core, p.tables.releases, p.tables.dependencies))
query(
    "a10_dashboard_tiles",
    """SELECT (SELECT count(*) FROM nodes) AS repos, (SELECT CAST(sum(stars) AS BIGINT) FROM nodes) AS stars, (SELECT count(*) FROM edges) AS links,
count(*) AS people, count_if(n > 1)::BIGINT AS connectors FROM (SELECT owner_login, count(*) AS n FROM links WHERE repo_id IN (SELECT id FROM nodes) GROUP BY 1)""",
)(lambda p: A.dashboard_tiles(p.nodes, p.edges, Fi.pile_links(p.nodes, p.active)))
query(
    "a11_pile_languages",
    """SELECT language, bytes, round(bytes / sum(bytes) OVER (), 4) AS share FROM (SELECT language, CAST(sum(bytes) AS BIGINT) AS bytes FROM repo_languages
WHERE repo_id IN (SELECT id FROM nodes) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 14)""",
)(lambda p: A.pile_language_bytes(p.nodes, p.tables.repo_languages))
query(
    "a12_push_years",
    "SELECT y.year, count(n.id) AS n FROM (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM facts) y LEFT JOIN nodes n ON n.year = y.year GROUP BY 1",
)(lambda p: A.push_year_histogram(p.nodes, p.core))
query("a12_dormant", "SELECT count(*) AS dormant FROM nodes WHERE year IS NULL OR year <= 2000")(lambda p: A.dormant_count(p.nodes, 2000))
query(
    "a13_star_histogram",
    """SELECT b.bin, count(n.id) AS n FROM (SELECT unnest(range(12)) AS bin) b LEFT JOIN
(SELECT id, CAST(least(11, floor(log10(stars + 1) / log10((SELECT greatest(1, max(stars)) FROM facts) + 1) * 12)) AS BIGINT) AS bin FROM nodes) n ON n.bin = b.bin GROUP BY 1""",
)(lambda p: A.star_histogram(p.nodes, p.core))
query("a14_top_connectors", "SELECT owner_login, count(*) AS repos, CAST(sum(contributions) AS BIGINT) AS total FROM links GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 24")(
    lambda p: A.top_connectors(p.links)
)
query("a15_top_edges", "SELECT src, dst, shared FROM edges ORDER BY shared DESC, src, dst LIMIT 16")(lambda p: A.top_edges(p.edges).select("src", "dst", "shared"))
query("a16_top_hubs", "SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 16")(lambda p: A.top_hubs(G.degree(p.edges)))
query(
    "a17_node_metrics",
    """SELECT id, degree, round(2.2 + sqrt(stars) / 9 + least(6, 0.16 * degree), 6) AS radius, round(2 * degree + sqrt(stars), 6) AS priority,
round(CASE WHEN ms > 0 THEN log10(stars + 1) / log10(ms + 1) ELSE 0 END, 6) AS star_scale, round(CASE WHEN year IS NULL OR y1 = y0 THEN 0 ELSE (year - y0)::DOUBLE / (y1 - y0) END, 6) AS age_scale,
round(CASE WHEN md > 0 THEN degree::DOUBLE / md ELSE 0 END, 6) AS degree_scale, round(log10(stars + 1), 6) AS log_stars, round(log10(n_contrib + 1), 6) AS log_contribs FROM
(SELECT n.*, coalesce(d.degree, 0) AS degree, max(stars) OVER () AS ms, max(coalesce(d.degree, 0)) OVER () AS md, min(year) OVER () AS y0, max(year) OVER () AS y1 FROM nodes n LEFT JOIN deg d ON d.id = n.id)""",
)(lambda p: A.node_metrics(p.nodes, G.degree(p.edges)))

_IN = "contributions c WHERE repo_id IN (SELECT id FROM nodes)"
_BOT = "(ends_with(owner_login, '[bot]') OR ends_with(owner_login, '-bot'))"
query(
    "p1_bus_factor",
    f"""SELECT repo_id, people, top_login, round(share, 6) AS share FROM (SELECT repo_id, count(*) AS people, arg_min(owner_login, (-contributions, owner_login)) AS top_login,
CASE WHEN sum(contributions) = 0 THEN 1 ELSE max(contributions)::DOUBLE / sum(contributions) END AS share FROM {_IN} GROUP BY 1)
WHERE people >= 2 AND share >= 0.7 ORDER BY round(share, 6) DESC, repo_id LIMIT 40""",
)(lambda p: P.bus_factor(p.contributions, p.nodes))
query(
    "p2_co_maintainers",
    f"""SELECT a, b, repos, ids FROM (SELECT x.owner_login AS a, y.owner_login AS b, count(*) AS repos, array_to_string(list_sort(list(x.repo_id)), ',') AS ids FROM ok x JOIN ok y
ON x.repo_id = y.repo_id AND x.owner_login < y.owner_login GROUP BY 1, 2) WHERE repos >= 3 ORDER BY repos DESC, a, b LIMIT 40""",
    (*PILE, f"inn AS (SELECT DISTINCT repo_id, owner_login FROM {_IN} AND NOT {_BOT})", "ok AS (SELECT * FROM inn WHERE repo_id IN (SELECT repo_id FROM inn GROUP BY 1 HAVING count(*) BETWEEN 2 AND 60))"),
)(lambda p: P.co_maintainers(p.contributions, p.nodes))
query(
    "p3_brokers",
    """SELECT owner_login, count(DISTINCT cluster) FILTER (cluster >= 0) AS clusters, count(*) AS repos FROM links l JOIN clusters c ON c.id = l.repo_id GROUP BY 1
HAVING count(DISTINCT cluster) FILTER (cluster >= 0) >= 2 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 40""",
    CLUSTERS,
)(lambda p: P.brokers(p.links, p.clusters))
query(
    "p4_serial_forkers",
    "SELECT owner_login, count(*) AS n, array_to_string(list_sort(list(id)), ',') AS ids FROM nodes WHERE is_fork GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 40",
)(lambda p: P.serial_forkers(p.nodes))
query(
    "p5_bot_operated",
    f"""SELECT repo_id, people, bots, round(bots::DOUBLE / people, 6) AS ratio, top_login, names FROM (SELECT repo_id, count(*) AS people, count_if({_BOT})::BIGINT AS bots,
arg_min(owner_login, (-contributions, owner_login)) AS top_login, coalesce(array_to_string(list_sort(list(owner_login) FILTER ({_BOT})), ','), '') AS names FROM {_IN} GROUP BY 1)
WHERE ends_with(top_login, '[bot]') OR ends_with(top_login, '-bot') OR bots >= 0.5 * people ORDER BY round(bots::DOUBLE / people, 6) DESC, repo_id LIMIT 40""",
)(lambda p: P.bot_operated(p.contributions, p.nodes))
query(
    "p6_abandoned_influential",
    """SELECT id, full_name, stars, year FROM nodes WHERE stars >= (SELECT greatest(50, list_sort(list(stars))[CAST(floor(0.75 * count(*)) AS BIGINT) + 1]) FROM nodes)
AND year <= (SELECT max(year) FROM facts) - 5 ORDER BY stars DESC, id LIMIT 40""",
)(lambda p: P.abandoned_influential(p.counted_nodes, p.counted_core))
query(
    "p7_language_monoculture",
    """SELECT cluster, language, repos, round(share, 6) AS share FROM (SELECT cluster, CAST(sum(n) AS BIGINT) AS repos, arg_min(language, (-n, language)) AS language, max(n)::DOUBLE / sum(n) AS share FROM
(SELECT cluster, coalesce(primary_language, '—') AS language, count(*) AS n FROM clusters c JOIN nodes n ON n.id = c.id WHERE cluster >= 0 GROUP BY 1, 2) GROUP BY 1)
WHERE repos >= 3 AND share >= 0.8 AND language <> '—' ORDER BY repos DESC, cluster LIMIT 30""",
    CLUSTERS,
)(lambda p: P.language_monoculture(p.nodes, p.clusters))
query(
    "p9_dependency_convergence",
    """SELECT package, count(DISTINCT repo_id) AS repos, min(ecosystem) AS ecosystem FROM dependencies WHERE repo_id IN (SELECT id FROM nodes) GROUP BY 1
HAVING count(DISTINCT repo_id) >= 3 ORDER BY 2 DESC, 1 LIMIT 40""",
)(lambda p: P.dependency_convergence(p.tables.dependencies, p.nodes))

query(
    "r1_repo_inspector",
    f"""SELECT f.id, f.full_name, f.stars, coalesce(people, '') AS people, coalesce(mix, '') AS mix, coalesce(tags, '') AS releases, coalesce(pk, '') AS packages, coalesce(nb, '') AS neighbours FROM nodes f
LEFT JOIN (SELECT repo_id, string_agg(owner_login || ':' || contributions, ',' ORDER BY r) AS people FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY contributions DESC, owner_login) AS r FROM {_IN}) WHERE r <= 12 GROUP BY 1) a ON a.repo_id = f.id
LEFT JOIN (SELECT repo_id, string_agg(language || ':' || bytes, ',' ORDER BY r) AS mix FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY bytes DESC, language) AS r FROM repo_languages) WHERE r <= 6 GROUP BY 1) b ON b.repo_id = f.id
LEFT JOIN (SELECT repo_id, string_agg(tag, ',' ORDER BY r) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY published_at DESC NULLS LAST, tag) AS r FROM releases) WHERE r <= 6 GROUP BY 1) c ON c.repo_id = f.id
LEFT JOIN (SELECT repo_id, string_agg(package, ',' ORDER BY r) AS pk FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY package) AS r FROM (SELECT DISTINCT repo_id, package FROM dependencies)) WHERE r <= 14 GROUP BY 1) d ON d.repo_id = f.id
LEFT JOIN (SELECT id, string_agg(nbr || ':' || w, ',' ORDER BY r) AS nb FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, nbr) AS r FROM adj) WHERE r <= 10 GROUP BY 1) e ON e.id = f.id""",
)(lambda p: R.repo_inspector(p.nodes, p.contributions, p.tables.repo_languages, p.tables.releases, p.tables.dependencies, p.edges))
query(
    "r2_person_inspector",
    """SELECT login, type, repos, total, visible, coalesce(top, '') AS top, coalesce(languages, '') AS languages FROM (SELECT c.owner_login AS login, o.type, count(*) AS repos, CAST(sum(contributions) AS BIGINT) AS total,
count(n.id) AS visible FROM contributions c LEFT JOIN owners o ON o.login = c.owner_login LEFT JOIN nodes n ON n.id = c.repo_id GROUP BY 1, 2) x
LEFT JOIN (SELECT owner_login, string_agg(repo_id || ':' || contributions, ',' ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY owner_login ORDER BY contributions DESC, repo_id) AS r FROM contributions) WHERE r <= 40 GROUP BY 1) y ON y.owner_login = x.login
LEFT JOIN (SELECT owner_login, string_agg(language || ':' || k, ',' ORDER BY k DESC, language) AS languages FROM (SELECT c.owner_login, coalesce(primary_language, '—') AS language, count(*) AS k FROM contributions c JOIN facts f ON f.id = c.repo_id GROUP BY 1, 2) GROUP BY 1) z ON z.owner_login = x.login""",
)(lambda p: R.person_inspector(p.contributions, p.tables.owners, p.core, p.nodes))
query("r3_star_percentile", "SELECT id, stars, round((rank() OVER (ORDER BY stars) - 1)::DOUBLE / count(*) OVER (), 6) AS percentile FROM nodes")(lambda p: Fi.each(R.star_percentile(p.counted_nodes)).select("id", "stars", "percentile"))
query(
    "r4_repo_profile",
    f"""SELECT n.id, n.license, round(pr.percentile, 6) AS percentile, (SELECT max(year) FROM facts) - n.year AS years_since_push, coalesce((SELECT max(year) FROM facts) - n.year >= 5, false) AS stale,
b.people, b.top_login, round(b.share, 6) AS top_share, b.people > 1 AND b.share >= 0.7 AS bus_factor, e.nbr AS nearest, e.w AS nearest_weight, c.cluster, c.cluster_size, n.is_fork, n.archived FROM nodes n
JOIN (SELECT id, (rank() OVER (ORDER BY stars) - 1)::DOUBLE / count(*) OVER () AS percentile FROM nodes) pr ON pr.id = n.id
LEFT JOIN (SELECT repo_id, count(*) AS people, arg_min(owner_login, (-contributions, owner_login)) AS top_login, CASE WHEN sum(contributions) = 0 THEN 1 ELSE max(contributions)::DOUBLE / sum(contributions) END AS share FROM {_IN} GROUP BY 1) b ON b.repo_id = n.id
LEFT JOIN (SELECT id, arg_min(nbr, (-w, nbr)) AS nbr, max(w) AS w FROM adj GROUP BY 1) e ON e.id = n.id JOIN clusters c ON c.id = n.id""",
    CLUSTERS,
)(lambda p: R.repo_profile(p.counted_nodes, p.counted_core, p.contributions, p.edges, p.clusters))
query(
    "r5_person_profile",
    f"""SELECT x.*, y.language, z.top_repo, coalesce(c.clusters, 0) AS clusters, coalesce(c.clusters, 0) >= 2 AS bridge, coalesce(k.mates, '') AS mates FROM
(SELECT l.owner_login AS login, CASE WHEN ends_with(l.owner_login, '[bot]') OR ends_with(l.owner_login, '-bot') THEN 'bot' WHEN o.type = 'Organization' THEN 'organisation' ELSE 'user' END AS kind,
 count(*) AS repos, CAST(sum(contributions) AS BIGINT) AS commits FROM inn l LEFT JOIN owners o ON o.login = l.owner_login GROUP BY 1, 2) x
LEFT JOIN (SELECT owner_login, arg_min(language, (-k, language)) AS language FROM (SELECT inn.owner_login, primary_language AS language, count(*) AS k FROM inn JOIN nodes n ON n.id = repo_id WHERE primary_language IS NOT NULL GROUP BY 1, 2) GROUP BY 1) y ON y.owner_login = x.login
LEFT JOIN (SELECT owner_login, arg_min(repo_id, (-contributions, repo_id)) AS top_repo FROM inn GROUP BY 1) z ON z.owner_login = x.login
LEFT JOIN (SELECT owner_login, count(DISTINCT cluster) FILTER (cluster >= 0) AS clusters FROM inn JOIN clusters c ON c.id = repo_id GROUP BY 1) c ON c.owner_login = x.login
LEFT JOIN (SELECT a, string_agg(b || ':' || k, ',' ORDER BY k DESC, b) AS mates FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY k DESC, b) AS r FROM
 (SELECT p.owner_login AS a, q.owner_login AS b, count(*) AS k FROM inn p JOIN inn q ON p.repo_id = q.repo_id AND p.owner_login <> q.owner_login WHERE NOT (ends_with(q.owner_login, '[bot]') OR ends_with(q.owner_login, '-bot')) GROUP BY 1, 2)) WHERE r <= 3 GROUP BY 1) k ON k.a = x.login""",
    (*CLUSTERS, f"inn AS (SELECT repo_id, owner_login, contributions FROM {_IN})"),
)(lambda p: R.person_profile(p.contributions, p.tables.owners, p.nodes, p.clusters))
