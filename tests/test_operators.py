"""Operators on small inputs worked out by hand."""

import pytest
from pyspark.sql import functions as F

from weftline.functions.bots import is_bot_sql, is_bot_ui
from weftline.operators import aggregates as A
from weftline.operators import filters as Fi
from weftline.operators import geo as W
from weftline.operators import graph as G
from weftline.operators import merges as M
from weftline.operators import patterns as P
from weftline.operators import progress as T
from weftline.operators import worklists as U
from weftline.sources import bronze as B
from weftline.sources.gazetteer import gazetteer, rows

LINKS = [(1, "alice", 10), (1, "bob", 5), (1, "carol", 3), (1, "ci[bot]", 99), (2, "alice", 8), (2, "bob", 2), (2, "ci[bot]", 88)]
REPO = "id long, full_name string, owner_login string, primary_language string, stars long, detailed int"


def table(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def links(spark):
    return table(spark, LINKS, "repo_id long, owner_login string, contributions long")


@pytest.fixture(scope="module")
def repos(spark):
    return table(spark, [(1, "org/a", "org", "Python", 100, 1), (2, "org/b", "org", "C", 50, 0), (3, "org/stub", "org", None, None, 0)], REPO)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_overlap_skips_bots_and_counts_once(links):
    assert got(G.overlap_edges(links)) == [(1, 2, 2)]
    assert got(G.overlap_edges(links, 3)) == []


def test_cross_project(links):
    assert [r.owner_login for r in A.cross_project_contributors(links).collect()] == ["alice", "bob"]


def test_core_excludes_stubs(spark, links, repos):
    owners = table(spark, [("org", "Organization")], "login string, type string")
    core = Fi.core_repos(repos, links, owners)
    assert {r.id for r in core.collect()} == {1, 2}
    langs = table(spark, [(3, "Go", 7), (1, "Python", 42)], "repo_id long, language string, bytes long")
    assert got(Fi.restrict_children(langs, core)) == [(1, "Python", 42)]
    people = {r.login: (r.repos, r.total) for r in A.people(links, owners).collect()}
    assert people["alice"] == (2, 18) and "ci[bot]" in people


def test_bot_rules_differ(spark):
    df = table(spark, [("CI[BOT]",), ("x-bot",), ("x[bot]",), (None,), ("bot",)], "l string")
    assert [tuple(r) for r in df.select(is_bot_sql("l"), is_bot_ui("l")).collect()] == [(True, False), (False, True), (True, True), (None, False), (False, False)]


def test_language_shares_of_top_only(spark):
    langs = table(spark, [(1, "A", 60), (1, "B", 30), (1, "C", 10)], "repo_id long, language string, bytes long")
    assert [r.share for r in A.language_shares(langs, 2).collect()] == [0.6667, 0.3333]
    assert A.language_shares(langs.limit(0)).count() == 0


def test_components_path_rings_and_invariants(spark):
    edges = table(spark, [(1, 2, 1, ["a"]), (2, 3, 1, ["b"]), (3, 4, 2, ["c"]), (6, 7, 5, ["d"])], "src long, dst long, shared long, who array<string>")
    nodes = table(spark, [(i,) for i in (1, 2, 3, 4, 5, 6, 7)], "id long")
    assert got(G.component_labels(nodes, edges)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6), (7, 6)]
    assert got(G.connected_components(nodes, edges)) == [(3, 4)]
    assert got(G.shortest_path(edges, 1, 4)) == [(1, 1, 2, "a"), (2, 2, 3, "b"), (3, 3, 4, "c")]
    assert got(G.shortest_path(edges, 1, 7)) == [] == got(G.shortest_path(edges, 1, 1))
    assert got(G.ego_network(edges, 1, 2)) == [(1, 0), (2, 1), (3, 2)]
    assert G.degree(edges).agg(F.sum("degree")).head()[0] == 2 * edges.count()


def test_path_of_more_than_64_hops(spark):
    chain = table(spark, [(i, i + 1, 1, [f"p{i}"]) for i in range(66)], "src long, dst long, shared long, who array<string>")
    assert sorted(map(tuple, G.shortest_path(chain, 0, 66).collect())) == [(i + 1, i, i + 1, f"p{i}") for i in range(66)]


def test_clusters_lie_in_components(spark):
    edges = table(spark, [(1, 2, 3), (2, 3, 3), (1, 3, 3), (3, 4, 1), (4, 5, 3), (5, 6, 3), (4, 6, 3)], "src long, dst long, shared long")
    nodes = table(spark, [(i,) for i in range(1, 8)], "id long")
    clusters = G.number_clusters(G.label_propagation(nodes, edges))
    assert {r.id for r in clusters.where("cluster = -1").collect()} == {7}
    both = clusters.join(G.component_labels(nodes, edges), "id").where("cluster >= 0")
    assert both.groupBy("cluster").agg(F.countDistinct("component").alias("n")).where("n > 1").isEmpty()


def test_fold_without_caps_is_overlap(links, spark):
    nodes = table(spark, [(1,), (2,)], "id long")
    people = links.where("owner_login <> 'ci[bot]'")
    folded = G.fold_edges(people, nodes)
    assert got(folded.select("src", "dst", "shared")) == got(G.overlap_edges(links))
    assert folded.head().who == ["alice", "bob"]


def test_patterns(spark, links):
    nodes = table(spark, [(1, "org/a", "org", "C", 100, True, 2015), (2, "org/b", "org", "C", 60, True, 2020)], "id long, full_name string, owner_login string, primary_language string, stars long, is_fork boolean, year int")
    assert [(r.repo_id, r.top_login) for r in P.bus_factor(links, nodes).collect()] == [(2, "ci[bot]"), (1, "ci[bot]")]
    assert {r.repo_id for r in P.bot_operated(links, nodes).collect()} == {1, 2}
    assert got(P.co_maintainers(links, nodes, 2).select("a", "b", "repos")) == [("alice", "bob", 2)]
    assert got(P.serial_forkers(nodes, 2).select("owner_login", "n")) == [("org", 2)]
    assert P.top_quarter(table(spark, [(k,) for k in (1, 2, 3, 4)], "stars long"), 0) == 4
    assert [r.id for r in P.abandoned_influential(nodes, nodes).collect()] == [1]


GOLDEN = [
    ("San Francisco, CA", "United States", "San Francisco"), ("Berlin, Germany", "Germany", "Berlin"), ("Deutschland", "Germany", None), ("🇧🇷 São Paulo", "Brazil", "São Paulo"),
    ("London", "United Kingdom", "London"), ("北京", "China", "北京"), ("Bengaluru, India", "India", "Bengaluru"), ("Austin, TX", "United States", "Austin"), ("Remote", None, None), ("", None, None),
    ("Москва, Россия", "Russia", "Москва"), ("🇯🇵", "Japan", None), ("Germany", "Germany", None), ("china", "China", None), ("Netherlands", "Netherlands", None), ("Granada, Spain, Europe", "Spain", None),
    ("North Carolina", "United States", None), ("Cambridge, UK", "United Kingdom", None), ("nowhere-ville", None, None), ("Cluj-Napoca", "Romania", "Cluj"), ("U.K.", None, None), ("U.S.A.", "United States", None),
    ("Georgia", "United States", None), ("DE", "United States", None), (None, None, None),
]


def test_geocode_golden(spark):
    places = table(spark, [(i, t) for i, (t, _, _) in enumerate(GOLDEN)], "id long, location string")
    found = {r.id: (r.country, r.city) for r in W.geocode(places, "id", "location", gazetteer(spark)).collect()}
    assert [found.get(i, (None, None)) for i in range(len(GOLDEN))] == [(c, t) for _, c, t in GOLDEN]


def test_gazetteer_is_sound():
    countries, names, cities = rows()
    known = {c for c, *_ in countries}
    assert len(known) == 82 and {c for _, c, _ in names} <= known and {c for _, c, *_ in cities} <= known
    assert all(-90 <= a <= 90 and -180 <= b <= 180 for *_, a, b in cities)


def test_gazetteer_has_all_cities(spark):
    cities = [("Bangkok", "Thailand"), ("Brisbane", "Australia"), ("Atlanta, GA", "United States"), ("Ankara", "Turkey"), ("Cairo", "Egypt"), ("Busan", "South Korea"), ("Xi'an", "China"), ("Kraków", "Poland")]
    places = table(spark, [(i, t) for i, (t, _) in enumerate(cities)], "id long, location string")
    found = {r.id: (r.country, r.city) for r in W.geocode(places, "id", "location", gazetteer(spark)).collect()}
    assert found == {i: (c, t.split(",")[0]) for i, (t, c) in enumerate(cities)}
    assert len({key for key, *_ in rows()[2]}) == len(rows()[2]) == 259


def test_geocode_pending_is_idempotent(spark):
    owners = table(spark, [(1, "a", "User", "Tokyo, Japan", 0), (2, "b", "User", "Mars Base Alpha", 0)], "id long, login string, type string, location string, enriched int")
    once = W.geocode_pending(owners, gazetteer(spark))
    assert got(once.select("id", "country", "city", "geo_tried")) == [(1, "Japan", "Tokyo", 1), (2, None, None, 1)]
    assert got(W.geocode_pending(once, gazetteer(spark))) == got(once)
    assert [r.iso for r in W.located_owners(once, gazetteer(spark)).collect()] == ["JP"]


def test_point_in_polygon(spark):
    square = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 0.0, "y": 4.0}]
    polygons = table(spark, [("q", square)], "name string, ring array<struct<x: double, y: double>>")
    points = table(spark, [(1, 1.0, 1.0), (2, 5.0, 1.0), (3, 3.9, 3.9), (4, -1.0, 2.0)], "id long, x double, y double")
    assert got(W.point_in_polygon(points, polygons)) == [(1, "q"), (3, "q")]


def test_merges(spark):
    schema = "id long, login string, type string, location string, enriched int, created_at string"
    cur = table(spark, [(1, "a", "User", "Here", 1, "2001"), (2, "b", "User", None, 0, None)], schema)
    inc = table(spark, [(1, "a2", "User", None, 0, None), (3, "c", "User", "There", 0, None)], schema)
    new = M.merge_owners(cur, inc)
    # kept where the new is null, but created_at is overwritten by null; enriched never falls
    assert got(new) == [(1, "a2", "User", "Here", 1, None), (2, "b", "User", None, 0, None), (3, "c", "User", "There", 0, None)]
    assert got(M.merge_owners(new, inc)) == got(new)
    kids = table(spark, [(1, "x"), (2, "y")], "repo_id long, topic string")
    assert got(M.replace_children(kids, kids.limit(0), table(spark, [(1,)], "repo_id long"))) == [(2, "y")]
    stubs = M.merge_stubs(cur, table(spark, [(1, "zzz", None, None, 0, None), (9, "n", None, None, 0, None)], schema))
    assert {(r.id, r.login) for r in stubs.collect()} == {(1, "a"), (2, "b"), (9, "n")}


def test_worklists(spark, repos, links):
    queue = table(spark, [(i, f"u{i}/r", 0, a) for i, a in ((2, 0), (1, 0), (3, 5))], "id long, full_name string, detailed int, attempts int")
    assert [r.id for r in U.pending_queue(queue).collect()] == [1, 2]
    owners = table(spark, [("org", 0), ("alice", 0), ("bob", 1), ("ci[bot]", 0)], "login string, enriched int")
    assert got(U.enrich_worklist(repos, links, owners)) == [("alice", 1), ("org", 0)]
    assert U.core_owner_count(repos, links).head().n == 4
    assert U.range_table(spark, 2_000_000_000, 1_000_000).count() == 2000


def test_throughput(spark):
    snaps = table(spark, [("k", f"2024-01-01 00:00:0{t}", v) for t, v in ((0, 0), (4, 8), (8, 8))], "k string, ts string, value long").withColumn("ts", F.col("ts").cast("timestamp"))
    assert T.throughput(snaps).head().rate == 1.5
    assert T.throughput(snaps.where("value = 0")).head().rate == 0.0
    assert T.throughput(snaps.repartition(3)).head().rate == 1.5
    eta = T.eta(table(spark, [("k", 5, 10, 0.5), ("d", 10, 10, 0.0), ("s", 1, 10, 0.0)], "k string, done long, total long, rate double"))
    assert {r.k: (r.eta_s, r.state) for r in eta.collect()} == {"k": (10.0, "running"), "d": (None, "done"), "s": (None, "stalled")}


def test_made_enumeration_pages_stay_bounded(spark):
    from weftline.plans import extras
    from weftline.plans.registry import Tables

    pages = extras.responses(Tables(spark, "/root/testdata/sf0.01")).where("url LIKE '/repositories%' AND body <> '{}'")
    sizes = [r.n for r in pages.selectExpr("json_array_length(body) AS n").collect()]
    assert len(sizes) > 7 and max(sizes) <= 100


def test_bronze(spark):
    rows_ = [
        ("/repos/o/r", 7, '{"id": 7, "full_name": "o/r", "owner": {"id": 1, "login": "o"}, "stargazers_count": 3, "language": null, "topics": ["x", "x", "y"], "license": {"spdx_id": "MIT"}}', 2),
        ("/repos/o/r", 7, "{}", 1), ("/repos/o/r/contributors", 7, '[{"login": "a", "contributions": 1}, {"contributions": 9}, {"login": "a", "contributions": 4}, {"login": "b"}]', 1),
        ("/repos/o/r/languages", 7, '{"C": 10, "Go": 2}', 1), ("/repos/o/r/releases", 7, '[{"id": 5, "tag_name": null, "author": null}]', 1),
        ("/repos/o/r/dependency-graph/sbom", 7, '{"sbom": {"packages": [{"name": "com.github.O/R"}, {"name": ""}, {"name": "p", "externalRefs": [{"referenceLocator": "pkg:npm/p@1"}]}, {"name": "p"}]}}', 1),
    ]
    bronze = table(spark, rows_, "url string, repo_id long, body string, t int").selectExpr("url", "repo_id", "body", "timestamp_seconds(t) AS fetched_at")
    last = B.latest_response(bronze)
    repo = B.extract_repos(last).head()
    assert (repo.id, repo.stars, repo.license, repo.is_fork) == (7, 3, "MIT", False)
    assert got(B.extract_topics(last)) == [(7, "x"), (7, "y")]
    assert got(B.extract_contributions(last)) == [(7, "a", 4), (7, "b", 0)]
    assert got(B.extract_languages(last)) == [(7, "C", 10), (7, "Go", 2)]
    assert B.extract_releases(last).head().tag == "_id5"
    assert [r.package for r in B.extract_dependencies(last).collect()] == ["p"]


def test_the_last_release_of_a_tag_wins(spark):
    body = '[{"id": 1, "tag_name": "v1", "name": "old"}, {"id": 2, "tag_name": "v2"}, {"id": 3, "tag_name": "v1", "name": "new"}, {"id": 4, "tag_name": ""}, {"id": 5}]'
    bronze = spark.createDataFrame([("/repos/o/r/releases", 7, body)], "url string, repo_id long, body string").selectExpr("*", "timestamp_seconds(1) AS fetched_at")
    got = {r.tag: r.name for r in B.extract_releases(bronze).collect()}
    assert got == {"v1": "new", "v2": None, "_id4": None, "_id5": None}


def test_helper_names_do_not_clash(spark):
    names = ["wanted", "wanted_", "__key", "__in", "__cur", "__id", "old", "new", "found", "filled"]
    df = spark.range(4).selectExpr("id", *[f"id * 10 + {k} AS `{n}`" for k, n in enumerate(names)])
    kept = Fi.restrict(df, spark.range(2), "id")
    assert kept.columns == df.columns and sorted(r.wanted for r in kept.collect()) == [0, 10]
    merged = M.merge_repos(df, df.where("id > 2").withColumn("old", df.old + 1000))
    assert merged.columns == df.columns and {r.id: r.old for r in merged.collect()} == {0: 6, 1: 16, 2: 26, 3: 1036}
    geo = df.selectExpr("*", "'x' AS country", "'c' AS city", "0D AS lat", "0D AS lon", "0 AS geo_tried")
    hits = spark.createDataFrame([(1, "Peru", "Lima", 1.0, 2.0), (2, None, None, None, None)], "id long, country string, city string, lat double, lon double")
    assert {r.id: (r.country, r.geo_tried, r.found) for r in M.merge_geo(geo, hits).collect()} == {0: ("x", 0, 8), 1: ("Peru", 1, 18), 2: ("x", 1, 28), 3: ("x", 0, 38)}


def test_of_several_stubs_the_first_discovered_is_taken(spark):
    rows = [(1, "b", 2), (1, "z", 1), (2, "y", 5), (2, "x", 5)]
    new = spark.createDataFrame(rows, "id long, full_name string, discovered_at int")
    got = {r.id: r.full_name for r in M.merge_stubs(new.limit(0), new).collect()}
    assert got == {1: "z", 2: "x"}


def test_overlap_edges_of_heavy_logins_in_blocks(spark):
    rows = [(r, f"p{p}") for p in range(3) for r in range(10 * p, 10 * p + 30)] + [(1, "alone"), (5, "x[bot]"), (6, "x[bot]")]
    frame = spark.createDataFrame(rows, "repo_id long, owner_login string")
    want = {}
    for p in range(3):
        for a in range(10 * p, 10 * p + 30):
            for b in range(a + 1, 10 * p + 30):
                want[a, b] = want.get((a, b), 0) + 1
    for block in (4, 2048):
        assert {(r.src, r.dst): r.shared for r in G.overlap_edges(frame, block=block).collect()} == want
    folded = G.fold_edges(frame, spark.range(100).withColumnRenamed("id", "id"), who=2)
    assert {(r.src, r.dst): (r.shared, len(r.who)) for r in folded.collect()} == {k: (n + (k == (5, 6)), min(2, n + (k == (5, 6)))) for k, n in want.items()}
