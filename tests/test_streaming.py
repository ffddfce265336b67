"""Streams against the batch operators."""

import json
import random

import pytest

from weftline.operators.progress import throughput
from weftline.operators.worklists import enrich_worklist
from weftline.sources import router
from weftline.sources.gazetteer import gazetteer
from weftline.streaming import streams
from weftline.streaming.log import Log, Spec


def test_ingest_is_incremental_and_idempotent(spark, tmp_path):
    schema = "url string, repo_id long, body string, fetched_at timestamp"
    source = tmp_path / "in"

    def land(name: str, rows: list[tuple]) -> None:
        spark.createDataFrame(rows, "url string, repo_id long, body string, t int").selectExpr("url", "repo_id", "body", "timestamp_seconds(t) AS fetched_at").coalesce(1).write.mode("append").parquet(str(source))

    repo = {"id": 7, "full_name": "o/r", "owner": {"id": 1, "login": "o", "type": "User"}, "stargazers_count": 3, "topics": ["x"]}
    land("a", [("/repos/o/r", 7, json.dumps(repo), 1)])

    def run() -> None:
        q = streams.stream_ingest(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()

    run()
    versions = streams.Tables(str(tmp_path / "out"))
    assert versions.table(spark, "repos", 0).head().stars == 3 and versions.table(spark, "repo_topics", 0).count() == 1
    land("b", [("/repos/o/r", 7, json.dumps(repo | {"stargazers_count": 9, "topics": []}), 2), ("/users/o", None, json.dumps({"id": 1, "login": "o", "location": "Berlin"}), 2)])
    run()
    assert versions.table(spark, "repos", 1).head().stars == 9 and versions.table(spark, "repos", 0).head().stars == 3
    owner = versions.table(spark, "owners", 1).head()
    assert (owner.enriched, owner.location) == (1, "Berlin")
    assert versions.table(spark, "repo_topics", 1).count() == 0


def test_ingest_of_enumeration_pages(spark, tmp_path):
    versions = streams.Tables(str(tmp_path / "out"))

    def ingest(number: int, *rows: tuple) -> tuple[dict, dict]:
        batch = spark.createDataFrame([(u, i, json.dumps(b), t) for u, i, b, t in rows], "url string, repo_id long, body string, t int")
        streams.ingest_batch(batch.selectExpr("url", "repo_id", "body", "timestamp_seconds(t) AS fetched_at"), number, versions)
        read = lambda name: {r.id: r for r in versions.table(spark, name, number).collect()}
        return read("repos"), read("owners")

    entry = lambda i, name, owner: {"id": i, "full_name": f"{name}/r", "owner": {"id": owner, "login": name, "type": "User", "html_url": f"h/{name}"}}
    full = entry(7, "o", 1) | {"stargazers_count": 3}
    page = [entry(7, "stub", 1), entry(8, "p", 2), entry(9, "q", 2)]
    repos, owners = ingest(0, ("/repos/o/r", 7, full, 1), ("/repositories?since=0", None, page, 2), ("/repositories?since=7", None, page[1:2], 3))
    assert {i: (r.full_name, r.stars, r.detailed) for i, r in repos.items()} == {7: ("o/r", 3, 1), 8: ("p/r", None, 0), 9: ("q/r", None, 0)}
    assert repos[8].discovered_at.second == 2 and repos[8].attempts == 0
    assert {i: r.enriched for i, r in owners.items()} == {1: 0, 2: 0} and owners[1].login == "o" and owners[2].html_url[:2] == "h/"
    repos, owners = ingest(1, ("/repos/p/r", 8, entry(8, "p", 2) | {"stargazers_count": 5}, 4), ("/repositories?since=8", None, [entry(9, "other", 2), entry(10, "z", 3)], 5))
    assert {i: (r.full_name, r.stars, r.detailed) for i, r in repos.items()} == {7: ("o/r", 3, 1), 8: ("p/r", 5, 1), 9: ("q/r", None, 0), 10: ("z/r", None, 0)}
    assert owners[2].login == "p" and set(owners) == {1, 2, 3}


def test_geocode_stream(spark, tmp_path):
    spark.createDataFrame([(1, "Tokyo, Japan"), (2, "Nowhere")], "id long, location string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, location string").parquet(str(tmp_path / "in"))
    q = streams.stream_geocode(stream, gazetteer(spark), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert [r.city for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["Tokyo"]


def test_throughput_stream_equals_batch(spark, tmp_path):
    rows = [("k", t, v) for t, v in ((0, 0), (4, 8), (8, 8))] + [("j", 0, 1), ("j", 10, 31)]
    snaps = spark.createDataFrame(rows, "k string, t int, value long").selectExpr("k", "timestamp_seconds(t) AS ts", "value")
    snaps.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = streams.stream_throughput(spark.readStream.schema(snaps.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("rates").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("rates").collect()} == {tuple(r) for r in throughput(snaps).collect()}


HOST = "https://api.example.org"


def responses_of(spark, rows):
    """Raw responses (url, body, day)."""
    frame = spark.createDataFrame([(u, b if isinstance(b, str) else json.dumps(b), t) for u, b, t in rows], "url string, body string, t int")
    return frame.selectExpr("url", "body", "timestamp_seconds(t) AS fetched_at")


def person(i: int, n: int) -> dict:
    return {"id": i, "login": f"u{i}", "type": "User", "html_url": f"h/u{i}", "contributions": n}


def test_a_bad_body_changes_nothing_and_an_empty_list_empties(spark, tmp_path):
    tables = streams.Tables(str(tmp_path / "out"))
    repo = {"id": 7, "full_name": "O/R", "owner": {"id": 1, "login": "o", "type": "User"}, "topics": ["x", "y"]}
    people = lambda: sorted((r.repo_id, r.owner_login, r.contributions) for r in tables.table(spark, "contributions").collect())
    steps = [
        ([(f"{HOST}/repos/o/r", repo, 1), (f"{HOST}/repos/o/r/contributors?per_page=100", [person(1, 3), person(2, 1)], 2), (f"{HOST}/repositories/7/contributors?per_page=100&page=2", [person(3, 5), {"contributions": 9}], 3)], [(7, "u1", 3), (7, "u2", 1), (7, "u3", 5)]),
        ([(f"{HOST}/repos/o/r/contributors?per_page=100", "<html>502</html>", 4), (f"{HOST}/repos/o/r/contributors?per_page=100&page=2", '{"message": "no"}', 4), (f"{HOST}/repos/o/r", "[1", 4)], [(7, "u1", 3), (7, "u2", 1), (7, "u3", 5)]),
        ([(f"{HOST}/repositories/7/contributors?page=2&per_page=100", [person(3, 6)], 5)], [(7, "u1", 3), (7, "u2", 1), (7, "u3", 6)]),
        ([(f"{HOST}/repos/O/r/contributors?per_page=100", [person(2, 2)], 6)], [(7, "u2", 2)]),  # the list is one page now
        ([(f"{HOST}/repos/o/r/contributors?per_page=100", [], 7), (f"{HOST}/repos/no/such/languages", {"C": 1}, 7), ("mailto:x", "{}", 7), (None, "{}", 7)], []),
    ]
    for number, (rows, want) in enumerate(steps):
        streams.ingest_batch(responses_of(spark, rows), number, tables)
        assert people() == want
    assert sorted((r.url or "", r.reason) for r in tables.table(spark, "quarantine").collect()) == [
        ("", "url"), (f"{HOST}/repos/no/such/languages", "repository"), (f"{HOST}/repos/o/r", "body"), (f"{HOST}/repos/o/r/contributors?per_page=100", "body"),
        (f"{HOST}/repos/o/r/contributors?per_page=100&page=2", "body"), ("mailto:x", "url"),
    ]
    owners = {r.id: r for r in tables.table(spark, "owners").collect()}
    assert set(owners) == {1, 2, 3} and {r.enriched for r in owners.values()} == {0} and owners[3].login == "u3"
    assert {r.topic for r in tables.table(spark, "repo_topics").collect()} == {"x", "y"}


def test_contributors_come_to_the_worklist(spark, tmp_path):
    tables = streams.Tables(str(tmp_path / "out"))
    repo = {"id": 7, "full_name": "o/r", "owner": {"id": 1, "login": "o"}}
    streams.ingest_batch(responses_of(spark, [("/repos/o/r", repo, 1), ("/repos/o/r/contributors", [person(2, 4), person(5, 1) | {"login": "ci[bot]"}, person(1, 2) | {"login": "o"}], 1), ("/users/o", {"id": 1, "login": "o", "name": "N"}, 2)]), 0, tables)
    owners = tables.table(spark, "owners")
    todo = enrich_worklist(tables.table(spark, "repos"), tables.table(spark, "contributions"), owners)
    assert [r.login for r in todo.collect()] == ["u2"]


def folder_bytes(path) -> int:
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_batches_write_what_they_bring_and_folds_change_nothing(spark, tmp_path):
    spec = {"t": Spec(("id",), keep=("name",), first=("born_as",), greatest=("level",))}
    log, rng, want, wrote = Log(str(tmp_path / "log"), spec, fan=3), random.Random(4), {}, []
    for number in range(14):
        ids = range(5000) if number == 0 else rng.sample(range(5200), 6)
        rows = [(i, None if rng.random() < 0.5 else f"n{number}", f"x{number}" if rng.random() < 0.8 else None, rng.randint(0, 9), rng.randint(0, 1) if number else 1, number * 100 + 5) for i in ids]
        for i, name, other, level, full, _ in rows:
            old = want.get(i)
            if old is None:
                want[i] = (name, other, other, level, full)
            elif full:
                want[i] = (name or old[0], other, old[2], max(level, old[3]), 1)
            elif not old[4]:
                want[i] = (old[0] or name, old[1], old[2], max(level, old[3]), 0)
            else:
                want[i] = (old[0] or name, *old[1:3], max(level, old[3]), 1)
        frame = spark.createDataFrame(rows, "id long, name string, other string, level int, full int, t int").selectExpr("*", "other AS born_as", "timestamp_seconds(t) AS at")
        parts = [streams.stamped(frame.where(f"full = {k}").drop("full", "t"), number, bool(k), "at") for k in (0, 1)]
        for _ in range(2 if number in (3, 8) else 1):  # a batch that is repeated
            log.commit(spark, number, {"t": parts[0].unionByName(parts[1])})
        segments = log.manifest(spark, number)["t"]
        wrote.append(sum(folder_bytes(tmp_path / "log" / "t" / s["path"].rsplit("/", 1)[1]) for s in segments if s["high"] == number))
        assert [(s["low"], s["high"]) for s in segments][0][0] == 0 and all(a["high"] + 1 == b["low"] for a, b in zip(segments, segments[1:], strict=False))
    got = {r.id: (r.name, r.other, r.born_as, r.level) for r in log.stored(spark, "t").collect()}
    assert got == {i: v[:4] for i, v in want.items()}
    assert max(wrote[1:]) * 4 < wrote[0]  # no later batch rewrites the table
    assert len(log.manifest(spark)["t"]) <= 8
    named = {s["path"].rsplit("/", 1)[1] for n in (11, 12, 13) for s in log.manifest(spark, n)["t"]}
    assert {p.name for p in (tmp_path / "log" / "t").iterdir()} == named


def test_a_batch_that_died_before_its_manifest_has_no_effect(spark, tmp_path, monkeypatch):
    tables = streams.Tables(str(tmp_path / "out"), fan=2)
    repo = lambda stars: [("/repos/o/r", {"id": 7, "full_name": "o/r", "stargazers_count": stars}, stars)]
    streams.ingest_batch(responses_of(spark, repo(1)), 0, tables)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Log, "_put", die)
        with pytest.raises(RuntimeError):
            streams.ingest_batch(responses_of(spark, repo(2)), 1, tables)
    assert tables.table(spark, "repos").head().stars == 1
    streams.ingest_batch(responses_of(spark, repo(2)), 1, tables)
    assert tables.table(spark, "repos").head().stars == 2 and tables.table(spark, "repos", 0).head().stars == 1


def test_routes(spark):
    urls = {
        "/repos/o/r": ("repo", "o/r", None, 1), f"{HOST}/repos/o/r/?x=1": ("repo", "o/r", None, 1), f"{HOST}/repos/o/r.js/releases?per_page=100&page=3#top": ("releases", "o/r.js", None, 3),
        f"{HOST}/repositories/42/contributors?page=2": ("contributors", None, 42, 2), f"{HOST}/repositories?since=42&per_page=100": ("enumeration", None, None, 1),
        f"{HOST}/users/x": ("user", None, None, 1), f"{HOST}/users/x/repos": (None, None, None, 1), "/repos/o/r/dependency-graph/sbom": ("sbom", "o/r", None, 1),
        "/repos/o/r/commits": (None, "o/r", None, 1), "": (None, None, None, 1), f"{HOST}/repos/o/r/languages?per_page=7": ("languages", "o/r", None, 1), "/repositories/9": ("repo", None, 9, 1),
    }
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: (r.kind, r.full_name, r.url_repo_id, r.page) for r in router.route(frame).collect()} == urls


def test_owners_are_extracted_in_one_pass(spark):
    from weftline.sources import bronze

    rows = [
        ("/users/a", '{"id": 1, "login": "a", "following": 2, "created_at": "2020-01-02T03:04:05Z"}'), ("/users/b", '{"login": "b"}'), ("/users/c", None),
        ("/repos/o/n", '{"id": 5, "owner": {"id": 3, "login": "o", "type": "User"}}'), ("/repos/o/m", '{"id": 6}'),
        ("/repos/o/n/contributors", '[{"id": 10, "login": "p"}, {"id": null, "login": "q"}, {"id": 11, "login": ""}, {"id": 12}, null]'), (None, '{"id": 9}'),
    ]
    owners = bronze.extract_owners(spark.createDataFrame(rows, "url string, body string").selectExpr("*", "timestamp '2024-01-01' AS fetched_at"))
    found = owners.selectExpr("id", "login", "type", "following", "string(created_at)", "enriched").collect()
    assert sorted(map(tuple, found)) == [(1, "a", None, 2, "2020-01-02 03:04:05", 1), (3, "o", "User", None, None, 0), (10, "p", None, None, None, 0)]
    assert "Union" not in owners._jdf.queryExecution().optimizedPlan().toString()


def test_responses_join_lines_and_orders_once_a_kind(spark):
    from weftline.plans import extras
    from weftline.plans.registry import Tables

    plan = extras.responses(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_") == 4  # contributors, releases, languages, dependencies
