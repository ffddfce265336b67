"""Overlap edges under updates against a full recompute."""

import random

import pytest

from weftline.operators.graph import overlap_edges
from weftline.streaming import overlaps as O

LINKS = "repo_id long, owner_login string"


def got(df):
    return [] if df is None else sorted(map(tuple, df.collect()))


def test_random_inserts_and_deletes_equal_a_full_recompute(spark, tmp_path):
    rng, held = random.Random(3), set()
    kept = O.Overlaps(str(tmp_path / "log"), fan=3)
    people = ["hub"] * 4 + [f"p{k}" for k in range(12)] + ["ci[bot]"]
    for batch in range(7):
        gone = {x for x in held if rng.random() < 0.3}
        new = {(rng.randint(1, 25), rng.choice(people)) for _ in range(40)} - held
        rows = [(*x, -1) for x in gone] + [(*x, 1) for x in new] + [(None, "hub", 1), (3, None, 1), (4, "hub", None)]
        kept.apply(spark.createDataFrame(rows, LINKS + ", change int"), batch)
        held = held - gone | new
        if batch == 4:  # a batch that is run again changes nothing
            kept.apply(spark.createDataFrame(rows, LINKS + ", change int"), batch)
        full = spark.createDataFrame(sorted(held), LINKS)
        assert got(kept.edges(spark)) == got(overlap_edges(full))
        assert got(kept.links(spark)) == sorted((p, r, 1) for r, p in held if p != "ci[bot]")
    assert got(kept.edges(spark, 2)) == got(overlap_edges(full, 2))
    kept.apply(spark.createDataFrame([(*x, -1) for x in held], LINKS + ", change int"), 7)
    assert got(kept.edges(spark)) == [] and got(kept.links(spark)) == []


@pytest.mark.parametrize("block", [1, 3, 100])
def test_blocks_change_no_row(spark, block):
    rng = random.Random(5)
    before = [(r, p) for p in ("a", "b", "hub") for r in range(30) if p == "hub" or rng.random() < 0.4]
    after = [x for x in before if rng.random() < 0.6] + [(r, "hub") for r in range(30, 40)] + [(50, "c"), (51, "c")]
    one, two = spark.createDataFrame(before, LINKS), spark.createDataFrame(after, LINKS)
    changes = O.link_changes(one, two).withColumnRenamed("change", "d")
    want = {(a, b): n for a, b, n in got(overlap_edges(two))}
    for a, b, n in got(overlap_edges(one)):
        want[a, b] = want.get((a, b), 0) - n
    links = one.groupBy("owner_login", "repo_id").count().withColumnRenamed("count", "n")
    assert {(a, b): n for a, b, n in got(O.edge_changes(links, changes, block))} == {k: n for k, n in want.items() if n}


def test_a_batch_reads_the_folders_of_its_people_alone(spark, tmp_path):
    kept = O.Overlaps(str(tmp_path / "log"))
    kept.apply(spark.createDataFrame([(r, f"p{p}", 1) for p in range(200) for r in (p, p + 1)], LINKS + ", change int"), 0)
    part = spark.range(1).select(O.SPECS["links"].part(O.F.lit("p7")).alias("k")).head().k
    files = kept.log.rows(spark, kept.log.manifest(spark)["links"], [part]).select("owner_login", O.F.input_file_name().alias("f")).distinct().collect()
    assert "p7" in {r.owner_login for r in files} and all(f"_part={part}/" in r.f for r in files)
    plan = kept.links(spark, 0, [part])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan and "Batched: true" in plan


def test_a_stream_of_changes_and_duplicates(spark, tmp_path):
    rows = [[(1, "a", 1), (2, "a", 1), (2, "a", 1)], [(2, "a", -1), (3, "a", 1)]]
    for k, some in enumerate(rows):
        spark.createDataFrame(some, LINKS + ", change int").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(LINKS + ", change int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    kept = O.Overlaps(str(tmp_path / "log"))
    O.stream_overlaps(stream, kept, str(tmp_path / "state"), availableNow=True).awaitTermination()
    assert got(kept.edges(spark)) == [(1, 2, 1), (1, 3, 1), (2, 3, 1)]


def test_edges_told_from_kept_links_equal_the_kept_edges(spark, tmp_path):
    rng = random.Random(7)
    both = [O.Overlaps(str(tmp_path / f"log{k}"), fan=2, keep_edges=k == 0) for k in range(2)]
    assert both[1].edges(spark) is None
    for batch in range(4):  # links that come twice, or go before they come, have counts other than 1
        rows = [(rng.randint(1, 12), rng.choice(["hub", "hub", "a", "b", "ci[bot]"]), rng.choice([-1, 1, 1, 2])) for _ in range(25)]
        for kept in both:
            kept.apply(spark.createDataFrame(rows, LINKS + ", change int"), batch)
        assert got(both[1].links(spark)) == got(both[0].links(spark)) and any(n != 1 for _, _, n in got(both[1].links(spark)))
        for least in (-100, 1, 2):
            assert got(both[1].edges(spark, least)) == got(both[0].edges(spark, least)) != []
    assert got(both[1].edges(spark, batch=1)) == got(both[0].edges(spark, batch=1))
    assert "edges" not in both[1].log.manifest(spark)
    plan = both[1].edges(spark)._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.find("Initial Plan") :]
    assert "Exchange" not in plan[: plan.find("explode(")]


def test_g1_delta_edges_writes_no_edge(spark, monkeypatch):
    from weftline.plans import QUERIES
    from weftline.streaming.log import Log

    tables, commit = set(), Log.commit
    monkeypatch.setattr(Log, "commit", lambda self, spark, batch, deltas: (tables.update(deltas), commit(self, spark, batch, deltas)))
    assert QUERIES["g1_delta_edges"](spark, "/root/testdata/sf0.001").count() > 0 and tables == {"links"}
