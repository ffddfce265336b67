"""Overlap edges by tiles: pairs are counted where they are made."""

import random

from weftline.operators.graph import overlap_edges


def test_pairs_are_not_shuffled(spark):
    rng = random.Random(1)
    links = [(r, p) for p in ("hub", "a", "b", "c") for r in range(60) if p == "hub" or rng.random() < 0.3] + [(3, "hub"), (None, "hub"), (4, None), (70, "alone"), (1, "x[bot]"), (2, "x[bot]")]
    frame = spark.createDataFrame(links, "repo_id long, owner_login string")
    want = {}
    for r, p in links:
        for q, o in links:
            if p and p == o and not p.endswith("[bot]") and r is not None and q is not None and r < q:
                want[r, q] = want.get((r, q), 0) + 1
    for block in (1, 5, 1000):
        edges = overlap_edges(frame, block=block)
        assert {(e.src, e.dst): e.shared for e in edges.collect()} == want
        plan = edges._jdf.queryExecution().executedPlan().toString()
        plan = plan[plan.find("Initial Plan") :]  # from the top down: aggregates over pairs, the pairs, one exchange by tile
        made = max(plan.find("explode("), plan.find("SortMergeJoin"))
        assert made > 0 and "Exchange" not in plan[:made]
