"""Closest collaborators against all pairs."""

import random
from collections import Counter

import pytest

from weftline.operators import profiles


def brute(rows, k):
    out = {}
    for p in {p for _, p in rows}:
        shared = Counter(q for r, q in rows if q != p and not q.endswith(("[bot]", "-bot")) and (r, p) in rows)
        out[p] = sorted(((-n, q) for q, n in shared.items()))[:k]
    return out


@pytest.mark.parametrize("crowd", [0, 3, 8, 1000])
def test_first_mates_are_those_of_all_pairs(spark, crowd):
    rng = random.Random(crowd)
    people = [f"p{i:02}" for i in range(40)] + ["ci[bot]", "x-bot"]
    rows = {(r, p) for r in range(25) for p in rng.sample(people, rng.choice([1, 2, 3, 5, 9, 30]))} | {(99, p) for p in people} | {(50, "alone")}
    frame = spark.createDataFrame([*rows], "repo_id long, owner_login string")
    got = {}
    for r in profiles.mates(frame, 3, crowd).collect():
        got.setdefault(r.owner_login, []).append((-r.k, r.mate))
    want = brute(rows, 3)
    assert {p: sorted(v)[:3] for p, v in got.items()} == {p: v for p, v in want.items() if v}


def test_a_crowd_makes_no_pairs(spark):
    frame = spark.range(3000).selectExpr("1L AS repo_id", "concat('u', lpad(id, 4, '0')) AS owner_login")
    found = profiles.mates(frame, 3, 100)
    assert found.count() <= 4 * 3000 and found.where("owner_login = 'u2999'").orderBy("mate").limit(3).collect()[2].mate == "u0002"
