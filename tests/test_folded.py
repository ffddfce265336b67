"""Figures of a fold from classes of twins against all its edges."""

import random
from collections import Counter

import pytest

from weftline.operators import folded as N
from weftline.operators import graph as G

LINKS = "repo_id long, owner_login string"


def told(links, copies):
    """The row of ``net_stats`` edge by edge; a repository votes with each of its copies."""
    held = {}
    for r, p in links:
        if r in copies and p is not None:
            held.setdefault(p, set()).add(r)
    near = {}
    for repos in held.values():
        for a in repos:
            for b in repos - {a}:
                near.setdefault(a, Counter())[b] += 1
    labels = {x: x for x in near}
    for _ in range(9):
        new = {}
        for x, others in near.items():
            score = Counter()
            for y, w in others.items():
                score[labels[y]] += w * copies[y]
            new[x] = max(score, key=lambda v, x=x, score=score: (score[v], v == labels[x], -v))
        labels = new
    seen, components = set(), []
    for x in near:
        if x not in seen:
            seen.add(x)
            front = found = {x}
            while front := {y for z in front for y in near[z]} - seen:
                seen |= front
                found = found | front
            components.append(len(found))
    sizes = Counter()
    for x, label in labels.items():
        sizes[label] += copies[x]
    n, m = sum(copies[x] for x in near), sum(map(len, near.values())) // 2
    largest = max(components)
    return (n, m, round(200 * m / (n * (n - 1)), 6), round(2 * m / n, 6), max(map(len, near.values())), len(components), largest, round(100 * largest / n, 6), n - len(near),
            sum(k > 1 for k in sizes.values()), max(sizes.values()))


@pytest.mark.parametrize("hub", [0, 405])
def test_figures_of_all_edges_whoever_has_how_many(spark, hub):
    rng = random.Random(hub + 1)
    links = [(r, "hub") for r in range(hub)]  # more than 400: before, its pairs were left out
    for k in range(40):
        links += [(r, f"p{k}") for r in rng.sample(range(450), rng.randint(1, 14))]
    links += [(r, p) for r in range(600, 630) for p in ("t", "u")] + [(r, "z") for r in range(700, 704)] + [(900, "alone"), (999, "z"), (3, None)]
    copies = {r: rng.choice([1, 1, 2, 3]) for r in {r for r, _ in links} | {950} if r != 999}
    rows = [(r, n - k) for r, n in copies.items() for k in ((0,) if n < 3 else (1, 2))]  # copies of an id in one row or two
    nodes = spark.createDataFrame(rows, "id long, copies long")
    assert Counter({r: sum(n for q, n in rows if q == r) for r in copies}) == Counter(copies)
    (got,) = N.fold_stats(spark.createDataFrame(links, LINKS), nodes).collect()
    assert tuple(got) == told(links, copies)


def test_an_empty_fold_and_one_without_edges(spark):
    for links in ([], [(1, "a"), (2, "b")]):
        (row,) = N.fold_stats(spark.createDataFrame(links, LINKS), spark.createDataFrame([(1,), (2,)], "id long")).collect()
        assert (row.nodes, row.edges, row.max_degree, row.components, row.largest, row.isolates, row.clusters, row.largest_cluster) == (0, 0, None, 0, None, 0, 0, None)


def test_a_fold_without_a_cap_keeps_everybody(spark):
    links = spark.range(401).selectExpr("id AS repo_id", "'hub' AS owner_login")
    assert G.fold_edges(links, spark.range(401)).isEmpty()
    assert G.fold_edges(links, spark.range(401), cap=None).count() == 401 * 200


def test_best_labels_of_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(N, "MOST", 3)
    rng = random.Random(6)
    rows = [(i, p) for i in range(40) for p in "abcdef" if rng.random() < 0.4]
    m = {label: rng.randint(0, 3) for label in range(-8, 30)}
    labels = [(p, label, rng.randint(1, 4), m[label]) for p in "abcdeg" for label in m if rng.random() < 0.3]
    best = N.best_labels(spark.createDataFrame(rows, "id long, owner_login string"), spark.createDataFrame(labels, "owner_login string, label long, v long, m long"), block=2)
    want = {}
    for i in {i for i, _ in rows}:
        score = Counter()
        for p, label, v, _ in labels:
            score[label] += v * ((i, p) in rows)
        found = sorted((-s, label) for label, s in score.items() if s)
        if found:
            want[i] = (sum(m[label] for _, label in found), found[:2])
    assert {r.id: (r.met, [tuple(t) for t in r.top]) for r in best.collect()} == want
