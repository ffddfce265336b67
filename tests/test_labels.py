"""Label propagation by changes against nine full rounds."""

import random
from collections import Counter

import pytest

from weftline.operators import graph


def full_rounds(nodes, edges, rounds=9):
    near = {x: [] for x in nodes}
    for a, b, w in edges:
        if a in near and b in near:
            near[a].append((b, w)), near[b].append((a, w))
    label, moves = {x: x for x in nodes}, []
    for _ in range(rounds):
        new = {}
        for x in nodes:
            score = Counter()
            for y, w in near[x]:
                score[label[y]] += w
            new[x] = max(score, key=lambda v: (score[v], v == label[x], -v)) if score else label[x]
        moves.append(sum(len(near[x]) for x in nodes if new[x] != label[x]))
        label = new
    return label, moves


@pytest.mark.parametrize(("seed", "count", "links"), [(1, 60, 70), (2, 60, 200), (3, 200, 260)])
def test_changes_give_the_labels_of_full_rounds(spark, seed, count, links):
    rng = random.Random(seed)
    nodes = list(range(count))
    pairs = {tuple(sorted((rng.randrange(count + 5), rng.choice((rng.randrange(count), 0))))) for _ in range(links)}
    edges = [(a, b, rng.randint(1, 3)) for a, b in sorted(pairs) if a != b]
    want, moves = full_rounds(nodes, edges)
    trace: list[int] = []
    labels = graph.label_propagation(spark.createDataFrame([(x,) for x in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long, shared long"), trace=trace)
    assert {r.id: r.label for r in labels.collect()} == want
    assert trace == [n for n in moves[:8]][: len(trace)] and not any(moves[len(trace) + 1 :])  # only who moved writes, to each neighbour


def test_nothing_to_do(spark):
    none = spark.createDataFrame([], "src long, dst long, shared long")
    assert sorted(graph.label_propagation(spark.range(3), none).collect()) == [(0, 0), (1, 1), (2, 2)]
    assert graph.label_propagation(spark.range(0), none).collect() == []
    assert sorted(graph.label_propagation(spark.range(2), spark.createDataFrame([(0, 1, 1)], none.schema), rounds=1).collect()) == [(0, 1), (1, 0)]
