"""Components by contraction."""

import random

from weftline.operators import graph


def test_a_long_path_shrinks_in_every_round(spark):
    n = 100_000
    numbers = list(range(n))
    random.Random(1).shuffle(numbers)
    edges = spark.createDataFrame(list(zip(numbers[: n // 2 - 1], numbers[1 : n // 2], strict=True)) + list(zip(numbers[n // 2 : -1], numbers[n // 2 + 1 :], strict=True)), "src long, dst long")
    trace: list[int] = []
    labels = graph.component_labels(spark.range(n + 3), edges, trace)
    sizes = {r.component: r.n for r in labels.groupBy("component").agg({"id": "count"}).withColumnRenamed("count(id)", "n").collect()}
    assert sizes == {min(numbers[: n // 2]): n // 2, min(numbers[n // 2 :]): n // 2, n: 1, n + 1: 1, n + 2: 1}
    assert all(b < 0.7 * a for a, b in zip(trace, trace[1:], strict=False) if a > 100) and len(trace) <= 20


def test_stars_rings_and_what_leaves_the_nodes(spark):
    rng = random.Random(2)
    edges = [(0, k) for k in range(1, 300)] + [(1000 + k, 1000 + (k + 1) % 50) for k in range(50)] + [(2000, 5000), (2001, 5000), (7, 7)] + [(rng.randint(3000, 3100), rng.randint(3000, 3100)) for _ in range(60)]
    nodes = [*range(301), *range(1000, 1050), 2000, 2001, *range(3000, 3101)]
    top = {x: x for x in nodes}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        if a in top and b in top:
            a, b = root(a), root(b)
            top[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(edges, "src long, dst long")
    got = {r.id: r.component for r in graph.component_labels(spark.createDataFrame([(x,) for x in nodes], "id long"), frame).collect()}
    assert got == {x: root(x) for x in nodes}
    assert graph.connected_components(spark.range(3), frame.limit(0)).head().asDict() == {"components": 3, "largest": 1}
