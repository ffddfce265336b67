"""Figures of a pile that nothing is in, as SQL has them: sums and maxima are null, shares of nothing are not a number."""

import math

import pytest

from weftline.operators import aggregates as A
from weftline.operators import graph as G


@pytest.fixture
def none(spark):
    edges = spark.createDataFrame([], "src long, dst long, shared long, who array<string>")
    nodes = spark.createDataFrame([], "id long, stars long")
    return nodes, edges


def test_tiles_of_nothing(spark, none):
    links = spark.createDataFrame([], "repo_id long, owner_login string, contributions long")
    assert tuple(A.dashboard_tiles(*none, links).head()) == (0, None, 0, 0, None)


def test_net_of_nothing(spark, none):
    clusters = spark.createDataFrame([], "id long, cluster long, cluster_size long")
    row = G.net_stats(*none, G.connected_components(*none), clusters).head().asDict()
    assert math.isnan(row.pop("density_pct")) and math.isnan(row.pop("mean_degree"))
    assert row == {"nodes": 0, "edges": 0, "max_degree": None, "components": 0, "largest": None, "largest_pct": None, "isolates": 0, "clusters": 0, "largest_cluster": None}
    one = spark.createDataFrame([(1, 5)], "id long, stars long")
    lone = G.net_stats(one, none[1], G.connected_components(one, none[1]), spark.createDataFrame([(1, -1, 1)], clusters.schema)).head()
    assert math.isnan(lone["density_pct"]) and (lone["mean_degree"], lone["largest_pct"], lone["isolates"]) == (0.0, 100.0, 1)


def test_nothing_around_no_node(none):
    assert G.default_center(none[1]) is None and G.ego_network(none[1], None).collect() == []


def test_components_of_nothing(none):
    assert tuple(G.connected_components(*none).head()) == (0, None)
