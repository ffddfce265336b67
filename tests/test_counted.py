"""The pile where owners share logins: written rows grow with repositories, results have every row that SQL gives."""

import duckdb
import pytest
from test_queries import NAMES, normal

from weftline.operators import filters as Fi
from weftline.operators import patterns as P
from weftline.operators import profiles as R
from weftline.plans import ORACLES, QUERIES
from weftline.plans.pile import shared_pile
from weftline.plans.registry import Tables

COPIES = 3


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """The smallest tables with their owners three times: other numbers, the same names."""
    folder, con = tmp_path_factory.mktemp("copied"), duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in NAMES:
        key = {"customer": "c_custkey", "supplier": "s_suppkey"}.get(name)
        rows = f"SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'"
        if key:
            rows = f"SELECT * EXCLUDE(k) REPLACE({key} + 100000 * k AS {key}) FROM ({rows}), range({COPIES}) r(k)"
        con.execute(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


def test_core_and_nodes_are_written_once_a_repository(spark, copied):
    pile = shared_pile(Tables(spark, copied[0]))
    for counted, rows in ((pile.counted_core, pile.core), (pile.counted_nodes, pile.nodes)):
        n = counted.count()
        assert n == counted.select("id").distinct().count() > 0
        assert rows.count() == COPIES * n and Fi.COPIES not in rows.columns


def test_counted_rows_give_what_their_rows_give(spark, copied):
    pile = shared_pile(Tables(spark, copied[0]))
    assert P.abandoned_influential(pile.counted_nodes, pile.counted_core).collect() == P.abandoned_influential(pile.nodes, pile.core).collect()
    more = (pile.contributions, pile.edges, pile.clusters)
    assert normal(R.repo_profile(pile.counted_nodes, pile.counted_core, *more).collect()) == normal(R.repo_profile(pile.nodes, pile.core, *more).collect())


@pytest.mark.parametrize("name", ["f2_core_repos", "f3_ingest_defaults", "f4_filter_facets", "f8_isolate_filter", "p6_abandoned_influential", "r3_star_percentile", "r4_repo_profile"])
def test_as_in_sql(spark, copied, name):
    got, want = QUERIES[name](spark, copied[0]), copied[1].execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert normal(map(tuple, got.select(*columns).collect())) == normal(want.fetchall())
