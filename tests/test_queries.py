"""Registered queries against their DuckDB oracles at the smallest size, all of them."""

import math

import duckdb
import pytest

from weftline.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def normal(rows):
    def value(v):
        if isinstance(v, float):
            return round(v, 6) if math.isfinite(v) else str(v)
        return v if v is None or isinstance(v, (int, bool)) else str(v)

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert normal(map(tuple, got.select(*columns).collect())) == normal(want.fetchall())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
