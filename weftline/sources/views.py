"""The collaboration model over the test tables: one SQL text per relation, shared by Spark and the oracles."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Relation -> SQL over the test tables and earlier relations; ``{one}`` is the first index of a split array.
SQL: dict[str, str] = {
    "fx_link": """
SELECT l.l_partkey AS part, o.o_custkey AS cust, l.l_suppkey AS supp, l.l_orderkey AS ord, l.l_linenumber AS ln,
  CAST(floor(l.l_quantity) AS BIGINT) AS qty, CAST(floor(l.l_extendedprice) AS BIGINT) AS price, l.l_returnflag AS rf,
  l.l_shipdate AS shipdate, o.o_orderpriority AS prio
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "owners": """
SELECT c_custkey AS id,
  CASE WHEN c_custkey % 37 = 5 THEN concat(c_name, '[bot]') WHEN c_custkey % 41 = 7 THEN concat(c_name, '-bot') ELSE c_name END AS login,
  CASE WHEN c_custkey % 37 = 5 THEN 'Bot' ELSE 'User' END AS type,
  CASE c_custkey % 12 WHEN 0 THEN 'San Francisco, CA' WHEN 1 THEN 'Berlin, Germany' WHEN 2 THEN 'Deutschland' WHEN 3 THEN 'Cambridge, UK'
    WHEN 4 THEN 'Cluj-Napoca' WHEN 5 THEN 'U.K.' WHEN 6 THEN 'Remote' WHEN 7 THEN '' WHEN 8 THEN 'Austin, TX'
    WHEN 9 THEN 'Granada, Spain, Europe' WHEN 10 THEN 'Bengaluru, India' END AS location,
  CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS enriched
FROM customer
UNION ALL
SELECT 1000000000 + s_suppkey, s_name, 'Organization', CASE s_suppkey % 3 WHEN 0 THEN 'Tokyo, Japan' WHEN 1 THEN 'North Carolina' END, 1 FROM supplier""",
    "fx_part": """
SELECT part, min(supp) AS supp, max(CASE WHEN qty = 50 THEN shipdate END) AS pushed_at, min(shipdate) AS created_at FROM fx_link GROUP BY part""",
    "repos": """
SELECT p.p_partkey AS id, concat(s.s_name, '/', replace(p.p_name, ' ', '-'), '-', CAST(p.p_partkey AS VARCHAR(20))) AS full_name,
  s.s_name AS owner_login, CASE WHEN p.p_partkey % 13 = 0 THEN NULL WHEN p.p_partkey % 12 < 6 THEN concat('Lang', CAST(p.p_partkey % 12 AS VARCHAR(20))) ELSE p.p_type END AS primary_language,
  CASE WHEN p.p_partkey % 4 = 0 THEN NULL ELSE p.p_brand END AS license,
  CASE WHEN p.p_partkey % 9 = 8 THEN NULL ELSE CAST(floor(p.p_retailprice) AS BIGINT) * (p.p_partkey % 17) END AS stars,
  CAST(p.p_size AS BIGINT) AS forks, p.p_partkey % 100 AS open_issues, p.p_partkey % 5000 AS size,
  p.p_partkey % 5 = 0 AS is_fork, p.p_partkey % 11 = 0 AS archived, f.created_at, f.pushed_at,
  CASE WHEN p.p_partkey % 8 = 7 THEN 3 WHEN p.p_partkey % 3 = 0 THEN 0 ELSE 1 END AS detailed, p.p_partkey % 7 AS attempts
FROM part p LEFT JOIN fx_part f ON f.part = p.p_partkey LEFT JOIN supplier s ON s.s_suppkey = f.supp
WHERE s.s_name IS NOT NULL""",
    "contributions": """
SELECT l.part AS repo_id, o.login AS owner_login, CAST(sum((l.qty - 47) * (l.qty - 47) * (l.qty - 47)) AS BIGINT) AS contributions
FROM fx_link l JOIN owners o ON o.id = CASE WHEN l.qty = 50 AND l.part % 10 = 0 THEN l.cust % 360 ELSE (l.part % 12) * 30 + l.cust % 30 END
WHERE l.qty >= 48 GROUP BY l.part, o.login""",
    "repo_languages": """
SELECT part AS repo_id, prio AS language, CAST(sum(price) AS BIGINT) AS bytes FROM fx_link GROUP BY part, prio""",
    "repo_topics": """
SELECT DISTINCT p_partkey AS repo_id, split(p_name, ' ')[{one}] AS topic FROM part
UNION SELECT p_partkey, p_brand FROM part""",
    "releases": """
SELECT l.part AS repo_id, concat('v', CAST(l.ord AS VARCHAR(20))) AS tag, min(o.login) AS author_login, min(l.shipdate) AS published_at
FROM fx_link l JOIN owners o ON o.id = l.cust WHERE l.rf = 'R' AND l.qty >= 49 GROUP BY l.part, l.ord""",
    "dependencies": """
SELECT DISTINCT part AS repo_id, concat('pkg-', CAST(supp AS VARCHAR(20))) AS package,
  CASE WHEN ln = 1 THEN NULL ELSE CAST(ln AS VARCHAR(20)) END AS version,
  CASE supp % 3 WHEN 0 THEN 'pypi' WHEN 1 THEN 'npm' END AS ecosystem FROM fx_link WHERE qty >= 47""",
    "snapshots": """
SELECT event_type AS k, date_trunc('hour', ts) AS ts, CAST(sum(count(*)) OVER (PARTITION BY event_type ORDER BY date_trunc('hour', ts)) AS BIGINT) AS value
FROM events GROUP BY event_type, date_trunc('hour', ts)""",
    "enum_chunks": """
SELECT DISTINCT CAST(floor((p_partkey + 99) / 100.0) - 1 AS BIGINT) * 100 AS start,
  CAST(floor((p_partkey + 99) / 100.0) AS BIGINT) % 3 AS done FROM part WHERE p_partkey > 0""",
}

#: What each relation reads: test tables first, then relations.
READS = {
    "fx_link": (("lineitem", "orders"), ()), "owners": (("customer", "supplier"), ()), "fx_part": ((), ("fx_link",)),
    "repos": (("part", "supplier"), ("fx_part",)), "contributions": ((), ("fx_link", "owners")), "repo_languages": ((), ("fx_link",)),
    "repo_topics": (("part",), ()), "releases": ((), ("fx_link", "owners")), "dependencies": ((), ("fx_link",)),
    "snapshots": (("events",), ()), "enum_chunks": (("part",), ()),
}


def _needed(names: tuple[str, ...], given: Iterable[str] = ()) -> list[str]:
    """Relations that ``names`` need, themselves included, in the order of definition; those that are given need nothing and are left out."""
    found = set(names)
    for name in reversed(list(SQL)):
        if name in found and name not in given:
            found |= set(READS[name][1])
    return [name for name in SQL if name in found and name not in given]


def cte(*names: str, one: int = 1, given: Iterable[str] = ()) -> str:
    """``name AS (...), ...`` for the relations and what they need."""
    return ",\n".join(f"{n} AS ({SQL[n].replace('{one}', str(one))})" for n in _needed(names, given))


def relation(spark: SparkSession, sf_dir: str, name: str, given: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """A relation of the model over the tables in ``sf_dir``; relations that are ``given`` as frames are not made again."""
    given = given or {}
    needed = _needed((name,), given)
    tables = sorted({t for n in needed for t in READS[n][0]})
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    frames |= {n: df for n, df in given.items() if any(n in READS[r][1] for r in needed)}
    named = reduce(lambda text, t: text + f"{t} AS (SELECT * FROM {{{t}}}),\n", frames, "WITH ")
    return spark.sql(f"{named}{cte(name, one=0, given=given)}\nSELECT * FROM {name}", **frames)
