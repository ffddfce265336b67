"""Raw responses: how often they are made, judged and shuffled."""

import re

from pyspark.sql import functions as F

from weftline.plans.extras import narrowed, responses
from weftline.plans.registry import Tables
from weftline.sources import views
from weftline.sources.router import current_pages, judged, sort_out

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_narrowed_relations_are_those_of_the_model(spark):
    model = Tables(spark, FOLDER)
    made = narrowed(model)
    for name in ("repos", "contributions", "repo_languages", "releases", "dependencies", "repo_topics"):
        a, b = getattr(model, name), getattr(made, name).select(*getattr(model, name).columns)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name


def test_responses_join_lines_and_orders_no_more(spark):
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan(responses(Tables(spark, FOLDER))))
    assert scans and not any(c in s for s in scans for c in ("l_orderkey", "o_orderkey"))


def test_given_relations_are_not_made_again():
    assert "fx_link AS (" not in views.cte("contributions", given=("fx_link",)) and "owners AS (" in views.cte("contributions", given=("fx_link",))


def test_judged_responses_are_not_judged_again(spark):
    rows = [("/repos/a/b", '{"id": 1, "full_name": "a/b"}'), ("/repos/a/b/languages", '{"C": 2}'), ("/repos/c/d/languages", "{}"), ("/repos/a/b/releases", "{}"), ("/else", "1")]
    raw = spark.createDataFrame(rows, "url string, body string").withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    kept = judged(raw).localCheckpoint()
    for once, twice in zip(sort_out(kept), sort_out(raw), strict=True):
        assert sorted(map(str, once.collect())) == sorted(map(str, twice.select(*once.columns).collect()))
    sound, bad = sort_out(kept)
    assert "json_array_length" not in plan(sound) + plan(bad) and "RLIKE" not in plan(sound) + plan(bad)
    assert sorted(r.reason for r in bad.collect()) == ["body", "repository", "url"]


def test_pages_are_shuffled_once(spark):
    at = F.timestamp_seconds(F.col("fetched"))
    rows = [(1, 1, 10, "a"), (1, 1, 20, "b"), (1, 2, 15, "old"), (1, 3, 25, "c"), (2, 2, 5, "d"), (3, 1, 7, "e")]
    pages = current_pages(spark.createDataFrame(rows, "repo_id long, page int, fetched int, j string").withColumn("fetched_at", at).drop("fetched"), "j")
    assert sorted(r.j for r in pages.collect()) == ["b", "c", "d", "e"]
    assert plan(pages).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
