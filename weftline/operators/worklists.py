"""Set operations and worklists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.bots import is_bot_sql
from weftline.operators.filters import restrict


def enrich_worklist(repos: DataFrame, contributions: DataFrame, owners: DataFrame) -> DataFrame:
    """(login, rank): owners of detailed repositories first (0), then contributors (1); no bots, not yet enriched."""
    first = repos.where("detailed = 1").select(F.col("owner_login").alias("login"), F.lit(0).alias("rank"))
    then = contributions.select(F.col("owner_login").alias("login"), F.lit(1).alias("rank"))
    waiting = owners.where("enriched = 0").select("login")
    wanted = restrict(first.unionByName(then).where(~is_bot_sql("login")), waiting, "login")
    return wanted.groupBy("login").agg(F.min("rank").alias("rank"))


def core_owner_count(repos: DataFrame, contributions: DataFrame) -> DataFrame:
    """One row: how many logins, bots apart, own a detailed repository or contribute."""
    logins = repos.where("detailed = 1").select("owner_login").union(contributions.select("owner_login"))
    return logins.where(~is_bot_sql("owner_login")).distinct().agg(F.count(F.lit(1)).alias("n"))


def pending_queue(repos: DataFrame, limit: int = 50, attempts: int = 5) -> DataFrame:
    """The next repositories to fetch: stubs that have not failed too often."""
    return pending(repos, attempts).select("id", "full_name", "attempts").orderBy("id").limit(limit)


def pending(repos: DataFrame, attempts: int = 5) -> DataFrame:
    return repos.where((F.col("detailed") == 0) & (F.coalesce("attempts", F.lit(0)) < attempts))


def chunk_progress(chunks: DataFrame, repos: DataFrame, size: int) -> DataFrame:
    """(start, done, repos): repositories per id range, each covering (start, start + size]."""
    start = (F.floor((F.col("id") - 1) / size) * size).cast("long")
    counts = repos.groupBy(start.alias("start")).agg(F.count(F.lit(1)).alias("repos"))
    return chunks.join(counts, "start", "left").select("start", "done", F.coalesce("repos", F.lit(0)).alias("repos"))


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """One row: ranges, open, claimed and done ones, and the percentage done."""
    return chunks.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("done") == k).alias(n) for k, n in ((0, "open"), (2, "claimed"), (1, "finished"))],
        F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.count_if(F.col("done") == 1), F.count(F.lit(1))), F.lit(0.0)), 4).alias("pct"),
    )


def range_table(spark, most: int, size: int) -> DataFrame:
    """(start, done): the open ranges from 0 up to ``most``."""
    return spark.range(0, most, size).select(F.col("id").alias("start"), F.lit(0).alias("done"))
