"""Progress tables: state counts, throughput and time left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.worklists import core_owner_count

ALPHA = 0.25


def _count() -> Column:
    return F.count(F.lit(1))


def status_counts(repos: DataFrame, owners: DataFrame, contributions: DataFrame, releases: DataFrame, dependencies: DataFrame, cache: DataFrame, chunks: DataFrame, attempts: int = 5) -> DataFrame:
    """One row of table and state counts, and the phase; each table is scanned once."""
    d, tried = F.col("detailed"), F.coalesce("attempts", F.lit(0))
    r = repos.agg(
        _count().alias("discovered"), F.count_if(d == 1).alias("detailed"), F.count_if((d == 0) & (tried < attempts)).alias("pending"),
        F.count_if((d == 1) & F.col("stars").isNull()).alias("gone"), F.count_if((d != 1) & (tried >= attempts)).alias("failed"), F.count_if(d == 3).alias("claimed"),
    )
    sizes = [t.agg(_count().alias(n)) for t, n in ((owners, "owners"), (contributions, "contributions"), (releases, "releases"), (dependencies, "dependencies"), (cache, "cached"))]
    c = chunks.agg(_count().alias("chunks"), F.count_if(F.col("done") == 1).alias("chunks_done"))
    row = r
    for one in [*sizes, c]:  # rows of one aggregate each
        row = row.crossJoin(one)
    pct = F.round(F.when(F.col("chunks") > 0, 100.0 * F.col("chunks_done") / F.col("chunks")).otherwise(0.0), 4)
    phase = F.when(F.col("chunks_done") < F.col("chunks"), "ENUM").when(F.col("pending") > 0, "DETAIL").when(F.col("claimed") > 0, "FINISHING").otherwise("DONE")
    return row.withColumn("chunks_pct", pct).withColumn("phase", phase).drop("claimed")


def ops_counts(repos: DataFrame, owners: DataFrame, contributions: DataFrame, cache: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: repositories and ranges by state, owners by state, cached responses; attempts are ignored."""
    r = repos.agg(*[F.count_if(F.col("detailed") == k).alias(n) for k, n in ((1, "repos_done"), (0, "repos_pending"), (3, "repos_claimed"))])
    c = chunks.agg(*[F.count_if(F.col("done") == k).alias(n) for k, n in ((1, "chunks_done"), (0, "chunks_open"), (2, "chunks_claimed"))])
    located = F.count_if(F.col("lat").isNotNull()) if "lat" in owners.columns else F.lit(0)
    o = owners.agg(_count().alias("owners"), F.count_if(F.col("enriched") == 1).alias("owners_enriched"), located.alias("owners_located"))
    core = core_owner_count(repos, contributions).withColumnRenamed("n", "owners_core")
    row = r.crossJoin(c).crossJoin(o).crossJoin(core).crossJoin(cache.agg(_count().alias("cached")))
    return row.withColumn("owners_pending", F.greatest(F.lit(0), F.col("owners_core") - F.col("owners_enriched")))


#: Seconds of a chunk of a counter's history.
CHUNK = 86_400


def throughput(snapshots: DataFrame, alpha: float = ALPHA, chunk: float = CHUNK) -> DataFrame:
    """(k, rate): smoothed growth per second of every counter of ``snapshots(k, ts, value)``; 0 while there is none.

    Of equal times the least value counts. The mean is a sum of the rates between neighbours whose weights fall by
    ``1 - alpha`` with each later point, so it is summed by chunks of time, and only one row a chunk is ordered along a counter.
    """
    keep = 1 - alpha
    weight = lambda n: F.pow(F.lit(keep), n)
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    points = snapshots.groupBy("k", seconds.alias("at")).agg(F.min(F.col("value").cast("double")).alias("v")).withColumn("chunk", F.floor(F.col("at") / chunk))
    rate = lambda before, at, v: F.greatest(F.lit(0.0), (v - before["v"]) / (at - before["at"]))
    inside = Window.partitionBy("k", "chunk").orderBy("at")
    steps = points.select(
        "k", "chunk", F.struct("at", "v").alias("p"), rate(F.lag(F.struct("at", "v")).over(inside), F.col("at"), F.col("v")).alias("inst"),
        (F.row_number().over(Window.partitionBy("k", "chunk").orderBy(F.desc("at"))) - 1).alias("later"),
    )
    inst = F.when(F.col("p.at") > F.col("first.at"), F.col("inst"))  # greatest skips nulls, so a chunk's first point has no rate of its own
    steps = steps.withColumn("first", F.min("p").over(Window.partitionBy("k", "chunk"))).withColumn("inst", inst)
    chunks = steps.groupBy("k", "chunk").agg(
        _count().alias("n"), F.min("p").alias("first"), F.max("p").alias("last"), F.min_by("inst", F.when(F.col("inst").isNotNull(), F.col("p.at"))).alias("second"),
        F.coalesce(F.sum(F.col("inst") * alpha * weight(F.col("later"))), F.lit(0.0)).alias("total"),
    )
    along = Window.partitionBy("k").orderBy("chunk")
    ordered = chunks.withColumn("before", F.lag("last").over(along)).withColumn("later", F.coalesce(F.sum("n").over(along.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)))
    start = F.when(F.col("before").isNotNull(), rate(F.col("before"), F.col("first.at"), F.col("first.v")))
    ordered = ordered.withColumn("start", start).withColumn("earliest", F.coalesce("start", "second"))
    part = F.col("total") + F.coalesce(F.col("start"), F.lit(0.0)) * alpha * weight(F.col("n") - 1)
    whole = ordered.groupBy("k").agg(
        F.sum(part * weight(F.col("later"))).alias("sum"), F.sum("n").alias("n"), F.min_by("earliest", F.when(F.col("earliest").isNotNull(), F.col("chunk"))).alias("earliest")
    )
    return whole.select("k", (F.col("sum") + F.coalesce(F.col("earliest") * weight(F.col("n") - 1), F.lit(0.0))).alias("rate"))


def eta(progress: DataFrame) -> DataFrame:
    """Adds pct, left, rate per minute, seconds left and state to ``progress(k, done, total, rate)``."""
    left = F.greatest(F.lit(0), F.col("total") - F.col("done"))
    return progress.select(
        "k", F.round(F.when(F.col("total") > 0, F.least(F.lit(100.0), 100.0 * F.col("done") / F.col("total"))).otherwise(0.0), 4).alias("pct"),
        left.alias("left"), F.round(F.col("rate") * 60, 4).alias("per_minute"),
        F.round(F.when((left > 0) & (F.col("rate") > 0), left / F.col("rate")), 4).alias("eta_s"),
        F.when(left == 0, "done").when(F.col("rate") > 0, "running").otherwise("stalled").alias("state"),
    )
