"""Overlap edges kept up to date: a batch of changed links is joined to the links of its people alone.

With A the links before a batch and d the signed changes, a person's pairs change by d x A + A x d + d x d. Links and edges are
log-structured tables of counts (``streaming/log.py``): a batch appends what it adds and takes away, readers sum. Links lie in
folders by hash of the login, so a batch opens those of the people it touches. Neither the edges nor other people's links are read.

Edges grow with the square of a login's repositories. Where a log of them does not fit a disk, links alone are kept (``keep_edges=False``):
a pair's count is the sum over people of the products of their links' counts, so what the batches come to is told from the links they come
to, tile by tile, and no edge is written or shuffled. Batches then cost what they bring, and a reader of the edges makes all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.bots import is_bot_sql
from weftline.operators.filters import restrict
from weftline.operators.graph import counted_edges, removed, written
from weftline.streaming.log import FAN, Log, Spec, stamped

#: Links of a person in one block.
BLOCK = 2048
#: Folders of links.
PARTS = 64
SPECS = {"links": Spec(("owner_login", "repo_id"), add=("n",), parts=PARTS), "edges": Spec(("src", "dst"), add=("shared",))}


def link_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo_id, owner_login, change): what makes the links ``before`` those of ``after``; a repeated link counts as often as it is there."""
    sides = [df.select("repo_id", "owner_login", F.lit(sign).alias("change")) for df, sign in ((before, -1), (after, 1))]
    return sides[0].unionAll(sides[1]).groupBy("repo_id", "owner_login").agg(F.sum("change").alias("change")).where("change <> 0")


def edge_changes(links: DataFrame | None, changes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(src < dst, shared): signed changes of the overlap edges.

    ``links(owner_login, repo_id, n)`` are counts before the changes, of the people in ``changes(owner_login, repo_id, d)``
    at least; of others they are dropped. Both have one row for each person and repository. Changes and links of a person are
    dealt into blocks, every pair of which is a key of its own.
    """
    moved = changes.select("owner_login", "repo_id", F.lit(0).cast("long").alias("a"), "d")
    held = moved
    if links is not None:
        known = restrict(links, changes.select("owner_login").distinct(), "owner_login").select("owner_login", "repo_id", F.col("n").alias("a"), F.lit(0).cast("long").alias("d"))
        held = moved.unionByName(known).groupBy("owner_login", "repo_id").agg(F.sum("a").alias("a"), F.sum("d").alias("d"))
    count = lambda c: F.ceil(F.count(c) / block).cast("int")
    blocks = held.groupBy("owner_login").agg(F.count(F.lit(1)).alias("k"), count(F.when(F.col("d") != 0, 1)).alias("is"), count(F.lit(1)).alias("js")).where("k > 1").drop("k")
    dealt = held.join(blocks, "owner_login")
    own = lambda n: F.pmod(F.xxhash64("repo_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = dealt.where("d <> 0").select("owner_login", own("is").alias("i"), every("js").alias("j"), F.col("repo_id").alias("x"), F.col("a").alias("ax"), F.col("d").alias("dx"))
    y = dealt.select("owner_login", own("js").alias("j"), every("is").alias("i"), F.col("repo_id").alias("y"), F.col("a").alias("ay"), F.col("d").alias("dy"))
    pairs = x.join(y, ["owner_login", "i", "j"]).where("x <> y AND (dy = 0 OR x < y)")  # two changed links meet from both sides
    change = F.expr("dx * ay + ax * dy + dx * dy")
    return pairs.groupBy(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).agg(F.sum(change).alias("shared")).where("shared <> 0")


class Overlaps:
    """Links and overlap edges under a folder that the driver and all executors share."""

    def __init__(self, folder: str, fan: int = FAN, keep_edges: bool = True):
        self.log, self.keep_edges = Log(folder, SPECS, fan), keep_edges

    def links(self, spark: SparkSession, batch: int | None = None, parts: list[int] | None = None) -> DataFrame | None:
        """(owner_login, repo_id, n) as of the end of ``batch``, or of the last one; none before the first. ``parts`` asks for some folders."""
        stored = self.log.stored(spark, "links", batch, parts)
        return None if stored is None else stored.select("owner_login", "repo_id", "n")

    def edges(self, spark: SparkSession, min_shared: int = 1, batch: int | None = None) -> DataFrame | None:
        """(src < dst, shared), as ``overlap_edges`` of the links would have it; none before the first edge, or link if edges are not kept."""
        if not self.keep_edges:
            links = self.links(spark, batch)
            return None if links is None else counted_edges(written(links, "links"), min_shared)
        stored = self.log.stored(spark, "edges", batch)
        return None if stored is None else stored.select("src", "dst", "shared").where(F.col("shared") >= min_shared)

    def apply(self, changes: DataFrame, batch: int) -> None:
        """``changes(repo_id, owner_login, change)``, +1 for each new link, -1 for each that is gone; idempotent per batch number.

        Bots make no edges and rows without a login, repository or change do nothing. A link taken away more often than it
        was there has a negative count, and makes up for a later batch that brings it: batches may come out of order.
        """
        spark = changes.sparkSession
        named = changes.where("owner_login IS NOT NULL AND repo_id IS NOT NULL AND change IS NOT NULL").where(~is_bot_sql("owner_login"))
        moved = named.groupBy("owner_login", "repo_id").agg(F.sum("change").cast("long").alias("d")).where("d <> 0")
        at = lambda df: stamped(df.withColumn("at", F.timestamp_seconds(F.lit(0))), batch, True, "at").drop("at")
        if not self.keep_edges:
            self.log.commit(spark, batch, {"links": at(moved.withColumnRenamed("d", "n"))})
            return
        d = written(moved, "changes")
        parts = [r.part for r in d.select(SPECS["links"].part(F.col("owner_login")).alias("part")).distinct().collect()]  # PARTS at most
        edges = edge_changes(self.links(spark, batch - 1, parts), d)
        self.log.commit(spark, batch, {"links": at(d.withColumnRenamed("d", "n")), "edges": at(edges)})
        removed(d)


def stream_overlaps(changes: DataFrame, overlaps: Overlaps, checkpoint: str, **trigger):
    """A stream of changes kept as edges; returns the running query."""
    return changes.writeStream.foreachBatch(lambda df, number: overlaps.apply(df, number)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
