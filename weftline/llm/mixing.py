"""Mixing sources to target weights by entropy balancing.

Of all document rates between 0 and ``CAP`` that meet every source's token target, entropy balancing takes those
closest, in Kullback-Leibler divergence over the token mass, to rate 1. The solution is the exponential tilt
``min(CAP, exp(lambda_source))`` whose multipliers solve a convex dual; distributed Newton steps find them, each one
aggregation over a histogram of (source, size) in which equal documents are one row. Rates are then rounded to
copies, none to ``CAP``: documents of a source are dealt by hash into groups of bounded size, and in each group, from
large to small, the rounding error is carried on, so a source's total stays within about its smallest documents of the
target.

Null text has size 0; empty documents take no words. A null source is a source of its own, the last. Equal rows are
rounded one by one. Very long texts count whole; one larger than a target's slack leaves the error that no copies of it can
settle. An empty table gives an empty result; other columns pass through ``mix`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import WORD_SQL, materialize, ship

#: Weights that the sources take in turn, by code point of their names; the share of all words that is mixed; the
#: greatest rate of a document.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
#: Documents of a rounding group, on average.
GROUP = 2048
TOLERANCE, STEPS = 1e-12, 50

#: Sources compare null-safely by this pair.
_KEY = ["absent", "name"]


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_SQL)), F.lit(0)).cast("long")


def _source(column: str = "source") -> list[Column]:
    return [F.col(column).isNull().alias("absent"), F.coalesce(column, F.lit("")).alias("name")]


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with the rank of each by (absent, name), without one task that sorts them all."""
    parts = sources.repartitionByRange(*_KEY).withColumn("part", F.spark_partition_id())
    parts = materialize(parts.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(*_KEY))), "sources")
    ahead = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    ahead = ahead.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    return parts.join(ahead, "part").withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("r") - 1).drop("part", "r", "n", "before")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sources(absent, name, source_size)`` with each one's target: shares by weight, never above ``cap`` times its size."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(_ranked(sources).withColumn("weight", w), "ranked")
    total = ranked.agg(F.sum("source_size")).head()[0] or 0
    level, goal = 0.0, share * total
    while True:  # each turn caps at least one more source; what they leave is shared again by weight
        above = F.col("weight") * level > cap * F.col("source_size")
        capped, open_weight = ranked.agg(
            F.coalesce(F.sum(F.when(above, cap * F.col("source_size"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))
        ).head()
        new = (goal - capped) / open_weight if open_weight else level
        if new <= level * (1 + TOLERANCE):
            break
        level = new
    return ranked.select(*_KEY, "source_size", F.least(F.col("weight") * level, cap * F.col("source_size")).alias("target"))


def balance(histogram: DataFrame, wanted: DataFrame, cap: float = CAP) -> DataFrame:
    """Multiplier of each source: Newton on the dual of the entropy problem, all sources in one pass a step."""
    state = materialize(wanted.withColumn("multiplier", F.lit(0.0)), "multipliers")
    rate = F.least(F.lit(cap), F.exp("multiplier"))
    for _ in range(STEPS):
        mass = (
            histogram.join(state, _KEY)
            .groupBy(*_KEY).agg(
                F.sum(F.col("n") * F.col("size") * rate).alias("met"),
                F.sum(F.when(F.exp("multiplier") <= cap * (1 + TOLERANCE), F.col("n") * F.col("size") * rate).otherwise(0.0)).alias("curvature"),
            )
        )
        # a step never leaves the region in which the dual curves: multipliers stay at or below log(cap)
        step = F.when(F.col("curvature") > 0, (F.col("target") - F.col("met")) / F.col("curvature")).otherwise(0.0)
        state = materialize(
            state.join(mass, _KEY).select(
                *_KEY, "source_size", "target", F.least(F.col("multiplier") + F.greatest(F.lit(-2.0), F.least(step, F.lit(2.0))), F.lit(float(np.log(cap)))).alias("multiplier"),
                (F.abs(F.col("target") - F.col("met")) / F.greatest(F.col("target"), F.lit(1.0))).alias("gap"),
            ), "multipliers",
        )
        if (state.agg(F.max("gap")).head()[0] or 0.0) <= 1e-9:
            break
    return state.drop("gap")


PLANNED = "key long, doc_id long, h long, size long, source_size long, target double, copies long"


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies of each document; rows come sorted by (source, group, size falling, id, hash), the error is carried on."""
    names = [c.split()[0] for c in PLANNED.split(", ")]
    key, error = None, 0.0
    for rows in batches:
        copies = np.empty(rows.num_rows, np.int64)
        columns = (rows.column(c).to_pylist() for c in ("absent", "name", "part", "size", "rate"))
        for k, (absent, name, part, size, rate) in enumerate(zip(*columns, strict=True)):
            if (absent, name, part) != key:
                key, error = (absent, name, part), 0.0
            wish = error + rate * size
            copies[k] = min(int(CAP), max(0, int(np.floor(wish / size + 0.5)))) if size else round(rate)
            error = wish - copies[k] * size
        yield pa.RecordBatch.from_arrays([*map(rows.column, names[:-1]), pa.array(copies)], names)


def plan(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """(key, doc_id, h, size, source_size, target, copies) per row of ``docs(doc_id, text, source)``; h is the text's hash.

    ``key`` names a row for whoever joins the plan to it. It decides nothing but the group of a row that more than a group's
    number of rows equal, lest one group hold them all.
    """
    ship(docs.sparkSession)
    named = F.monotonically_increasing_id() if key is None else key
    sized = materialize(docs.select(named.alias("key"), "doc_id", F.xxhash64("text").alias("h"), *_source(), words_in("text").alias("size")), "sizes")
    histogram = materialize(sized.groupBy(*_KEY, "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    sources = histogram.groupBy(*_KEY).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    solved = balance(histogram, targets(sources.drop("docs"))).join(sources.drop("source_size"), _KEY)
    groups = F.greatest(F.lit(1), F.ceil(F.col("docs") / GROUP))
    same = sized.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > GROUP)
    spread = sized.withColumn("salt", F.lit(0).cast("long"))
    if not same.isEmpty():
        same = same.select(F.col("doc_id").alias("id"), F.col("h").alias("hash"), F.ceil(F.col("times") / GROUP).alias("times"))
        salted = sized.join(same, sized.doc_id.eqNullSafe(same.id) & (sized.h == same.hash), "left").drop("id", "hash")
        spread = salted.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("key"), "times"), F.lit(0))).drop("times")
    dealt = spread.join(solved, _KEY).select(
        "key", "doc_id", "h", *_KEY, "size", "source_size", "target", F.round(F.least(F.lit(CAP), F.exp("multiplier")), 12).alias("rate"),
        F.pmod(F.xxhash64("doc_id", "h", "salt"), groups).alias("part"),
    )
    order = [*_KEY, "part"]
    return (
        dealt.repartition(*order).sortWithinPartitions(*order, F.desc("size"), F.asc_nulls_last("doc_id"), "h", "key")
        .mapInArrow(_round, PLANNED)
    )


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns and the copies."""
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; documents without words take none and stay once.

    The rows are numbered in a written table, so every row is told from its equals and columns of any name do no harm.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("key"), row), "rows")
    read = rows.select("key", "row.doc_id", "row.text", "row.source")
    copies = plan(read, F.col("key")).select("key", F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int").alias("copies"))
    taken = rows.join(copies.where("copies > 0"), "key").select("row", F.explode(F.sequence(F.lit(1), "copies")))
    return taken.select(*[F.col("row")[c].alias(c) for c in docs.columns])
