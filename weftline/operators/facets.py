"""Facets as bitmaps: any choice of facet values is counted from an index, without the rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.filters import NO_LANGUAGE
from weftline.operators.graph import numbered

#: What stands for a missing push year, which passes every range of years.
NO_YEAR = "none"


def facet_index(core: DataFrame, releases: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(facet, value, bucket, bits): for each value of a facet the rows of ``core`` that have it, 32,768 a bitmap.

    Facets are language, license, topic, owner_type, year, archived, fork, releases and dependencies (the last four ``true`` or ``false``).
    A missing language or year is a value of its own, other missing values are none. Rows are numbered without gaps first, so bitmaps
    are as full as values are frequent. ``core`` has a row for each id.
    """
    has = lambda child, name: child.select(F.col("repo_id").alias("id")).distinct().withColumn(name, F.lit(True))
    flagged = core.join(has(releases, "has_releases"), "id", "left").join(has(dependencies, "has_dependencies"), "id", "left")
    truth = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("string")
    single = {
        "language": F.coalesce("primary_language", F.lit(NO_LANGUAGE)), "license": F.col("license"), "owner_type": F.col("owner_type"),
        "year": F.coalesce(F.col("year").cast("string"), F.lit(NO_YEAR)), "archived": truth("archived"), "fork": truth("is_fork"),
        "releases": truth("has_releases"), "dependencies": truth("has_dependencies"),
    }
    pair = lambda facet, value: F.struct(F.lit(facet).alias("facet"), value.alias("value"))
    held = F.concat(F.array(*[pair(f, v) for f, v in single.items()]), F.transform(F.array_distinct(F.coalesce("topics", F.array().cast("array<string>"))), lambda t: pair("topic", t)))
    rows = numbered(flagged.select("id", held.alias("held")), "place", "id").withColumn("place", F.col("place") + 1)
    marks = rows.select("place", F.inline("held")).where("value IS NOT NULL")
    return marks.groupBy("facet", "value", F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))


def chosen(index: DataFrame, settings: dict[str, Iterable[str]]) -> DataFrame:
    """(bucket, bits) of the rows that have one of the values of every facet in ``settings``; of all rows if it is empty."""
    settings = {facet: sorted(values) for facet, values in settings.items()} or {"archived": ["true", "false"]}  # every row has one of these
    union = None
    for facet, values in settings.items():
        one = index.where((F.col("facet") == facet) & F.col("value").isin(values)).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        union = one if union is None else union.unionByName(one)
    every = union.groupBy("bucket").agg(F.count(F.lit(1)).alias("facets"), F.bitmap_and_agg("bits").alias("bits"))
    return every.where(F.col("facets") == len(settings)).select("bucket", "bits")


def count_chosen(index: DataFrame, settings: dict[str, Iterable[str]]) -> DataFrame:
    """One row: how many rows the settings leave."""
    return chosen(index, settings).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def facets_of_chosen(index: DataFrame, settings: dict[str, Iterable[str]]) -> DataFrame:
    """(facet, value, n): how often each value occurs among the rows that the settings leave; values that do not occur are absent."""
    kept = chosen(index, settings).withColumnRenamed("bits", "kept")
    both = index.join(kept, "bucket").select("facet", "value", "bucket", F.explode(F.array("bits", "kept")).alias("bits"))
    met = both.groupBy("facet", "value", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    return met.groupBy("facet", "value").agg(F.sum(F.bitmap_count("bits")).alias("n")).where("n > 0")
