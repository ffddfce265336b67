"""Keyed merges: table maintenance that returns the new version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.filters import unused


def last_per_key(increment: DataFrame, key: str, seq: str, keep_old: tuple[str, ...] = (), greatest: tuple[str, ...] = ()) -> DataFrame:
    """One row per key of several increments: the last by ``seq``, but for ``keep_old`` the last that is not null, for ``greatest`` the greatest."""
    aggs = []
    for c in increment.columns:
        if c in (key, seq):
            continue
        if c in keep_old:
            aggs.append(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c))
        elif c in greatest:
            aggs.append(F.max(c).alias(c))
        else:
            aggs.append(F.max_by(c, seq).alias(c))
    return increment.groupBy(key).agg(*aggs)


def _upsert(current: DataFrame, increment: DataFrame, key: str, rule) -> DataFrame:
    """Full outer join by key; ``rule(column, old, new)`` gives a column's value where both sides have the key.

    Both sides are joined as one struct each, so their columns may have any names.
    """
    old, new = current.select(F.struct("*").alias("old")), increment.select(F.struct("*").alias("new"))
    joined = old.join(new, F.col("old")[key] == F.col("new")[key], "full_outer")

    def value(c: str) -> Column:
        before, after = F.col("old")[c], F.col("new")[c] if c in increment.columns else F.lit(None)
        if c == key:
            return F.coalesce(before, after)
        if c not in increment.columns:
            return before
        return F.when(F.col("new").isNull(), before).when(F.col("old").isNull(), after).otherwise(rule(c, before, after))

    return joined.select(*[value(c).alias(c) for c in current.columns])


OWNER_KEPT = ("name", "company", "location", "blog", "bio", "followers", "following", "public_repos")


def merge_owners(current: DataFrame, increment: DataFrame) -> DataFrame:
    """Profile columns keep their old value where the new is null, ``enriched`` never falls, the rest are overwritten, by null too.

    Geographic columns are untouched. The increment holds one row per id (see ``last_per_key``).
    """

    def rule(c: str, old: Column, new: Column) -> Column:
        if c in OWNER_KEPT:
            return F.coalesce(new, old)
        if c == "enriched":
            return F.greatest(old, new)
        return old if c in ("country", "city", "lat", "lon", "geo_tried") else new

    return _upsert(current, increment, "id", rule)


def merge_repos(current: DataFrame, increment: DataFrame) -> DataFrame:
    """Overwrites all but created_at and the crawl's own columns; parent and source keep their old value where the new is null."""

    def rule(c: str, old: Column, new: Column) -> Column:
        if c in ("created_at", "detailed", "attempts", "discovered_at"):
            return old
        return F.coalesce(new, old) if c in ("parent_id", "source_id") else new

    return _upsert(current, increment, "id", rule)


def merge_stubs(current: DataFrame, increment: DataFrame) -> DataFrame:
    """Adds rows of absent ids and changes none; of several new rows of an id the first discovered is taken, then the least by its columns."""
    rest = sorted((c for c in increment.columns if c != "id"), key=lambda c: c != "discovered_at")
    fresh = increment.groupBy("id").agg(F.min(F.struct(*rest)).alias("s")).select(*[F.col("s")[c].alias(c) if c != "id" else F.col("id") for c in increment.columns])
    return current.unionByName(fresh.join(current.select("id"), "id", "left_anti"), allowMissingColumns=True)


def replace_children(current: DataFrame, increment: DataFrame, refreshed: DataFrame, key: str = "repo_id") -> DataFrame:
    """Drops the child rows of the refreshed parents and adds their new ones; a parent without any loses its old rows."""
    ids = refreshed.select(F.col(refreshed.columns[0]).alias(key)).distinct()
    return current.join(ids, key, "left_anti").unionByName(increment.select(*current.columns))


def merge_geo(owners: DataFrame, hits: DataFrame) -> DataFrame:
    """Writes found places (id, country, city, lat, lon) and marks every attempted row; an earlier place stays on a miss."""
    name = unused("found", owners)
    places = hits.select(F.struct("id", "country", "city", "lat", "lon").alias(name))
    joined = owners.join(places, F.col("id") == F.col(name)["id"], "left")
    hit = F.col(name)["country"].isNotNull()
    columns = [
        F.when(hit, F.col(name)[c]).otherwise(F.col(c)).alias(c) if c in ("country", "city", "lat", "lon")
        else F.when(F.col(name).isNotNull(), 1).otherwise(F.col(c)).alias(c) if c == "geo_tried" else F.col(f"`{c}`") for c in owners.columns
    ]
    return joined.select(*columns)
