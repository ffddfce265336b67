"""Geocoding by table joins, and geographic roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.cells import point_in_polygon  # noqa: F401
from weftline.operators.merges import merge_geo
from weftline.sources.gazetteer import AMBIGUOUS

_FLAG = r"[\x{1F1E6}-\x{1F1FF}]{2}"
_SPLIT = r"\s*[,/|·•→\-–—]\s*|\s{2,}"
#: Rows of a gazetteer table up to which it is broadcast.
BROADCAST_ROWS = 200_000


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def tokenize_location(places: DataFrame, id: str, text: str) -> DataFrame:
    """(id, pos, token, key): parts of a free-text place without flags; the key is lower-case, without dots and spaces at its ends."""
    parts = F.split(F.regexp_replace(F.col(text), _FLAG, " "), _SPLIT)
    rows = places.select(F.col(id).alias("id"), F.posexplode(parts).alias("pos", "raw")).withColumn("token", F.trim("raw")).where("token <> ''")
    key = F.regexp_replace(F.lower("token"), r"^[. ]+|[. ]+$", "")
    return rows.select("id", "pos", "token", key.alias("key"))


def geocode(places: DataFrame, id: str, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """(id, country, city, lat, lon) of every place that is found.

    The first known flag decides the country, and a city counts only within it. Else the leftmost city wins, unless its
    name is ambiguous and the rightmost country differs; a country alone gives its centre.
    """
    tokens = tokenize_location(places.where(F.col(text).isNotNull()), id, text)
    city = tokens.join(_small(tables["cities"]), "key").groupBy("id").agg(
        F.min_by(F.struct("key", "token", "country", "lat", "lon"), "pos").alias("city")
    )
    name = tokens.join(_small(tables["names"]), "key").groupBy("id").agg(F.max_by("country", F.struct("pos", -F.col("rank"))).alias("named"))
    flags = places.select(F.col(id).alias("id"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(_FLAG), F.lit(0))).alias("pos", "flag"))
    flagged = flags.join(_small(tables["flags"]), "flag").groupBy("id").agg(F.min_by("country", "pos").alias("flagged"))
    all_ = city.join(name, "id", "full_outer").join(flagged, "id", "full_outer")
    clash = F.col("city.key").isin(AMBIGUOUS) & F.col("named").isNotNull() & (F.col("named") != F.col("city.country"))
    use_city = F.when(F.col("flagged").isNotNull(), F.coalesce(F.col("city.country") == F.col("flagged"), F.lit(False))).otherwise(F.col("city").isNotNull() & ~F.coalesce(clash, F.lit(False)))
    country = F.when(F.col("flagged").isNotNull(), F.col("flagged")).when(use_city, F.col("city.country")).otherwise(F.col("named"))
    found = all_.select("id", country.alias("country"), F.when(use_city, F.col("city")).alias("hit"))
    centre = tables["countries"].select("country", F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    return found.join(_small(centre), "country").select(
        "id", "country", F.col("hit.token").alias("city"), F.coalesce("hit.lat", "clat").alias("lat"), F.coalesce("hit.lon", "clon").alias("lon")
    )


def with_geo_columns(owners: DataFrame) -> DataFrame:
    """Owners with the geographic columns that older rows lack."""
    kinds = {"country": "string", "city": "string", "lat": "double", "lon": "double", "geo_tried": "int"}
    missing = {c: F.lit(0 if c == "geo_tried" else None).cast(k) for c, k in kinds.items() if c not in owners.columns}
    return owners.withColumns(missing) if missing else owners


def geocode_pending(owners: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Owners after geocoding those with a place that was not tried; everyone tried is marked, found or not."""
    owners = with_geo_columns(owners)
    work = owners.where("geo_tried = 0 AND location IS NOT NULL AND location <> ''").select("id", "location")
    hits = geocode(work, "id", "location", tables)
    return merge_geo(owners, work.select("id").join(hits, "id", "left"))


def located_owners(owners: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Owners with coordinates, and their country's code."""
    codes = tables["countries"].select("country", "iso")
    return owners.where("lat IS NOT NULL").join(_small(codes), "country", "left").select("id", "login", "type", "country", "iso", "city", "lat", "lon")


def attach_repo_geo(repos: DataFrame, located: DataFrame) -> DataFrame:
    """Repositories with their owner's place."""
    return repos.join(located.select(F.col("login").alias("owner_login"), "country", "city", "lat", "lon"), "owner_login", "left")


def attach_person_geo(people: DataFrame, located: DataFrame) -> DataFrame:
    """People with their own place."""
    return people.join(located.select("login", "country", "city", "lat", "lon"), "login", "left")


def country_rollup(items: DataFrame) -> DataFrame:
    """Items per country, and how many have no city."""
    return items.where("country IS NOT NULL").groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("city").isNull()).alias("country_only"))


def city_rollup(items: DataFrame, item: str, country: str | None = None, limit: int = 40) -> DataFrame:
    """Items per city with the coordinates of its first item."""
    rows = items.where("city IS NOT NULL")
    rows = rows.where(F.col("country") == country) if country else rows
    per = rows.groupBy("city", "country").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("lat", "lon"), item).alias("at"))
    return per.select("city", "country", "n", "at.lat", "at.lon").orderBy(F.desc("n"), "city", "country").limit(limit)


def geo_coverage(items: DataFrame) -> DataFrame:
    """One row: located items, countries, cities, items with a country only."""
    located = F.col("lat").isNotNull()
    row = items.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(located).alias("located"), F.countDistinct("country").alias("countries"),
        F.countDistinct(F.when(F.col("city").isNotNull(), F.struct("city", "country"))).alias("cities"), F.count_if(located & F.col("city").isNull()).alias("country_only"),
    )
    return row.withColumn("pct", F.round(F.when(F.col("total") > 0, 100.0 * F.col("located") / F.col("total")).otherwise(0.0), 4))


def geo_drilldown(items: DataFrame, country: str, city: str | None, score: str, item: str, limit: int = 60) -> DataFrame:
    """Items at a place, the greatest ``score`` first."""
    rows = items.where(F.col("country") == country)
    rows = rows.where(F.col("city") == city) if city else rows
    return rows.select(item, score, "city").orderBy(F.desc_nulls_last(score), item).limit(limit)


def largest_city(items: DataFrame) -> DataFrame:
    """The city of most items in each country."""
    per = items.where("city IS NOT NULL").groupBy("country", "city").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("n"), "city"))
    return per.withColumn("r", rank).where("r = 1").drop("r")
