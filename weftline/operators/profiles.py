"""Entity cards for all repositories and people at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.bots import is_bot_ui
from weftline.operators.filters import COPIES, NO_LANGUAGE, each, restrict_children, rows_of
from weftline.operators.graph import adjacency, written
from weftline.operators.patterns import _leader


def _first(df: DataFrame, key: str, order: list, k: int, text: Column, name: str) -> DataFrame:
    """Per key the texts of its first ``k`` rows, joined by commas; rows are ranked before they are gathered."""
    ranked = df.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("r") <= k)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", text.alias("t")))), lambda x: x["t"]), ",")
    return ranked.groupBy(key).agg(joined.alias(name))


def _pair(a: str, b: str) -> Column:
    return F.concat(F.col(a).cast("string"), F.lit(":"), F.col(b).cast("string"))


def repo_inspector(nodes: DataFrame, contributions: DataFrame, languages: DataFrame, releases: DataFrame, dependencies: DataFrame, edges: DataFrame) -> DataFrame:
    """Contributors (12), language mix (6), last releases (6), packages (14) and strongest neighbours (10) of every node."""
    parts = [
        _first(restrict_children(contributions, nodes), "repo_id", [F.desc("contributions"), "owner_login"], 12, _pair("owner_login", "contributions"), "people"),
        _first(restrict_children(languages, nodes), "repo_id", [F.desc("bytes"), "language"], 6, _pair("language", "bytes"), "mix"),
        _first(restrict_children(releases, nodes), "repo_id", [F.desc_nulls_last("published_at"), "tag"], 6, F.col("tag"), "releases"),
        _first(restrict_children(dependencies, nodes).select("repo_id", "package").distinct(), "repo_id", [F.col("package")], 14, F.col("package"), "packages"),
        _first(adjacency(edges), "id", [F.desc("w"), "nbr"], 10, _pair("nbr", "w"), "neighbours").withColumnRenamed("id", "repo_id"),
    ]
    out = nodes.select("id", "full_name", "stars")
    names = ["people", "mix", "releases", "packages", "neighbours"]
    for part in parts:
        out = out.join(part.withColumnRenamed("repo_id", "id"), "id", "left")
    return out.fillna("", names)


def person_inspector(contributions: DataFrame, owners: DataFrame, core: DataFrame, nodes: DataFrame) -> DataFrame:
    """Repositories, contributions, how many are in the pile, the 40 first repositories and the languages of every person."""
    seen = nodes.select(F.col("id").alias("repo_id"), F.lit(1).alias("seen"))
    base = contributions.join(seen, "repo_id", "left").groupBy("owner_login").agg(
        F.count(F.lit(1)).alias("repos"), F.sum("contributions").alias("total"), F.count("seen").alias("visible")
    )
    types = owners.select(F.col("login").alias("owner_login"), "type")
    top = _first(contributions, "owner_login", [F.desc("contributions"), "repo_id"], 40, _pair("repo_id", "contributions"), "top")
    spoken = contributions.join(core.select(F.col("id").alias("repo_id"), F.coalesce("primary_language", F.lit(NO_LANGUAGE)).alias("language")), "repo_id")
    counted = spoken.groupBy("owner_login", "language").agg(F.count(F.lit(1)).alias("k"))
    languages = _first(counted, "owner_login", [F.desc("k"), "language"], 1 << 30, _pair("language", "k"), "languages")
    out = base.join(types, "owner_login", "left").join(top, "owner_login", "left").join(languages, "owner_login", "left").fillna("", ["top", "languages"])
    return out.select(F.col("owner_login").alias("login"), "type", "repos", "total", "visible", "top", "languages")


def star_percentile(nodes: DataFrame) -> DataFrame:
    """(id, stars, percentile): share of the pile with fewer stars; only distinct star values are put in order. Counted rows stay counted."""
    histogram = nodes.groupBy("stars").agg(rows_of(nodes).alias("n"))
    running = Window.orderBy("stars").rowsBetween(Window.unboundedPreceding, -1)
    below = histogram.withColumn("below", F.coalesce(F.sum("n").over(running), F.lit(0))).drop("n")
    total = nodes.agg(rows_of(nodes).alias("all"))
    kept = [c for c in ("id", "stars", COPIES) if c in nodes.columns]
    return nodes.select(*kept).join(below, "stars").crossJoin(F.broadcast(total)).select(*kept, F.round(F.col("below") / F.col("all"), 6).alias("percentile"))


def repo_profile(nodes: DataFrame, core: DataFrame, contributions: DataFrame, edges: DataFrame, clusters: DataFrame, stale_years: int = 5) -> DataFrame:
    """Standing, freshness, first contributor, nearest neighbour and cluster of every node.

    Nodes and core may be counted rows. A node met several times in ``nodes`` meets each of its percentiles and clusters;
    equal ones are joined once with their number, and told apart again behind all joins.
    """
    latest = core.agg(F.max("year").alias("latest"))
    n = F.coalesce("contributions", F.lit(0))
    heads = restrict_children(contributions, nodes).withColumn("n", n).groupBy(F.col("repo_id").alias("id")).agg(
        F.count(F.lit(1)).alias("people"), _leader().alias("top_login"), F.when(F.sum("n") == 0, 1.0).otherwise(F.max("n") / F.sum("n")).alias("part")
    )
    nearest = adjacency(edges).groupBy("id").agg(F.min_by("nbr", F.struct(-F.col("w"), "nbr")).alias("nearest"), F.max("w").alias("nearest_weight"))
    years = F.col("latest") - F.col("year")
    shown, number = ["license", "year", "is_fork", "archived"], lambda df, *keys: df.groupBy("id", *keys).agg(rows_of(df).alias(COPIES))
    standing = number(star_percentile(nodes), "percentile").withColumnRenamed(COPIES, "standings")
    placed = number(clusters, "cluster", "cluster_size").withColumnRenamed(COPIES, "places")
    joined = number(nodes, *shown).join(standing, "id").join(heads, "id", "left").join(nearest, "id", "left").join(placed, "id").crossJoin(F.broadcast(latest))
    for copies in (COPIES, "standings", "places"):
        joined = each(joined.withColumnRenamed(copies, COPIES))
    return joined.select(
        "id", "license", "percentile", years.alias("years_since_push"), F.coalesce(years >= stale_years, F.lit(False)).alias("stale"), "people", "top_login",
        F.round("part", 6).alias("top_share"), ((F.col("people") > 1) & (F.col("part") >= 0.7)).alias("bus_factor"), "nearest", "nearest_weight", "cluster", "cluster_size", "is_fork", "archived",
    )


#: People of a repository up to which all its pairs are made.
CROWD = 1000


def mates(inside: DataFrame, k: int, crowd: int = CROWD) -> DataFrame:
    """(owner_login, mate, k): shared repositories of ``inside(repo_id, owner_login)``; for each person at least the ``k`` first mates, ties by name. Bots are no mates.

    Pairs are made in repositories of at most ``crowd`` people, so their number is bounded by that times the links. Of a crowded one no pairs are made.
    People who are in the same crowded ones have the same number of these in common with anyone, so candidates are ranked
    for each such set: the ``k + 1`` first names of every set that overlaps. Whoever is not among these, and was not met in a small
    repository, has ``k`` others before them. Who was met gets the crowded repositories in common added.
    """
    crowded = inside.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("repo_id")
    small = inside.join(crowded, "repo_id", "left_anti").select("repo_id", "owner_login")
    other = small.where(~is_bot_ui("owner_login")).select("repo_id", F.col("owner_login").alias("mate"))
    met = small.join(other, "repo_id").where("owner_login <> mate").groupBy("owner_login", "mate").agg(F.count(F.lit(1)).alias("k"))

    at = inside.join(crowded, "repo_id", "left_semi").groupBy("owner_login").agg(F.array_sort(F.collect_set("repo_id")).alias("at"))
    sets = written(at.withColumn("crowds", F.array_join(F.col("at").cast("array<string>"), ",")), "crowds")
    common = F.coalesce(F.size(F.array_intersect("own", "at")), F.lit(0))
    met = met.join(sets.select("owner_login", F.col("at").alias("own")), "owner_login", "left").join(sets.select(F.col("owner_login").alias("mate"), "at"), "mate", "left")
    met = met.select("owner_login", "mate", (F.col("k") + common).alias("k"))

    by_name = F.row_number().over(Window.partitionBy("crowds").orderBy("owner_login"))
    first = sets.where(~is_bot_ui("owner_login")).withColumn("r", by_name).where(F.col("r") <= k + 1).select(F.col("crowds").alias("theirs"), F.col("owner_login").alias("mate"))
    held = sets.select("crowds", "at").distinct().select("crowds", F.explode("at").alias("repo_id"))
    overlap = held.join(held.withColumnRenamed("crowds", "theirs"), "repo_id").groupBy("crowds", "theirs").agg(F.count(F.lit(1)).alias("k"))
    best = F.row_number().over(Window.partitionBy("crowds").orderBy(F.desc("k"), "mate"))
    ranked = overlap.join(first, "theirs").withColumn("r", best).where(F.col("r") <= k + 1).groupBy("crowds").agg(F.collect_list(F.struct("mate", "k")).alias("c"))
    seen = sets.join(ranked, "crowds").select("owner_login", F.inline("c")).where("owner_login <> mate")
    return met.unionByName(seen).groupBy("owner_login", "mate").agg(F.max("k").alias("k"))


def person_profile(contributions: DataFrame, owners: DataFrame, nodes: DataFrame, clusters: DataFrame, closest: int = 3, crowd: int = CROWD) -> DataFrame:
    """Kind, work, language, first repository, clusters and closest collaborators of everyone in the pile."""
    inside = restrict_children(contributions, nodes).select("repo_id", "owner_login", "contributions")
    kind = F.when(is_bot_ui("owner_login"), "bot").when(F.col("type") == "Organization", "organisation").otherwise("user")
    base = inside.groupBy("owner_login").agg(
        F.count(F.lit(1)).alias("repos"), F.sum("contributions").alias("commits"), F.min_by("repo_id", F.struct(-F.col("contributions"), "repo_id")).alias("top_repo")
    )
    spoken = inside.join(nodes.select(F.col("id").alias("repo_id"), F.col("primary_language").alias("language")), "repo_id").where("language IS NOT NULL")
    language = spoken.groupBy("owner_login", "language").agg(F.count(F.lit(1)).alias("k")).groupBy("owner_login").agg(F.min_by("language", F.struct(-F.col("k"), "language")).alias("language"))
    spread = inside.join(clusters.select(F.col("id").alias("repo_id"), "cluster"), "repo_id").groupBy("owner_login").agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"))
    near = _first(mates(inside, closest, crowd), "owner_login", [F.desc("k"), "mate"], closest, _pair("mate", "k"), "mates")
    out = base.join(owners.select(F.col("login").alias("owner_login"), "type"), "owner_login", "left")
    for part in (language, spread, near):
        out = out.join(part, "owner_login", "left")
    found = F.coalesce("clusters", F.lit(0))
    return out.select(
        F.col("owner_login").alias("login"), kind.alias("kind"), "repos", "commits", "language", "top_repo", found.alias("clusters"), (found >= 2).alias("bridge"), F.coalesce("mates", F.lit("")).alias("mates")
    )
