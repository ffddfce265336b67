"""Counts, shares, rankings and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.bots import is_bot_sql
from weftline.operators.filters import NO_LANGUAGE, restrict_children


def _count() -> Column:
    return F.count(F.lit(1))


def _of_total(df: DataFrame, column: str, digits: int = 4) -> DataFrame:
    """Adds each row's share of the column's sum over the rows given, a sum of 0 counting as 1; for the few rows of a top-k."""
    total = df.agg(F.coalesce(F.sum(column), F.lit(0)).alias("__total"))
    share = F.col(column) / F.when(F.col("__total") == 0, 1).otherwise(F.col("__total"))
    return df.crossJoin(F.broadcast(total)).withColumn("share", F.round(share, digits)).drop("__total")


def language_shares(languages: DataFrame, limit: int = 12) -> DataFrame:
    """Languages with most bytes and their share of what these have together."""
    top = languages.groupBy("language").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "language").limit(limit)
    return _of_total(top, "bytes")


def category_shares(topics: DataFrame, limit: int = 15) -> DataFrame:
    """Most frequent topics."""
    return topics.groupBy("topic").agg(_count().alias("n")).orderBy(F.desc("n"), "topic").limit(limit)


def top_repos(repos: DataFrame, limit: int = 10) -> DataFrame:
    """Repositories with most stars."""
    return repos.select("id", "full_name", "stars", "forks", "primary_language").orderBy(F.desc_nulls_last("stars"), "id").limit(limit)


def cross_project_contributors(contributions: DataFrame, min_repos: int = 2, limit: int = 20) -> DataFrame:
    """People, bots apart, who contribute to several repositories."""
    people = contributions.where(~is_bot_sql("owner_login")).groupBy("owner_login")
    counted = people.agg(F.countDistinct("repo_id").alias("repos"), F.sum("contributions").alias("total"))
    return counted.where(F.col("repos") >= min_repos).orderBy(F.desc("repos"), F.desc("total"), "owner_login").limit(limit)


def summary_counts(repos: DataFrame, owners: DataFrame, contributions: DataFrame) -> DataFrame:
    """One row of table sizes, the stars' sum and the number of people who are no bots."""
    one = repos.agg(_count().alias("repos"), F.coalesce(F.sum("stars"), F.lit(0)).alias("stars"))
    two = owners.agg(_count().alias("owners"))
    person = F.when(~is_bot_sql("owner_login"), F.col("owner_login"))
    three = contributions.agg(_count().alias("contributions"), F.countDistinct(person).alias("contributors"))
    return one.crossJoin(two).crossJoin(three)  # rows of one aggregate each


def people(contributions: DataFrame, owners: DataFrame) -> DataFrame:
    """Every contributor, bots too: type, repositories, contributions; an owner row is optional."""
    counted = contributions.groupBy("owner_login").agg(F.countDistinct("repo_id").alias("repos"), F.sum("contributions").alias("total"))
    types = owners.select(F.col("login").alias("owner_login"), "type")
    return counted.join(types, "owner_login", "left").select(F.col("owner_login").alias("login"), "type", "repos", "total")


def universe_counts(repos: DataFrame, owners: DataFrame, cache: DataFrame) -> DataFrame:
    """Sizes of whole tables, core or not."""
    one = repos.agg(_count().alias("repos"), F.count_if(F.col("detailed") == 1).alias("detailed"))
    return one.crossJoin(owners.agg(_count().alias("owners"))).crossJoin(cache.agg(_count().alias("cached")))


def facet_counts(core: DataFrame, limit: int | None = None, null_language: str | None = NO_LANGUAGE) -> DataFrame:
    """(facet, value, n): languages and licenses in one pass of grouping sets, topics exploded; nulls are no value but a language's."""
    language = F.coalesce("primary_language", F.lit(null_language)) if null_language else F.col("primary_language")
    base = core.select(language.alias("language"), "license", "topics")
    sets = base.groupingSets([["language"], ["license"]], "language", "license").agg(
        F.grouping_id().alias("g"), _count().alias("n")
    ).select(F.when(F.col("g") == 1, "language").otherwise("license").alias("facet"), F.when(F.col("g") == 1, F.col("language")).otherwise(F.col("license")).alias("value"), "n")
    topics = base.select(F.explode("topics").alias("value")).groupBy("value").agg(_count().alias("n")).select(F.lit("topic").alias("facet"), "value", "n")
    counted = sets.unionByName(topics).where(F.col("value").isNotNull())
    if limit is None:
        return counted
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counted.withColumn("r", rank).where(F.col("r") <= limit).drop("r")


def coverage_counts(core: DataFrame, releases: DataFrame, dependencies: DataFrame) -> DataFrame:
    """How many core repositories have releases, have dependencies, are archived, are forks."""
    flags = core.agg(F.count_if("archived").alias("archived"), F.count_if("is_fork").alias("forks"))
    with_ = [restrict_children(t, core).agg(F.countDistinct("repo_id").alias(n)) for t, n in ((releases, "with_releases"), (dependencies, "with_deps"))]
    return flags.crossJoin(with_[0]).crossJoin(with_[1])


def dashboard_tiles(nodes: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """One row: repositories, stars, links, people, people of several repositories; sums over nothing are null."""
    per_person = links.groupBy("owner_login").agg(_count().alias("n"))
    return (
        nodes.agg(_count().alias("repos"), F.sum("stars").alias("stars"))
        .crossJoin(edges.agg(_count().alias("links")))
        .crossJoin(per_person.agg(_count().alias("people"), F.sum((F.col("n") > 1).cast("long")).alias("connectors")))
    )


def pile_language_bytes(nodes: DataFrame, languages: DataFrame, limit: int = 14) -> DataFrame:
    """Bytes by language over the pile, with the share of the languages shown."""
    return language_shares(restrict_children(languages, nodes), limit)


def push_year_histogram(nodes: DataFrame, core: DataFrame) -> DataFrame:
    """Repositories of the pile per push year, for every year from the first to the last in core."""
    ends = core.agg(F.min("year").alias("a"), F.max("year").alias("b")).where(F.col("a").isNotNull())
    years = ends.select(F.explode(F.sequence("a", "b")).alias("year"))
    counts = nodes.groupBy("year").agg(_count().alias("n"))
    return years.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


def dormant_count(nodes: DataFrame, year: int = 2010) -> DataFrame:
    """Repositories last pushed by ``year``; an unknown year counts as dormant."""
    return nodes.agg(F.count_if(F.col("year").isNull() | (F.col("year") <= year)).alias("dormant"))


def star_histogram(nodes: DataFrame, core: DataFrame, bins: int = 12) -> DataFrame:
    """Repositories per logarithmic star bin, empty bins included."""
    most = core.agg(F.greatest(F.lit(1), F.coalesce(F.max("stars"), F.lit(0))).alias("most"))
    bin_ = F.least(F.lit(bins - 1), F.floor(F.log10(F.col("stars") + 1) / F.log10(F.col("most") + 1) * bins))
    counts = nodes.crossJoin(F.broadcast(most)).groupBy(bin_.cast("long").alias("bin")).agg(_count().alias("n"))
    every = nodes.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def top_connectors(links: DataFrame, limit: int = 24) -> DataFrame:
    """People with more than one strong repository."""
    counted = links.groupBy("owner_login").agg(_count().alias("repos"), F.sum("contributions").alias("total")).where("repos > 1")
    return counted.orderBy(F.desc("repos"), F.desc("total"), "owner_login").limit(limit)


def top_edges(edges: DataFrame, limit: int = 16) -> DataFrame:
    """Strongest edges; with a larger limit, the edges that fit a drawing budget."""
    return edges.orderBy(F.desc("shared"), "src", "dst").limit(limit)


def top_hubs(degrees: DataFrame, limit: int = 16) -> DataFrame:
    """Nodes with most neighbours."""
    return degrees.orderBy(F.desc("degree"), "id").limit(limit)


def node_metrics(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """Drawing radius, label priority, scaled stars, age and degree, and the scatter pair of every node."""
    all_ = nodes.join(degrees, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    ends = all_.agg(F.max("stars").alias("ms"), F.max("degree").alias("md"), F.min("year").alias("y0"), F.max("year").alias("y1"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    age = F.when(F.col("year").isNull(), 0.0).otherwise(ratio(F.col("year") - F.col("y0"), (F.col("y1") - F.col("y0")).cast("double")))
    return all_.crossJoin(F.broadcast(ends)).select(
        "id", "degree",
        F.round(2.2 + F.sqrt("stars") / 9 + F.least(F.lit(6.0), 0.16 * F.col("degree")), 6).alias("radius"),
        F.round(2 * F.col("degree") + F.sqrt("stars"), 6).alias("priority"),
        F.round(ratio(F.log10(F.col("stars") + 1), F.log10(F.col("ms") + 1)), 6).alias("star_scale"), F.round(age, 6).alias("age_scale"),
        F.round(ratio(F.col("degree").cast("double"), F.col("md")), 6).alias("degree_scale"),
        F.round(F.log10(F.col("stars") + 1), 6).alias("log_stars"), F.round(F.log10(F.col("n_contrib") + 1), 6).alias("log_contribs"),
    )
