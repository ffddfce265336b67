"""Faceted filters: what counts as core, the rack of filters, and the pile that everything else is computed over."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.bots import is_bot_ui

#: What stands for a missing language.
NO_LANGUAGE = "—"


@dataclass(frozen=True)
class FilterSpec:
    """Settings of the rack; empty or None is off. Percentages are log-scale bounds, 0 to 100."""

    search: str = ""
    languages: frozenset[str] = field(default_factory=frozenset)
    min_stars: float = 0
    min_forks: float = 0
    min_issues: float = 0
    min_size: float = 0
    min_contributors: int = 0
    percent: bool = False
    no_archived: bool = False
    no_forks: bool = False
    has_releases: bool = False
    has_deps: bool = False
    license: str = ""
    topic: str = ""
    owner_types: frozenset[str] = field(default_factory=frozenset)
    year_from: int | None = None
    year_to: int | None = None
    weight: int = 1
    degree: int = 1
    no_bots: bool = False


#: Column of counted rows: how many equal rows each stands for.
COPIES = "copies"


def rows_of(df: DataFrame) -> Column:
    """The aggregate that counts the rows of ``df``, or those that its counted rows stand for."""
    return F.coalesce(F.sum(COPIES), F.lit(0)) if COPIES in df.columns else F.count(F.lit(1))


def each(counted: DataFrame) -> DataFrame:
    """Counted rows as the rows that they stand for."""
    again = unused("again", counted)
    return counted.withColumn(again, F.explode(F.array_repeat(F.lit(0), F.col(COPIES).cast("int")))).drop(COPIES, again)


def core_repos(repos: DataFrame, contributions: DataFrame, owners: DataFrame, *, counted: bool = False) -> DataFrame:
    """Repositories with substance, detailed or contributed to, with their owner's type.

    A login that several owners have gives a repository a row for each. ``counted`` keeps one row for each type and
    says in ``copies`` how many owners have it, so that rows grow with the repositories and not with the owners of a login too.
    """
    linked = contributions.select(F.col("repo_id").alias("id")).distinct().withColumn("linked", F.lit(True))
    types = owners.select(F.col("login").alias("owner_login"), F.col("type").alias("owner_type"))
    kept = repos.join(linked, "id", "left").where((F.col("detailed") == 1) | F.col("linked")).drop("linked")
    if counted:
        types = types.groupBy("owner_login", "owner_type").agg(F.count(F.lit(1)).alias(COPIES))
        return kept.join(types, "owner_login", "left").withColumn(COPIES, F.coalesce(COPIES, F.lit(1)))
    return kept.join(types, "owner_login", "left")


def ingest_defaults(core: DataFrame, contributions: DataFrame, topics: DataFrame) -> DataFrame:
    """Nulls of counts become 0; adds push year, short name, number of contributors and the sorted topics."""
    heads = contributions.groupBy(F.col("repo_id").alias("id")).agg(F.count(F.lit(1)).alias("n_contrib"))
    tagged = topics.groupBy(F.col("repo_id").alias("id")).agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    filled = core.fillna(0, ["stars", "forks", "open_issues", "size"])
    return (
        filled.join(heads, "id", "left").join(tagged, "id", "left")
        .withColumn("n_contrib", F.coalesce("n_contrib", F.lit(0)))
        .withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
        .withColumn("year", F.year("pushed_at"))
        .withColumn("short_name", F.coalesce(F.element_at(F.split("full_name", "/"), 2), F.col("full_name")))
    )


def _log_bound(core: DataFrame, column: str, percent: float) -> float:
    """The count at a percentage of the logarithmic scale up to the column's greatest value, 1 at least."""
    if percent <= 0:
        return 0
    most = max(1, core.agg(F.max(column)).head()[0] or 0)
    return core.sparkSession.range(1).select(F.floor(F.pow(F.lit(10.0), F.lit(percent / 100) * F.log10(F.lit(most + 1.0))) - 1 + 0.5)).head()[0]


def filter_repos(core: DataFrame, spec: FilterSpec, contributions: DataFrame, releases: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Repositories that pass every filter that is on; an unknown push year passes."""
    out, tests = core, []
    if spec.search:
        wanted = spec.search.lower()
        people = contributions.where(F.lower("owner_login").contains(wanted)).select(F.col("repo_id").alias("id")).distinct()
        out = out.join(people.withColumn("by_person", F.lit(True)), "id", "left")
        out = out.where(F.lower("full_name").contains(wanted) | F.coalesce("by_person", F.lit(False))).drop("by_person")
    if spec.languages:
        tests.append(F.coalesce("primary_language", F.lit(NO_LANGUAGE)).isin(sorted(spec.languages)))
    for column, bound in (("stars", spec.min_stars), ("forks", spec.min_forks), ("open_issues", spec.min_issues), ("size", spec.min_size)):
        if bound:
            scaled = _log_bound(core, column, bound) if spec.percent else bound
            tests.append(F.col(column) >= scaled)
    if spec.min_contributors:
        tests.append(F.col("n_contrib") >= spec.min_contributors)
    if spec.no_archived:
        tests.append(~F.coalesce("archived", F.lit(False)))
    if spec.no_forks:
        tests.append(~F.coalesce("is_fork", F.lit(False)))
    if spec.license:
        tests.append(F.col("license") == spec.license)
    if spec.topic:
        tests.append(F.array_contains("topics", spec.topic))
    if spec.owner_types:
        tests.append(F.coalesce("owner_type", F.lit("User")).isin(sorted(spec.owner_types)))
    if spec.year_from is not None:
        tests.append(F.col("year").isNull() | (F.col("year") >= spec.year_from))
    if spec.year_to is not None:
        tests.append(F.col("year").isNull() | (F.col("year") <= spec.year_to))
    for test in tests:
        out = out.where(test)
    for on, child in ((spec.has_releases, releases), (spec.has_deps, dependencies)):
        if on:
            out = restrict(out, child.select(F.col("repo_id").alias("id")), "id")
    return out


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, longer by as many underscores as it takes to be no column of the frames."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def restrict(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` occurs in the first column of ``ids``."""
    key = unused("wanted", df)
    keys = ids.select(F.col(ids.columns[0]).alias(key))
    return df.join(keys, F.col(column) == F.col(key), "left_semi")


def restrict_children(child: DataFrame, core: DataFrame) -> DataFrame:
    """Child rows of core repositories."""
    return restrict(child, core.select("id"), "repo_id")


def active_people(contributions: DataFrame, spec: FilterSpec) -> DataFrame:
    """Strong links of people with enough of them; judged over all repositories, not the pile."""
    strong = contributions.where(F.coalesce("contributions", F.lit(0)) >= spec.weight)
    if spec.no_bots:
        strong = strong.where(~is_bot_ui("owner_login"))
    kept = strong.groupBy("owner_login").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= spec.degree)
    return restrict(strong, kept.select("owner_login"), "owner_login")


def pile_links(nodes: DataFrame, active: DataFrame) -> DataFrame:
    """Active links whose repository is in the pile; people without any drop out."""
    return restrict(active, nodes.select("id"), "repo_id")


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def isolate_filter(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with an edge."""
    return restrict(nodes, _ends(edges), "id")


def cluster_filter(nodes: DataFrame, edges: DataFrame, clusters: DataFrame, cluster: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of one cluster and the edges between them; degrees stay those of before."""
    members = clusters.where(F.col("cluster") == cluster).select("id")
    kept = restrict(nodes, members, "id")
    return kept, restrict(restrict(edges, members, "src"), members, "dst")


