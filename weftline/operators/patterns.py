"""The nine relation patterns over the pile; each gives all findings, sorted and cut where a report asks for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.bots import is_bot_ui
from weftline.operators.filters import COPIES, NO_LANGUAGE, each, restrict, restrict_children, rows_of

#: Findings that a report shows.
FINDINGS, MONOCULTURES = 40, 30


def _count():
    return F.count(F.lit(1))


def _leader():
    """The login of the greatest contribution, the first of equals."""
    return F.min_by("owner_login", F.struct(-F.col("n"), "owner_login"))


def _inside(links: DataFrame, nodes: DataFrame) -> DataFrame:
    return restrict_children(links, nodes).withColumn("n", F.coalesce("contributions", F.lit(0)))


def _with_lists(top: DataFrame, rows: DataFrame, keys: list[str], value, *order) -> DataFrame:
    """The few rows of a cut report with the sorted list of a value of each; only for these are lists made."""
    listed = rows.select(*keys, value)
    name = listed.columns[-1]
    lists = listed.join(F.broadcast(top.select(*keys)), keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list(name)).alias(name))
    return top.join(lists, keys, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType))).orderBy(*order)


def bus_factor(links: DataFrame, nodes: DataFrame, share: float = 0.70, limit: int = FINDINGS) -> DataFrame:
    """Repositories of several contributors of whom one did most of the work."""
    per = _inside(links, nodes).groupBy("repo_id").agg(
        _count().alias("people"), _leader().alias("top_login"), F.max("n").alias("top"), F.sum("n").alias("total")
    )
    part = F.when(F.col("total") == 0, 1.0).otherwise(F.col("top") / F.col("total"))
    found = per.withColumn("share", F.round(part, 6)).where((F.col("people") >= 2) & (part >= share))
    return found.select("repo_id", "people", "top_login", "share").orderBy(F.desc("share"), "repo_id").limit(limit)


def co_maintainers(links: DataFrame, nodes: DataFrame, min_repos: int = 3, most_people: int = 60, limit: int = FINDINGS) -> DataFrame:
    """Pairs of people who share several repositories; those with one or over ``most_people`` people are skipped."""
    inside = restrict_children(links, nodes).where(~is_bot_ui("owner_login")).select("repo_id", "owner_login").distinct()
    heads = inside.groupBy("repo_id").agg(_count().alias("k")).where(F.col("k").between(2, most_people))
    some = restrict(inside, heads.select("repo_id"), "repo_id")
    a, b = some.withColumnRenamed("owner_login", "a"), some.withColumnRenamed("owner_login", "b")
    pairs = a.join(b, "repo_id").where("a < b")
    top = pairs.groupBy("a", "b").agg(_count().alias("repos")).where(F.col("repos") >= min_repos).orderBy(F.desc("repos"), "a", "b").limit(limit)
    return _with_lists(top, pairs, ["a", "b"], F.col("repo_id").alias("ids"), F.desc("repos"), "a", "b")


def brokers(links: DataFrame, clusters: DataFrame, limit: int = FINDINGS) -> DataFrame:
    """Active people whose repositories lie in several clusters."""
    placed = links.join(clusters.select(F.col("id").alias("repo_id"), "cluster"), "repo_id")
    per = placed.groupBy("owner_login").agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"), _count().alias("repos"))
    return per.where("clusters >= 2").orderBy(F.desc("clusters"), F.desc("repos"), "owner_login").limit(limit)


def serial_forkers(nodes: DataFrame, min_forks: int = 3, limit: int = FINDINGS) -> DataFrame:
    """Owners of several forks in the pile."""
    forks = nodes.where("is_fork").select("owner_login", "id")
    top = forks.groupBy("owner_login").agg(_count().alias("n")).where(F.col("n") >= min_forks).orderBy(F.desc("n"), "owner_login").limit(limit)
    return _with_lists(top, forks, ["owner_login"], F.col("id").alias("ids"), F.desc("n"), "owner_login")


def bot_operated(links: DataFrame, nodes: DataFrame, share: float = 0.5, limit: int = FINDINGS) -> DataFrame:
    """Repositories whose first contributor is a bot, or of whose heads half are."""
    inside = _inside(links, nodes)
    per = inside.groupBy("repo_id").agg(_count().alias("people"), F.count_if(is_bot_ui("owner_login")).alias("bots"), _leader().alias("top_login"))
    ratio = F.col("bots") / F.col("people")
    found = per.where(is_bot_ui("top_login") | (ratio >= share)).withColumn("ratio", F.round(ratio, 6))
    top = found.select("repo_id", "people", "bots", "ratio", "top_login").orderBy(F.desc("ratio"), "repo_id").limit(limit)
    bots = inside.where(is_bot_ui("owner_login")).select("repo_id", "owner_login")
    return _with_lists(top, bots, ["repo_id"], F.col("owner_login").alias("names"), F.desc("ratio"), "repo_id")


def top_quarter(nodes: DataFrame, floor: int = 50) -> int | None:
    """The star count at zero-based place floor(0.75 n) of the sorted stars, ``floor`` at least.

    Only distinct star values are sorted: a histogram with running counts.
    """
    n = nodes.agg(rows_of(nodes)).head()[0]
    if not n:
        return None
    histogram = nodes.groupBy("stars").agg(rows_of(nodes).alias("n"))
    running = histogram.withColumn("upto", F.sum("n").over(Window.orderBy("stars")))
    return max(floor, running.where(F.col("upto") > (3 * n) // 4).agg(F.min("stars")).head()[0])


def abandoned_influential(nodes: DataFrame, core: DataFrame, years: int = 5, limit: int = FINDINGS) -> DataFrame:
    """Repositories of the top quarter by stars that were last pushed years before the latest year in core; both may be counted rows."""
    bound = top_quarter(nodes)
    latest = core.agg(F.max("year")).head()[0]
    if bound is None or latest is None:
        found = nodes.limit(0)
    else:
        found = nodes.where((F.col("stars") >= bound) & (F.col("year") <= latest - years))
    shown, order = ["id", "full_name", "stars", "year"], [F.desc("stars"), F.col("id")]
    if COPIES in found.columns:  # the first counted rows hold the first rows
        found = each(found.select(*shown, COPIES).orderBy(*order).limit(limit))
    return found.select(*shown).orderBy(*order).limit(limit)


def language_monoculture(nodes: DataFrame, clusters: DataFrame, least: int = 3, share: float = 0.8, limit: int = MONOCULTURES) -> DataFrame:
    """Clusters of which one language holds most."""
    spoken = nodes.select("id", F.coalesce("primary_language", F.lit(NO_LANGUAGE)).alias("language"))
    counted = clusters.where("cluster >= 0").join(spoken, "id").groupBy("cluster", "language").agg(_count().alias("n"))
    per = counted.groupBy("cluster").agg(F.sum("n").alias("repos"), F.min_by("language", F.struct(-F.col("n"), "language")).alias("language"), F.max("n").alias("top"))
    ratio = F.col("top") / F.col("repos")
    found = per.where((F.col("repos") >= least) & (ratio >= share) & (F.col("language") != NO_LANGUAGE)).withColumn("share", F.round(ratio, 6))
    return found.select("cluster", "language", "repos", "share").orderBy(F.desc("repos"), "cluster").limit(limit)


def co_location(links: DataFrame, owners: DataFrame, limit: int = FINDINGS) -> DataFrame:
    """Cities in which several active people live."""
    people = links.select(F.col("owner_login").alias("login")).distinct()
    placed = people.join(owners.where("city IS NOT NULL").select("login", "city", "country"), "login")
    top = placed.groupBy("city", "country").agg(_count().alias("people")).where("people >= 2").orderBy(F.desc("people"), "city", "country").limit(limit)
    return _with_lists(top, placed.where("country IS NOT NULL"), ["city", "country"], F.col("login").alias("logins"), F.desc("people"), "city", "country")


def dependency_convergence(dependencies: DataFrame, nodes: DataFrame, min_repos: int = 3, limit: int = FINDINGS) -> DataFrame:
    """Packages that several repositories of the pile use."""
    per = restrict_children(dependencies, nodes).groupBy("package").agg(F.countDistinct("repo_id").alias("repos"), F.min("ecosystem").alias("ecosystem"))
    return per.where(F.col("repos") >= min_repos).orderBy(F.desc("repos"), "package").limit(limit)
