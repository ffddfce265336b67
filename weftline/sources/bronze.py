"""From raw responses to typed rows; the body of a response is JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.router import current_pages, route, sort_out

_OWNER = "STRUCT<id: BIGINT, login: STRING, type: STRING, html_url: STRING>"
_SHOWN = ("id", "login", "type", "html_url")
_REPO = f"""id BIGINT, full_name STRING, name STRING, owner {_OWNER}, description STRING, homepage STRING, language STRING,
 license STRUCT<spdx_id: STRING>, stargazers_count BIGINT, forks_count BIGINT, subscribers_count BIGINT, open_issues_count BIGINT, size BIGINT,
 fork BOOLEAN, archived BOOLEAN, created_at STRING, updated_at STRING, pushed_at STRING, topics ARRAY<STRING>,
 parent STRUCT<id: BIGINT>, source STRUCT<id: BIGINT>"""
_PROFILE = """id BIGINT, login STRING, type STRING, name STRING, company STRING, location STRING, blog STRING, bio STRING, followers BIGINT,
 following BIGINT, public_repos BIGINT, html_url STRING, created_at STRING"""


def latest_response(bronze: DataFrame) -> DataFrame:
    """One response per URL, the last fetched; of equals the greater body."""
    columns = [c for c in bronze.columns if c != "url"]
    return bronze.groupBy("url").agg(F.max_by(F.struct(*columns), F.struct("fetched_at", "body")).alias("r")).select("url", "r.*")


def parsed(bronze: DataFrame, schema: str, kind: str) -> DataFrame:
    """Responses of a kind, with their body parsed as ``j``; bodies that are no such JSON are dropped. Routes what is not routed yet."""
    routed = bronze if "kind" in bronze.columns else route(bronze)
    return routed.where(F.col("kind") == kind).withColumn("j", F.from_json("body", schema)).where("j IS NOT NULL")


def _time(c: str) -> Column:
    return F.try_to_timestamp(c).alias(c.split(".")[-1])


def extract_repos(bronze: DataFrame) -> DataFrame:
    """Repository responses as rows; missing booleans are false."""
    return parsed(bronze, _REPO, "repo").where("j.id IS NOT NULL").select(
        "j.id", "j.full_name", F.col("j.owner.login").alias("owner_login"), "j.name", "j.description", "j.homepage", F.col("j.language").alias("primary_language"),
        F.col("j.license.spdx_id").alias("license"), F.col("j.stargazers_count").alias("stars"), F.col("j.forks_count").alias("forks"),
        F.col("j.subscribers_count").alias("watchers"), F.col("j.open_issues_count").alias("open_issues"), "j.size",
        F.coalesce("j.fork", F.lit(False)).alias("is_fork"), F.coalesce("j.archived", F.lit(False)).alias("archived"),
        _time("j.created_at"), _time("j.updated_at"), _time("j.pushed_at"), "fetched_at", F.col("j.parent.id").alias("parent_id"), F.col("j.source.id").alias("source_id"),
    )


def extract_owners(bronze: DataFrame) -> DataFrame:
    """Full profiles (enriched 1), and owners embedded in repository responses and contributors (enriched 0); entries without an id are skipped."""
    routed = (bronze if "kind" in bronze.columns else route(bronze)).where(F.col("kind").isin("user", "repo", "contributors"))
    profile, repo, listed = F.from_json("body", _PROFILE), F.from_json("body", f"owner {_OWNER}"), F.from_json("body", f"ARRAY<{_OWNER}>")
    columns = [c.split()[0] for c in _PROFILE.split(",")]
    stub = lambda o: F.struct(*[(o[c] if c in _SHOWN else F.lit(None)).alias(c) for c in columns], F.lit(0).alias("enriched"))
    full = F.struct(*[profile[c].alias(c) for c in columns], F.lit(1).alias("enriched"))
    people = F.transform(F.filter(listed, lambda e: e["login"] != ""), stub)
    # one pass over the responses: a body is parsed as its kind says
    found = F.when(F.col("kind") == "user", F.array(full)).when(F.col("kind") == "repo", F.array(stub(repo["owner"]))).otherwise(people)
    rows = routed.select(F.explode(found).alias("o"), "fetched_at").select("o.*", "fetched_at").where("id IS NOT NULL")
    return rows.withColumn("created_at", F.try_to_timestamp("created_at"))


def extract_topics(bronze: DataFrame) -> DataFrame:
    """(repo_id, topic), each once."""
    return parsed(bronze, _REPO, "repo").select(F.col("j.id").alias("repo_id"), F.explode("j.topics").alias("topic")).where("topic IS NOT NULL").dropDuplicates()


#: Kind -> schema of the bodies of a repository's children.
BODIES = {
    "languages": "MAP<STRING, BIGINT>",
    "contributors": "ARRAY<STRUCT<login: STRING, contributions: BIGINT>>",
    "releases": "ARRAY<STRUCT<id: BIGINT, tag_name: STRING, name: STRING, author: STRUCT<login: STRING>, published_at: STRING>>",
    "sbom": "sbom STRUCT<packages: ARRAY<STRUCT<name: STRING, versionInfo: STRING, externalRefs: ARRAY<STRUCT<referenceLocator: STRING>>>>>",
}


def listings(bronze: DataFrame, kind: str) -> DataFrame:
    """(repo_id, page, fetched_at, full_name, j) of every response of a repository's children of a kind, also where it lists nothing.

    Without a column repo_id the repository is told from the URL, by its number or by the name that a repository's response gives it.
    """
    if "kind" in bronze.columns:
        sound = bronze
    elif "repo_id" in bronze.columns:
        sound = route(bronze).withColumn("repo_id", F.coalesce("repo_id", "url_repo_id"))
    else:
        sound = sort_out(bronze)[0]
    return parsed(sound, BODIES[kind], kind).where("repo_id IS NOT NULL").select("repo_id", "page", "fetched_at", "url", F.coalesce("full_name", F.lit("")).alias("full_name"), "j")


def _child(bronze: DataFrame, kind: str) -> DataFrame:
    return current_pages(listings(bronze, kind), "full_name", "j")


def languages_of(pages: DataFrame) -> DataFrame:
    """(repo_id, language, bytes) of pages whose keys are the languages."""
    return pages.select("repo_id", F.explode("j").alias("language", "bytes"))


def contributions_of(pages: DataFrame) -> DataFrame:
    """(repo_id, owner_login, contributions): entries without a login are skipped, a missing count is 0, the last of a login wins."""
    entries = pages.select("repo_id", "page", F.posexplode("j").alias("at", "e"))
    named = entries.where("e.login IS NOT NULL AND e.login <> ''")
    n = F.coalesce("e.contributions", F.lit(0))
    return named.groupBy("repo_id", F.col("e.login").alias("owner_login")).agg(F.max_by(n, F.struct("page", "at")).alias("contributions"))


def releases_of(pages: DataFrame) -> DataFrame:
    """(repo_id, tag, name, author_login, published_at): a missing tag becomes ``_id`` and the release's id; the last of a tag wins."""
    entries = pages.select("repo_id", "page", F.posexplode("j").alias("at", "e")).where("e IS NOT NULL").select(
        "repo_id", F.coalesce(F.nullif("e.tag_name", F.lit("")), F.concat(F.lit("_id"), F.col("e.id").cast("string"))).alias("tag"),
        F.struct("e.name", F.col("e.author.login").alias("author_login"), _time("e.published_at")).alias("r"), F.struct("page", "at").alias("place"),
    )
    return entries.groupBy("repo_id", "tag").agg(F.max_by("r", "place").alias("r")).select("repo_id", "tag", "r.*")


def dependencies_of(pages: DataFrame) -> DataFrame:
    """(repo_id, package, version, ecosystem) of bills of materials, each once; nameless packages and the repository itself are dropped."""
    rows = pages.select("repo_id", "full_name", F.explode("j.sbom.packages").alias("p"))
    itself = F.concat(F.lit("com.github."), "full_name")
    locators = F.filter(F.transform("p.externalRefs", lambda r: r["referenceLocator"]), lambda u: u.startswith("pkg:"))
    kept = rows.where((F.col("p.name") != "") & (F.lower("p.name") != F.lower(itself)))
    ecosystem = F.nullif(F.regexp_extract(F.get(locators, F.lit(0)), r"^pkg:([^/]+)", 1), F.lit(""))
    return kept.select("repo_id", F.col("p.name").alias("package"), F.col("p.versionInfo").alias("version"), ecosystem.alias("ecosystem")).dropDuplicates(["repo_id", "package", "version"])


def extract_languages(bronze: DataFrame) -> DataFrame:
    return languages_of(_child(bronze, "languages"))


def extract_contributions(bronze: DataFrame) -> DataFrame:
    return contributions_of(_child(bronze, "contributors"))


def extract_releases(bronze: DataFrame) -> DataFrame:
    return releases_of(_child(bronze, "releases"))


def extract_dependencies(bronze: DataFrame) -> DataFrame:
    return dependencies_of(_child(bronze, "sbom"))


def extract_stubs(bronze: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Minimal repository and owner rows of enumeration pages."""
    entry = f"ARRAY<STRUCT<id: BIGINT, full_name: STRING, name: STRING, owner: {_OWNER}, description: STRING, fork: BOOLEAN>>"
    rows = parsed(bronze, entry, "enumeration").select(F.explode("j").alias("e"), "fetched_at").where("e.id IS NOT NULL")
    repos = rows.select(
        "e.id", "e.full_name", F.col("e.owner.login").alias("owner_login"), "e.name", "e.description", F.coalesce("e.fork", F.lit(False)).alias("is_fork"),
        F.lit(0).alias("detailed"), F.lit(0).cast("long").alias("attempts"), F.col("fetched_at").alias("discovered_at"),
    )
    return repos, rows.where("e.owner.id IS NOT NULL").select("e.owner.id", "e.owner.login", "e.owner.type", "e.owner.html_url", F.lit(0).alias("enriched"), "fetched_at")
