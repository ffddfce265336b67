"""Composite reports: named frames, and writing one out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weftline.operators import aggregates as A
from weftline.operators import filters as Fi
from weftline.operators import geo as W
from weftline.operators.graph import passing_folder
from weftline.sources.tables import write_table


def summary(repos: DataFrame, owners: DataFrame, contributions: DataFrame, languages: DataFrame, topics: DataFrame) -> dict[str, DataFrame]:
    """Counts, language and topic shares, top repositories and people of several repositories."""
    return {
        "counts": A.summary_counts(repos, owners, contributions), "languages": A.language_shares(languages), "categories": A.category_shares(topics),
        "top": A.top_repos(repos), "cross_project": A.cross_project_contributors(contributions),
    }


def intel(tables, gazetteer: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Core repositories with everything that hangs on them; ``tables`` has the relations as attributes."""
    core = Fi.core_repos(tables.repos, tables.contributions, tables.owners)
    child = lambda name: Fi.restrict_children(getattr(tables, name), core)
    located = W.located_owners(W.geocode_pending(tables.owners, gazetteer), gazetteer)
    return {
        "repos": core, "people": A.people(tables.contributions, tables.owners), "owners": located, "languages": child("repo_languages"), "topics": child("repo_topics"),
        "releases": child("releases"), "dependencies": child("dependencies"), "links": child("contributions"), "universe": A.universe_counts(tables.repos, tables.owners, tables.snapshots),
    }


def written(df: DataFrame) -> DataFrame:
    """Write a frame to a fresh folder of the shared folder and read it back."""
    path = passing_folder(df.sparkSession, "report")
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
