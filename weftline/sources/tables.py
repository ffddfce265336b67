"""Schemas of the model's tables, and reading and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"long": T.LongType(), "string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _schema(text: str) -> T.StructType:
    """A schema from ``name type, ...``; needs no session."""
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in (c.split() for c in text.split(", "))])


#: Table -> fixed schema.
SCHEMAS: dict[str, T.StructType] = {
    "http_cache": _schema("url string, etag string, last_modified string, status long, body string, fetched_at timestamp"),
    "owners": _schema(
        "id long, login string, type string, name string, company string, location string, blog string, bio string, followers long, following long, public_repos long, html_url string, created_at timestamp, enriched int, fetched_at timestamp, country string, city string, lat double, lon double, geo_tried int"
    ),
    "repos": _schema(
        "id long, full_name string, owner_login string, name string, description string, homepage string, primary_language string, license string, stars long, forks long, watchers long, open_issues long, size long, is_fork boolean, archived boolean, created_at timestamp, updated_at timestamp, pushed_at timestamp, fetched_at timestamp, detailed int, attempts long, discovered_at timestamp, parent_id long, source_id long"
    ),
    "repo_topics": _schema("repo_id long, topic string"),
    "repo_languages": _schema("repo_id long, language string, bytes long"),
    "contributions": _schema("repo_id long, owner_login string, contributions long"),
    "releases": _schema("repo_id long, tag string, name string, author_login string, published_at timestamp"),
    "dependencies": _schema("repo_id long, package string, version string, ecosystem string"),
    "enum_chunks": _schema("start long, done int"),
}


#: Values of columns that older files lack; all others are null there.
ADDED = {
    "repos": {"detailed": "CASE WHEN stars IS NOT NULL THEN 1 ELSE 0 END", "attempts": "0"},
    "owners": {"enriched": "0", "geo_tried": "0"},
}


def read_table(spark: SparkSession, directory: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A relation stored as Parquet, with its fixed schema. Files may lack later columns: these are null there, or as ``ADDED`` says."""
    schema = schema or SCHEMAS.get(name)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    table = reader.parquet(f"{directory}/{name}.parquet")
    added = {c: v for c, v in ADDED.get(name, {}).items() if c in table.columns}
    return table.withColumns({c: F.coalesce(F.col(c), F.expr(v)).cast(table.schema[c].dataType) for c, v in added.items()}) if added else table


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", fmt: str = "parquet") -> None:
    """Write a relation or a report as Parquet or JSON lines."""
    df.write.mode(mode).format(fmt).save(path)
