"""The registered queries of the graph operators, each with its DuckDB oracle over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Relations of one folder, each built once; others are made from those that are given."""

    def __init__(self, spark: SparkSession, sf_dir: str, given: dict[str, DataFrame] | None = None):
        self.spark, self.sf_dir, self._given, self._made = spark, sf_dir, given or {}, dict(given or {})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = views.relation(self.spark, self.sf_dir, name, self._given)
        return self._made[name]

    def state(self) -> tuple:
        """What tells this folder's files from any others: path, length and time of each."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.sf_dir)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found, files = [], store.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return self.sf_dir, tuple(sorted(found))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Integers as longs and arrays as comma-joined text, as the oracles give them."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def register(name: str, sql: str | None = None):
    """Adds a function of ``Tables`` as a query, with its oracle."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: plain(f(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def over(relations: str, select: str, *more: str) -> str:
    """``WITH`` the relations (a space-separated list) and further ``name AS (...)`` parts, then the statement."""
    parts = [views.cte(*relations.split())] if relations else []
    return f"WITH {', '.join([*parts, *more])}\n{select}"
