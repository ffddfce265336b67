"""Log-structured tables: batches append keyed deltas, readers merge on read, small segments are folded by key range.

A segment is a folder of rows of one table with their sequence: those of one batch (a delta), or what the deltas of consecutive batches come to.
A manifest for each batch names the segments that make up the tables; it is written last, so a batch that was
interrupted before it has no effect, and a batch that is repeated writes its own delta and manifest again.

A row's sequence is (full, batch, place): full rows go before stubs, of full rows the later wins, of stubs the earlier. Merging takes, for each key,
every column by its rule. Rules are associative over consecutive batches, so folding some of them changes no result.

After a batch the last segments of a table are folded when ``fan`` of them are of one size (a power of ``fan`` rows), with smaller ones among them. A row is thus written
once for each power between its delta's size and the table's: what batches write grows with what they bring, not with the table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.filters import unused

#: Segments of one size that are folded; manifests that are kept.
FAN, KEPT = 8, 3
#: Rows in a range of keys of a folded segment, about: a task's and a file's share.
RANGE = 1_000_000


@dataclass(frozen=True)
class Spec:
    """A table's key and the columns whose old value counts; of all other columns the last row's value is taken, null or not."""

    key: tuple[str, ...]
    keep: tuple[str, ...] = ()  # the last that is not null
    first: tuple[str, ...] = ()  # of the first row, null or not
    greatest: tuple[str, ...] = ()
    add: tuple[str, ...] = ()  # sums; a key whose sums are all zero is no row
    parts: int = 0  # folders by hash of the first key column, so that a reader of some keys opens theirs alone

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")


#: Folder column of tables with parts.
PART = "_part"
#: Of a row: its sequence, and the batch and place at which its key was first seen.
SEQ = "struct<full: int, batch: bigint, place: struct<at: timestamp, tie: bigint>>"
BORN = "struct<batch: bigint, place: struct<at: timestamp, tie: bigint>>"


def stamped(rows: DataFrame, batch: int, full: bool, at: str, *tie: str) -> DataFrame:
    """Rows of a batch with ``seq`` and ``born``; ``at`` orders those of one batch, then a hash of ``tie``.

    Stubs count down, so that the earliest is the greatest.
    """
    place = F.struct(F.col(at).alias("at"), (F.xxhash64(*tie) if tie else F.lit(0).cast("long")).alias("tie"))
    if full:
        seq = F.struct(F.lit(1).alias("full"), F.lit(batch).cast("long").alias("batch"), place.alias("place"))
    else:
        back = F.timestamp_micros(-F.unix_micros(at))
        seq = F.struct(F.lit(0).alias("full"), F.lit(-batch).cast("long").alias("batch"), F.struct(back.alias("at"), place["tie"].alias("tie")).alias("place"))
    born = F.struct(F.lit(batch).cast("long").alias("batch"), place.alias("place"))
    return rows.withColumns({"seq": seq.cast(SEQ), "born": born.cast(BORN)})


def merged(rows: DataFrame, spec: Spec) -> DataFrame:
    """One row for each key, with its sequence."""
    kept = [c for c in rows.columns if c not in (*spec.key, "seq", "born")]
    last = unused("last", rows)
    latest = [c for c in kept if c not in (*spec.keep, *spec.first, *spec.greatest, *spec.add)]
    aggs: list[Column] = [F.max_by(F.struct(F.lit(0).alias("present"), *latest), "seq").alias(last)]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in spec.keep]
    aggs += [F.min_by(F.struct(F.lit(0).alias("present"), c), "born")[c].alias(c) for c in spec.first]
    aggs += [F.max(c).alias(c) for c in spec.greatest] + [F.sum(c).alias(c) for c in spec.add]
    held = rows.groupBy(*spec.key).agg(*aggs, F.max("seq").alias("seq"), F.min("born").alias("born"))
    if spec.add:
        held = held.where(" OR ".join(f"`{c}` <> 0" for c in spec.add))
    return held.select(*[F.col(last)[c].alias(c) if c in latest else F.col(c) for c in rows.columns])


class Log:
    """Tables of ``specs`` under a folder that the driver and all executors share."""

    def __init__(self, folder: str, specs: dict[str, Spec], fan: int = FAN):
        self.folder, self.specs, self.fan = folder.rstrip("/"), specs, fan

    # files: names and small texts only
    def _at(self, spark: SparkSession, path: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()), at

    def _names(self, spark: SparkSession, path: str) -> list[str]:
        store, at = self._at(spark, path)
        return [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []

    def _manifest_path(self, batch: int) -> str:
        return f"{self.folder}/_manifest/{batch}.json"

    def manifest(self, spark: SparkSession, batch: int | None = None) -> dict[str, list[dict]]:
        """Table -> segments (folder, first and last batch, rows), oldest first, after ``batch`` or the last one before it that was committed."""
        done = sorted(int(n[:-5]) for n in self._names(spark, f"{self.folder}/_manifest") if n.endswith(".json") and n[:-5].isdigit())
        done = [n for n in done if batch is None or n <= batch]
        if not done:
            return {}
        store, at = self._at(spark, self._manifest_path(done[-1]))
        stream = store.open(at)
        try:
            return json.loads(bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)))
        finally:
            stream.close()

    def _put(self, spark: SparkSession, batch: int, manifest: dict[str, list[dict]]) -> None:
        """Under a passing name first: a manifest is there whole or not at all."""
        store, at = self._at(spark, self._manifest_path(batch))
        _, passing = self._at(spark, self._manifest_path(batch) + ".passing")
        out = store.create(passing, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        store.delete(at, False)
        if not store.rename(passing, at):
            raise OSError(f"cannot put {self._manifest_path(batch)} in its place")

    def _write(self, rows: DataFrame, name: str, folder: str, low: int, high: int) -> dict:
        path, spark, spec = f"{self.folder}/{name}/{folder}", rows.sparkSession, self.specs[name]
        if spec.parts:
            rows = rows.withColumn(PART, spec.part(F.col(spec.key[0])))
            rows.hint("rebalance", PART).sortWithinPartitions(PART, *spec.key).write.mode("overwrite").partitionBy(PART).parquet(path)
        else:
            rows.write.mode("overwrite").parquet(path)
        return {"path": path, "low": low, "high": high, "rows": spark.read.schema(rows.schema).parquet(path).count(), "schema": rows.schema.json()}

    def rows(self, spark: SparkSession, segments: list[dict], parts: list[int] | None = None) -> DataFrame:
        """All rows of some segments, or those in some parts; columns that an older one lacks are null there."""
        frames: dict[tuple, list[str]] = {}
        for s in segments:
            alone = s["path"] if PART in s["schema"] else ""  # folders of parts are found from one root only
            frames.setdefault((s["schema"], alone), []).append(s["path"])
        tables = [spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*paths) for (schema, _), paths in frames.items()]
        out = tables[0]
        for table in tables[1:]:
            out = out.unionByName(table, allowMissingColumns=True)
        return (out if parts is None else out.where(F.col(PART).isin(parts))).drop(PART)

    def _folds(self, segments: list[dict]) -> Iterator[int]:
        """How many of the last segments to fold: none, or the first number that is due."""
        size = lambda s: next(k for k in range(64) if s["rows"] < self.fan ** (k + 1))
        for level in range(size(max(segments, key=lambda s: s["rows"])) + 1 if segments else 0):
            due = next((k for k, s in enumerate(reversed(segments)) if size(s) > level), len(segments))
            if not due:
                continue
            if sum(size(s) == level for s in segments[-due:]) >= self.fan:
                yield due
                return

    def commit(self, spark: SparkSession, batch: int, deltas: dict[str, DataFrame]) -> None:
        """Append a batch's stamped rows, fold what is due, put the manifest, and remove what no kept manifest names."""
        made: set[str] = set()
        now = {name: list(segments) for name, segments in self.manifest(spark, batch - 1).items()}
        for name, rows in deltas.items():
            delta = self._write(merged(rows, self.specs[name]), name, f"d{batch}", batch, batch)
            made.add(delta["path"])
            if not delta["rows"]:
                continue
            segments = now.setdefault(name, [])
            segments.append(delta)
            while due := next(self._folds(segments), 0):
                some, key = segments[-due:], self.specs[name].key
                ranges = -(-sum(s["rows"] for s in some) // RANGE)
                table = merged(self.rows(spark, some), self.specs[name]).repartitionByRange(ranges, *key).sortWithinPartitions(*key)
                segments[-due:] = [self._write(table, name, f"f{some[0]['low']}-{batch}", some[0]["low"], batch)]
                made.add(segments[-1]["path"])
        self._put(spark, batch, now)
        self._clean(spark, batch, made)

    def _clean(self, spark: SparkSession, batch: int, made: set[str]) -> None:
        done = sorted(int(n[:-5]) for n in self._names(spark, f"{self.folder}/_manifest") if n.endswith(".json") and n[:-5].isdigit() and int(n[:-5]) <= batch)
        kept = {s["path"] for n in done[-KEPT:] for segments in self.manifest(spark, n).values() for s in segments}
        old = made | {s["path"] for n in done[:-KEPT] for segments in self.manifest(spark, n).values() for s in segments}
        for path in [*(old - kept), *(self._manifest_path(n) for n in done[:-KEPT])]:
            store, at = self._at(spark, path)
            store.delete(at, True)

    def stored(self, spark: SparkSession, name: str, batch: int | None = None, parts: list[int] | None = None) -> DataFrame | None:
        """A table with its sequence as of the end of ``batch`` (the last one if not given); none while it has no row.

        Of a table with parts some can be asked for: folders of the others are not read.
        """
        segments = self.manifest(spark, batch).get(name)
        return merged(self.rows(spark, segments, parts), self.specs[name]) if segments else None

    def columns(self, spark: SparkSession, name: str, columns: list[str], batch: int | None = None) -> DataFrame | None:
        """Some columns and the sequence of every row of a table, unmerged: a scan of those columns alone."""
        segments = self.manifest(spark, batch).get(name)
        return self.rows(spark, segments).select(*columns, "seq") if segments else None
