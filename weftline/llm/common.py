"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's word: a run of characters other than ASCII space, tab, LF, VT, FF and CR.
#: ``bytes.split()`` without arguments splits on exactly these six bytes.
WORD_SQL = r"[^\x20\x09-\x0D]+"

MAX_LONG = (1 << 63) - 1


#: Bytes of a row group of an intermediate table; what a writing task holds grows with it.
ROW_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, one of our own if all run in this machine's one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_weftline_folder", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-weftline-")
        spark.sparkContext._weftline_folder = path
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new folder name in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    store, at = _located(spark, path)
    store.deleteOnExit(at)
    return path


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = fresh_dir(df.sparkSession, what)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._weftline_path = path
    return table


def remove(*tables: DataFrame | None) -> None:
    """Delete tables of ``materialize`` that nothing will read again."""
    for table in tables:
        if table is not None:
            store, at = _located(table.sparkSession, table._weftline_path)
            store.delete(at, True)


def settle() -> None:
    """Give freed memory back to the system at the end of a task; an idle Python worker keeps what it holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that no later step reads, and the shuffle files of finished steps.

    Spark removes shuffle files when the driver collects the plans that made them; one collection frees the plans and
    the next what they held.
    """
    remove(*tables)
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even where the repository is not on their path."""
    root = Path(__file__).resolve().parents[2]
    on_path = {os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    sc = spark.sparkContext
    if str(root) in on_path or getattr(sc, "_weftline_shipped", False):
        return
    work = tempfile.mkdtemp(prefix="spark-weftline-")
    sc.addPyFile(shutil.make_archive(f"{work}/weftline_package", "zip", root, "weftline"))
    sc._weftline_shipped = True


def text_rows(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of each text of an Arrow batch; null is empty."""
    for value in batch.column(column).cast(pa.binary()):
        yield value.as_py() or b""


def row_key(*columns: str):
    """64-bit key of a row's given columns; equal rows share it, and so share every decision."""
    return F.xxhash64(*columns)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)``: (id, component_id), the smallest id reachable; ids without edges are absent.

    Each round every vertex joins its neighbour of least random priority and the edges are contracted, so the
    number of vertices about halves whatever the shape. Keys are aggregated before they are shuffled and
    joined with joins that Spark may split, so a hub costs no more than its edges.
    """
    edge = lambda a, b: [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]
    left = materialize(edges.where("u <> v").select(*edge("u", "v")).distinct(), "edges")
    mapping, step = None, 0
    while not left.isEmpty():
        step += 1
        order = lambda c: F.struct(F.xxhash64(F.lit(step), c).alias("p"), F.col(c).alias("x"))  # noqa: E731,B023
        both = left.select("u", "v").unionAll(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = materialize(
            both.groupBy("u").agg(F.min(order("v")).alias("m")).select("u", F.least(order("u"), "m")["x"].alias("p")), "parents"
        )
        old = mapping, left
        if mapping is None:
            mapping = materialize(parent.select(F.col("u").alias("id"), F.col("p").alias("cur")), "mapping")
        else:
            mapping = materialize(
                mapping.join(parent, mapping.cur == parent.u, "left").select("id", F.coalesce("p", "cur").alias("cur")), "mapping"
            )
        a, b = parent.select("u", F.col("p").alias("pu")), parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        left = materialize(
            left.join(a, "u").join(b, "v").where("pu <> pv").select(*edge("pu", "pv")).distinct(), "edges"
        )
        remove(*old, parent)
    if mapping is None:
        return left.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    remove(left)
    # written first: a join of its own can be split where one component holds many rows
    least = materialize(mapping.groupBy("cur").agg(F.min("id").alias("component_id")), "least")
    return mapping.join(least, "cur").select("id", "component_id")
