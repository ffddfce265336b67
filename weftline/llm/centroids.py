"""Centroid clustering by dimension-sharded Lloyd rounds in whole numbers.

Vectors are cut into column blocks: a row of the block table holds some columns of a chunk of vectors. A round's first job
has each block task compute exact partial squared distances of its rows to the centroids' slices of its columns; reduceByKey adds the
blocks of a chunk and the nearest centroid is taken where the sum stands. Its second job brings the chosen numbers back to
the blocks, adds each block's rows by cluster, and each block moves its own slice of the centroids. The block table is dealt by chunk once,
as buckets, so later joins by chunk shuffle numbers of clusters, never vectors. What the driver holds are the centroids: as many numbers
as clusters times dimensions.

A component x becomes floor(scale * x). Vectors that are null, of another length, or hold null or non-finite components are left out. Starts
are the kept vectors of least SHA-256 of ``1:<vec_id>``, equal ids by their components, null ids last; with fewer vectors there are fewer
clusters, with none an empty result. Of equally near centroids the smallest number wins. A centroid is the floor of its members' mean;
without members it stays. Equal rows get equal results. Numbers beyond 2**27 are held as Python's integers, and a distance
or sum that no long can hold is given as the greatest long. Labels and other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import MAX_LONG, fresh_dir, materialize, remove, ship

CLUSTERS, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
#: Columns of a block; vectors of a chunk.
COLUMNS, CHUNK = 16, 1024
#: Up to this a squared difference of 4,096 components fits into 64 bits; up to the other, sums are exact in doubles.
LARGE, EXACT = 1 << 27, 1 << 20

BLOCKS = "chunk long, block int, rows int, kind string, data binary, ids array<long>"


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit integers, or Python's where these would overflow later."""
    floors = np.floor(vectors * float(scale))
    if np.abs(floors).max(initial=0) < LARGE:
        return floors.astype(np.int64)
    return np.array([[int(x) if np.isfinite(x) else int(v) * scale for x, v in zip(f, row, strict=True)] for f, row in zip(floors.tolist(), vectors.tolist(), strict=True)], object)


def packed(block: np.ndarray) -> tuple[str, bytes]:
    if block.dtype == object:
        return "json", json.dumps(block.tolist()).encode()
    kind = next(k for k in ("<i1", "<i2", "<i4") if np.iinfo(k).min <= block.min() and block.max() <= np.iinfo(k).max)
    return kind, block.astype(kind).tobytes()


def unpacked(kind: str, data: bytes, rows: int) -> np.ndarray:
    if kind == "json":
        return np.array(json.loads(data), object).reshape(rows, -1)
    return np.frombuffer(data, kind).reshape(rows, -1).astype(np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids over some columns."""
    if x.dtype == object or c.dtype == object:
        x, c = x.astype(object), c.astype(object)
    elif max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT:  # products below 2**40: exact in doubles
        return ((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)).astype(np.int64) - 2 * (x.astype(float) @ c.astype(float).T).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def _cut(scale: int, columns: int, chunk: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for k in range(0, batch.num_rows, chunk):
                part = batch.slice(k, chunk)
                vectors = whole(np.array(part.column("embedding").flatten(), np.float64).reshape(part.num_rows, -1), scale)
                ids, rows = part.column("vec_id").to_pylist(), []
                for block, at in enumerate(range(0, vectors.shape[1], columns)):
                    rows.append((number, block, part.num_rows, *packed(vectors[:, at : at + columns]), None if block else ids))
                number += 1
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["chunk", "block", "rows", "kind", "data", "ids"])

    return cut


def _partial(centroids: np.ndarray, columns: int):
    """A row of the block table as (chunk, partial distances)."""

    def of(row) -> tuple[int, np.ndarray]:
        slice_ = centroids[:, row.block * columns : (row.block + 1) * columns]
        return row.chunk, distances(unpacked(row.kind, row.data, row.rows), slice_)

    return of


def _nearest(total: np.ndarray) -> tuple[list[int], list[int]]:
    best = np.argmin(total, axis=1)
    return best.tolist(), [min(int(d), MAX_LONG) for d in total[np.arange(len(total)), best]]


def _moved(held: np.ndarray, columns: int):
    """A block's members summed by cluster as its new slice; centroids without members stay."""

    def of(item: tuple[int, tuple[np.ndarray, np.ndarray]]) -> tuple[int, list[list[int]]]:
        block, (sums, counts) = item
        new = held[:, block * columns : (block + 1) * columns].astype(object)
        for k in np.flatnonzero(counts).tolist():
            new[k] = [int(s) // int(counts[k]) for s in sums[k]]
        return block, new.tolist()

    return of


def _summed(clusters: int):
    """Rows of the block table with their clusters as (block, (sums, counts)), added up within the task."""

    def of(rows) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for row in rows:
            x, label = unpacked(row.kind, row.data, row.rows), np.array(row.cluster)
            counts = np.bincount(label, minlength=clusters)
            sums = np.array([x[label == k].astype(object if x.dtype == object else np.int64).sum(axis=0) for k in range(clusters)])
            before = held.get(row.block)
            held[row.block] = (sums.astype(object), counts) if before is None else (before[0] + sums, before[1] + counts)
        yield from held.items()

    return of


def _array(rows: list[list[int]]) -> np.ndarray:
    """Centroids as 64-bit integers where all are small."""
    small = all(abs(x) < LARGE for row in rows for x in row)
    return np.array(rows, np.int64 if small else object)


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, embedding) of vectors of the right length with finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).where((F.size("embedding") == dims) & finite)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, columns: int = COLUMNS, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable vector of ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    ship(spark)
    kept = usable(vectors, dims)
    seed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    starts = kept.orderBy(F.asc_nulls_last(seed), "embedding").limit(clusters).collect()
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = _array(whole(np.array([r.embedding for r in starts]), scale).tolist())
    k = len(centroids)

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = fresh_dir(spark, "blocks")
    name = "blocks_" + folder.rsplit("-", 1)[1]
    cut = kept.mapInArrow(_cut(scale, columns, chunk), BLOCKS)
    cut.repartition(buckets, "chunk").write.bucketBy(buckets, "chunk").option("path", folder).saveAsTable(name)
    blocks = spark.table(name)

    def assigned(now: np.ndarray) -> DataFrame:
        """(chunk, cluster, distance): lists in the order of the chunk's rows."""
        parts = blocks.select("chunk", "block", "kind", "data", "rows").rdd.map(_partial(now, columns))
        nearest = parts.reduceByKey(lambda a, b: a + b, buckets).map(lambda x: (x[0], *_nearest(x[1])))
        return materialize(spark.createDataFrame(nearest, "chunk long, cluster array<int>, distance array<long>"), "nearest")

    for _ in range(rounds):
        labels = assigned(centroids)
        sums = blocks.drop("ids").join(labels.select("chunk", "cluster"), "chunk").rdd.mapPartitions(_summed(k))
        slices = sums.reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1])).map(_moved(centroids, columns)).collectAsMap()
        centroids = _array([[x for b in sorted(slices) for x in slices[b][row]] for row in range(k)])
        remove(labels)

    labels = assigned(centroids)
    ids = blocks.where("block = 0").select("chunk", F.col("ids").alias("vec_id"))
    zipped = F.inline(F.arrays_zip("vec_id", "cluster", "distance"))
    rows = materialize(ids.join(labels, "chunk").select(zipped), "clustered")
    spark.sql(f"DROP TABLE {name}")
    blocks._weftline_path = folder
    remove(labels, blocks)
    sums = {r[0]: int(r[1]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20, 0)"))).collect()}  # a row a cluster
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    digests = [hashlib.sha256(",".join(str(int(x)) for x in row).encode()).hexdigest() for row in centroids.tolist()]
    return rows.select(
        "vec_id", "cluster", "distance", of([min(sums.get(c, 0), MAX_LONG) for c in range(k)], "long").alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), MAX_LONG)).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"),
    )
