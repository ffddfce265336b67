"""Embedding near-dedup by Euclidean p-stable hashing, with exact cosine checks.

Vectors are normalised in double precision; cosine >= 0.98 is then a distance of at most 0.2. Each of ``TABLES`` tables
quantises ``PROJECTIONS`` random Gaussian projections of a vector into cells of ``WIDTH`` and uses the cells (with the
label) as its bucket. A pair at the threshold shares a cell of one projection with probability 0.920, so it misses all
tables with probability (1 - 0.920**13)**36, below 4e-7; closer pairs miss less.

Only numbers are shuffled by bucket: a vector's node, its bucket and 64 signs of further projections. Buckets of one are
dropped; the others are dealt into blocks and every pair of blocks is met once, so no task gathers a large bucket. Who has no
partner there within ``SIGNS`` differing signs (a pair at the threshold has more with probability below 1e-9) is
dropped as well. Vectors are joined to what is left, and all pairs of blocks compared exactly; a pair found in several tables
counts only in the first, which both sides' buckets tell. Comparisons report a count for each vector and one edge to a
local root for each vertex that is joined, never all pairs.

Equal vectors of a label (by 128 bits of hashes) are one vertex that counts its copies, so they never multiply. Vectors that are null, empty,
zero, or hold null or non-finite components link with nothing, nor do those without a label; their component is their own
id. Vectors of different lengths link with nothing. Rows equal in vec_id count as different vectors with one id. Labels are whole numbers; text that is none raises an error. Vectors
may be of any length; a block holds at most about ``BLOCK`` a side. Other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import components, materialize, remove, ship

THRESHOLD = 0.98
TABLES, PROJECTIONS, WIDTH, SEED = 36, 13, 2.0, 17
#: Differing signs of 64 up to which a pair may be close; vectors of a bucket in one block.
SIGNS, BLOCK = 20, 512


#: Fixed-point steps of a unit vector's component and of a projection's. Their products and sums are whole numbers below
#: 2**53, so a vector falls into the same cells wherever and in whatever batch it is hashed.
FINE, COARSE = 1 << 20, 1 << 10


@functools.lru_cache(maxsize=8)
def planes(dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projections (those of the tables, then 64 for signs), offsets and odd multipliers for vectors of a length; the same everywhere."""
    rng = np.random.default_rng([SEED, dims])
    n = TABLES * PROJECTIONS
    a, b = np.rint(rng.standard_normal((dims, n + 64)) * COARSE), np.floor(rng.uniform(0, WIDTH, n) * FINE * COARSE)
    return a, b, rng.integers(1, 1 << 62, (TABLES, PROJECTIONS), np.int64) * 2 + 1


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def cells(unit: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each vector in each table, and its signs."""
    a, b, odd = planes(unit.shape[1])
    seen = np.rint(unit * FINE) @ a
    cell = np.floor((seen[:, : len(b)] + b) / (WIDTH * FINE * COARSE)).astype(np.int64).reshape(len(unit), TABLES, PROJECTIONS)
    key = ((cell * odd).sum(axis=2) + (labels.astype(np.int64) * 1_000_003 + unit.shape[1])[:, None] * odd[:, 0] + np.arange(TABLES)).view(np.uint64)
    key = (key ^ key >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    signs = np.packbits(seen[:, len(b) :] > 0, axis=1).view(np.int64)[:, 0]
    return (key ^ key >> np.uint64(29)).view(np.int64), signs


def _by_length(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of each length."""
    lengths = np.array(lists.value_lengths().fill_null(0))
    for dims in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dims)
        yield rows, np.array(lists.take(pa.array(rows)).flatten(), np.float64).reshape(-1, dims)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, signs, bucket): a row for each table."""
    for batch in batches:
        node, label = np.array(batch.column("node")), np.array(batch.column("label"))
        for rows, vectors in _by_length(batch.column("embedding")):
            for k in range(0, len(rows), 2048):
                some = rows[k : k + 2048]
                keys, signs = cells(_unit(vectors[k : k + 2048]), label[some])
                columns = np.repeat(node[some], TABLES), np.repeat(signs, TABLES), keys.ravel()
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["node", "signs", "bucket"])


KEY = ["bucket", "i", "j"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups of equal ``KEY`` and the rows at which one starts; rows come sorted by it."""
    left: pa.RecordBatch | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None and left is not None:
            batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0] if left.num_rows + batch.num_rows else batch
        last, batch = batch is None, left if batch is None else batch
        if batch is None or not batch.num_rows:
            continue
        keys = np.stack([np.array(batch.column(c)).astype(np.int64) for c in KEY], 1)
        starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
        left = None if last else batch.slice(starts[-1])
        if last:
            yield batch, starts
        elif len(starts) > 1:
            yield batch.slice(0, starts[-1]), starts[:-1]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a partner in their pair of blocks whose signs differ little."""
    for batch, starts in _groups(batches):
        n = batch.num_rows
        ends = np.repeat(np.concatenate([starts[1:], [n]]), np.diff(np.concatenate([starts, [n]])))
        signs, side = np.array(batch.column("signs")).view(np.uint64), np.array(batch.column("side"))
        same = np.array(batch.column("i")) == np.array(batch.column("j"))
        keep, row, k = np.zeros(n, bool), np.arange(n), 1
        while len(row := row[row + k < ends[row]]):  # row against the k-th after it, where that is in its group
            other = row + k
            close = (np.bitwise_count(signs[row] ^ signs[other]) <= SIGNS) & (same[row] | (side[row] != side[other]))
            keep[row[close]] = keep[other[close]] = True
            k += 1
        if keep.any():
            yield batch.filter(pa.array(keep)).select([*KEY, "side", "node"])


class Vectors:
    """Rows of one block of a bucket as arrays; all vectors are of one length."""

    def __init__(self, node: np.ndarray, copies: np.ndarray, vector: np.ndarray, unit: np.ndarray, keys: np.ndarray):
        self.node, self.copies, self.vector, self.unit, self.keys = node, copies, vector, unit, keys
        self.links = np.zeros(len(node), np.int64)


def link(a: Vectors, b: Vectors, table: int, root: dict[int, int]) -> None:
    """Compare two blocks, or a block with itself: adds to the counts and unites in ``root`` what is linked."""
    close = a.unit @ b.unit.T >= THRESHOLD - 1e-9
    if a is b:
        close = np.triu(close, 1)
    x, y = np.nonzero(close)
    for k in range(0, len(x), 1 << 15):
        p, q = x[k : k + (1 << 15)], y[k : k + (1 << 15)]
        # exact: the cosine of the given components in double precision
        u, v = a.vector[p], b.vector[q]
        cosine = np.einsum("ij,ij->i", u, v) / (np.sqrt(np.einsum("ij,ij->i", u, u)) * np.sqrt(np.einsum("ij,ij->i", v, v)))
        new = (cosine >= THRESHOLD) & (a.keys[p, :table] != b.keys[q, :table]).all(axis=1)
        p, q = p[new], q[new]
        np.add.at(a.links, p, b.copies[q])
        np.add.at(b.links, q, a.copies[p])
        for s, t in zip(a.node[p].tolist(), b.node[q].tolist(), strict=True):
            s, t = _top(root, s), _top(root, t)
            if s != t:
                root[max(s, t)] = min(s, t)


def _top(root: dict[int, int], n: int) -> int:
    while (up := root.get(n, n)) != n:
        root[n] = root.get(up, up)
        n = up
    return n


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, links, root) of what is linked within pairs of blocks."""
    for batch, starts in _groups(batches):
        side, label, node, copies, bucket = (np.array(batch.column(c)) for c in ("side", "label", "node", "copies", "bucket"))
        same = np.array(batch.column("i")) == np.array(batch.column("j"))
        number = np.cumsum(np.isin(np.arange(batch.num_rows), starts))
        out: list = []
        for rows, vectors in _by_length(batch.column("embedding")):
            unit = _unit(vectors)
            keys, _ = cells(unit, label[rows])
            cuts = np.flatnonzero(np.diff(number[rows])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
                parts = [part for part in (a + np.flatnonzero(side[rows[a:b]] == k) for k in (0, 1)) if len(part)]
                if b - a < 2 or len(parts) != 1 + (not same[rows[a]]):
                    continue
                sides, root = [Vectors(node[rows[p]], copies[rows[p]], vectors[p], unit[p], keys[p]) for p in parts], {}
                link(sides[0], sides[-1], int(np.argwhere(keys[a:b] == bucket[rows[a]])[0, 1]), root)
                for s in sides:
                    new = s.links > 0
                    out.append((s.node[new], s.links[new], np.array([_top(root, n) for n in s.node[new].tolist()], np.int64)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["node", "links", "root"])


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that may link: a label, and finite components of which one is not zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col("label").isNotNull() & (F.size("embedding") > 0)).where(finite & F.exists("embedding", lambda x: x != 0))


def links(nodes: DataFrame) -> DataFrame:
    """(node, links, root) rows of ``nodes(node, label, embedding, copies)``: counts to be summed, edges to be united."""
    hashed = nodes.select("node", "label", "embedding").mapInArrow(_hashed, "node long, signs long, bucket long")
    sizes = hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # of blocks i <= j a row belongs to its own with every other
    dealt = hashed.join(sizes, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "signs"
    )
    kinds = "bucket long, i int, j int, side int, node long"
    near = dealt.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_near, kinds)
    placed = near.join(nodes.select("node", "label", "embedding", "copies"), "node")
    return placed.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_compared, "node long, links long, root long")


def _name() -> list[Column]:
    """A vector's name: two hashes of label and vector from different seeds."""
    return [F.xxhash64("label", "embedding").alias("high"), F.xxhash64(F.lit(SEED), "label", "embedding").alias("low")]


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept."""
    ship(vectors.sparkSession)
    spread = vectors.select("vec_id", F.col("label").cast("int").alias("label"), F.transform("embedding", lambda x: x.cast("float")).alias("embedding"))
    # equal vectors of a label are one node, known by 128 bits of both; -0.0 and 0.0 are equal
    exact = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0).cast("float")).otherwise(x))
    named = usable(spread).withColumn("embedding", exact).select("*", *_name())
    groups = named.groupBy("high", "low").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    nodes = materialize(groups.withColumn("node", F.monotonically_increasing_id()), "vectors")  # any numbers do, once they are written
    found = materialize(links(nodes.drop("least", "high", "low")), "links")
    grouped = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    others = found.groupBy("node").agg(F.sum("links").alias("others"))
    rooted = nodes.join(grouped, nodes.node == grouped.id, "left").select("node", "high", "low", "copies", "least", F.coalesce("component_id", "node").alias("root"))
    rooted = materialize(rooted, "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component")), "least")  # so that the join can be split
    result = rooted.join(others, "node", "left").join(least, "root").select(
        "high", "low", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("component")
    )
    rows = spread.withColumn("embedding", exact)
    able = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.select("vec_id", *[F.when(able, c).alias(name) for c, name in zip(_name(), ("high", "low"), strict=True)])
    component = F.coalesce("component", "vec_id")
    return rows.join(result, ["high", "low"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
