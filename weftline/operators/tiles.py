"""Pairs within tiles: a task holds the links of two blocks, makes their pairs a piece at a time and gives out what these come to."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Pairs that a task makes at once, whole rows of them.
PIECE = 1 << 21
#: Up to so many different counts of a piece, an edge list a row and count; above, an edge a row.
KINDS = 16


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


def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each tile of a partition, which has one if partitions are as many as tiles."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    tiles = table["tile"].unique()
    for tile in tiles:
        yield table if len(tiles) == 1 else table.filter(pc.equal(table["tile"], tile))


def listed(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, and the row of each."""
    lists = table[column].combine_chunks()
    return lists.flatten(), np.repeat(np.arange(table.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def met(code: np.ndarray, row: np.ndarray, keys: np.ndarray, width: int, later: np.ndarray | None = None, piece: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, counts, positions): for links ``start`` to ``end`` how many links of the other side have its login, and which these are.

    Links are in the order of their rows, ``keys`` (code * width + column) of the other side in theirs. A row is never cut, so a piece has ``piece``
    pairs or one row's, which are no more than its links times the other side's. Of ``later`` columns only those behind it are met.
    """
    begin = np.searchsorted(keys, code * width) if later is None else np.searchsorted(keys, code * width + later, "right")
    counts = np.searchsorted(keys, (code + 1) * width) - begin
    ends = np.cumsum(counts)
    last = np.append(np.flatnonzero(row[1:] != row[:-1]) + 1, len(row))  # ends of rows
    total, start = ends[last - 1], 0
    while start < len(row):
        done = ends[start - 1] if start else 0
        at = max(np.searchsorted(total, done + piece, "right") - 1, np.searchsorted(last, start, "right"))
        end = last[at]
        c = counts[start:end]
        if n := int(ends[end - 1] - done):
            yield start, end, c, np.repeat(begin[start:end] - (ends[start:end] - c - done), c) + np.arange(n)
        start = end


def edges_of_tile(least: int, weighted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (tile, own, owner_login, xs) as (x, shared, ys): x shares ``shared``, ``least`` at least, with each of ys, each pair once.

    ``xs`` are repositories of block ``own``, structs of one and its count if ``weighted``. A tile has rows of two blocks, or of one, whose
    repositories are met with each other.
    """

    def sides(table: pa.Table) -> Iterator[tuple]:
        code = table["owner_login"].dictionary_encode().combine_chunks().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        own = table["own"].to_numpy()
        values, at = listed(table, "xs")
        ids, n = (values.field("repo_id").to_numpy(), values.field("n").to_numpy()) if weighted else (values.to_numpy(), None)
        for block in np.unique(own):
            some = own[at] == block
            names, place = np.unique(ids[some], return_inverse=True)
            yield code[at[some]], names, place.astype(np.int64), None if n is None else n[some]

    def pieces(table: pa.Table) -> Iterator[pa.RecordBatch]:
        found = list(sides(table))
        (code, ids, row, n), (codes, others, col, m) = found[0], found[-1]
        width = len(others)
        first, second = np.argsort(row, kind="stable"), np.argsort(codes * width + col)
        code, row, keys, col = code[first], row[first], (codes * width + col)[second], col[second]
        for start, end, c, at in met(code, row, keys, width, row if len(found) == 1 else None):
            low, high = row[start], row[end - 1] + 1
            kind = np.uint32 if (high - low) * width < 1 << 32 else np.int64
            key = np.repeat(((row[start:end] - low) * width).astype(kind), c) + col[at].astype(kind)
            if weighted:
                order = np.argsort(key)
                key, value = key[order], (np.repeat(n[first[start:end]], c) * m[second[at]])[order]
            else:
                key.sort()
            new = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
            shared = np.add.reduceat(value, new) if weighted else np.diff(np.append(new, len(key)))
            key, kept = key[new], (shared >= least) & (shared != 0)
            if not kept.all():
                key, shared = key[kept], shared[kept]
            yield from lists(key, shared, ids[low:high], others, width)

    def lists(key: np.ndarray, shared: np.ndarray, ids: np.ndarray, others: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
        kinds = np.unique(shared)
        if len(kinds) > KINDS:
            yield batch(ids[key // width], shared, np.arange(len(key) + 1), others[key % width])
            return
        for n in kinds:
            some = key if len(kinds) == 1 else key[shared == n]
            bounds = np.searchsorted(some, (np.arange(len(ids) + 1) * width).astype(key.dtype))
            sizes = np.diff(bounds)
            rows = np.flatnonzero(sizes)
            ys = others[some - np.repeat((rows * width).astype(key.dtype), sizes[rows])]
            yield batch(ids[rows], np.full(len(rows), n), np.append(bounds[rows], len(some)), ys)

    def batch(x: np.ndarray, shared: np.ndarray, bounds: np.ndarray, ys: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(shared.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ys))], ["x", "shared", "ys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables(batches):
            yield from pieces(table)

    return run


def best_of_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, side, owner_login, xs) as (id, score1, label1, score2, label2, met): for each id of side 0 the two labels of side 1 of greatest score, the smaller of equals.

    ``xs`` are structs (id, v, m). A label's score is the sum of ``v`` over the logins that it shares with the id; ``met`` sums ``m`` of the labels met, each once. Without a second label its score is 0.
    """
    for table in tables(batches):
        code = table["owner_login"].dictionary_encode().combine_chunks().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        values, at = listed(table, "xs")
        a, b = (table["side"].to_numpy()[at] == side for side in (0, 1))
        ids, row = np.unique(values.field("id").to_numpy()[a], return_inverse=True)
        labels, col = np.unique(values.field("id").to_numpy()[b], return_inverse=True)
        width, v, m = len(labels), values.field("v").to_numpy()[b], np.zeros(len(labels), np.int64)
        m[col] = values.field("m").to_numpy()[b]
        keys = code[at[b]] * width + col
        first, second = np.argsort(row, kind="stable"), np.argsort(keys)
        code, row, keys, col, v = code[at[a]][first], row[first], keys[second], col[second], v[second]
        for start, end, c, met_at in met(code, row, keys, width):
            key = np.repeat(row[start:end] * width, c) + col[met_at]
            order = np.argsort(key)
            key = key[order]
            new = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
            score, key = np.add.reduceat(v[met_at][order], new), key[new]
            rows, column = np.divmod(key, width)
            begin = np.append(0, np.flatnonzero(rows[1:] != rows[:-1]) + 1)
            sizes = np.diff(np.append(begin, len(rows)))
            out = [ids[rows[begin]]]
            for _ in range(2):
                most = np.maximum.reduceat(score, begin)
                top = np.flatnonzero(score == np.repeat(most, sizes))
                top = top[np.append(True, rows[top[1:]] != rows[top[:-1]])]  # columns are in the order of labels
                out += [most, labels[column[top]]]
                score[top] = 0
            out.append(np.add.reduceat(m[column], begin))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["id", "score1", "label1", "score2", "label2", "met"])
