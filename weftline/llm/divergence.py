"""Source divergence audit by single-pass in-memory indexing: how far the words of each source are from those of others.

Each task reads its documents once and counts terms by group (language and source) in a block of postings. A block that has
filled its memory is spilled as a run: postings sorted by slot, a hash of language and term, and then by term, cut into
segments. Runs are shuffled by slot. A merging task reads the segments of a slot in the order of their first terms and keeps
a heap of those that are open, so it holds about a segment of each run and never a slot. What it
puts out are frequencies: a row for each term of a language that enough documents hold, with its sources and counts.

Two reports are made from them. ``term``: the terms that a group uses more than its language, a bounded number each.
``pair``: the divergence of a group from every other of its language over all kept terms. A term that neither of a pair holds adds the
same amount each time, one that only one of them holds depends on its count alone, so both are multiplied
out of a histogram of counts; only where both hold a term is a correction added, and these are streamed term by term
and summed within a task. Nothing grows with pairs times terms.

Arithmetic is exact: whole numbers, decimals of 38 digits in sums. Null text, language and source are read as ''. Every group that
occurs is reported, one without terms too: with no kept term in its language its divergences are 0. Rows are documents,
so repeated rows count each time. Ties go by the UTF-8 of the item. Long texts are cut between terms, megabyte by megabyte. Other
columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import itertools
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialize, settle, ship, text_rows

#: Documents of a language that a kept term is found in; rows of a group in part ``term``; what probabilities are multiplied by.
LEAST, TOP, SCALE = 3, 200, 1_000_000_000
#: Postings that fill a block (some 400 bytes each), and terms of a segment.
BLOCK, SEGMENT = 900_000, 256
#: Bytes of input for each merging task at most, and slots of a task.
SHARD, SLOTS = 32 << 20, 8
#: Bytes of a text that are split into terms at a time; sums of pairs that a task holds.
SLICE, HELD = 1 << 20, 500_000

#: Bytes of UTF-8: A-Z become a-z, other ASCII becomes a separator, all bytes of longer characters stay.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The terms of a text in order, about ``size`` bytes of it at a time."""
    at = 0
    while at < len(text):
        piece = text[at : at + size].translate(_BYTES)
        if (more := at + size) < len(text):  # the last term may go on
            cut = piece.rfind(b" ") + 1
            while not cut:
                piece += text[more : more + size].translate(_BYTES)
                more += size
                cut = piece.rfind(b" ") + 1 if more < len(text) else len(piece)
            piece = piece[:cut]
        at += len(piece)
        yield piece.split()


class Block:
    """Postings of some documents: occurrences and documents of each term in each group."""

    def __init__(self):
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.size = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        counts, docs = self.groups.setdefault((lang, source), (Counter(), Counter()))
        before, seen = len(counts), set()
        for some in terms(text):
            counts.update(some)
            seen.update(some)
        docs.update(seen)
        self.size += len(counts) - before

    def run(self, slots: int) -> pa.Table:
        """(key, source, n, docs) in the order of keys: slot, language, zero byte, term. The empty term stands for the group itself."""
        keys, ns, docs, sizes, slot = [], [], [], [], struct.Struct(">I").pack
        for (lang, _), (counts, found) in self.groups.items():
            head = lang.encode() + b"\0"
            start = zlib.crc32(head)
            keys.append(slot(start % slots) + head)
            keys += [slot(zlib.crc32(term, start) % slots) + head + term for term in counts]
            ns += [0, *counts.values()]
            docs += [0, *map(found.__getitem__, counts)]
            sizes.append(len(counts) + 1)
        sources = pa.array([source for _, source in self.groups], pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        table = pa.table([pa.array(keys, pa.large_binary()), sources, pa.array(ns, pa.int64()), pa.array(docs, pa.int64())], ["key", "source", "n", "docs"])
        return table.take(pc.array_sort_indices(table["key"].chunk(0))).combine_chunks()


RUN = "slot int, first binary, keys array<binary>, ends array<int>, sources array<string>, n array<long>, docs array<long>"


def _lists(cuts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Lists of the values between consecutive cuts."""
    return pa.ListArray.from_arrays(pa.array(cuts - cuts[0], pa.int32()), values.slice(cuts[0], cuts[-1] - cuts[0]))


def segments(run: pa.Table, size: int) -> Iterator[pa.RecordBatch]:
    """A run as rows of ``RUN``, each of one slot: its distinct keys, where the postings of each end, and the postings."""
    if not run.num_rows:
        return
    key, source, n, docs = (run[c].chunk(0) for c in ("key", "source", "n", "docs"))
    new = np.append(True, np.array(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1))))
    starts = np.flatnonzero(new)
    distinct = key.take(pa.array(starts)).to_numpy(zero_copy_only=False).tolist()
    slots = np.array([int.from_bytes(k[:4], "big") for k in distinct], np.int32)
    keys, starts = pa.array([k[4:] for k in distinct], pa.binary()), np.append(starts, run.num_rows)
    edges = [0, *(np.flatnonzero(np.diff(slots)) + 1).tolist(), len(slots)]
    cuts = np.array([*(k for a, b in itertools.pairwise(edges) for k in range(a, b, size)), len(slots)])  # in distinct keys
    for k in range(0, len(cuts) - 1, 256):
        some = cuts[k : k + 257]
        ends = starts[1:] - np.repeat(starts[cuts[:-1]], np.diff(cuts))
        at = starts[some]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(slots[some[:-1]]), keys.take(pa.array(some[:-1])), _lists(some, keys), _lists(some, pa.array(ends, pa.int32())),
                _lists(at, source), _lists(at, n), _lists(at, docs),
            ],
            ["slot", "first", "keys", "ends", "sources", "n", "docs"],
        )


def _indexed(slots: int, block: int, segment: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Block()
        for batch in batches:
            named = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), text_rows(batch), strict=True)
            for lang, source, text in named:
                held.add(lang or "", source or "", text)
                if held.size >= block:
                    full, held = held.run(slots), Block()
                    yield from segments(full, segment)
        yield from segments(held.run(slots), segment)
        settle()

    return index


def merged(rows: Iterator[tuple[int, bytes, list, list, list, list, list]]) -> Iterator[tuple[bytes, dict[str, int], int]]:
    """(key, count of each source, documents) of segments that come in the order of slot and first key.

    The heap holds a cursor for each open segment. Before a segment is taken in, all keys before its first are merged.
    """
    heap: list[tuple[bytes, int, int, int, tuple]] = []
    slot, key, found, total, number = None, None, {}, 0, 0
    for row in itertools.chain(rows, [None]):
        limit = None if row is None or row[0] != slot else row[1]
        while heap and (limit is None or heap[0][0] < limit):
            least, order, at, start, held = heap[0]
            if least != key:
                if key is not None:
                    yield key, found, total
                key, found, total = least, {}, 0
            _, _, keys, ends, sources, n, docs = held
            end = ends[at]
            if end - start == 1 and not found:  # most terms: one source of one run
                found[sources[start]] = n[start]
                total = docs[start]
            else:
                for i in range(start, end):
                    source = sources[i]
                    found[source] = found.get(source, 0) + n[i]
                    total += docs[i]
            at += 1
            if at < len(keys):
                heapq.heapreplace(heap, (keys[at], order, at, end, held))
            else:
                heapq.heappop(heap)
        if limit is None and key is not None:
            yield key, found, total
            key = None
        if row is not None:
            slot, number = row[0], number + 1
            heapq.heappush(heap, (row[1], number, 0, 0, row))


def _unlisted(column: pa.ListArray) -> list[list]:
    """A column of lists as Python's, converted all at once."""
    values, at = column.flatten().to_numpy(zero_copy_only=False).tolist(), np.array(column.offsets)
    return [values[a:b] for a, b in itertools.pairwise((at - at[0]).tolist())]


def _frequencies(least: int):
    names = ["lang", "term", "sources", "counts"]
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:  # a few segments at a time become Python's
                for k in range(0, batch.num_rows, 64):
                    slot, first, *lists = batch.slice(k, 64).columns
                    yield from zip(slot.to_pylist(), first.to_pylist(), *map(_unlisted, lists), strict=True)

        out, size = [], 0
        for key, found, docs in merged(rows()):
            if docs >= least or key.endswith(b"\0"):
                lang, _, term = key.rpartition(b"\0")
                sources = sorted(found)
                out.append((lang.decode(), term.decode(), sources, [found[s] for s in sources]))
                size += len(sources)
            if size >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        settle()

    return merge


def frequencies(docs: DataFrame, least: int = LEAST, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """(lang, term, sources, counts) of each kept term; the row of the empty term has all sources of its language.

    Merging tasks are as many as shuffles have partitions, or more where the input is larger than ``SHARD`` for each.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select("lang", "source", "text")
    size = int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    size = size if size < 1 << 60 else 0  # of an input whose size Spark does not know
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
    runs = texts.mapInArrow(_indexed(SLOTS * tasks, block, segment), RUN)
    dealt = runs.repartition(tasks, "slot").sortWithinPartitions("slot", "first")
    return dealt.mapInArrow(_frequencies(least), "lang string, term string, sources array<string>, counts array<long>")


def _p(n: str, total: str) -> str:
    """1 + floor(SCALE * (n + 1) / total), exact; null where the total is 0."""
    return f"1 + (cast({n} + 1 as decimal(20, 0)) * {SCALE}) div nullif(cast({total} as decimal(20, 0)), 0)"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _amount(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Sums:
    """Exact sums by key of int64 values."""

    def __init__(self):
        self.total: dict[int, int] = {}

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        found, at = np.unique(keys, return_inverse=True)
        parts = np.zeros((2, len(found)), np.int64)
        np.add.at(parts[0], at, values >> 30)
        np.add.at(parts[1], at, values & ((1 << 30) - 1))
        for key, high, low in zip(found.tolist(), *parts.tolist(), strict=True):
            self.total[key] = self.total.get(key, 0) + (high << 30) + low


def whole_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole terms and the rows at which one starts, of rows sorted by (lang, term)."""
    left: pa.Table | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            table = pa.Table.from_batches([batch])
            left = table if left is None else pa.concat_tables([left, table]).combine_chunks()
        if left is None or not left.num_rows:
            continue
        change = np.zeros(left.num_rows - 1, bool)
        for c in ("lang", "term"):
            codes = left.column(c).combine_chunks().dictionary_encode()
            codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
            change |= np.diff(np.array(codes.indices)) != 0
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        if batch is None:
            yield left, starts
        elif len(starts) > 1:
            yield left.slice(0, starts[-1]), starts[:-1]
            left = left.slice(starts[-1])


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value): what pairs that both hold a term add beyond the amounts of each alone, summed."""
    numbers: dict[tuple[str, str], int] = {}
    sums = Sums()

    def out() -> Iterator[pa.RecordBatch]:
        names = list(numbers)
        rows = [(*names[k >> 31], names[k & 0x7FFFFFFF][1], Decimal(v)) for k, v in sums.total.items()]
        sums.total.clear()
        if rows:
            kinds = (pa.string(), pa.string(), pa.string(), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "source", "item", "value"])

    for table, starts in whole_terms(batches):
        n = table.num_rows
        groups = zip(table.column("lang").to_pylist(), table.column("source").to_pylist(), strict=True)
        code = np.array([numbers.setdefault(g, len(numbers)) for g in groups], np.int64)
        p, z = np.array(table.column("p")), np.array(table.column("z"))
        ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
        row, k = np.arange(n), 1
        while len(row := row[row + k < ends[row]]):  # each posting with the k-th after it, where that is of its term
            for a, b in ((row, row + k), (row + k, row)):
                sums.add(code[a] << 31 | code[b], _amount(p[a], p[b]) - _amount(p[a], z[b]) - _amount(z[a], p[b]) + _amount(z[a], z[b]))
            k += 1
            if len(sums.total) >= HELD:
                yield from out()
    yield from out()


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs(lang, source, text)``."""
    kept = materialize(frequencies(docs, least, block, segment), "frequencies")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    posting = F.explode(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n"))).alias("x")
    postings = kept.select("lang", "term", total.alias("total"), posting).select("lang", "term", "total", "x.source", "x.n")
    sizes = kept.where("term <> ''").groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(total).alias("lang_n"))
    groups = postings.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count_if(F.col("term") != "").alias("held"))
    groups = groups.join(sizes, "lang", "left").fillna(0, ["v", "lang_n"]).withColumn("z", F.expr(_p("0", "own_n + v")))
    groups = materialize(groups, "groups")

    found = postings.where("term <> ''").join(groups, ["lang", "source"])
    found = found.withColumn("p", F.expr(_p("n", "own_n + v"))).select("lang", "source", "term", "p", F.expr(_p("total", "lang_n + v")).alias("q"), "z")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = found.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
    first = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    shared = found.select("lang", "term", "source", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term")
    corrections = shared.mapInArrow(_corrections, "lang string, source string, item string, value decimal(38, 0)")
    counts = found.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("z").alias("other_z"), F.col("held").alias("other_held"))
    amount = lambda n, f: f"cast(cast({n} as decimal(19, 0)) * cast({f} as decimal(19, 0)) as decimal(38, 0))"
    alone = counts.join(other, "lang").where("source <> other").select(
        "lang",
        F.explode(
            F.array(
                F.struct(F.col("source"), F.col("other").alias("item"), F.expr(amount("n", _f("p", "other_z"))).alias("value")),
                F.struct(F.col("other").alias("source"), F.col("source").alias("item"), F.expr(amount("n", _f("other_z", "p"))).alias("value")),
            )
        ).alias("x"),
    ).select("lang", "x.*")
    neither = groups.join(other, "lang").where("source <> other").select(
        "lang", "source", F.col("other").alias("item"), F.coalesce(F.expr(amount("v - held - other_held", _f("z", "other_z"))), F.lit(0).cast("decimal(38, 0)")).alias("value")
    )
    sums = neither.unionByName(alone).unionByName(corrections).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    pairs = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(first)
