"""SimHash near-duplicates by anchor-point covering.

The 64 fingerprint bits are cut into three parts of 23, 23 and 18 bits. Of two fingerprints at four or fewer
differing bits, the pigeonhole principle leaves at most 1, 1 or 0 differences in one part: 2 + 2 + 1 = 5 > 4.
The anchors of a 23-bit part are the words of the perfect binary Golay code (covering radius 3): a fingerprint
*lives* at its one anchor within 3 and *visits* every anchor within 3 + 1, 5.3 on average. The anchors of the
last part are all 18-bit words (radius 0, allowance 0). A pair within the threshold then meets at an anchor
where one of the two lives, and every meeting is compared exactly on all 64 bits.

Equal fingerprints are one vertex, so exact copies never multiply. Residents of an anchor are dealt into blocks
of bounded size and each visitor reads each block of its anchor; a block keeps its residents in memory and
streams the visitors, and reports one edge to a local root for each vertex it joins, never all pairs. The last part has
2**18 anchors whatever the corpus, so from some billions of distinct fingerprints its blocks make most of the work; ``PARTS``
can be given with longer parts and larger allowances, which trade that for more copies.

Null and empty texts have fingerprint zero and are linked like any other. Rows equal in text share a fingerprint and so a
component; null ids get their group's smallest id and are kept only where no row of it has an id. Very long texts count
whole. An empty table gives an empty result; other columns are not read, and pass through ``keep_one`` whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import components, materialize, ship, text_rows

N_SHINGLE, SEED, THRESHOLD = 4, 42, 4
#: (shift, bits, allowance) of the parts.
PARTS = ((41, 23, 1), (18, 23, 1), (0, 18, 0))
#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b101011100011
#: Residents of an anchor that one block holds.
BLOCK = 4096


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of a text's 4-word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # bytes.lower() maps A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= N_SHINGLE:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], ">u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: 1 - N_SHINGLE].tolist()
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[N_SHINGLE - 1 :].tolist(), strict=True)], ">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.array([fingerprint(t) for t in text_rows(batch)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(fp)], ["doc_id", "h", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp) per row; h is the text's hash, fp holds the 64 bits as a signed long."""
    ship(docs.sparkSession)
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(_fingerprints, "doc_id long, h long, fp long")


def remainders(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator: zero for code words, one of 2,048 cosets otherwise.

    It is linear, so the remainders of the twelve high bits' values are all that is kept.
    """
    return Golay.table()[0][words >> 11] ^ (words & 0x7FF)


def _words_of_weight(k: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(23), k)], np.int64)


class Golay:
    """Anchors near a 23-bit word: one within distance 3, and those at distance 4."""

    _made = None

    @classmethod
    def table(cls):
        if cls._made is None:
            high = np.arange(1 << 12, dtype=np.int64) << 11
            for k in range(22, 10, -1):
                high = np.where(high >> k & 1, high ^ (GOLAY << (k - 11)), high)
            rest = lambda words: high[words >> 11] ^ (words & 0x7FF)
            near = np.concatenate([_words_of_weight(k) for k in range(4)])
            leader = np.zeros(1 << 11, np.int64)
            leader[rest(near)] = near
            far = np.sort(_words_of_weight(4))
            far = far[np.argsort(rest(far), kind="stable")]
            counts = np.bincount(rest(far), minlength=1 << 11)
            cls._made = high, leader, far, counts, np.cumsum(counts) - counts
        return cls._made

    @classmethod
    def anchors(cls, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The anchor where each word lives, then row numbers and anchors of its visits beyond that one."""
        _, leader, far, counts, first = cls.table()
        coset = remainders(words)
        n = counts[coset]
        row = np.repeat(np.arange(len(words)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return words ^ leader[coset], row, words[row] ^ far[first[coset[row]] + k]


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, anchor, fp, lives) for every anchor that a fingerprint lives at or visits."""
    for batch in batches:
        fp = np.array(batch.column("fp")).view(np.uint64)
        for part, (shift, bits, allowance) in enumerate(PARTS):
            word = (fp >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
            home, row, visited = Golay.anchors(word) if allowance else (word, np.zeros(0, np.int64), np.zeros(0, np.int64))
            anchor = np.concatenate([home, visited]) | part << 32
            lives = np.arange(len(anchor)) < len(home)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(np.concatenate([fp, fp[row]]).view(np.int64)), pa.array(lives)], ["anchor", "fp", "lives"]
            )


class Block:
    """Residents of one anchor's block; joins what the visitors link, with path-halving union."""

    def __init__(self, key):
        self.key, self.parts, self.fp, self.root = key, [], None, None

    def close(self) -> None:
        self.fp = np.unique(np.concatenate(self.parts)) if self.parts else np.zeros(0, np.uint64)
        self.root = np.arange(len(self.fp))

    def find(self, k: int) -> int:
        root = self.root
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def visit(self, fp: np.ndarray) -> list[tuple[int, int]]:
        """Edges from visitors to one resident each; residents that a visitor links are united."""
        out = []
        step = max(1, (1 << 22) // max(1, len(self.fp)))
        for k in range(0, len(fp), step):
            some = fp[k : k + step]
            visitor, resident = np.nonzero(np.bitwise_count(some[:, None] ^ self.fp[None, :]) <= THRESHOLD)
            if len(visitor) == 0:
                continue
            first = np.concatenate([[True], visitor[1:] != visitor[:-1]])
            head = resident[first][np.cumsum(first) - 1]
            for a, b in np.unique(np.stack([head, resident], 1)[head != resident], axis=0).tolist():
                a, b = self.find(a), self.find(b)
                self.root[max(a, b)] = min(a, b)
            at, to = some[visitor[first]], self.fp[resident[first]]
            new = at != to
            out += zip(at[new].tolist(), to[new].tolist(), strict=True)
        return out

    def united(self) -> list[tuple[int, int]]:
        return [(int(self.fp[k]), int(self.fp[self.find(k)])) for k in range(len(self.fp)) if self.root[k] != k]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (anchor, block, residents first); a block stays open across batches."""
    block, open_ = None, False

    def edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        two = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1])], ["u", "v"])

    for batch in batches:
        anchor, number, role = (np.array(batch.column(c)) for c in ("anchor", "block", "role"))
        fp = np.array(batch.column("fp")).view(np.uint64)
        cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (number[1:] != number[:-1]) | (role[1:] != role[:-1])) + 1
        found = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
            if a == b:
                continue
            key = (anchor[a], number[a])
            if block is None or block.key != key:
                if block is not None and not open_:
                    found += block.united()
                block, open_ = Block(key), True
            if role[a] == 0:
                block.parts.append(fp[a:b])
            else:
                if open_:
                    block.close()
                    open_ = False
                found += block.visit(fp[a:b])
        if found:
            yield edges(found)
    if block is not None and not open_:
        yield edges(block.united())


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fps(fp)`` that join all that differ in at most four bits."""
    placed = fps.mapInArrow(_placed, "anchor long, fp long, lives boolean")
    sizes = (
        placed.where("lives").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
        .select("anchor", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    some = placed.join(sizes, "anchor")  # nobody lives at the other anchors
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    residents = some.where("lives").select("anchor", own.alias("block"), F.lit(0).alias("role"), "fp")
    visitors = some.select("anchor", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "fp")
    dealt = residents.unionAll(visitors).repartition("anchor", "block").sortWithinPartitions("anchor", "block", "role")
    return dealt.mapInArrow(_compared, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, h, fp, component_id (the smallest doc_id reachable, nulls last) and root, which names the component.

    Empty and null texts share fingerprint zero. Rows with a null id get their group's smallest id, or null if it has none.
    """
    fps = materialize(fingerprints(docs), "fingerprints")
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = components(links(groups.select("fp")))
    rooted = groups.join(linked, groups.fp == linked.id, "left").select("fp", "least", F.coalesce("component_id", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")  # so that the join can be split
    return fps.join(rooted.join(least, "root").select("fp", "component_id", "root"), "fp").select("doc_id", "h", "fp", "component_id", "root")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of their group, or in a group without ids the texts of least hash; equal rows share their fate."""
    near = materialize(near_duplicates(docs), "groups")
    named = near.where("doc_id = component_id").select("doc_id", "h")
    nameless = near.where("component_id IS NULL").groupBy("root").agg(F.min("h").alias("h")).select(F.lit(None).cast("long").alias("doc_id"), "h")
    kept = named.union(nameless).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.doc_id) & (F.xxhash64(docs.text) == kept.h), "left_semi")
