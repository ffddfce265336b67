"""Substring dedup by automata over recurring phrases.

A *window* is 20 consecutive words; a *phrase* is the 6 consecutive words of a window whose hash is least (the
first of equals). Equal windows have equal phrases at equal offsets, so a window can repeat only if its phrase recurs.
Documents are dealt by hash into *buckets* of about ``BUCKET`` bytes of text, whatever their ids.

1. Count: hashes of the chosen phrases, about one for eight words, are summed over the corpus. Those seen twice are
   sent to the buckets that hold them.
2. Confirm: each bucket spells these phrases, and the corpus counts them again by their words. The passages that recur
   so are what the automata are made of.
3. Locate: the confirmed phrases that a bucket may hold are cut into shards of bounded size, each compiled into an
   Aho-Corasick automaton (pyahocorasick) whose letters are whole words. Every document of the bucket streams through
   every shard, and only where an automaton reports an occurrence is anything looked at further.
4. Mark: consecutive windows that share an occurrence form a *segment* of at most 34 words. Equal segments (by a
   128-bit BLAKE2 digest of their words) repeat all their windows, so the first stands for the others; only
   where one phrase has several different segments are single windows compared, by 96 bits of hashes. Whatever is not
   first in (doc_id, start) is removed.

Null and empty texts have no words. A null doc_id sorts last. Rows equal in doc_id and text count as one document:
neither is earlier than the other. Different texts of one doc_id are ordered by start as if they were one document.
A very long text shares its bucket's task with the other documents that fall there. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import MAX_LONG, materialize, release, remove, settle, ship

WINDOW, PHRASE = 20, 6
SPAN = WINDOW - PHRASE + 1
#: Bytes of text in a bucket, on average; phrases of one automaton at most; characters of a word and bits of a character in
#: it, enough for all words of a shard.
BUCKET, SHARD, DIGITS, BITS = 4 << 20, 100_000, 3, 7
#: Bytes of texts whose words are hashed and compared at once.
GROUP = 1 << 18
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class Rolling:
    """Hashes of word ranges by prefix sums of word hashes times powers of an odd base, modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.powers):
            n = max(1 << n.bit_length(), 1 << 15)
            factors = (np.full(n, b, np.uint64) for b in (self.base, self.inverse))
            self.powers, self.inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), f[1:]])) for f in factors)

    def prefix(self, h: np.ndarray) -> np.ndarray:
        self.grow(len(h) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.powers[: len(h)])])

    def every(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all ranges of ``k`` words."""
        x = (prefix[k:] - prefix[:-k]) * self.inverses[: len(prefix) - k]
        x = (x ^ x >> np.uint64(32)) * _MIX
        return x ^ x >> np.uint64(29)

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (prefix[end] - prefix[start]) * self.inverses[start]
        x = (x ^ x >> np.uint64(32)) * _MIX
        return x ^ x >> np.uint64(29)


#: Low bits of a phrase's hash that do not take part in the choice; the position stands there while the least is sought.
PLACE = np.uint64(24)


def chosen(prefix: np.ndarray, rolling: Rolling, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrase hash of every position, and per run of windows that share a phrase its position, first window and end; ``text`` is each word's."""
    phrase = rolling.every(prefix, PHRASE)
    high = phrase >> PLACE
    if len(phrase) < 1 << int(PLACE):
        least = high << PLACE | np.arange(len(phrase), dtype=np.uint64)
        width = 1
        while width < SPAN:  # least of twice as many neighbours, until the span is covered
            step = min(width, SPAN - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        pick = (least & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    else:
        pick = sliding_window_view(high, SPAN).argmin(axis=1) + np.arange(len(phrase) - SPAN + 1)
    own = np.flatnonzero(text[: len(pick)] == text[WINDOW - 1 :])  # windows that lie in one text
    pick = pick[own]
    changes = np.flatnonzero(pick[1:] != pick[:-1]) + 1
    first = np.concatenate([np.zeros(min(len(own), 1), np.int64), changes])
    last = np.concatenate([changes, np.full(min(len(own), 1), len(own))]) - 1
    return phrase, pick[first], own[first], own[last] + 1


class WordHashes:
    """64-bit hashes of a text's words, from prefix sums over its bytes; no word is made a Python object."""

    def __init__(self):
        rng = np.random.default_rng(2024)  # fixed: the same hashes in every task
        self.table = rng.integers(0, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1)
        self.separator = np.zeros(256, bool)
        self.separator[[9, 10, 11, 12, 13, 32]] = True
        self.rolling = Rolling(0xA0761D6478BD642F)

    def places(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end."""
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~self.separator[data]
        change = np.flatnonzero(inside[1:] != inside[:-1])
        return change[::2], change[1::2]

    def of(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        return self.rolling.ranges(self.rolling.prefix(self.table[data]), *self.places(data))


class Group:
    """Words of some texts in a row: ``h`` their hashes, ``text`` the text of each, ``first`` the first word of each text."""

    def __init__(self, texts: list[bytes], hashes: WordHashes):
        self.data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)  # a separator behind each
        self.start, self.end = hashes.places(self.data)
        self.h = hashes.rolling.ranges(hashes.rolling.prefix(hashes.table[self.data]), self.start, self.end)
        bounds = np.searchsorted(self.start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        self.first = bounds[:-1]
        self.text = np.repeat(np.arange(len(texts)), np.diff(bounds))

    def spelled(self) -> tuple[bytes, np.ndarray]:
        """All words, a space behind each, and where each begins; the end of the last is there too."""
        length = self.end - self.start + 1
        at = np.concatenate([[0], np.cumsum(length)])
        spelling = self.data[np.repeat(self.start - at[:-1], length) + np.arange(at[-1])]
        spelling[at[1:] - 1] = 32
        return spelling.tobytes(), at


def _groups(rows: pa.RecordBatch, hashes: WordHashes) -> Iterator[tuple[int, Group]]:
    """Groups of the packed texts of a batch, with the row of the first of each; those of fewer words than a window are left out."""
    texts, held, row = [], 0, 0
    for k, text in enumerate(unpacked(rows), 1):
        texts.append(text)
        held += len(text)
        if held >= GROUP or k == rows.num_rows:
            group = Group(texts, hashes)
            if len(group.h) >= WINDOW:
                yield row, group
            texts, held, row = [], 0, k


BASE, OTHER = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the text by its zstd frame, which is what the joins by document shuffle; null stays null."""
    pack = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
    for batch in batches:
        at = batch.schema.get_field_index("text")
        frames = [None if t.as_py() is None else pack(t.as_py()) for t in batch.column("text").cast(pa.binary())]
        yield batch.set_column(at, "text", pa.array(frames, pa.binary()))


def packed(docs: DataFrame) -> DataFrame:
    return docs.mapInArrow(_pack, T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType) for f in docs.schema]))


def unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    """Texts of packed rows; null is empty."""
    unpack = zstandard.ZstdDecompressor().decompress
    for frame in batch.column("text"):
        yield unpack(frame.as_py()) if frame.is_valid else b""


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, bucket, n): hashes of the phrases that a batch's documents of a bucket choose, and how often."""
    hashes, rolling = WordHashes(), Rolling(BASE)
    for batch in batches:
        h, b = [], []
        bucket = np.array(batch.column("bucket"))
        for row, group in _groups(batch, hashes):
            phrase, pick, _, _ = chosen(rolling.prefix(group.h), rolling, group.text)
            h.append(phrase[pick]), b.append(bucket[row + group.text[pick]])
        h, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (h, b))
        if len(h):
            order = np.lexsort((h, b))
            h, b = h[order], b[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (b[1:] != b[:-1])]))
            n = np.diff(np.concatenate([first, [len(h)]])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(b[first]), pa.array(n)], ["h", "bucket", "n"])
    settle()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(bucket, kind, rows): rows come sorted by bucket, phrases (kind 0) before documents (kind 1)."""
    for batch in batches:
        bucket, kind = (np.array(batch.column(c)) for c in ("bucket", "kind"))
        cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
            if b > a:
                yield int(bucket[a]), int(kind[a]), batch.slice(a, b - a)


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(phrase, bucket, n): words of the phrases of a bucket whose hashes recur, joined by a space."""
    hashes, rolling = WordHashes(), Rolling(BASE)
    bucket, parts, wanted, counts = None, [], None, {}

    def result() -> pa.RecordBatch:
        columns = [pa.array(counts.keys(), pa.binary()), pa.array([bucket] * len(counts), pa.int32()), pa.array(counts.values(), pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["phrase", "bucket", "n"])

    for number, kind, rows in _runs(batches):
        if number != bucket:
            if counts:
                yield result()
            bucket, parts, wanted, counts = number, [], None, {}
        if kind == 0:
            parts.append(np.array(rows.column("h")).view(np.uint64))
            continue
        if not parts:
            continue
        if wanted is None:
            wanted = np.unique(np.concatenate(parts))
        for _, group in _groups(rows, hashes):
            phrase, pick, _, _ = chosen(rolling.prefix(group.h), rolling, group.text)
            some = phrase[pick]
            pick = pick[wanted[np.minimum(np.searchsorted(wanted, some), len(wanted) - 1)] == some]
            if len(pick):
                spelling, at = group.spelled()
                for x, y in zip(at[pick].tolist(), (at[pick + PHRASE] - 1).tolist(), strict=True):
                    phrase = spelling[x:y]
                    counts[phrase] = counts.get(phrase, 0) + 1
    if counts:
        yield result()
    settle()


class Shard:
    """An automaton over some phrases whose letters are whole words.

    A word is spelled by its number in ``DIGITS`` characters, each of an alphabet of its own, so hits start at words only; small
    alphabets keep nodes from branching much. A word is found by its hash; words of no phrase are all spelled alike.
    """

    def __init__(self, phrases: list[bytes]):
        hashes = WordHashes()
        words = np.concatenate([hashes.of(b" ".join(phrases[k : k + 2048])) for k in range(0, len(phrases), 2048)])
        self.known = np.unique(words)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        spelled, step = self.spell(words), DIGITS * PHRASE
        for k in range(0, len(spelled), step):
            self.automaton.add_word(spelled[k : k + step])
        self.automaton.make_automaton()

    def spell(self, words: np.ndarray) -> str:
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        number = np.where(self.known[at] == words, at + 1, 0)
        digits = number[:, None] >> np.arange(0, BITS * DIGITS, BITS) & ((1 << BITS) - 1)
        return (digits + (np.arange(1, DIGITS + 1) << BITS)).astype("<u2").tobytes().decode("utf-16-le")

    def hits(self, words: np.ndarray) -> np.ndarray:
        """Positions at which a phrase starts, of the hashes of a text's words."""
        return (np.fromiter((end for end, _ in self.automaton.iter(self.spell(words))), np.int64) + 1) // DIGITS - PHRASE


def shards(phrases: list[bytes], size: int = SHARD) -> list[Shard]:
    return [Shard(phrases[k : k + size]) for k in range(0, len(phrases), size)]


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments around the occurrences that a bucket's automata report."""
    hashes, one, two = WordHashes(), Rolling(BASE), Rolling(OTHER)
    names = ["h", "a", "b", "d", "variant", "start", "n", "windows"]
    bucket, parts, automata = None, set(), None
    for number, kind, rows in _runs(batches):
        if number != bucket:
            bucket, parts, automata = number, set(), None
        if kind == 0:
            parts.update(rows.column("phrase").to_pylist())
            continue
        if not parts:
            continue
        if automata is None:
            automata = shards(sorted(parts))
        out: list[list] = [[] for _ in names]
        d, variant = (np.array(rows.column(c)) for c in ("d", "variant"))
        for row, group in _groups(rows, hashes):
            h = group.h
            located = np.zeros(len(h), bool)
            for automaton in automata:
                located[automaton.hits(h)] = True
            if not located.any():
                continue
            p1 = one.prefix(h)
            phrase, pick, first, last = chosen(p1, one, group.text)
            keep = located[pick]
            if not keep.any():
                continue
            phrase, first, last = phrase[pick[keep]], first[keep], last[keep]
            spelling, at = group.spelled()
            digest = b"".join([hashlib.blake2b(spelling[x:y], digest_size=16).digest() for x, y in zip(at[first].tolist(), (at[last + WINDOW - 1] - 1).tolist(), strict=True)])
            a, b = np.frombuffer(digest, np.int64).reshape(-1, 2).T
            p2 = two.prefix(h)
            key = one.every(p1, WINDOW) ^ two.every(p2, WINDOW) * _MIX
            n = last - first
            inside = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            text = group.text[first]
            start = (first - group.first[text]).astype(np.int32)
            for column, x in zip(
                out, (phrase.view(np.int64), a, b, d[row + text], variant[row + text], start, n.astype(np.int32), key[inside].view(np.int64)), strict=True
            ):
                column.append(x)
        if out[0]:
            *flat, windows = (np.concatenate(x) for x in out)
            offsets = np.concatenate([[0], np.cumsum(flat[-1])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*map(pa.array, flat), pa.ListArray.from_arrays(pa.array(offsets), pa.array(windows))], names)
    settle()


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with d, the id (null: the greatest long), and variant, which tells different texts of one id apart.

    d is shared by all null ids, so it only orders documents; (d, variant) names them.
    """
    return docs.select(*columns, F.coalesce("doc_id", F.lit(MAX_LONG)).alias("d"), F.xxhash64("text").alias("variant"))


def _beside(needles: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of both by bucket, the phrases of a bucket before its documents."""
    (needle, kind), *_ = [x for x in needles.dtypes if x[0] != "bucket"]
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    first = needles.select("bucket", F.lit(0).alias("kind"), needle, null("d", "long"), null("variant", "long"), null("text", "binary"))
    second = docs.select("bucket", F.lit(1).alias("kind"), null(needle, kind), "d", "variant", "text")
    return first.unionAll(second).repartition("bucket").sortWithinPartitions("bucket", "kind")


def framed(docs: DataFrame, *columns: str) -> DataFrame:
    """Table of ``columns``, d, variant, the packed text and its bytes: what every later step reads instead of ``docs``."""
    ship(docs.sparkSession)
    return materialize(packed(keyed(docs, *columns, "text", F.octet_length("text").alias("bytes"))), "texts")


def segments(texts: DataFrame) -> DataFrame:
    """Table of located segments: h, their phrase's hash; (a, b), their key; (d, variant), the document; start, n windows and their keys."""
    spark = texts.sparkSession
    total = texts.agg(F.sum("bytes")).head()[0] or 0
    bucket = F.pmod(F.xxhash64("d", "variant"), F.lit(total // BUCKET + 1)).cast("int").alias("bucket")
    phrases = materialize(texts.select("text", bucket).mapInArrow(_phrases, "h long, bucket int, n int"), "phrases")
    recurring = phrases.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    wanted = materialize(phrases.join(recurring, "h").select("bucket", "h"), "wanted")
    del recurring
    release(spark, phrases)
    frames, own = texts.select(bucket, "d", "variant", "text"), None
    if not texts.groupBy("d", "variant").count().where("count > 1").isEmpty():  # of equal rows one, lest a group of them fill a bucket
        frames = own = materialize(frames.dropDuplicates(["d", "variant"]), "distinct")
    spelled = materialize(_beside(wanted, frames).mapInArrow(_spelled, "phrase binary, bucket int, n int"), "spelled")
    remove(wanted)
    confirmed = spelled.groupBy("phrase").agg(F.sum("n").alias("n")).where("n > 1").select("phrase")
    needles = materialize(spelled.join(confirmed, "phrase").select("bucket", "phrase"), "confirmed")
    del confirmed
    release(spark, spelled)
    located = _beside(needles, frames).mapInArrow(
        _located, "h long, a long, b long, d long, variant long, start int, n int, windows array<long>"
    )
    found = materialize(located, "segments")
    del located
    remove(own)
    release(spark, needles)
    return found


def removals(texts: DataFrame) -> DataFrame:
    """(d, variant, runs): per document of a ``framed`` table the runs of windows (start, n) that also start earlier."""
    spark, found = texts.sparkSession, segments(texts)
    place = F.struct("d", "start")
    later = place > F.col("first")
    first = materialize(found.groupBy("a", "b").agg(F.min("h").alias("h"), F.min(place).alias("first"), F.count(F.lit(1)).alias("times")), "first")
    single = _repeated_windows(found, first, place, later)
    again = first.where("times > 1").select("a", "b", "first")
    whole = materialize(found.drop("windows").join(again, ["a", "b"]).where(later).select("d", "variant", "start", "n"), "repeated")
    del again
    release(spark, found, first)
    return whole.unionAll(single).groupBy("d", "variant").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def _repeated_windows(found: DataFrame, first: DataFrame, place, later) -> DataFrame:
    """Table of the single windows (d, variant, start, 1) that repeat part of a different segment of their phrase."""
    spark = found.sparkSession
    disputed = first.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("h")
    heads = first.join(disputed, "h").select("a", "b", "first.d", "first.start")
    windows = found.join(heads, ["a", "b", "d", "start"]).select(
        F.shiftright("h", 32).cast("int").alias("h"), "d", "variant", "start", F.posexplode("windows").alias("k", "window")
    ).select("h", "window", "d", "variant", (F.col("start") + F.col("k")).alias("start"))
    windows = materialize(windows, "windows")
    del disputed, heads
    release(spark)
    earliest = materialize(windows.groupBy("h", "window").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times"), "earliest")
    single = materialize(windows.join(earliest, ["h", "window"]).where(later).select("d", "variant", "start", F.lit(1).alias("n")), "repeated")
    release(spark, windows, earliest)
    return single


def kept_words(text: bytes, runs) -> tuple[list[bytes], int]:
    """Words left of a text, and how many there were."""
    words = text.split()
    if runs is None or not len(runs):
        return words, len(words)
    start, n = (np.array(runs.field(k), np.int64) for k in (0, 1))
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + n + WINDOW - 1, -1)
    keep = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k], len(words)


def _with_runs(docs: DataFrame, column: str) -> DataFrame:
    texts = framed(docs, column)
    return texts.select(column, "d", "variant", "text").join(removals(texts), ["d", "variant"], "left").drop("d", "variant")


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        runs = batch.column("runs")
        for row, text in enumerate(unpacked(batch)):
            kept, n = kept_words(text, runs[row].values)
            rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        if rows:
            columns = [pa.array(x) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per row of ``docs``."""
    return _with_runs(docs, "doc_id").mapInArrow(_report, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def rewrite(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated words: texts with removals become their kept words joined by a space, others stay."""
    columns = docs.columns
    rest = F.struct(*[F.col(c) for c in columns if c != "text"]).alias("row")
    joined = _with_runs(docs.select("doc_id", "text", rest), "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, frames = batch.column("runs"), batch.column("text")
            new = []
            for row, text in enumerate(unpacked(batch)):
                left = text if runs[row].values is None else b" ".join(kept_words(text, runs[row].values)[0])
                new.append(left.decode() if frames[row].is_valid else None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(new, pa.string())], ["row", "text"])

    out = joined.mapInArrow(cut, T.StructType([joined.schema["row"], T.StructField("text", T.StringType())]))
    fields = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[fields[c].alias(c) if c in fields else F.col("row")[c].alias(c) for c in columns])
