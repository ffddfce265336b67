"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Two passes over the documents. The first counts hashed word uni- and bigrams into two multinomials of fixed
size: one of the trusted documents (a bounded sample of the labelled ones), one of every document. Only
per-task sums are shuffled, and only ``N_BUCKETS`` rows reach the driver. The second scores each document by its
mean log ratio per n-gram and thresholds it, so the outcome depends on the document and the tables alone.

Null or empty text has no words: it fails the base rule and is not kept, with score 0. Equal rows get equal
verdicts; null ids pass through. With no trusted document all scores are 0 and only the base rule decides. Very long texts
count whole, one at a time. An empty table gives an empty result; other columns are not read, and pass through
``keep_good`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import settle, ship, text_rows

#: Size of both multinomials.
N_BUCKETS = 1 << 16
#: At most about this many labelled documents make up the trusted target.
TARGET_BOUND = 20_000
#: A document is kept when its mean log ratio per n-gram reaches this.
THRESHOLD = -0.12
#: Characters that count as symbols (fixed by the contract).
SYMBOLS = "#*$%&|<>"
SEPARATORS = " \t\n\x0b\x0c\r"

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SHIFT = np.uint64(48)


class Hashes(dict):
    """Word -> 64-bit hash, computed once per word; emptied when it grows past ``bound`` words."""

    def __init__(self, bound: int = 200_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def buckets(h: np.ndarray) -> np.ndarray:
    """Buckets of the unigrams and bigrams of hashed words."""
    two = h[:-1] * _A + h[1:] * _B
    return (np.concatenate([h, two]) * _C >> _SHIFT).astype(np.int64)


def repeated_words(h: np.ndarray) -> int:
    """Words within three-word windows that are found twice or more, the first included."""
    if len(h) < 4:
        return 0
    three = h[:-2] * _A + h[1:-1] * _B + h[2:] * _C
    _, inverse, counts = np.unique(three, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(SEPARATORS):
            n += line in seen
            seen.add(line)
    return n


def _counts(trusted: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = Hashes(), np.zeros((2, N_BUCKETS), np.int64)
        held: list[list[np.ndarray]] = [[], []]

        def flush(kind: int) -> None:
            if held[kind]:
                total[kind] += np.bincount(np.concatenate(held[kind]), minlength=N_BUCKETS)
                held[kind].clear()

        for batch in batches:
            ids = batch.column("doc_id")
            target = np.isin(np.array(ids.fill_null(0)), trusted) & np.array(ids.is_valid())
            size = 0
            for text, good in zip(text_rows(batch), target, strict=True):
                if words := text.split():
                    b = buckets(hashes.of(words))
                    held[1].append(b)
                    if good:
                        held[0].append(b)
                    size += len(b)
                    if size > 2_000_000:
                        flush(0), flush(1)
                        size = 0
            flush(0), flush(1)
        hashes.clear()
        settle()
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "n_target", "n_raw"])

    return count


def trusted_ids(labels: DataFrame, bound: int = TARGET_BOUND) -> np.ndarray:
    """Ids of about ``bound`` trusted documents at most: good, not toxic, of least hash rank; the same on every run."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    share = min(1.0, bound / max(1, good.count()))
    picked = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * bound)
    return np.sort(np.array([r[0] for r in picked.collect()], np.int64))


def log_ratios(docs: DataFrame, labels: DataFrame, bound: int = TARGET_BOUND) -> np.ndarray:
    """Log ratio of the smoothed target to the smoothed raw multinomial, per bucket."""
    per_task = docs.select("doc_id", "text").mapInArrow(_counts(trusted_ids(labels, bound)), "bucket long, n_target long, n_raw long")
    rows = per_task.groupBy("bucket").agg(F.sum("n_target"), F.sum("n_raw")).collect()
    n = np.zeros((2, N_BUCKETS))
    for bucket, target, raw in rows:
        n[:, bucket] = target, raw
    if not n[0].any():
        return np.zeros(N_BUCKETS, np.float32)
    p = (n + 1) / (n.sum(axis=1, keepdims=True) + N_BUCKETS)
    return np.log(p[0] / p[1]).astype(np.float32)


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def judge(text: str, words: list[bytes], h: np.ndarray, ratios: np.ndarray, threshold: float) -> tuple:
    """One document's values of ``FIELDS``."""
    n, repeats = len(words), repeated_words(h)
    failed = n < 50 or 100 * repeats > 50 * n
    score = round(float(ratios[buckets(h)].mean(dtype=np.float64)), 9) if n else 0.0
    return (
        n, len(text) - sum(map(text.count, SEPARATORS)), sum(map(text.count, SYMBOLS)), repeated_lines(text), repeats,
        failed, score, not failed and score >= threshold,
    )


def _judged(batch: pa.RecordBatch, hashes: Hashes, ratios: np.ndarray, threshold: float) -> list[tuple]:
    return [judge(t.decode(), w := t.split(), hashes.of(w), ratios, threshold) for t in text_rows(batch)]


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = TARGET_BOUND) -> DataFrame:
    """doc_id and ``FIELDS`` of every row of ``docs(doc_id, text)``."""
    ship(docs.sparkSession)
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, bound))
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            columns = list(zip(*_judged(batch, hashes, ratios.value, threshold), strict=True)) or [[]] * len(names)
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", *names])
        hashes.clear()
        settle()

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id long, {FIELDS}")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = TARGET_BOUND) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; no shuffle of the texts."""
    ship(docs.sparkSession)
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, bound))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            yield batch.filter(pa.array([row[-1] for row in _judged(batch, hashes, ratios.value, threshold)], pa.bool_()))
        hashes.clear()
        settle()

    return docs.mapInArrow(keep, docs.schema)
