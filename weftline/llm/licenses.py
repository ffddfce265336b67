"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word 3-gram of every document is hashed and joined to the positions of the same 3-gram in the
license templates: notices of a line and whole licence texts, some three thousand words in all, which are broadcast
(their size is checked). Each hit votes for a diagonal, its
position in the document less that in the template; diagonals at most ``SLACK`` apart are merged, so a few inserted
or lost words do no harm, and a merged diagonal is verified by the share of the template's words that its hits
cover. Base phrases are found by the same join, exactly: a phrase's own grams, all on one diagonal.

Words are runs of ASCII digits, lower-case letters (A-Z are lowered) and non-ASCII characters. Null text has none: its
counts are 0, its places null and its labels empty. Very long texts are one row whose words are held at once; only hits leave it.
Rows equal in doc_id and text get equal results; null ids pass through; other columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.license_texts import NOTICES, TEXTS

K, SLACK, COVER = 3, 2, 0.8
#: Template words that a broadcast may hold.
MOST_WORDS = 100_000
#: Phrases of the contract and their labels (fixed values).
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices and whole texts, and their labels.
TEMPLATES = (*NOTICES, *TEXTS)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text that is not lowered yet.
_WORD_RAW = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def _gram(words: str, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(F.col(words), at + j) for j in range(k)])


def _grams(words: str, k: int, first=None) -> Column:
    """(pos, k, h) of every k-gram of ``words``, or of those at which ``first`` holds of the word."""
    last = F.size(words) - k
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    if first is not None:
        at = F.filter(at, first)
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.lit(k).alias("k"), _gram(words, i, k).alias("h")))


def templates(spark: SparkSession, base=BASE, notices=TEMPLATES) -> DataFrame:
    """(template, label, is_base, n, k, h, tpos): grams of every template; those of fewer than ``K`` words are one gram."""
    rows = [F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(n < len(base)).alias("is_base"), F.lit(text).alias("text"))
            for n, (label, text) in enumerate([*((b, a) for a, b in base), *notices])]
    one = spark.range(1).select(F.inline(F.array(*rows))).withColumn("words", words_of(F.col("text")))
    grams = F.when(F.size("words") >= K, _grams("words", K))
    for short in range(1, K):
        grams = grams.when(F.size("words") == short, _grams("words", short))
    return one.select("template", "label", "is_base", F.size("words").alias("n"), F.explode(grams).alias("g")).select(
        "template", "label", "is_base", "n", F.col("g.k").alias("k"), F.col("g.h").alias("h"), F.col("g.pos").alias("tpos")
    )


def _short_starts(base, notices) -> dict[int, list[str]]:
    """First words of the templates of fewer than ``K`` words, by their length; only there are shorter grams hashed."""
    starts: dict[int, list[str]] = {}
    for text in [*(p for p, _ in base), *(t for _, t in notices)]:
        words = text.lower().split()
        if len(words) < K:
            starts.setdefault(len(words), []).append(words[0])
    return starts


def _starts_with(first: list[str]):
    return lambda i: F.get("words", i).isin(first)


def hits(docs: DataFrame, base=BASE, notices=TEMPLATES) -> DataFrame:
    """Distinct hits (key, doc_id, pos, template, label, is_base, n, k, tpos) of template grams in ``docs``."""
    table = templates(docs.sparkSession, base, notices)
    if sum(len(t.split()) for _, t in [*base, *notices]) <= MOST_WORDS:
        table = F.broadcast(table)
    words = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), words_of(F.col("text")).alias("words"))
    grams = [_grams("words", K)]
    for k, first in _short_starts(base, notices).items():
        grams.append(_grams("words", k, _starts_with(first)))
    rolled = words.select("doc_id", "key", F.explode(F.concat(*grams)).alias("g")).select("doc_id", "key", "g.pos", "g.k", "g.h")
    return rolled.join(table, ["h", "k"]).drop("h").distinct()


def spans(docs: DataFrame, base=BASE, notices=TEMPLATES) -> DataFrame:
    """(key, doc_id, label, is_base, start, first_word, last_word, coverage) of every merged diagonal; exact for base phrases."""
    found = hits(docs, base, notices).withColumn("diagonal", F.col("pos") - F.col("tpos"))
    votes = found.groupBy("key", "doc_id", "template", "label", "is_base", "n", "k", "diagonal").agg(F.collect_set("tpos").alias("at"))
    order = Window.partitionBy("key", "doc_id", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    merged = votes.withColumn("cluster", F.sum(F.when(F.col("is_base") | gap.isNull() | (gap > SLACK), 1).otherwise(0)).over(order))
    several = merged.groupBy("key", "doc_id", "template", "label", "is_base", "n", "k", "cluster").agg(
        F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.flatten(F.collect_list("at")).alias("at")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + F.col("k") - 1)))))
    return several.select(
        "key", "doc_id", "label", "is_base", F.col("low").alias("start"), (F.col("low") + F.array_min("at")).alias("first_word"),
        (F.col("high") + F.array_max("at") + F.col("k") - 1).alias("last_word"), (covered / F.col("n")).alias("coverage"),
    )


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(labels), ",")


def scan(docs: DataFrame, base=BASE, notices=TEMPLATES, cover: float = COVER) -> DataFrame:
    """The contract's columns, one row per row of ``docs(doc_id, text)``.

    Base labels need the whole phrase, others the share ``cover`` of a notice; of notices that start at one place the best
    covered count. Score is the largest share found.
    """
    found = spans(docs, base, notices)
    best = F.max(F.when(~F.col("is_base"), F.col("coverage"))).over(Window.partitionBy("key", "doc_id", "start"))
    found = found.withColumn("best", best)
    whole = F.col("is_base") & (F.col("coverage") == 1.0)
    good = whole | ~F.col("is_base") & (F.col("coverage") >= cover) & (F.col("coverage") == F.col("best"))
    per_doc = found.where(whole | ~F.col("is_base")).groupBy("key", "doc_id").agg(
        F.count_if(whole).alias("n_base"), F.min(F.when(whole, F.col("first_word"))).alias("first_word"),
        F.max(F.when(whole, F.col("first_word"))).alias("last_word"), _joined(F.collect_set(F.when(whole, F.col("label")))).alias("base_labels"),
        _joined(F.collect_set(F.when(good, F.col("label")))).alias("labels"), F.max("coverage").alias("score"),
    ).withColumnRenamed("doc_id", "id")
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.regexp_count("text", F.lit(_WORD_RAW)), F.lit(0)).alias("n_words"))
    per_doc = per_doc.withColumnRenamed("key", "own")
    return rows.join(per_doc, (rows.key == per_doc.own) & rows.doc_id.eqNullSafe(per_doc.id), "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
