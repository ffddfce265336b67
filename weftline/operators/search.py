"""Substring search over names and logins by an index of trigrams, equal to a scan of them all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.filters import restrict
from weftline.operators.graph import numbered, written

#: Characters in a gram, and how many of a pattern's grams, the rarest, are looked up.
GRAM, RAREST = 3, 3


@dataclass(frozen=True)
class TextIndex:
    """Distinct lower-case texts by number, who holds them, where each gram occurs (sorted by gram), and how often."""

    terms: DataFrame
    holders: DataFrame
    postings: DataFrame
    sizes: DataFrame


def repo_texts(core: DataFrame, contributions: DataFrame) -> DataFrame:
    """(id, text): what ``filter_repos`` searches, a repository's full name and its contributors' logins."""
    return core.select("id", F.col("full_name").alias("text")).unionAll(contributions.select("repo_id", "owner_login"))


def text_index(rows: DataFrame) -> TextIndex:
    """Index of ``rows(id, text)``; nulls are no texts, texts are short (names). A frequent gram is spread over files by number."""
    low = written(rows.where("id IS NOT NULL AND text IS NOT NULL").select("id", F.lower("text").alias("text")).distinct(), "texts")
    terms = written(numbered(low.select("text").distinct(), "number", "text"), "terms")
    holders = written(low.join(terms, "text").select("number", "id").repartitionByRange("number", "id").sortWithinPartitions("number", "id"), "holders")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - (GRAM - 1)), lambda i: F.substring("text", i, GRAM)))
    found = terms.where(F.length("text") >= GRAM).select(F.explode(grams).alias("gram"), "number")
    postings = written(found.repartitionByRange("gram", "number").sortWithinPartitions("gram", "number"), "postings")
    sizes = written(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "sizes")
    return TextIndex(terms, holders, postings, sizes)


def search(index: TextIndex, pattern: str) -> DataFrame:
    """(id) of who holds a text that contains ``pattern``, whatever the case of either.

    Postings of the pattern's rarest grams are intersected, and what they have in common is looked at itself. Patterns
    shorter than a gram look at every distinct text, once each.
    """
    wanted = pattern.lower()
    grams = sorted({wanted[k : k + GRAM] for k in range(len(wanted) - GRAM + 1)})
    texts = index.terms
    if grams:
        sizes = {r.gram: r.n for r in index.sizes.where(F.col("gram").isin(grams)).collect()}  # one row at most for each gram of the pattern
        rare = sorted(grams, key=lambda g: (sizes.get(g, 0), g))[:RAREST]
        common = index.postings.where(F.col("gram").isin(rare)).groupBy("number").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rare))
        texts = restrict(texts, common.select("number"), "number")
    hits = texts.where(F.col("text").contains(wanted)).select("number")
    return restrict(index.holders, hits, "number").select("id").distinct()


def search_repos(core: DataFrame, index: TextIndex, pattern: str) -> DataFrame:
    """Rows of ``core`` that ``filter_repos`` keeps for this search; ``index`` is one of its ``repo_texts``. An empty pattern is off."""
    return restrict(core, search(index, pattern), "id") if pattern else core
