"""Weak-label quality classifier: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Eight labellers, column expressions over a text, vote good (1), bad (0) or nothing (2). A document's votes are one
of at most 3**8 patterns, and the pattern counts over all documents are everything that expectation-maximisation
needs: it estimates each labeller's accuracies and every pattern's posterior of good exactly, whatever the size of
the corpus. The posteriors are the soft labels of a logistic regression on hashed words, fitted on a sample of documents of
bounded size (``TRAIN_BOUND``, by hash of the id) and applied to every document. The verdict is the scorer's. No given label
is used; the table ``labels`` serves to measure held-out accuracy.

Null text is empty. Texts without words have no features: they score 0 and are not kept. An empty table gives an
empty result. Equal rows get equal results, null ids pass through, other columns are not read. Very long texts are one
row: all their words count. Votes and scores are made in one pass over the rows without a shuffle; only the patterns' counts and
the sample leave their tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize, remove

#: Documents on which the linear scorer is fitted, about; size of its feature space; score from which a text is kept.
TRAIN_BOUND, FEATURES, KEEP = 20_000, 1 << 16, 0.5
#: Frequent words of the corpus languages (fixed values).
STOP_WORDS = (
    "the of and to in a is that for with on as are be this by from or an it",
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "de la le et les des en un du une que est pour qui dans a par plus pas au",
    "de la que el en y a los se del las un por con no una su para es al",
)
STEPS = 60

_SPLIT = r"[\x20\x09-\x0D]+"


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(2)


def labellers() -> list[tuple[str, Column]]:
    """Name and vote of each labeller, over the columns of ``described``."""
    per_word = lambda c: F.try_divide(F.col(c), F.col("n_words"))
    symbols, capitals, marks, stops = (F.coalesce(per_word(c), F.lit(0.0)) for c in ("n_symbols", "n_capitals", "n_marks", "n_stops"))
    variety, length = F.coalesce(per_word("n_distinct"), F.lit(0.0)), F.coalesce(per_word("n_letters"), F.lit(0.0))
    lines = F.coalesce(F.try_divide("n_lines_distinct", "n_lines"), F.lit(1.0))
    n = F.col("n_words")
    return [
        ("length", _vote(n < 10, n >= 40)),
        ("symbols", _vote(symbols > 0.3, symbols < 0.1)),
        ("capitals", _vote(capitals > 2.0, capitals < 1.0)),
        ("marks", _vote(marks > 0.5, marks < 0.1)),
        ("stop_words", _vote(stops < 0.01, stops >= 0.05)),
        ("variety", _vote(variety < 0.15, variety >= 0.35)),
        ("word_length", _vote((length > 12) | (length < 2), length.between(3, 9))),
        ("lines", _vote(lines < 0.7, lines >= 0.95)),
    ]


def described(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, words, votes), and the columns in ``more``: a pattern of one digit per labeller for every row."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", "text", *more, F.filter(F.split(text, _SPLIT), lambda w: w != "").alias("words"), F.split(text, "\n").alias("lines"))
    stop = sorted({w for line in STOP_WORDS for w in line.split()})
    counts = split.select(
        "doc_id", "text", *more, "words", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"),
        F.size("lines").alias("n_lines"), F.size(F.array_distinct("lines")).alias("n_lines_distinct"),
        F.size(F.filter("words", lambda w: w.isin(stop))).alias("n_stops"),
        *[F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).alias(n) for n, p in
          (("n_symbols", r"[#*$%&|<>]"), ("n_capitals", r"\p{Lu}"), ("n_marks", r"[!?|=~_^]"), ("n_letters", r"[^\x20\x09-\x0D]"))],
    )
    return counts.select("doc_id", "text", *more, "words", F.concat(*[v.cast("string") for _, v in labellers()]).alias("votes"))


def fit_labellers(patterns: list[tuple[str, int]], steps: int = STEPS) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of good for each (pattern, count), and each labeller's P(vote | bad or good), by EM from the majority vote."""
    if not patterns:
        return {}, np.zeros((0, 2, 3))
    votes = np.array([[int(c) for c in p] for p, _ in patterns])
    weight = np.array([n for _, n in patterns], float)
    posterior = np.clip(((votes == 1).sum(1) + 0.5) / ((votes < 2).sum(1) + 1), 0.01, 0.99)
    for _ in range(steps):
        mass = np.stack([weight * (1 - posterior), weight * posterior])
        prior = (mass.sum(1) + 1) / (weight.sum() + 2)
        chance = np.stack([[(mass * (votes[:, k] == v)).sum(1) + 1 for v in range(3)] for k in range(votes.shape[1])])
        chance = np.swapaxes(chance / chance.sum(axis=1, keepdims=True), 1, 2)
        log = np.log(prior)[:, None] + sum(np.log(chance[k])[:, votes[:, k]] for k in range(votes.shape[1]))
        posterior = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return {p: float(x) for (p, _), x in zip(patterns, posterior, strict=True)}, chance


def _features(described: DataFrame) -> DataFrame:
    hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="words", outputCol="hashed").transform(described)
    return Normalizer(inputCol="hashed", outputCol="features").transform(hashed).drop("hashed", "words")


def training_rows(docs: DataFrame, total: int, bound: int) -> DataFrame:
    """(doc_id, text, n): at most ``bound`` different rows, of least hash, and how often each stands in ``docs``; never none if there are rows.

    Hashes of about twice the bound are looked at; only if all of these are missing, as with few different rows, are all of them.
    """
    whole = 1 << 62
    place = F.pmod(F.xxhash64(F.lit("train"), "doc_id", "text"), F.lit(whole))
    for limit in (min(whole, max(1, 2 * bound * whole // max(1, total))), whole):
        least = docs.select(place.alias("place")).where(F.col("place") < limit).distinct().orderBy("place").limit(bound).agg(F.max("place")).head()[0]
        if least is not None:
            break
    some = docs.select("doc_id", "text", place.alias("place")).where(F.col("place") <= F.lit(least))
    return some.groupBy("place").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("n")).drop("place")


def classify(docs: DataFrame, bound: int = TRAIN_BOUND, keep: float = KEEP) -> DataFrame:
    """doc_id, votes, posterior, score, kept per row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    rows = described(docs)
    patterns = sorted((r[0], r[1]) for r in rows.groupBy("votes").count().collect())  # 3**8 at most
    posteriors, _ = fit_labellers(patterns)
    if not patterns:
        return spark.createDataFrame([], "doc_id long, votes string, posterior double, score double, kept boolean")
    table = F.broadcast(spark.createDataFrame(list(posteriors.items()), "votes string, posterior double"))
    total = sum(n for _, n in patterns)
    sample = training_rows(docs, total, bound)
    both = F.array(*[F.struct(F.lit(y).alias("label"), (F.col("n") * w).alias("weight")) for y, w in ((1.0, F.col("posterior")), (0.0, 1 - F.col("posterior")))])
    soft = _features(described(sample, "n")).join(table, "votes").select("features", F.explode(both).alias("x")).select("features", "x.label", "x.weight")
    train = materialize(soft, "train")
    model = LogisticRegression(weightCol="weight", maxIter=40, regParam=1e-4, standardization=False).fit(train)
    remove(train)
    some = rows.withColumn("n", F.size("words"))
    scored = model.transform(_features(some)).join(table, "votes")
    score = F.when(F.col("n") > 0, F.round(vector_to_array("probability")[1], 9)).otherwise(F.lit(0.0))
    return scored.select("doc_id", "votes", "posterior", score.alias("score")).withColumn("kept", F.col("score") >= keep)
