"""Structured Streaming: incremental ingest, geocoding and throughput."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from weftline.operators import geo, merges
from weftline.operators.progress import ALPHA
from weftline.sources import bronze as B
from weftline.sources.router import current_pages, judged, sort_out
from weftline.streaming.log import FAN, Log, Spec, stamped


#: Children of a repository: table, kind of response, rows of its current pages.
CHILDREN = (
    ("repo_languages", "languages", B.languages_of), ("contributions", "contributors", B.contributions_of),
    ("releases", "releases", B.releases_of), ("dependencies", "sbom", B.dependencies_of),
)

#: Owners: a profile keeps what a later null says nothing of. Children are kept as the pages that list them.
SPECS = {
    "owners": Spec(("id",), keep=merges.OWNER_KEPT, greatest=("enriched",)),
    "repos": Spec(("id",), keep=("parent_id", "source_id"), first=("created_at", "attempts", "discovered_at"), greatest=("detailed",)),
    "repo_topics": Spec(("repo_id",)),
    **{name: Spec(("repo_id", "page")) for name, _, _ in CHILDREN},
    "quarantine": Spec(("url", "fetched_at")),
}


class Tables:
    """What a stream of responses has come to: a log of deltas, read as the model's tables."""

    def __init__(self, folder: str, fan: int = FAN):
        self.log = Log(folder, SPECS, fan)

    def table(self, spark: SparkSession, name: str, batch: int | None = None) -> DataFrame | None:
        """A table as of the end of ``batch``, or of the last one; none before its first row. ``quarantine`` holds what could not be used, and why."""
        stored = self.log.stored(spark, name, batch)
        if stored is None:
            return None
        rows = stored.drop("seq", "born")
        if name == "repo_topics":
            return rows.select("repo_id", F.explode("topics").alias("topic"))
        for child, _, of in CHILDREN:
            if name == child:
                return of(current_pages(rows, "full_name", "j"))
        return rows


def ingest_batch(batch: DataFrame, number: int, tables: Tables) -> None:
    """Raw responses of one micro-batch into owners, repositories and their children; idempotent per batch number.

    Enumeration pages add stubs of absent repositories and owners; a later response of the repository itself fills the stub.
    Contributors become owners that are not enriched. A response is a refresh only if it is sound: an empty list empties its
    page, a body that is no such JSON goes to quarantine and changes nothing. Only deltas are written; of the tables, the names of repositories
    are read, and only if the batch has responses that do not say which repository they belong to.
    """
    spark = batch.sparkSession
    latest = judged(B.latest_response(batch)).persist()  # URLs and bodies are judged once, however often they are read
    try:
        names = tables.log.columns(spark, "repos", ["id", "full_name"], number - 1)
        known = names.where("full_name IS NOT NULL").select(F.lower("full_name").alias("name"), "id", F.col("seq.place.at").alias("at")) if names is not None else None
        sound, bad = sort_out(latest, known)
        sound = sound.persist()
        try:
            kinds = {r[0] for r in sound.select("kind").distinct().collect()}  # what the batch has nothing of is not written
            deltas = {}
            pages, embedded = B.extract_stubs(sound)
            if kinds & {"repo", "enumeration"}:
                full = B.extract_repos(sound).selectExpr("*", "1 AS detailed", "0L AS attempts", "fetched_at AS discovered_at")
                stubs = stamped(pages, number, False, "discovered_at", *[c for c in pages.columns if c != "id"])
                deltas["repos"] = stamped(full, number, True, "fetched_at", "full_name").unionByName(stubs, allowMissingColumns=True)
            if kinds & {"repo", "user", "contributors", "enumeration"}:
                owners = stamped(B.extract_owners(sound), number, True, "fetched_at", "enriched", "login")
                deltas["owners"] = owners.unionByName(stamped(embedded, number, False, "fetched_at", "login"), allowMissingColumns=True)
            if "repo" in kinds:
                named = F.array_distinct(F.array_compact(F.coalesce("j.topics", F.array().cast("array<string>")))).alias("topics")
                topics = B.parsed(sound, "id BIGINT, topics ARRAY<STRING>", "repo").where("j.id IS NOT NULL").select(F.col("j.id").alias("repo_id"), "fetched_at", named)
                deltas["repo_topics"] = stamped(topics, number, True, "fetched_at")
            for name, kind, _ in CHILDREN:
                if kind in kinds:
                    deltas[name] = stamped(B.listings(sound, kind).drop("url"), number, True, "fetched_at")
            if not bad.isEmpty():
                deltas["quarantine"] = stamped(bad, number, True, "fetched_at", "body")
            tables.log.commit(spark, number, deltas)
        finally:
            sound.unpersist()
    finally:
        latest.unpersist()


def stream_ingest(responses: DataFrame, folder: str, checkpoint: str, **trigger):
    """Start the ingest of a stream of responses (url, body, fetched_at, and repo_id if known); returns the query. ``trigger`` is as of ``DataStreamWriter.trigger``."""
    tables = Tables(folder)
    writer = responses.writeStream.foreachBatch(lambda df, n: ingest_batch(df, n, tables)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def stream_geocode(owners: DataFrame, tables: dict[str, DataFrame], folder: str, checkpoint: str, **trigger):
    """Start geocoding a stream of owners (id, location); each micro-batch writes its places once under its number."""

    def places(df: DataFrame, n: int) -> None:
        geo.geocode(df, "id", "location", tables).write.mode("overwrite").parquet(f"{folder}/batch={n}")

    writer = owners.writeStream.foreachBatch(places).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def _rates(alpha: float):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rate, ts, value = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "value"])
        for at, now in zip(rows["ts"].astype("int64") / 1e9, rows["value"].astype(float), strict=True):
            if ts is None:
                ts, value = at, now
            elif at > ts:
                inst = max(0.0, (now - value) / (at - ts))
                rate = inst if rate is None else rate + alpha * (inst - rate)
                ts, value = at, now
        state.update((rate, ts, value))
        yield pd.DataFrame({"k": [key[0]], "rate": [rate or 0.0]})

    return update


def stream_throughput(snapshots: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(k, rate) of a stream of snapshots (k, ts, value): one state row a counter, sorted within a micro-batch; late ones change nothing."""
    return snapshots.groupBy("k").applyInPandasWithState(
        _rates(alpha), "k string, rate double", "rate double, ts double, value double", "update", "NoTimeout"
    )
