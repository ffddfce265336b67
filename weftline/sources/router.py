"""What a raw response answers: its kind, repository and page, told from the URL once, and what is wrong with those that answer nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scheme and host, if any; slashes, query and fragment behind a path. A repository by name or number with what follows; enumerations; people.
_HOST, _REST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?", r"/*(?:[?#].*)?$"
_NAMED = _HOST + r"/(?:repos/([^/?#]+/[^/?#]+)|repositories/([0-9]{1,18}))((?:/[^?#]*?)??)" + _REST
_PAGES, _USER = _HOST + "/repositories" + _REST, _HOST + "/users/[^/?#]+" + _REST
#: Part of the path behind a repository -> kind.
_PARTS = {"": "repo", "/languages": "languages", "/contributors": "contributors", "/releases": "releases", "/dependency-graph/sbom": "sbom"}
#: Kinds whose body is a list; the others' is an object.
LISTS = ("contributors", "releases", "enumeration")
#: Kinds that belong to a repository without naming its id in the body.
CHILDREN = ("languages", "contributors", "releases", "sbom")


def route(responses: DataFrame) -> DataFrame:
    """``responses(url, body, ...)`` with kind, full_name (or null), page and the repository's id where the URL has it (``url_repo_id``).

    URLs may have a scheme and host and a query, as a crawler stores them, or be a path alone. A repository is named
    ``/repos/<owner>/<name>`` or, as links to further pages do, ``/repositories/<id>``. Without ``page`` in the query the page is 1.
    Unknown and null URLs have no kind.
    """
    is_named, part = F.col("url").rlike(_NAMED), F.regexp_extract("url", _NAMED, 3)
    kinds = F.create_map(*[F.lit(x) for pair in _PARTS.items() for x in pair])
    kind = F.when(is_named, F.try_element_at(kinds, part)).when(F.col("url").rlike(_PAGES), "enumeration").when(F.col("url").rlike(_USER), "user")
    number = lambda text, digits: F.try_to_number(F.nullif(text, F.lit("")), F.lit("9" * digits))
    return responses.withColumns(
        {
            "kind": kind, "full_name": F.nullif(F.regexp_extract("url", _NAMED, 1), F.lit("")), "url_repo_id": number(F.regexp_extract("url", _NAMED, 2), 18).cast("long"),
            "page": F.coalesce(number(F.regexp_extract("url", r"[?&]page=([0-9]{1,9})(?:[&#]|$)", 1), 9).cast("int"), F.lit(1)),
        }
    )


def fault(columns: list[str]) -> Column:
    """Why a routed response cannot be used: ``status``, ``url``, ``body`` (no JSON of the shape its kind has) or ``id``; null if it can.

    An empty list or object is fine: it says that there is nothing. A status is looked at where there is such a column; null passes.
    """
    shaped = F.when(F.col("kind").isin(*LISTS), F.json_array_length("body").isNotNull()).otherwise(F.json_object_keys("body").isNotNull())
    named = ~F.col("kind").isin("repo", "user") | F.get_json_object("body", "$.id").try_cast("long").isNotNull()
    failed = F.coalesce(~F.col("status").between(200, 299), F.lit(False)) if "status" in columns else F.lit(False)
    return F.when(failed, "status").when(F.col("kind").isNull(), "url").when(~shaped, "body").when(~named, "id")


def repo_names(routed: DataFrame) -> DataFrame:
    """(name, id, at) of the repositories that sound responses name, names in lower case; the name in the body and the one in the URL."""
    repos = routed.where("kind = 'repo'").select(
        F.get_json_object("body", "$.id").try_cast("long").alias("id"), F.array(F.get_json_object("body", "$.full_name"), "full_name").alias("names"), F.col("fetched_at").alias("at")
    )
    return repos.where("id IS NOT NULL").select(F.explode("names").alias("name"), "id", "at").where("name IS NOT NULL").withColumn("name", F.lower("name"))


def identify(routed: DataFrame, names: DataFrame) -> DataFrame:
    """``routed`` with ``repo_id``: what it says itself (a column, or the URL's number), or by ``names(name, id, at)`` the latest of that name."""
    own = F.coalesce("repo_id", "url_repo_id") if "repo_id" in routed.columns else F.col("url_repo_id")
    known = names.groupBy(F.col("name").alias("known_name")).agg(F.max_by("id", F.struct("at", "id")).alias("known_id"))
    rows = routed.withColumn("own_id", own).drop("repo_id", "url_repo_id").withColumnRenamed("own_id", "repo_id")
    asks = F.col("repo_id").isNull() & F.col("kind").isin(*CHILDREN) & F.col("full_name").isNotNull()
    asked = rows.where(asks).join(known, F.lower("full_name") == F.col("known_name"), "left")  # only what asks is joined
    told = asked.withColumn("repo_id", F.col("known_id")).drop("known_id", "known_name")
    return rows.where(~asks).unionByName(told)


def judged(responses: DataFrame) -> DataFrame:
    """``responses`` routed, with the ``reason`` why one cannot be used, or null. All that a URL and a body are parsed for, so best kept where it is read often."""
    return route(responses).withColumn("reason", fault(responses.columns))


def sort_out(responses: DataFrame, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sound responses, routed and identified, and the others as quarantine rows (url, fetched_at, reason, body).

    A sound response of a repository that neither ``names`` nor the responses themselves know waits in quarantine too (``repository``).
    Responses may be ``judged`` already.
    """
    routed = responses if {"kind", "reason"} <= set(responses.columns) else judged(responses)
    sound = routed.where("reason IS NULL").drop("reason")
    own = repo_names(sound)
    found = identify(sound, own.unionByName(names) if names is not None else own)
    lost = F.col("kind").isin(*CHILDREN) & F.col("repo_id").isNull()
    rows = ["url", "fetched_at", "reason", "body"]
    bad = routed.where("reason IS NOT NULL").select(rows).unionByName(found.where(lost).withColumn("reason", F.lit("repository")).select(rows))
    return found.where(~lost), bad


def current_pages(listings: DataFrame, *columns: str) -> DataFrame:
    """Of ``listings(repo_id, page, fetched_at, ...)`` the last response for each page, without pages older than their listing's first.

    Pages are fetched in order, so a page from before the first is what an earlier, longer listing has left.
    A repository's responses are shuffled to one place once: there pages are told apart and compared with the first.
    """
    order = F.struct("fetched_at", *[c for c in listings.columns if c not in ("repo_id", "page", "fetched_at", *columns)])
    last = listings.repartition("repo_id").groupBy("repo_id", "page").agg(F.max_by(F.struct("fetched_at", *columns), order).alias("r")).select("repo_id", "page", "r.*")
    first = F.max(F.when(F.col("page") == 1, F.col("fetched_at"))).over(Window.partitionBy("repo_id"))
    return last.withColumn("first_at", first).where("first_at IS NULL OR fetched_at IS NULL OR fetched_at >= first_at").drop("first_at")
