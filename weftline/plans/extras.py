"""Queries of geography, merges, extraction from raw responses, and the composite reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import geo as W
from weftline.operators import graph as G
from weftline.operators import merges as M
from weftline.operators import patterns as P
from weftline.operators import reports as C
from weftline.plans.pile import PILE, pile, shared_pile
from weftline.plans.registry import ORACLES, Tables, over, register
from weftline.plans.tables import CORE, PAIRS
from weftline.sources import bronze as B
from weftline.sources import gazetteer as Z
from weftline.sources.tables import read_table, write_table
from weftline.streaming import overlaps, streams


def _values(rows: list[tuple]) -> str:
    literal = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)


_COUNTRIES, _NAMES, _CITIES = Z.rows()
_SPLIT = r"\s*[,/|·•→\-–—]\s*|\s{2,}"
TOKENS = (
    "places AS (SELECT id, login, type, location FROM owners WHERE location IS NOT NULL AND location <> '')",
    f"""tokens AS (SELECT id, pos - 1 AS pos, trim(raw) AS token, trim(lower(trim(raw)), '. ') AS key FROM (SELECT id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS pos FROM
 (SELECT id, regexp_split_to_array(location, '{_SPLIT}') AS parts FROM places)) WHERE trim(raw) <> '')""",
)
GEO = (
    *TOKENS,
    f"gc(country, lat, lon, iso) AS (VALUES {_values(_COUNTRIES)})", f"gn(key, country, rank) AS (VALUES {_values(_NAMES)})", f"gt(key, country, lat, lon) AS (VALUES {_values(_CITIES)})",
    "fc AS (SELECT id, arg_min({'key': t.key, 'token': token, 'country': country, 'lat': lat, 'lon': lon}, pos) AS c FROM tokens t JOIN gt ON gt.key = t.key GROUP BY 1)",
    "fn AS (SELECT id, arg_max(country, (pos, -rank)) AS named FROM tokens t JOIN gn ON gn.key = t.key GROUP BY 1)",
    f"""chosen AS (SELECT coalesce(fc.id, fn.id) AS id, c, named, c IS NOT NULL AND NOT (c.key IN ({', '.join(repr(a) for a in Z.AMBIGUOUS)}) AND named IS NOT NULL AND named <> c.country) AS use_city
 FROM fc FULL JOIN fn ON fn.id = fc.id)""",
    """geo AS (SELECT h.id, g.country, CASE WHEN use_city THEN c.token END AS city, CAST(CASE WHEN use_city THEN c.lat ELSE g.lat END AS DOUBLE) AS lat, CAST(CASE WHEN use_city THEN c.lon ELSE g.lon END AS DOUBLE) AS lon
 FROM chosen h JOIN gc g ON g.country = CASE WHEN use_city THEN c.country ELSE named END)""",
    "located AS (SELECT o.id, login, type, g.country, gc.iso, city, g.lat, g.lon FROM owners o JOIN geo g ON g.id = o.id LEFT JOIN gc ON gc.country = g.country)",
)


def _places(t: Tables) -> DataFrame:
    return t.owners.where("location IS NOT NULL AND location <> ''")


def _located(t: Tables) -> DataFrame:
    tables = Z.gazetteer(t.spark)
    return W.located_owners(W.geocode_pending(t.owners, tables), tables)


def _geo(name: str, select: str, more: tuple[str, ...] = (), relations: str = "owners"):
    return register(name, over(relations, select, *GEO, *more))


_geo(
    "w1_owners_per_country",
    "SELECT g.country, g.lat::DOUBLE AS lat, g.lon::DOUBLE AS lon, g.iso, count(l.id) AS n FROM gc g LEFT JOIN located l ON l.country = g.country GROUP BY ALL",
)(lambda t: Z.gazetteer(t.spark)["countries"].join(_located(t).groupBy("country").agg(F.count("id").alias("n")), "country", "left").select("country", "lat", "lon", "iso", F.coalesce("n", F.lit(0)).alias("n")))
register("w2_tokenize_location", over("owners", "SELECT id, pos, token, key FROM tokens", *TOKENS))(lambda t: W.tokenize_location(_places(t), "id", "location"))
_geo("w3_geocode", "SELECT * FROM geo")(lambda t: W.geocode(_places(t), "id", "location", Z.gazetteer(t.spark)))
_geo("w4_geocode_pending", "SELECT o.id, g.country, g.city, CAST(coalesce(o.location, '') <> '' AS BIGINT) AS geo_tried FROM owners o LEFT JOIN geo g ON g.id = o.id")(
    lambda t: W.geocode_pending(t.owners, Z.gazetteer(t.spark)).select("id", "country", "city", "geo_tried")
)
_geo("w5_located_owners", "SELECT * FROM located")(_located)
_geo("w6_repo_geo", "SELECT r.id, l.country, l.city FROM repos r LEFT JOIN located l ON l.login = r.owner_login", relations="owners repos")(
    lambda t: W.attach_repo_geo(t.repos, _located(t)).select("id", "country", "city")
)
_geo("w6_person_geo", "SELECT p.login, l.country, l.city FROM (SELECT DISTINCT owner_login AS login FROM contributions) p LEFT JOIN located l ON l.login = p.login", relations="owners contributions")(
    lambda t: W.attach_person_geo(t.contributions.selectExpr("owner_login AS login").distinct(), _located(t)).select("login", "country", "city")
)
_geo("w7_country_rollup", "SELECT country, count(*) AS n, count_if(city IS NULL)::BIGINT AS country_only FROM located GROUP BY 1")(lambda t: W.country_rollup(_located(t)))
_geo("w8_city_rollup", "SELECT city, country, count(*) AS n, arg_min(lat, id) AS lat, arg_min(lon, id) AS lon FROM located WHERE city IS NOT NULL GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 40")(
    lambda t: W.city_rollup(_located(t), "id")
)
_geo(
    "w9_geo_coverage",
    """SELECT (SELECT count(*) FROM owners) AS total, count(*) AS located, count(DISTINCT country) AS countries, count(DISTINCT (city, country)) FILTER (city IS NOT NULL) AS cities,
count_if(city IS NULL)::BIGINT AS country_only, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM owners), 4) AS pct FROM located""",
)(lambda t: W.geo_coverage(W.geocode_pending(t.owners, Z.gazetteer(t.spark))))
_geo("w10_geo_drilldown", "SELECT r.id, r.stars, l.city FROM repos r JOIN located l ON l.login = r.owner_login WHERE l.country = 'Japan' ORDER BY stars DESC NULLS LAST, r.id LIMIT 60", relations="owners repos")(
    lambda t: W.geo_drilldown(W.attach_repo_geo(t.repos, _located(t)), "Japan", "Tokyo", "stars", "id")
)
_geo("w11_largest_city", "SELECT country, city, n FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, city) AS r FROM (SELECT country, city, count(*) AS n FROM located WHERE city IS NOT NULL GROUP BY 1, 2)) WHERE r = 1")(
    lambda t: W.largest_city(_located(t))
)
#: Two test rings over the plane of (size, retail price / 100): a triangle and a concave pentagon.
_RINGS = {"triangle": ((5, 5), (45, 9.5), (12, 15)), "dart": ((2, 9), (25, 14), (48, 9.3), (30, 20), (25, 11.5))}
_ALL_SEGMENTS = _values([(n, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for n, r in _RINGS.items() for a, b in zip(r, r[1:] + r[:1], strict=True)])


def _polygons(t: Tables) -> DataFrame:
    rings = [(n, [{"x": float(x), "y": float(y)} for x, y in r]) for n, r in _RINGS.items()]
    return t.spark.createDataFrame(rings, "name string, ring array<struct<x: double, y: double>>")


register(
    "w12_point_in_polygon",
    f"""SELECT id, name FROM (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice / 100 AS y FROM part) JOIN (VALUES {_ALL_SEGMENTS}) s(name, x1, y1, x2, y2)
ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1""",
)(lambda t: W.point_in_polygon(t.table("part").selectExpr("p_partkey AS id", "CAST(p_size AS DOUBLE) AS x", "p_retailprice / 100 AS y"), _polygons(t)))
register(
    "p8_co_location",
    pile(
        "SELECT city, country, count(*) AS people, array_to_string(list_sort(list(login)), ',') AS logins FROM (SELECT DISTINCT owner_login FROM links) l JOIN located g ON g.login = l.owner_login WHERE city IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY 3 DESC, 1, 2 LIMIT 40",
        (*PILE, *GEO),
    ),
)(lambda t: P.co_location(shared_pile(t).links, _located(t)))

# merges: the current version lacks every third owner or repository, the increment touches every second
_CUR = "cur AS (SELECT id, login, type, location, enriched FROM owners WHERE id % 3 <> 0)"
_INC = "inc AS (SELECT id, concat(login, '-new') AS login, CAST(NULL AS VARCHAR) AS type, CASE WHEN id % 4 = 0 THEN 'Lima' END AS location, CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END AS enriched FROM owners WHERE id % 2 = 0)"


def _owner_versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    cur = t.owners.where("id % 3 <> 0").select("id", "login", "type", "location", "enriched")
    inc = t.owners.where("id % 2 = 0").selectExpr(
        "id", "concat(login, '-new') AS login", "CAST(NULL AS STRING) AS type", "CASE WHEN id % 4 = 0 THEN 'Lima' END AS location", "CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END AS enriched"
    )
    return cur, inc


register(
    "m1_merge_owners",
    over("owners", """SELECT coalesce(c.id, i.id) AS id, CASE WHEN i.id IS NULL THEN c.login ELSE i.login END AS login, CASE WHEN i.id IS NULL THEN c.type ELSE i.type END AS type,
coalesce(i.location, c.location) AS location, CAST(greatest(c.enriched, i.enriched) AS BIGINT) AS enriched FROM cur c FULL JOIN inc i ON i.id = c.id""", _CUR, _INC),
)(lambda t: M.merge_owners(*_owner_versions(t)))
register(
    "m1_last_per_key",
    over("releases", "SELECT repo_id, max_by(tag, (published_at, tag)) AS tag, max_by(author_login, (published_at, tag)) AS author_login FROM releases GROUP BY 1"),
)(lambda t: M.last_per_key(t.releases.withColumn("seq", F.struct("published_at", "tag")).drop("published_at"), "repo_id", "seq").select("repo_id", "tag", "author_login"))
register(
    "m2_merge_repos",
    over("repos", """SELECT r.id, CASE WHEN r.id % 2 = 0 THEN concat(full_name, '-new') ELSE full_name END AS full_name, CASE WHEN r.id % 2 = 0 THEN NULL ELSE stars END AS stars,
CAST(CASE WHEN r.id % 3 = 0 THEN 0 ELSE detailed END AS BIGINT) AS detailed FROM repos r WHERE r.id % 3 <> 0 OR r.id % 2 = 0"""),
)(
    lambda t: M.merge_repos(
        t.repos.where("id % 3 <> 0").select("id", "full_name", "stars", "detailed"),
        t.repos.where("id % 2 = 0").selectExpr("id", "concat(full_name, '-new') AS full_name", "CAST(NULL AS BIGINT) AS stars", "0 AS detailed"),
    )
)
register("m3_merge_stubs", over("repos", "SELECT id, CASE WHEN id % 3 <> 0 THEN full_name ELSE 'stub' END AS full_name FROM repos WHERE id % 3 <> 0 OR id % 2 = 0"))(
    lambda t: M.merge_stubs(t.repos.where("id % 3 <> 0").select("id", "full_name"), t.repos.where("id % 2 = 0").selectExpr("id", "'stub' AS full_name"))
)
register(
    "m4_replace_children",
    over("repo_languages", "SELECT repo_id, language, bytes FROM repo_languages WHERE repo_id % 2 <> 0 UNION ALL SELECT repo_id, 'New', 1 FROM (SELECT DISTINCT repo_id FROM repo_languages WHERE repo_id % 4 = 0)"),
)(
    lambda t: M.replace_children(
        t.repo_languages, t.repo_languages.where("repo_id % 4 = 0").select("repo_id").distinct().selectExpr("repo_id", "'New' AS language", "1L AS bytes"),
        t.repo_languages.where("repo_id % 2 = 0").select("repo_id"),
    )
)
_geo("m5_merge_geo", "SELECT o.id, g.country, g.lat, CAST(coalesce(o.location, '') <> '' AS BIGINT) AS geo_tried FROM owners o LEFT JOIN geo g ON g.id = o.id")(
    lambda t: M.merge_geo(W.with_geo_columns(t.owners), _places(t).select("id").join(W.geocode(_places(t), "id", "location", Z.gazetteer(t.spark)), "id", "left")).select("id", "country", "lat", "geo_tried")
)


def narrowed(t: Tables) -> Tables:
    """The model with its lines joined to their orders twice in all: once for what counts all of them, once for the few large ones.

    What parts and languages say of all lines is aggregated from one join and written, by part and priority; contributions, releases
    and dependencies are of lines from 47 pieces, which are written; and so are repositories, which all kinds of responses need.
    """
    by_priority = t.fx_link.groupBy("part", "prio").agg(
        F.sum("price").alias("bytes"), F.min("supp").alias("supp"), F.max(F.when(F.col("qty") == 50, F.col("shipdate"))).alias("pushed_at"), F.min("shipdate").alias("created_at")
    )
    parts = G.written(by_priority, "parts")
    given = {
        "fx_link": G.written(t.fx_link.where("qty >= 47").drop("price", "prio"), "links"),
        "fx_part": parts.groupBy("part").agg(F.min("supp").alias("supp"), F.max("pushed_at").alias("pushed_at"), F.min("created_at").alias("created_at")),
        "repo_languages": parts.selectExpr("part AS repo_id", "prio AS language", "bytes"),
    }
    made = Tables(t.spark, t.sf_dir, given)
    return Tables(t.spark, t.sf_dir, given | {"repos": G.written(made.repos, "repos")})


def responses(t: Tables) -> DataFrame:
    """Raw responses made from the model's own tables: (url, repo_id, body, fetched_at), each twice, the older with other content.

    What several kinds need is written once (``narrowed``); both versions of a response come from one row.
    """
    t = narrowed(t)
    url = lambda tail: F.concat(F.lit("/repos/"), F.regexp_replace("full_name", "#", ""), F.lit(tail)).alias("url")
    names = t.repos.select(F.col("id").alias("repo_id"), "full_name")
    owner = F.struct(F.hash("owner_login").cast("long").alias("id"), F.col("owner_login").alias("login"), F.lit("Organization").alias("type"))
    topics = t.repo_topics.groupBy("repo_id").agg(F.array_sort(F.collect_list("topic")).alias("topics"))
    repos = t.repos.withColumnRenamed("id", "repo_id").join(topics, "repo_id").select(
        url(""), "repo_id", F.to_json(F.struct(
            F.col("repo_id").alias("id"), "full_name", owner.alias("owner"), F.col("primary_language").alias("language"), F.struct(F.col("license").alias("spdx_id")).alias("license"),
            F.col("stars").alias("stargazers_count"), F.col("forks").alias("forks_count"), "open_issues", "size", F.when(F.col("is_fork"), True).alias("fork"), "archived", "topics",
        )).alias("body"),
    )
    joined = lambda df, entry, tail: df.join(names, "repo_id").groupBy("repo_id", "full_name").agg(F.collect_list(entry).alias("j")).select(url(tail), "repo_id", F.to_json("j").alias("body"))
    contribs = joined(t.contributions, F.struct(F.col("owner_login").alias("login"), "contributions"), "/contributors")
    releases = joined(t.releases, F.struct(F.crc32(F.col("tag")).alias("id"), F.when(F.col("repo_id") % 5 > 0, F.col("tag")).alias("tag_name"), F.struct(F.col("author_login").alias("login")).alias("author"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at")), "/releases")
    languages = t.repo_languages.join(names, "repo_id").groupBy("repo_id", "full_name").agg(F.map_from_entries(F.collect_list(F.struct("language", "bytes"))).alias("j")).select(url("/languages"), "repo_id", F.to_json("j").alias("body"))
    package = F.struct(F.col("package").alias("name"), F.col("version").alias("versionInfo"), F.array(F.struct(F.lit("https://x").alias("referenceLocator")), F.struct(F.concat(F.lit("pkg:"), "ecosystem", F.lit("/x")).alias("referenceLocator"))).alias("externalRefs"))
    deps = t.dependencies.join(names, "repo_id").groupBy("repo_id", "full_name").agg(F.struct(F.collect_list(package).alias("packages")).alias("sbom")).select(url("/dependency-graph/sbom"), "repo_id", F.to_json(F.struct("sbom")).alias("body"))
    page = t.repos.groupBy((F.floor((F.col("id") - 1) / 100) * 100).alias("page")).agg(F.collect_list(F.struct("id", "full_name", owner.alias("owner"), F.col("is_fork").alias("fork"))).alias("j")).select(
        F.concat(F.lit("/repositories?since="), F.col("page").cast("string")).alias("url"), F.lit(None).cast("long").alias("repo_id"), F.to_json("j").alias("body")
    )
    new = repos.unionByName(contribs).unionByName(releases).unionByName(languages).unionByName(deps).unionByName(page)
    at = lambda s: F.lit(s).cast("timestamp").alias("fetched_at")
    versions = F.array(F.struct("body", at("2024-01-02 00:00:00")), F.struct(F.lit("{}").alias("body"), at("2024-01-01 00:00:00")))
    return new.select("url", "repo_id", F.explode(versions).alias("v")).select("url", "repo_id", "v.body", "v.fetched_at")


def _latest(t: Tables) -> DataFrame:
    return B.latest_response(responses(t))


_MODEL = "owners repos contributions releases repo_topics repo_languages dependencies"
_URLS = """SELECT url, repo_id, CAST('2024-01-02' AS TIMESTAMP) AS fetched_at, true AS whole FROM (
SELECT '/repos/' || replace(full_name, '#', '') || tail AS url, r.id AS repo_id FROM repos r JOIN (
 SELECT repo_id, '' AS tail FROM repo_topics UNION SELECT repo_id, '/contributors' FROM contributions UNION SELECT repo_id, '/releases' FROM releases
 UNION SELECT repo_id, '/languages' FROM repo_languages UNION SELECT repo_id, '/dependency-graph/sbom' FROM dependencies) p ON p.repo_id = r.id
UNION ALL SELECT DISTINCT '/repositories?since=' || CAST(floor((id - 1) / 100)::BIGINT * 100 AS VARCHAR), CAST(NULL AS BIGINT) FROM repos)"""
register("s2_latest_response", over(_MODEL, _URLS))(lambda t: _latest(t).select("url", "repo_id", "fetched_at", (F.col("body") != "{}").alias("whole")))
register(
    "s3_extract_repos",
    over(_MODEL, """SELECT r.id, full_name, owner_login, primary_language, license, stars, forks, CAST(NULL AS BIGINT) AS watchers, is_fork, archived FROM repos r WHERE id IN (SELECT repo_id FROM repo_topics)"""),
)(lambda t: B.extract_repos(_latest(t)).select("id", "full_name", "owner_login", "primary_language", "license", "stars", "forks", "watchers", "is_fork", "archived"))
register("s4_extract_owners", over(_MODEL, "SELECT owner_login AS login, 'Organization' AS type, 0::BIGINT AS enriched FROM repos WHERE id IN (SELECT repo_id FROM repo_topics)"))(
    lambda t: B.extract_owners(_latest(t)).select("login", "type", "enriched")
)
register("s4_full_profiles", over("owners", "SELECT id, login, type, location, 1::BIGINT AS enriched FROM owners"))(
    lambda t: B.extract_owners(
        t.owners.select(F.concat(F.lit("/users/"), "login").alias("url"), F.to_json(F.struct("id", "login", "type", "location")).alias("body"), F.lit("2024-01-02").cast("timestamp").alias("fetched_at"))
    ).select("id", "login", "type", "location", "enriched")
)
register("s5_extract_topics", over(_MODEL, "SELECT repo_id, topic FROM repo_topics WHERE repo_id IN (SELECT id FROM repos)"))(lambda t: B.extract_topics(_latest(t)))
register("s6_extract_languages", over(_MODEL, "SELECT repo_id, language, bytes FROM repo_languages WHERE repo_id IN (SELECT id FROM repos)"))(lambda t: B.extract_languages(_latest(t)))
register("s7_extract_contributions", over(_MODEL, "SELECT repo_id, owner_login, contributions FROM contributions WHERE repo_id IN (SELECT id FROM repos)"))(lambda t: B.extract_contributions(_latest(t)))
register("s8_extract_releases", over(_MODEL, "SELECT repo_id, tag, author_login FROM releases WHERE repo_id IN (SELECT id FROM repos) AND repo_id % 5 > 0"))(
    lambda t: B.extract_releases(_latest(t)).where("tag NOT LIKE '\\\\_id%'").select("repo_id", "tag", "author_login")
)
register("s8_release_tag_fallback", over(_MODEL, "SELECT repo_id, count(*) AS n FROM releases WHERE repo_id IN (SELECT id FROM repos) AND repo_id % 5 = 0 GROUP BY 1"))(
    lambda t: B.extract_releases(_latest(t)).where(F.col("tag").startswith("_id")).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
)
register("s9_extract_dependencies", over(_MODEL, "SELECT repo_id, package, version, ecosystem FROM dependencies WHERE repo_id IN (SELECT id FROM repos)"))(lambda t: B.extract_dependencies(_latest(t)))
register("s10_extract_stubs", over(_MODEL, "SELECT id, full_name, owner_login, is_fork, 0::BIGINT AS detailed FROM repos"))(
    lambda t: B.extract_stubs(_latest(t))[0].select("id", "full_name", "owner_login", "is_fork", "detailed")
)
register("s10_stub_owners", over(_MODEL, "SELECT owner_login AS login, 'Organization' AS type, 0::BIGINT AS enriched FROM repos"))(
    lambda t: B.extract_stubs(_latest(t))[1].select("login", "type", "enriched")
)


def _older_files(t: Tables) -> DataFrame:
    """Repositories as older files hold them, without the columns that came later, read with the fixed schema."""
    folder = G.passing_folder(t.spark, "older")
    write_table(t.repos.select("id", "full_name", "owner_login", "stars", "is_fork"), f"{folder}/repos.parquet")
    return read_table(t.spark, folder, "repos")


register(
    "s1_read_table",
    over("repos", "SELECT id, full_name, stars, is_fork, CASE WHEN stars IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS detailed, 0::BIGINT AS attempts, CAST(NULL AS BIGINT) AS parent_id FROM repos"),
)(lambda t: _older_files(t).select("id", "full_name", "stars", "is_fork", "detailed", "attempts", "parent_id"))


def _ingested(t: Tables, name: str) -> DataFrame:
    """A table as the stream of all raw responses leaves it."""
    folder, made = G.passing_folder(t.spark, "ingest"), responses(t)
    write_table(made, f"{folder}/in")
    stream = t.spark.readStream.schema(made.schema).parquet(f"{folder}/in")
    streams.stream_ingest(stream, f"{folder}/out", f"{folder}/state", availableNow=True).awaitTermination()
    return streams.Tables(f"{folder}/out").table(t.spark, name)


register(
    "t5_stream_ingest",
    over(_MODEL, """SELECT id, full_name, CASE WHEN full_ THEN stars END AS stars, full_::BIGINT AS detailed FROM (SELECT *, id IN (SELECT repo_id FROM repo_topics) AS full_ FROM repos)"""),
)(lambda t: _ingested(t, "repos").select("id", "full_name", "stars", "detailed"))
register("t5_stream_contributions", ORACLES["s7_extract_contributions"])(lambda t: _ingested(t, "contributions").select("repo_id", "owner_login", "contributions"))


def crawled(t: Tables, contributions: DataFrame, day: int, *, repos: bool = True) -> DataFrame:
    """Contributors of repositories as a crawler stores them: whole URLs, two pages, ids of people, and no id of the repository."""
    host = F.lit("https://api.example.org/repos/")
    named = t.repos.select(F.col("id").alias("repo_id"), F.regexp_replace("full_name", "#", "").alias("full_name"))
    people = t.owners.select(F.col("login").alias("owner_login"), F.col("id").alias("person"), "type")
    entry = F.struct(F.col("person").alias("id"), F.col("owner_login").alias("login"), "type", "contributions")
    page = (2 - F.col("contributions") % 2).cast("string").alias("page")
    lists = contributions.join(named, "repo_id").join(people, "owner_login").groupBy("full_name", page).agg(F.to_json(F.collect_list(entry)).alias("body"))
    rows = lists.select(F.concat(host, "full_name", F.lit("/contributors?per_page=100&page="), "page").alias("url"), "body")
    if repos:
        rows = rows.unionByName(named.select(F.concat(host, "full_name").alias("url"), F.to_json(F.struct(F.col("repo_id").alias("id"), "full_name")).alias("body")))
    none = lambda kind, c: F.lit(None).cast(kind).alias(c)
    return rows.select("url", none("string", "etag"), none("string", "last_modified"), F.lit(200).cast("long").alias("status"), "body", F.timestamp_seconds(F.lit(86400 * day)).alias("fetched_at"))


def _cached(t: Tables) -> DataFrame:
    """The cache of a crawl, read with its fixed schema."""
    folder = G.passing_folder(t.spark, "crawl")
    write_table(crawled(t, t.contributions, 1), f"{folder}/http_cache.parquet")
    return read_table(t.spark, folder, "http_cache")


_PEOPLE = "SELECT repo_id, owner_login, contributions FROM contributions WHERE repo_id IN (SELECT id FROM repos)"
register("s7_crawled_contributions", over("repos owners contributions", _PEOPLE))(lambda t: B.extract_contributions(_cached(t)))
register(
    "s4_contributor_owners",
    over("repos owners contributions", "SELECT o.id, o.login, o.type, 0::BIGINT AS enriched FROM owners o WHERE o.login IN (SELECT owner_login FROM contributions WHERE repo_id IN (SELECT id FROM repos))"),
)(lambda t: B.extract_owners(_cached(t)).select("id", "login", "type", "enriched").distinct())


def _logged(t: Tables) -> DataFrame:
    """Contributions after four batches that overlap: some lists come broken in the third, some empty in the fourth."""
    folder, model = G.passing_folder(t.spark, "log"), t
    t = Tables(model.spark, model.sf_dir)
    t._made |= {name: G.written(getattr(model, name), name) for name in ("repos", "contributions", "owners")}  # every batch reads them
    tables = streams.Tables(f"{folder}/tables", fan=2)
    broken, emptied = F.col("id") % 5 == 0, F.col("id") % 7 == 0
    ids = t.repos.select("id", F.regexp_replace("full_name", "#", "").alias("full_name"))
    for k in range(4):
        some = t.contributions.where((F.col("repo_id") + k) % 3 != 0).withColumn("contributions", F.col("contributions") + 1000 * k)
        rows = crawled(t, some, 1 + k, repos=k == 0)
        name_of = F.regexp_extract("url", r"/repos/([^/]+/[^/]+)/contributors", 1)
        if k == 2:
            bad = ids.where(broken).select(F.col("full_name").alias("bad"))
            rows = rows.join(bad, name_of == F.col("bad"), "left").withColumn("body", F.when(F.col("bad").isNull(), F.col("body")).otherwise("<html>502</html>")).drop("bad")
        if k == 3:
            gone = ids.where(emptied & ((F.col("id") + k) % 3 != 0))
            rows = rows.join(gone.select(F.col("full_name").alias("gone")), name_of == F.col("gone"), "left_anti")
            empty = gone.select(F.concat(F.lit("https://api.example.org/repos/"), "full_name", F.lit("/contributors?per_page=100&page=1")).alias("url"), F.lit("[]").alias("body"), F.timestamp_seconds(F.lit(86400 * 4)).alias("fetched_at"))
            rows = rows.unionByName(empty, allowMissingColumns=True)
        write_table(rows, f"{folder}/in{k}")
        streams.ingest_batch(t.spark.read.schema(rows.schema).parquet(f"{folder}/in{k}"), k, tables)
    return tables.table(t.spark, "contributions")


register(
    "t5_log_contributions",
    over("repos owners contributions", """SELECT c.repo_id, owner_login, contributions + 1000 * k AS contributions FROM contributions c JOIN (
 SELECT id, max(k) AS k FROM repos CROSS JOIN range(4) r(k) WHERE (id + k) % 3 <> 0 AND NOT (k = 2 AND id % 5 = 0) GROUP BY id) l ON l.id = c.repo_id WHERE NOT (k = 3 AND c.repo_id % 7 = 0)"""),
)(lambda t: _logged(t).select("repo_id", "owner_login", "contributions"))


def _kept_edges(t: Tables) -> DataFrame:
    """Overlap edges after three batches of changes: links come, go, come again. They are too many for a log, so links are kept and edges told from them."""
    kept = overlaps.Overlaps(G.passing_folder(t.spark, "overlaps"), keep_edges=False)
    for k, (came, gone) in enumerate((("repo_id % 4 <> 0", "false"), ("repo_id % 4 = 0", "repo_id % 4 = 1"), ("repo_id % 8 = 1", "repo_id % 16 = 2"))):
        rows = t.contributions.withColumn("change", F.expr(f"CASE WHEN {came} THEN 1 WHEN {gone} THEN -1 END")).where("change IS NOT NULL")
        kept.apply(rows.select("repo_id", "owner_login", "change"), k)
    return kept.edges(t.spark)


register(
    "g1_delta_edges",
    over("contributions", PAIRS.replace("FROM contributions a JOIN contributions b", "FROM held a JOIN held b"), "held AS (SELECT * FROM contributions WHERE (repo_id % 4 <> 1 OR repo_id % 8 = 1) AND repo_id % 16 <> 2)"),
)(_kept_edges)


def _streamed_places(t: Tables) -> DataFrame:
    folder, places = G.passing_folder(t.spark, "places"), _places(t).select("id", "location")
    write_table(places, f"{folder}/in")
    stream = t.spark.readStream.schema(places.schema).parquet(f"{folder}/in")
    streams.stream_geocode(stream, Z.gazetteer(t.spark), f"{folder}/out", f"{folder}/state", availableNow=True).awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").drop("batch")


_geo("t6_stream_geocode", "SELECT * FROM geo")(_streamed_places)
_FLAGS = {"Japan": "\U0001f1ef\U0001f1f5", "Germany": "\U0001f1e9\U0001f1ea", "Spain": "\U0001f1ea\U0001f1f8"}


def _flagged(t: Tables) -> DataFrame:
    """Places with a flag before or behind them."""
    japan, germany, spain = (F.lit(f) for f in _FLAGS.values())
    text = F.when(F.col("id") % 3 == 0, F.concat("location", F.lit(" "), japan)).when(F.col("id") % 3 == 1, F.concat(germany, F.lit(" "), "location")).otherwise(F.concat(spain, F.lit(", "), "location"))
    return _places(t).select("id", text.alias("location"))


_geo(
    "w3_geocode_flags",
    """SELECT p.id, g.country, CASE WHEN c.country = g.country THEN c.token END AS city, CAST(CASE WHEN c.country = g.country THEN c.lat ELSE g.lat END AS DOUBLE) AS lat,
CAST(CASE WHEN c.country = g.country THEN c.lon ELSE g.lon END AS DOUBLE) AS lon FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'Japan' WHEN 1 THEN 'Germany' ELSE 'Spain' END AS country FROM places) p
JOIN gc g ON g.country = p.country LEFT JOIN fc ON fc.id = p.id""",
)(lambda t: W.geocode(_flagged(t), "id", "location", Z.gazetteer(t.spark)))
register(
    "s11_write_table",
    over("repos", "SELECT id, full_name, stars FROM repos WHERE stars IS NOT NULL"),
)(lambda t: C.written(t.repos.where("stars IS NOT NULL").select("id", "full_name", "stars")))

_CHILD = {"languages": ("repo_languages", "repo_id, language, bytes"), "topics": ("repo_topics", "repo_id, topic"), "releases": ("releases", "repo_id, tag, author_login"),
          "dependencies": ("dependencies", "repo_id, package, version, ecosystem"), "links": ("contributions", "repo_id, owner_login, contributions")}
for _part, _same in (("counts", "a5_summary_counts"), ("languages", "a1_language_shares"), ("categories", "a2_category_shares"), ("top", "a3_top_repos"), ("cross_project", "a4_cross_project")):
    register(f"c1_summary_{_part}", ORACLES[_same])(lambda t, part=_part: C.summary(t.repos, t.owners, t.contributions, t.repo_languages, t.repo_topics)[part])
for _part, _same in (("people", "a6_people"), ("universe", "a7_universe_counts"), ("owners", "w5_located_owners")):
    register(f"c2_intel_{_part}", ORACLES[_same])(lambda t, part=_part: C.intel(t, Z.gazetteer(t.spark))[part])
for _part, (_table, _columns) in _CHILD.items():
    register(f"c2_intel_{_part}", over(_MODEL, f"SELECT {_columns} FROM {_table} WHERE repo_id IN (SELECT id FROM core)", CORE))(
        lambda t, part=_part, columns=_columns: C.intel(t, Z.gazetteer(t.spark))[part].select(*columns.split(", "))
    )
register("c2_intel_repos", over(_MODEL, "SELECT id, full_name, owner_login, stars, owner_type FROM core", CORE))(
    lambda t: C.intel(t, Z.gazetteer(t.spark))["repos"].select("id", "full_name", "owner_login", "stars", "owner_type")
)
