"""DuckDB statements for the rows of those training-data queries that SQL can express."""

from __future__ import annotations

from weftline.llm import licenses

EMBEDDINGS = """
WITH RECURSIVE named AS (SELECT row_number() OVER () AS n, vec_id, label, CAST(CAST(embedding AS FLOAT[]) AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT * FROM named WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.n AS u, b.n AS v, a.vec_id AS ui, b.vec_id AS vi FROM usable a JOIN usable b ON a.label = b.label AND a.n <> b.n AND len(a.e) = len(b.e)
 WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach(n, least) AS (SELECT n, vec_id FROM named UNION SELECT l.v, r.least FROM reach r JOIN links l ON l.u = r.n WHERE r.least < l.vi)
SELECT m.vec_id, (SELECT count(*) FROM links l WHERE l.u = m.n) AS n_links, min(r.least) AS component_id, m.vec_id = min(r.least) AS kept
FROM named m JOIN reach r ON r.n = m.n GROUP BY m.n, m.vec_id"""

SUBSTRINGS = r"""
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, coalesce(doc_id, 9223372036854775807) AS d, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT n, d, w, unnest(range(1, len(w) - 18)) AS i FROM texts WHERE len(w) >= 20),
windows AS (SELECT n, d, i, array_to_string(w[i : i + 19], ' ') AS t FROM starts),
first AS (SELECT t, min((d, i)) AS place FROM windows GROUP BY t HAVING count(*) > 1),
gone AS (SELECT DISTINCT n, unnest(range(i, i + 20)) AS p FROM windows JOIN first USING (t) WHERE (d, i) > place),
kept AS (SELECT n, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS k FROM (SELECT n, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM texts) WHERE (n, p) NOT IN (SELECT n, p FROM gone) GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(k, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (n)"""

ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(page_id, 9223372036854775807) AS id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(id) AS least FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN least < id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN least < id THEN least END AS refers_to FROM p LEFT JOIN f USING (payload_digest)"""


#: Densely: every kept term in every group.
DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT n, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT n) >= 3),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY lang),
own AS (SELECT lang, source, sum(c) AS own_n FROM c GROUP BY ALL),
g AS (SELECT lang, source, coalesce(own_n, 0) AS own_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN own USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, CAST(1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (own_n + v) AS HUGEINT) AS p, CAST(1 + (1000000000::HUGEINT * (total + 1)) // (lang_n + v) AS HUGEINT) AS q
 FROM g JOIN k USING (lang) JOIN sizes USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""


def clusters(rounds: int = 3, k: int = 16) -> str:
    """Lloyd rounds unrolled; products of these small whole numbers are exact in doubles."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""d{r} AS (SELECT n, k, list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, c.v) + list_dot_product(c.v, c.v) AS d FROM kept x CROSS JOIN c{r} c),
a{r} AS (SELECT n, k, CAST(d AS BIGINT) AS distance FROM d{r} QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, k) = 1)""")
        if r < rounds:
            parts.append(f"""m{r} AS (SELECT k, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS m FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM kept JOIN a{r} USING (n)) GROUP BY ALL),
c{r + 1} AS (SELECT c.k, coalesce(new.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT k, list(CAST((s - ((s % m) + m) % m) // m AS DOUBLE) ORDER BY p) AS v FROM m{r} GROUP BY k) new USING (k))""")
    steps = ",\n".join(parts)
    return f"""
WITH kept AS (SELECT row_number() OVER () AS n, vec_id, e, list_transform(e, lambda x: floor(64 * x)) AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
 WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS k, v FROM kept QUALIFY k < {k}),
{steps},
sizes AS (SELECT k, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, distance, cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(list_transform(c.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (n) JOIN c{rounds} c USING (k) JOIN sizes USING (k)"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def license_scan() -> str:
    """Diagonal voting by words themselves: base phrases, then notices and texts, of three words a gram or all a short phrase has."""
    rows = [*((b, a, "true") for a, b in licenses.BASE), *((a, b, "false") for a, b in licenses.TEMPLATES)]
    values = ", ".join(f"({n}, {_text(label)}, {base}, {_text(text)})" for n, (label, text, base) in enumerate(rows))
    words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    k, slack, cover = licenses.K, licenses.SLACK, licenses.COVER
    return f"""
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, {words("text")} AS w FROM documents),
templates AS (SELECT template, label, is_base, w, len(w) AS m, least({k}, len(w)) AS k FROM (SELECT template, label, is_base, {words("body")} AS w FROM (VALUES {values}) v(template, label, is_base, body))),
own AS (SELECT template, label, is_base, m, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, m - k + 2)) AS i FROM templates)),
grams AS (SELECT n, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT n, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM texts, (SELECT DISTINCT k FROM templates))),
hits AS (SELECT n, template, label, is_base, m, o.k, o.i AS t, x.i - o.i AS diagonal FROM grams x JOIN own o ON o.g = x.g AND o.k = x.k),
steps AS (SELECT DISTINCT n, template, is_base, diagonal FROM hits),
gaps AS (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY n, template ORDER BY diagonal) AS gap FROM steps),
clusters AS (SELECT n, template, diagonal, sum(CASE WHEN is_base OR gap IS NULL OR gap > {slack} THEN 1 ELSE 0 END) OVER (PARTITION BY n, template ORDER BY diagonal) AS c FROM gaps),
covered AS (SELECT n, template, label, is_base, m, c, min(diagonal) AS start, min(t) AS t, list(DISTINCT t + x) AS p FROM (SELECT *, unnest(range(k)) AS x FROM hits JOIN clusters USING (n, template, diagonal)) GROUP BY ALL),
spans AS (SELECT *, len(p)::DOUBLE / m AS coverage FROM (SELECT n, template, label, is_base, m, c, min(start) AS start, list_distinct(flatten(list(p))) AS p FROM covered GROUP BY ALL)),
judged AS (SELECT *, is_base AND coverage = 1 AS whole, max(CASE WHEN NOT is_base THEN coverage END) OVER (PARTITION BY n, start) AS best FROM spans),
good AS (SELECT *, whole OR NOT is_base AND coverage >= {cover} AND coverage = best AS good FROM judged WHERE whole OR NOT is_base),
found AS (SELECT n, count_if(whole)::BIGINT AS n_base, min(start) FILTER (whole) AS first_word, max(start) FILTER (whole) AS last_word,
 array_to_string(list_sort(list(DISTINCT label) FILTER (whole)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label) FILTER (good)), ',') AS labels, max(coverage) AS score FROM good GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM texts LEFT JOIN found USING (n)"""


ORACLE_SQL: dict[str, str] = {
    "op3_embedding_dedup": EMBEDDINGS, "op6_license_scan": license_scan(), "op7_substring_dedup": SUBSTRINGS, "op8_warc": ARCHIVES,
    "op11_source_divergence": DIVERGENCE, "op13_centroids": clusters(),
}
