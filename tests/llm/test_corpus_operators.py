"""Source divergence, sharding and centroid clustering against brute-force versions."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from weftline.llm import centroids, divergence, html_text, quality_classifier, quality_rules, sharding

LONG_TEXT = "Zebra " + "ab-Cd é " * 300_000


def brute_audit(rows):
    """(lang, source, part, item) -> (value, rank), densely."""
    counts, docs, groups = defaultdict(Counter), defaultdict(set), defaultdict(set)
    for n, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            term = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in term)
            counts[lang, source][term] += 1
            docs[lang, term].add(n)
    out = {}
    for lang, sources in groups.items():
        kept = sorted(t for (k, t), d in docs.items() if k == lang and len(d) >= 3)
        p = lambda n, total: 1 + 10**9 * (n + 1) // (total + len(kept))  # noqa: B023,E731
        own = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        for s in sources:
            pairs = [(-sum((p(counts[lang, s][t], own[s]) - (q := p(counts[lang, o][t], own[o]))) ** 2 // q for t in kept), o.encode()) for o in sources if o != s]
            terms = []
            for t in kept:
                mine, q = p(counts[lang, s][t], own[s]), p(sum(counts[lang, o][t] for o in sources), sum(own.values()))
                if counts[lang, s][t] and mine > q:
                    terms.append((-((mine - q) ** 2 // q), t.encode()))
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                out |= {(lang, s, part, item.decode()): (-v, r) for r, (v, item) in enumerate(found, 1)}
    return out


def audited(frame, **sizes):
    return {(r.lang, r.source, r.part, r.item): (r.value, r.rank) for r in divergence.audit(frame, **sizes).collect()}


@pytest.mark.parametrize("sizes", [{}, {"block": 40, "segment": 3}])
def test_audit_against_a_dense_one(spark, sizes):
    rng = random.Random(5)
    words = ["".join(rng.choice("abéßЖ中Z") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "ü", "zz", None]), " ".join(rng.choices(words, k=rng.randint(0, 40)))) for _ in range(90)]
    rows += [("en", "a", None), ("en", "empty", ""), ("xx", "alone", "one two"), ("yy", "p", "few words"), ("yy", "q", "1 2 3"), ("en", "a", LONG_TEXT), ("en", "b", "ab cd"), ("a\0b", "s", "k k k"), *[("en", "twin", "same text")] * 40]
    frame = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS term", "'x' AS item", "2 AS value").repartition(5)
    assert audited(frame, **sizes) == brute_audit(rows)
    assert divergence.audit(frame.limit(0)).count() == 0


def test_terms_of_a_text_do_not_depend_on_its_cuts():
    for text in (b"", b"Abc", b"a b", b"abcdef ghi j--K \xc3\xa9t\xc3\xa9", b"x" * 50, b" " * 9 + b"q"):
        whole = re.findall(rb"[a-z\x80-\xff]+", text.lower())
        for size in range(1, 12):
            assert [t for some in divergence.terms(text, size) for t in some] == whole


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def brute_shards(rows, shards=16, rounds=12):
    """shard -> (doc_id, text) sorted, by the same rounds with lists."""
    name = lambda t: signed(xxhash.xxh64_intdigest(struct.pack("<q", len(t)), xxhash.xxh64_intdigest(t, 42)))
    texts = defaultdict(list)
    for doc, text in rows:
        texts[name((text or "").encode())].append((doc is not None, doc or 0, text or ""))
    linked = {k: sorted(v) for k, v in sorted(texts.items()) if len(v) > 1}
    even = lambda n: [n // shards + (s < n % shards) for s in range(shards)]
    capacity, at, pieces = even(len(rows)), 0, {}
    for k, v in linked.items():
        pieces[k] = Counter((at + i) % shards for i in range(len(v)))
        at += len(v)
    loads, closed = even(at), set()
    weight = lambda k, s: (pieces[k][s], signed(xxhash.xxh64_intdigest(struct.pack("<i", s), xxhash.xxh64_intdigest(struct.pack("<q", k), 42))))
    for _ in range(rounds):
        moves = []
        for k, held in pieces.items():
            goals = [(*weight(k, s), s) for s in held if s not in closed]
            if goals:
                moves += [(n - max(goals)[0], k, s, max(goals)[2], n) for s, n in held.items() if weight(k, s) < max(goals)[:2]]
        wanted = Counter()
        for _, _, s, goal, n in moves:
            wanted[s, goal] += n
        granted = sharding.quotas(dict(wanted), loads, capacity)
        left = Counter(granted)
        for _, k, s, goal, n in sorted(moves):
            taken = min(n, left[s, goal])
            left[s, goal] -= taken
            pieces[k] = +Counter({**pieces[k], s: pieces[k][s] - taken, goal: pieces[k][goal] + taken})
        for (i, j), n in granted.items():
            loads[i] -= n
            loads[j] += n
        coming = lambda of, j: sum(n for (_, to), n in of.items() if to == j)
        full = {j for _, j in wanted if 2 * coming(granted, j) < coming(wanted, j)}
        if not wanted or not full and granted == dict(wanted):
            break
        closed |= full
    out = defaultdict(list)
    for k, held in pieces.items():
        docs = iter(linked[k])
        for s in sorted(held):
            out[s] += [next(docs)[1:] for _ in range(held[s])]
    single = iter(sorted((k, v[0]) for k, v in texts.items() if len(v) == 1))
    for s in range(shards):
        out[s] += [next(single)[1][1:] for _ in range(capacity[s] - loads[s])]
    return {s: sorted(v) for s, v in out.items() if v}


def check_shards(spark, rows, shards=16):
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS shard", "0 AS size", "1 AS row", "'p' AS part").repartition(6)
    got = sharding.shard(frame, shards).collect()
    assert len(got) == len(rows)
    held = defaultdict(list)
    for r in got:
        held[r.shard].append(r)
        assert r.law == "rows" and r.grown_shard is None
    sizes = [len(held[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(r.slot for r in v) == list(range(len(v))) for v in held.values())
    true = {(d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())): t or "" for d, t in rows}
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    return {s: sorted((r.doc_id or 0, true[r.doc_id or 0, r["size"], r.text_crc32]) for r in v) for s, v in held.items()}


def test_shards_against_the_same_rounds_with_lists(spark):
    rng = random.Random(8)
    texts = [f"text {k} é" * rng.randint(1, 4) for k in range(60)]
    for rows in (
        [(k, rng.choice(texts)) for k in range(200)] + [(1000 + k, f"own {k}") for k in range(37)],
        [(k, "hot") for k in range(90)] + [(100 + k, f"pair {k // 2}") for k in range(140)] + [(None, None), (7, ""), (None, "x")],
    ):
        assert check_shards(spark, rows) == brute_shards(rows)


def test_texts_that_fit_lie_in_one_shard_and_the_hot_one_in_few(spark):
    rows = [(k, "hot") for k in range(200)] + [(1000 + k, f"t{k // 3}") for k in range(150)] + [(2000 + k, f"own {k}") for k in range(290)]
    got = check_shards(spark, rows)
    where = defaultdict(set)
    for s, docs in got.items():
        for _, text in docs:
            where[text].add(s)
    assert len(where["hot"]) <= 8  # 5 would hold it all
    assert sum(len(where[f"t{k}"]) > 1 for k in range(50)) <= 5


def test_shards_of_few_equal_or_no_rows(spark):
    assert sum(map(len, check_shards(spark, [(1, "a"), (1, "a"), (2, None)]).values())) == 3
    check_shards(spark, [(None, "same")] * 50)
    check_shards(spark, [(None, None)] * 33)
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_quotas_keep_every_shard_within_its_capacity():
    rng = random.Random(3)
    for _ in range(200):
        k = rng.randint(2, 6)
        capacity = [rng.randint(0, 50) for _ in range(k)]
        loads = [rng.randint(0, c) for c in capacity]
        wanted = {(i, j): rng.randint(1, 40) for i in range(k) for j in range(k) if i != j and rng.random() < 0.6}
        granted = sharding.quotas(wanted, loads, capacity)
        after = [loads[s] + sum(n for (_, j), n in granted.items() if j == s) - sum(n for (i, _), n in granted.items() if i == s) for s in range(k)]
        assert all(0 <= granted[f] <= wanted[f] for f in wanted) and all(a <= c for a, c in zip(after, capacity, strict=True))


def brute_clusters(rows, clusters, rounds, dims, scale):
    def ok(v):
        return v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, [math.floor(scale * x) if math.isfinite(scale * x) else scale * int(x) for x in v]) for i, v in rows if ok(v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [v for _, v in sorted(kept, key=key)[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        near = [min((far(v, c), k) for k, c in enumerate(centres)) for _, v in kept]
        for k in range(len(centres)) if r < rounds else ():
            if own := [v for (_, v), (_, n) in zip(kept, near, strict=True) if n == k]:
                centres[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    top = (1 << 63) - 1
    inertia = Counter()
    for d, k in near:
        inertia[k] += min(d, top)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, k, min(d, top), min(inertia[k], top), min(sum(inertia.values()), top), sha[k]) for (i, _), (d, k) in zip(kept, near, strict=True))


@pytest.mark.parametrize("huge", [False, True])
def test_clusters_against_brute_force(spark, huge):
    rng = random.Random(11)
    rows = [(k, [rng.gauss(k % 5, 1.0) for _ in range(10)]) for k in range(150)]
    rows += [(7, rows[7][1]), (8, [1.5] * 10), (None, [0.25] * 10), (200, None), (201, [1.0] * 9), (202, [1.0] * 9 + [None]), (203, [float("nan")] * 10), (204, [float("inf")] * 10), (205, [-0.01] * 10)]
    if huge:
        rows += [(300, [1e300] * 10), (301, [-3.5e12] * 10), (302, [1.7e308] + [0.0] * 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS cluster", "1 AS chunk", "2 AS label").repartition(3)
    got = Counter(map(tuple, centroids.cluster(frame, clusters=6, rounds=3, dims=10, scale=64, columns=4, chunk=16).collect()))
    assert got == brute_clusters(rows, 6, 3, 10, 64)


def test_fewer_vectors_than_clusters_and_none(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None)], "vec_id long, embedding array<float>")
    assert Counter(map(tuple, centroids.cluster(frame, dims=2).collect())) == brute_clusters([(1, [1.0, 2.0]), (1, [1.0, 2.0])], 16, 3, 2, 64)
    assert centroids.cluster(frame.limit(0), dims=2).collect() == [] and centroids.cluster(frame).columns == centroids.cluster(frame, dims=2).columns


@pytest.mark.parametrize("bound", [1, 30])
def test_a_scorer_is_fitted_whatever_rows_repeat(spark, bound):
    good = "the cat and the dog are in a house with an old tree that stands by the river for years as it was. " * 3
    rows = spark.range(30_000).selectExpr("7L AS doc_id", f"'{good}' AS text", "'x' AS votes", "1 AS n")
    out = quality_classifier.classify(rows, bound=bound)
    assert out.distinct().count() == 1 and out.count() == 30_000
    some = rows.limit(40).unionByName(spark.createDataFrame([(None, None, "", 0), (8, "", "", 0), (9, "%$ #$ %% $$", "", 0)], "doc_id long, text string, votes string, n int"))
    drawn = quality_classifier.training_rows(some, 43, bound).collect()
    assert 1 <= len(drawn) <= bound and sum(r.n for r in drawn) <= 43
    assert quality_classifier.training_rows(some, 10**30, 2).count() == 2  # a share that rounds to nothing


def test_unfinished_constructs_take_no_more_than_their_length():
    began = time.process_time()
    for piece in ("<a ", "<!--", '<a b="', "</a ", "<!x ", "<?x ", "<![CDATA[", "<!-- x>", "<a b='>", "<script><!--", "&am"):
        text = html_text.main_text("<html><body><article><p>Words of an article stand here.</p></article>" + piece * 20_000)
        assert text.startswith("Words of an article stand here.")
    assert time.process_time() - began < 20


def test_formulas_belong_to_the_article():
    page = "<html><body><article><p>Let <math><semantics><mi>x</mi><annotation>\\x</annotation></semantics></math> be large.</p><p>And <svg><text>no</text></svg>more.</p></article></body></html>"
    assert html_text.main_text(page) == "Let x be large.\nAnd more."


def test_null_ids_are_no_trusted_document(spark):
    docs = spark.createDataFrame([(-1, "good words here"), (None, "other words there"), (0, "zero")], "doc_id long, text string")
    labels = spark.createDataFrame([(-1, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    without = docs.where("doc_id IS NOT NULL")
    null_too, none = quality_rules.log_ratios(docs, labels), quality_rules.log_ratios(without.unionByName(spark.createDataFrame([(7, "other words there")], docs.schema)), labels)
    assert (null_too == none).all()
