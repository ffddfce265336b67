"""Training-data operators on texts against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from weftline.llm import bpe, licenses, mixing, quality_classifier, quality_rules, simhash, substring
from weftline.llm.common import components, materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(n=160, seed=3):
    """Documents with copies, near copies, shared passages, junk, nulls, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["de%%%", "été", "中文", "THE!!"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    docs = []
    for k in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice((5, 30, 80, 200))))
        if k % 9 == 0:
            text += "\n" + passage + " tail" + str(k)
        if k % 11 == 5:
            text = docs[rng.randrange(len(docs))][1] or "x"
        if k % 13 == 6 and docs[-1][1]:
            text = docs[-1][1].replace("w1", "w2", 1) + " end"
        docs.append((k, text, "en", rng.choice(["a", "b", "é", None]), 1))
    docs += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, " \t\x0b\n ", "en", "b", 5), (n + 3, "same same " * 3000, "en", "a", 9), (None, passage, "en", "c", 7)]
    return docs + [docs[4], docs[4]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def clash(spark):
    """Columns whose names the operators use themselves."""
    rows = [(k, f"alpha beta gamma {k}", "s", 1, 2, 3, 4, 5) for k in range(5)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, key long, d long, h long, fp long")


def words_of(text):
    return WORD.findall(text or "")


def base_counts(text):
    w = words_of(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 2000 else set(grams)
    covered = {i + j for i, g in enumerate(grams) if g in twice for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_base_and_score(spark, docs):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    out = quality_rules.score_documents(docs, labels).collect()
    assert len(out) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, r.text)
    for r in out:
        n, chars, symbols, dup, rep = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD)
    # the ratio by hand, over dictionaries
    count = [np.zeros(quality_rules.N_BUCKETS), np.zeros(quality_rules.N_BUCKETS)]
    hashes = quality_rules.Hashes()
    for r in docs.collect():
        if w := (r.text or "").encode().split():
            for b in quality_rules.buckets(hashes.of(w)):
                count[1][b] += 1
                count[0][b] += r.doc_id is not None and r.doc_id < 60 and r.doc_id % 2 == 0
    p, q = ((c + 1) / (c.sum() + quality_rules.N_BUCKETS) for c in count)
    for r in out[:40]:
        if w := (texts[r.doc_id] or "").encode().split():
            b = quality_rules.buckets(hashes.of(w))
            assert abs(r.score - np.mean(np.log(p[b] / q[b]))) < 1e-5
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)
    assert quality_rules.score_documents(docs.limit(0), labels.limit(0)).count() == 0


def test_components_of_a_chain_a_star_and_a_ring(spark):
    chain = [(k, k + 1) for k in range(1, 60)]
    star = [(100, k) for k in range(101, 160)]
    ring = [(200 + k, 200 + (k + 1) % 7) for k in range(7)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(chain + star + ring + [(5, 5)], "u long, v long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {k: 100 for k in range(100, 160)} | {k: 200 for k in range(200, 207)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words_of(low)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum((2 * ones[b] > len(shingles)) << b for b in range(64))


def test_simhash_against_all_pairs(docs):
    rows = docs.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    least = [r.doc_id if r.doc_id is not None else 1 << 62 for r in rows]
    moved = True
    while moved:
        moved = False
        for i, j in itertools.combinations(range(len(rows)), 2):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and least[i] != least[j]:
                least[i] = least[j] = min(least[i], least[j])
                moved = True
    want = sorted((r.doc_id or -1, f"{f:016x}", c) for r, f, c in zip(rows, fps, least, strict=True))
    got = sorted((r.doc_id if r.doc_id else -1, r.fingerprint, r.component_id if r.component_id is not None else 1 << 62) for r in simhash.report(docs).collect())
    assert [(a if a else -1, b, c) for a, b, c in got] == [(a if a else -1, b, c) for a, b, c in want]
    assert simhash.report(docs.limit(0)).count() == 0


def test_one_of_each_group_stays_without_ids_too(spark):
    long = lambda word: " ".join(f"{word}{k}" for k in range(60))
    rows = [(5, long("a")), (3, long("a")), (None, long("a")), (None, long("b")), (None, long("b") + " b60"), (5, long("c")), (4, long("c")), (None, None), (9, ""), (7, long("d")), (7, long("d"))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    close = (brute_fingerprint(rows[3][1]) ^ brute_fingerprint(rows[4][1])).bit_count() <= 4
    assert sorted((r.doc_id or -1, (r.text or "")[:1]) for r in kept) == sorted([(3, "a"), (4, "c"), (7, "d"), (7, "d"), (9, ""), (-1, "b"), *([] if close else [(-1, "b")])])


def test_anchors_cover_and_find_every_close_pair():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    home, row, visited = simhash.Golay.anchors(words)
    assert (np.bitwise_count(home ^ words) <= 3).all() and (np.bitwise_count(visited ^ words[row]) == 4).all()
    assert (simhash.remainders(np.concatenate([home, visited])) == 0).all()
    for _ in range(3):
        flipped = words ^ (1 << rng.integers(0, 23, 500))
        _, r2, v2 = simhash.Golay.anchors(flipped)
        reach = {(a, b) for a, b in zip(r2.tolist(), v2.tolist(), strict=True)} | set(enumerate(simhash.Golay.anchors(flipped)[0].tolist()))
        assert all((k, a) in reach for k, a in enumerate(home.tolist()))


def test_substring_against_brute_force(docs):
    rows = sorted({(r.doc_id if r.doc_id is not None else 1 << 62, r.text) for r in docs.collect()}, key=lambda x: (x[0], x[1] or ""))
    first = {}
    for d, text in rows:
        w = words_of(text)
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (d, i))
    want = {}
    for d, text in rows:
        w, gone = words_of(text), set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (d, i):
                gone |= set(range(i, i + 20))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[d, text] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = substring.report(docs).collect()
    assert len(got) == docs.count()
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want[r.doc_id if r.doc_id is not None else 1 << 62, r.text] for r in docs.collect())
    new = {r.doc_id: r for r in substring.rewrite(docs).collect()}
    assert new[160].text is None and new[163].text.split() == ["same", "same"] * 10 + [] or len(new[163].text.split()) < 6000
    assert substring.report(docs.limit(0)).count() == 0


def test_substring_with_null_and_shared_ids(spark, monkeypatch):
    """Documents of one id meet only their own phrases, and an earlier id's passage is cut from each of them."""
    rng = random.Random(8)
    passage = " ".join(f"p{rng.randrange(900)}" for _ in range(50))
    own = lambda k: " ".join(f"u{k}x{i}" for i in range(30))
    rows = [(1, passage + " end"), *((None if k % 2 else 5, f"{own(k)} {passage} {own(k)[::-1]}") for k in range(60)), *((None, own(k) + " tail") for k in range(60))]
    monkeypatch.setattr(substring, "BUCKET", 2000)  # many buckets
    got = sorted((r.doc_id or 9, r.n_words, r.n_removed) for r in substring.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    # own(k) also stands in the document of the same k, where id 5 is the earlier and null ids at the same place are equal
    want = [(d or 9, len(t.split()), 0 if d == 1 else 50 if passage in t else 30 if int(t[1:].split("x")[0]) % 2 == 0 else 0) for d, t in rows]
    assert got == sorted(want)


def test_nothing_is_removed_where_the_automata_report_nothing(spark, docs, monkeypatch):
    """What is removed follows from the automata's reports alone."""
    located = substring._located

    def blind(batches):
        from weftline.llm import substring as own

        seeing = own.Shard.hits
        own.Shard.hits = lambda self, words: seeing(self, words)[:0]
        try:
            yield from located(batches)
        finally:
            own.Shard.hits = seeing

    assert substring.report(docs).where("n_removed > 0").count() > 0
    monkeypatch.setattr(substring, "_located", blind)
    assert substring.report(docs).where("n_removed > 0").count() == 0


def test_shards_find_every_phrase_by_its_words():
    rng, size = random.Random(4), substring.PHRASE
    text = [f"v{rng.randrange(60)}".encode() for _ in range(4000)] + [b"x"] * 40
    phrases = sorted({b" ".join(text[k : k + substring.PHRASE]) for k in rng.sample(range(len(text) - size), 50)} | {b" ".join([b"x"] * size)})
    shards, of = substring.shards(phrases, 7), lambda words: substring.WordHashes().of(b" ".join(words))
    assert len(shards) == -(-len(phrases) // 7)
    want = [k for k in range(len(text) - size + 1) if b" ".join(text[k : k + size]) in set(phrases)]
    assert sorted(np.concatenate([s.hits(of(text)) for s in shards]).tolist()) == want
    assert not len(shards[0].hits(of([b"nothing", b"of", b"it"])))
    many = substring.Shard([b" ".join(f"{k}-{j}".encode() for j in range(size)) for k in range(9000)])
    assert many.hits(of([f"{8999}-{j}".encode() for j in range(size)])).tolist() == [0]


def test_substring_tells_texts_of_one_id_apart(spark):
    """Two texts without an id whose 32-bit hashes are equal: only the one that repeats a passage loses it."""
    passage = " ".join(f"p{k}" for k in range(30))
    seeds = spark.range(300_000).select(F.concat(F.lit(passage + " a"), "id").alias("a"), F.concat(F.lit("clean b"), "id", F.lit(" c" * 40)).alias("b"))
    pair = seeds.select("a", F.hash("a").alias("h")).join(seeds.select("b", F.hash("b").alias("h")), "h").orderBy("a").limit(1).head()
    rows = [(1, passage + " first"), (None, pair.a), (None, pair.b)]
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(pair.b.split())
    alone = {(r.doc_id, r.n_words): r.n_removed for r in substring.report(spark.createDataFrame([rows[2]], "doc_id long, text string")).collect()}
    assert got == {(1, 31): 0, (None, 31): 30, (None, n): alone[None, n]}


def test_mixing(docs, clash):
    out = mixing.report(docs).collect()
    assert len(out) == docs.count()
    size = {}
    for r in docs.collect():
        size[r.source] = size.get(r.source, 0) + len(words_of(r.text))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, capped, left = {}, set(), 1.5 * sum(size.values())
    while True:
        free = [s for s in order if s not in capped]
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * size[s]]
        if not over:
            break
        for s in over:
            capped.add(s)
            target[s] = 2.0 * size[s]
            left -= 2.0 * size[s]
    target |= {s: weight[s] * level for s in free}
    source = {r.doc_id: r.source for r in docs.collect()}
    taken = {}
    for r in out:
        s = source[r.doc_id]
        assert abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], 20) for s in order)
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.report(docs.repartition(2)).collect()), key=repr)
    assert mixing.report(docs.limit(0)).count() == 0
    assert mixing.mix(clash).columns == clash.columns
    names = ["__text", "__id", "__h", "__copies", "key", "row", "copies", "taken"]
    other = docs.select("*", *[F.concat(F.lit(n), F.col("text")).alias(n) for n in names])
    mixed = mixing.mix(other)
    assert mixed.columns == other.columns and mixed.where(F.col("__text") != F.concat(F.lit("__text"), "text")).count() == 0
    words = mixing.mix(docs).withColumn("n", mixing.words_in("text")).groupBy("source").agg(F.sum("n").alias("n"))
    assert {r.source: r.n for r in words.collect()} == taken  # row by row what the report says
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.where("text IS NULL").count() == 1


def test_mixing_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 8)
    rows = [(1, "a b c", "s")] * 100 + [(k, "d e", "t") for k in range(160)] + [(None, None, None)] * 40
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = mixing.report(frame).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 25 for r in out) and len(out) == 3
    assert mixing.mix(frame).where("doc_id IS NULL").count() == 40


def test_bpe_equals_tiktoken(spark, docs):
    import public_tokenizers as public

    ranks = bpe.read_ranks(public.path(bpe.VOCABULARY))
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = [(1, "<|endoftext|> it's  \n\n x" + " " * 300 + "y"), (2, "ab" * 700), (3, " é́中文🙂🏽 ١٢٣"), (4, None), (5, "")]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + extra
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = []
    for d, t in rows:
        ids = other.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.report(frame).collect()), key=repr) == sorted(want, key=repr)
    small = spark.createDataFrame(extra, "doc_id long, text string")
    back = bpe.decode(bpe.encode(small)).collect()
    assert {(r.doc_id, bytes(r.bytes).decode()) for r in back} == {(d, t or "") for d, t in extra}
    assert bpe.report(frame.limit(0)).count() == 0


def test_long_unbroken_pieces_equal_tiktoken_in_near_linear_time():
    import time

    import public_tokenizers as public

    path = public.path(bpe.VOCABULARY)
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    encoder = bpe.Encoder.of(path)
    rng = random.Random(6)
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(of) for _ in range(n))
    seconds = []
    for n in (25_000, 100_000):
        text = letters(n)
        began = time.time()
        [row] = encoder.pieces([text])
        seconds.append(time.time() - began)
        assert [int(x) for p in row for x in p[0].split()] == other.encode_ordinary(text)
        assert b"".join(p[2] for p in row).decode() == text
    assert seconds[1] < 8 * seconds[0] + 5
    texts = ["a" * 5003, "ab" * 3001, "abc" * 2000 + "d", "x" * 700 + "y" * 900, letters(3000, "ab"), letters(4000, "eatinos"), letters(2000, "中文字é"), "=" * 4001, " " * 3000 + "x", "".join(f"the{k}and" for k in range(800))]
    texts += [letters(rng.randrange(500, 1500), rng.choice(["etaoin", "aab", "xyz" * 3 + "e", "thequickbrown"])) for _ in range(12)]
    for text, row in zip(texts, encoder.pieces(texts), strict=True):
        assert [int(x) for p in row for x in p[0].split()] == other.encode_ordinary(text), text[:30]


def license_brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def label_brute(text):
    """Labels of notices and the score: every diagonal of every template, merged and covered by hand."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    w, spans, score = split(low), [], 0.0
    for number, (label, notice) in enumerate(licenses.TEMPLATES):
        t = split(notice.lower())
        k = min(licenses.K, len(t))
        votes: dict[int, set[int]] = {}
        for j in range(len(t) - k + 1):
            for i in range(len(w) - k + 1):
                if w[i : i + k] == t[j : j + k]:
                    votes.setdefault(i - j, set()).add(j)
        group: list[int] = []
        for d in [*sorted(votes), None]:
            if group and (d is None or d - group[-1] > licenses.SLACK):
                covered = len({j + x for g in group for j in votes[g] for x in range(k)}) / len(t)
                spans.append((group[0], covered, label))
                group = []
            if d is not None:
                group.append(d)
    best: dict[int, float] = {}
    for start, covered, _ in spans:
        best[start] = max(best.get(start, 0.0), covered)
    score = max([c for _, c, _ in spans], default=0.0)
    base = license_brute(text)[4]
    labels = {x for start, c, x in spans if c >= licenses.COVER and c == best[start]} | set(filter(None, base.split(",")))
    return ",".join(sorted(labels)), 1.0 if base else score


LICENSED = [
    "Released under the MIT License.", "x y z All Rights RESERVED, all rights reserved cc-by CC BY", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0 (the)", "Licensed under CC BY-NC 4.0", "released under a the MIT license", "nothing here", "general public", None, "", "éall rights reserved",
    "cc by " * 50, "Some words before. " + licenses.TEXTS[0][1] + " and after.", licenses.TEXTS[2][1].replace("COPYRIGHT HOLDERS", "REGENTS OF IT"), licenses.TEXTS[9][1][:400],
    " ".join(w for k, w in enumerate(licenses.TEXTS[4][1].split()) if k % 17), "permission is hereby granted free of charge to any person who asks", licenses.TEXTS[7][1].lower() + " cc-by",
]


def test_license_scan(spark):
    frame = spark.createDataFrame([*enumerate(LICENSED), (0, LICENSED[0]), (None, "all rights reserved")], "doc_id long, text string")
    out = licenses.scan(frame).collect()
    assert len(out) == len(LICENSED) + 2
    for r in out:
        text = "all rights reserved" if r.doc_id is None else LICENSED[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_brute(text)
        labels, score = label_brute(text)
        assert r.labels == labels and abs(r.score - score) < 1e-12, text
    labels = {r.doc_id: r.labels for r in out}
    assert labels[0] == "mit" and labels[2] == "gpl,gpl-3.0" and labels[3] == "apache-2.0" and "cc-by-nc-4.0" in labels[4] and labels[6] == labels[7] == ""
    assert licenses.scan(frame.limit(0)).count() == 0
    plan = licenses.scan(frame)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_weak_labels_agree_with_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = quality_classifier.classify(docs).join(labels, "doc_id")
    right = out.agg(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("double"))).head()[0]
    lost = out.where("quality = 1 AND NOT kept").count() / out.where("quality = 1").count()
    assert right > 0.95 and lost < 0.02


def test_classifier_against_brute_force(spark, docs):
    """Votes by plain Python, the posteriors of their patterns, and equal verdicts for equal rows; nothing without words is kept."""
    out = quality_classifier.classify(docs).collect()
    assert len(out) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, r.text or "")
    stop = {w for line in quality_classifier.STOP_WORDS for w in line.split()}
    vote = lambda bad, good: "0" if bad else "1" if good else "2"

    def votes(text):
        w, lines = words_of(text), text.split("\n")
        n = len(w)
        share = lambda x: x / n if n else 0.0
        symbols, capitals = share(sum(text.count(c) for c in "#*$%&|<>")), share(sum(c.isupper() for c in text))
        marks, stops = share(sum(text.count(c) for c in "!?|=~_^")), share(sum(x in stop for x in w))
        variety, length, fresh = share(len(set(w))), share(sum(map(len, w))), len(set(lines)) / len(lines)
        return "".join([
            vote(n < 10, n >= 40), vote(symbols > 0.3, symbols < 0.1), vote(capitals > 2, capitals < 1), vote(marks > 0.5, marks < 0.1), vote(stops < 0.01, stops >= 0.05),
            vote(variety < 0.15, variety >= 0.35), vote(length > 12 or length < 2, 3 <= length <= 9), vote(fresh < 0.7, fresh >= 0.95),
        ])

    counts: dict[str, int] = {}
    for r in docs.collect():
        counts[votes(r.text or "")] = counts.get(votes(r.text or ""), 0) + 1
    posteriors, _ = quality_classifier.fit_labellers(sorted(counts.items()))
    verdicts = {}
    for r in out:
        assert r.votes == votes(texts[r.doc_id]) and abs(r.posterior - posteriors[r.votes]) < 1e-12
        assert r.kept == (r.score >= quality_classifier.KEEP) and 0 <= r.score <= 1
        if not words_of(texts[r.doc_id]):
            assert r.score == 0 and not r.kept
        assert verdicts.setdefault(texts[r.doc_id], (r.score, r.kept)) == (r.score, r.kept)
    assert quality_classifier.classify(docs.where("doc_id = 161 OR doc_id = 162")).where("kept").count() == 0
    assert quality_classifier.classify(docs.limit(0)).count() == 0


def test_em_finds_the_better_labellers():
    rng = np.random.default_rng(5)
    truth = rng.random(20000) < 0.7
    rates = (0.95, 0.9, 0.85, 0.6)
    votes = np.stack([np.where(rng.random(20000) < a, truth, ~truth) for a in rates], 1).astype(int)
    patterns: dict[str, int] = {}
    for v in votes:
        patterns["".join(map(str, v))] = patterns.get("".join(map(str, v)), 0) + 1
    posterior, chance = quality_classifier.fit_labellers(sorted(patterns.items()))
    found = [(chance[k][1][1] + chance[k][0][0]) / 2 for k in range(4)]
    assert all(abs(a - b) < 0.03 for a, b in zip(found, rates, strict=True))
    assert posterior["1111"] > 0.95 > 0.05 > posterior["0000"]


def test_materialized_tables_survive_their_source(spark):
    assert materialize(spark.range(3)).count() == 3


def test_extra_columns_do_not_clash(spark, clash):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (quality_rules.keep_good(clash, labels), simhash.keep_one(clash), substring.rewrite(clash)):
        assert out.columns == clash.columns
        out.collect()
    for f in (simhash.report, substring.report, mixing.report, licenses.scan, bpe.report, quality_classifier.classify):
        assert f(clash).count() == 5


def test_pieces_met_again_outlive_the_bound_of_what_is_kept(monkeypatch):
    import public_tokenizers

    from weftline.llm import bpe

    monkeypatch.setattr(bpe, "CACHE", 40)
    monkeypatch.setattr(bpe, "GROUP", 1)
    encoder, learnt, learn = bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY)), [], bpe.Encoder.learn
    monkeypatch.setattr(bpe.Encoder, "learn", lambda self, new: (learnt.extend(new), learn(self, new)))
    texts = ["again" if k % 2 else " ".join(f"q{chr(97 + k)}{x}zk" for x in "abcdefgh") for k in range(24)]
    rows = list(encoder.pieces(texts))
    assert learnt.count("again") == 1 and len(encoder.known) + len(getattr(encoder, "older", ())) <= 80
    assert [b"".join(p[2] for p in row).decode() for row in rows] == texts
