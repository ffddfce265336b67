"""Embeddings, archives and pages."""

import hashlib

import numpy as np
import pyarrow.fs as fs
import pytest

from weftline.llm import embedding_dedup, html_text, warc
from weftline.llm.common import fresh_dir


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 16))
    rows = []
    for k in range(240):
        v = base[k % 12] + rng.standard_normal(16) * rng.choice([0.0, 0.03, 0.08])
        rows.append((k, [float(np.float32(x)) for x in v * rng.choice([1, 1, 5])], k % 3 if k % 50 else None))
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [1.0, None] * 8, 1), (304, [], 1), (305, [float("inf")] * 16, 1), (306, [1.0, 0.0], 1), (307, rows[7][1], rows[7][2])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    ok = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    links = {r[0]: set() for r in rows}
    for a in ok:
        for b in ok:
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                    links[a[0]].add(b[0])
    component = {k: k for k in links}
    for _ in range(50):
        component = {k: min([component[k], *(component[j] for j in links[k])]) for k in links}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame).collect()}
    assert got == {k: (len(links[k]), component[k], component[k] == k) for k in links}
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_cells_do_not_depend_on_the_batch_and_pairs_meet():
    rng = np.random.default_rng(4)
    unit = embedding_dedup._unit(rng.standard_normal((3000, 64)))
    labels = np.ones(len(unit), np.int64)
    keys, signs = embedding_dedup.cells(unit, labels)
    for some in (np.arange(1), np.arange(7, 500), rng.permutation(3000)[:1111]):
        again, same = embedding_dedup.cells(unit[some], labels[some])
        assert (again == keys[some]).all() and (same == signs[some]).all()
    step = rng.standard_normal(unit.shape)
    step -= (step * unit).sum(axis=1, keepdims=True) * unit
    near = unit * 0.98 + step / np.linalg.norm(step, axis=1, keepdims=True) * np.sqrt(1 - 0.98**2)  # all at the threshold
    other, others = embedding_dedup.cells(embedding_dedup._unit(near), labels)
    assert (keys == other).any(axis=1).all() and 0.25 < (keys == other).mean() < 0.45
    assert (np.bitwise_count(signs.view(np.uint64) ^ others.view(np.uint64)) <= embedding_dedup.SIGNS).all()


def test_a_bucket_of_many_blocks_is_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    rows = [(k, [float(x) for x in centre + 0.005 * rng.standard_normal(16)], 1) for k in range(100)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(99, 0)}


def pages(spark):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(3, "u3", big), (1, "u1", big), (2, "u2", "short"), (5, "u5", "short"), (7, None, None), (8, "u8\r\nX: y", ""), (9, "u9", "é\r\n\r\nWARC/1.1\r\n" + "é" * 80), (None, "n", big), (1, "u1", big)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archive_round_trip(spark):
    rows, frame = pages(spark)
    got = sorted(map(tuple, warc.round_trip(frame).collect()), key=repr)
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            first[b] = min(first.get(b, 1 << 63), p if p is not None else (1 << 63) - 1)
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and first[b] != p
        want.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_archives_are_equal_whatever_the_partitions(spark):
    rows, frame = pages(spark)
    seen = []
    for parts in (1, 5):
        folder = fresh_dir(spark, "warc")
        manifest = warc.write_archive(frame.repartition(parts), folder, roll=300, shard_bytes=600)
        seen.append(sorted(map(tuple, manifest.collect())))
        store, path = fs.FileSystem.from_uri(folder)
        names = {f.base_name for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".gz")}
        assert names == {r.name for r in manifest.collect()} and len(names) > 2
        payloads = {r.page_id: bytes(r.payload).decode() for r in warc.read_archive(folder, manifest).where("record_type = 'response'").collect()}
        assert payloads[9] == rows[6][2]
    assert seen[0] == seen[1]


@pytest.mark.parametrize("ids", ["dense and one far out", "null", "one"])
def test_shards_are_even_whatever_the_ids(spark, ids):
    """Dense ids beside an outlier, only null ids, and one id of many payloads are all cut into many shards."""
    name = {"dense and one far out": lambda k: k if k else 1 << 60, "null": lambda k: None, "one": lambda k: 7}[ids]
    rows = [(name(k), f"u{k}", f"<p>page {k} " + "x" * 300) for k in range(400)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = fresh_dir(spark, "warc")
    manifest = warc.write_archive(frame, folder, shard_bytes=40_000)
    per: dict[str, int] = {}
    for r in manifest.collect():
        per[r.name[:11]] = per.get(r.name[:11], 0) + r.records
    assert sum(per.values()) == 400 and len(per) >= 8 and max(per.values()) < 80, per
    again = warc.write_archive(frame.repartition(5), fresh_dir(spark, "warc"), shard_bytes=40_000)
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, again.collect()))
    got = warc.read_archive(folder, manifest)
    assert sorted(bytes(r.payload).decode() for r in got.collect()) == sorted(h for _, _, h in rows)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p>First  para\n with <b>bold</b>&nbsp;text that goes on for a good while so that there is some of it.<p>Tiny.
<aside>Related</aside><form><input>Sign up</form><ul><li>one</li><li>two</li></ul></article>
<section id="comments"><p>I disagree strongly with all of it and say so at great length here.</p></section><footer>&copy; 2024</footer></body></html>"""


def test_main_text():
    want = "Head & line\nFirst para with bold text that goes on for a good while so that there is some of it.\nTiny.\none\ntwo"
    assert html_text.main_text(PAGE) == want
    plain = "<body><div id=menu>Home</div><div><p>" + "A long paragraph of text. " * 9 + "</p><p>Short.</p></div><div class='footer'>(c)</div></body>"
    assert html_text.main_text(plain) == ("A long paragraph of text. " * 9).strip() + "\nShort."
    assert html_text.main_text("") == "" == html_text.main_text("<script>x</script>")


@pytest.mark.parametrize("tag", ["pre", "ul", "ol", "table", "section", "div", "em", "strong"])
def test_article_around_one_large_part(tag):
    """A part with over half of the text is not the article."""
    inner = {"ul": "<li>{}</li>", "ol": "<li>{}</li>", "table": "<tr><td>{}</td></tr>"}.get(tag, "{}")
    paragraphs = [f"Paragraph {k} of the story, with a fair number of words in it." for k in range(4)]
    large = "This part holds more than half of all the text. " * 7
    page = "<body><div id='nav'><a>Home</a></div><div>{}{}<{t}>{}</{t}>{}{}</div><div class='footer'>(c)</div></body>"
    p = [f"<p>{x}</p>" for x in paragraphs]
    text = html_text.main_text(page.format(p[0], p[1], inner.format(large), p[2], p[3], t=tag))
    assert text == "\n".join([*paragraphs[:2], large.strip(), *paragraphs[2:]])


def test_head_without_an_end():
    title, long = "<title>T</title><meta charset=utf-8><style>p {}</style>", "A long paragraph of text. " * 9
    for start in ("<body><p>", "<p>", "<div>", "<br>", "", "<noscript><link></noscript><body><p>", "<noscript><body><p>"):
        assert html_text.main_text(f"<html><head>{title}\n{start}{long}") == long.strip(), start
    assert html_text.main_text(f"<html><head>{title}</head><body><p>{long}</html>") == long.strip()


PLAIN = """<html><body><div class=x1><a href=1>Home</a> <a href=2>News</a> <a href=3>About</a></div><div class=x2>Slogan of the site</div>
<div class=x3><h2>Headline of it</h2><p>{long}</p><div class=x4><a href=4>More</a><a href=5>Even more</a></div><p>Short one.</p><p>{long}</p><p>Bye.</p></div>
<div class=x5><p>Follow us</p></div><table class=x6><tr><td><a href=6>Terms</a></td><td>Legal</td></tr></table></body></html>""".format(long="A sentence with quite a few words in it, and some more. " * 6)


def test_clusters_select_regions_without_article_main_or_class_words(monkeypatch):
    long = ("A sentence with quite a few words in it, and some more. " * 6).strip()
    assert html_text.main_text(PLAIN) == f"Headline of it\n{long}\nShort one.\n{long}\nBye."
    for page in (PLAIN, PAGE):
        whole = html_text.main_text(page)
        for chosen in (lambda lines, ratio: np.ones(len(lines), bool), lambda lines, ratio: np.arange(len(lines)) % 2 == 0):
            with monkeypatch.context() as m:
                m.setattr(html_text, "content_lines", chosen)
                assert html_text.main_text(page) != whole


def test_ratios_and_smoothing_by_hand():
    page = html_text.Page()
    page.feed("<p>one <b>two</b> three<p><a>four</a> fives<p>six")
    page.close()
    flagged, article = html_text.boilerplate(page)
    assert [(line.text, line.tags, line.linked) for line in page.lines] == [("one two three", 4, 0), ("four fives", 3, 4), ("six", 0, 0)]
    ratio = html_text.ratios(page, flagged, article)
    assert np.allclose(ratio, [13.1 / 5, 6.1 / 4, 3.1])
    weight = [np.exp(-0.5 * d * d) for d in (-2, -1, 0, 1, 2)]
    at = lambda k: ratio[min(max(k, 0), 2)]
    assert np.allclose(html_text.smoothed(ratio), [sum(w * at(k + d) for w, d in zip(weight, range(-2, 3), strict=True)) / sum(weight) for k in range(3)])


@pytest.mark.parametrize(
    "names, dropped",
    [("share-price", False), ("related-work", False), ("commentary", False), ("adsorption", False), ("share", True), ("ad", True), ("ad-slot", True), ("cookie-notice", True),
     ("cookieNotice", True), ("post-comments", True), ("related-posts", True), ("notice", True), ("intro share-buttons", True)],
)
def test_class_words_mark_a_block_only_when_they_are_all_of_its_name(names, dropped):
    for tag in ("article", "div"):
        long = "A sentence with quite a few words in it. " * 6
        page = f"<body><{tag}><p>{long}</p><div class='{names}'>This block of the page has a name.</div><p>{long}</p></{tag}></body>"
        assert ("has a name" not in html_text.main_text(page)) == dropped, tag


def test_a_header_by_class_is_the_pages_outside_of_the_article_only():
    long = "A sentence with quite a few words in it. " * 6
    page = f"<body><div class='site-header'><p>The site's own words.</p></div><article><div class='header'><h1>Title of it</h1></div><p>{long}</p></article></body>"
    assert html_text.main_text(page) == f"Title of it\n{long.strip()}"
    assert html_text.main_text(page.replace("article", "div")) == long.strip()


def test_a_marked_element_with_most_of_the_text_is_the_article():
    long = "A sentence with quite a few words in it. " * 20
    assert html_text.main_text(f"<body><p>Top</p><div class=widget><p>{long}</p></div></body>").endswith(long.strip())
    assert html_text.main_text(f"<body><p>The article.</p><div class=comments><p>{long}</p></div></body>") == "The article."


def test_nested_chrome_deep_pages_and_long_pages():
    page = "<body><nav><div><nav><a>x</a></nav>y</div></nav><main><article><nav>toc</nav><p>Text of it.</p><aside><article><p>Other</p></article></aside></article></main></body>"
    assert html_text.main_text(page) == "Text of it."
    deep = "<div>" * 30_000 + "<p>Deep down there is text.</p>" + "</div>" * 30_000
    assert html_text.main_text(deep) == "Deep down there is text."
    many = "".join(f"<p>Paragraph {k} of a long page.</p>" for k in range(30_000))
    assert html_text.main_text(f"<article>{many}</article>").count("\n") == 29_999


def test_extract_keeps_every_row(spark):
    frame = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "x", "<p>a</p>"), (1, "u", PAGE)], "page_id long, url string, html string")
    got = html_text.extract(frame).collect()
    assert len(got) == 4 and {(r.page_id, r.n_chars) for r in got} == {(1, len(html_text.main_text(PAGE))), (2, 0), (None, 1)}
    assert html_text.extract(frame.limit(0)).count() == 0
