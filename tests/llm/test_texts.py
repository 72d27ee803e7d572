"""Classifiers, page text, archives, url rules and segmentations on small cases."""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagtrail.llm import batches
from tagtrail.llm.archives import arc_record, arc_records, pages_through_archives, read_arc, warc_records, write_arc
from tagtrail.llm.language import fit_language, predict_language, subword_counts
from tagtrail.llm.main_text import Page, main_text
from tagtrail.llm.quality import fit_quality, isotonic, measured, quality, text_statistics
from tagtrail.llm.segmentation import decoded, load_vocabulary, sample, segmentations
from tagtrail.llm.toxicity import fit_toxicity, ftrl, toxicity
from tagtrail.llm.url_filters import build_cascade, judge_urls
from tagtrail.session import scratch_path

def every():
    return F.lit(True)

ODD = [(None, "no id"), (900, None), (901, ""), (902, " \n "), (903, "..."), (904, "word " * 300_000), (905, "x" * 1_500_000), (905, "twice")]


def documents(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, 1, "s", 0.5) for i, t, lang in rows], "doc_id long, text string, lang string, id int, label string, score double")


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_words_of_long_texts_are_cut_between_words(monkeypatch):
    rng = random.Random(1)
    text = " ".join("abcdefgh"[: rng.randrange(1, 9)] for _ in range(4000)) + " " + "y" * 5000 + " end"
    whole = batches.space_words([None, text, ""])
    monkeypatch.setattr(batches, "STEP", 700)
    cut = batches.space_words([None, text, ""])
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True)) and len(whole[0]) == 4002


def test_toxicity_learns_words_and_scores_every_row(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for k in range(400):
        text = [f"w{rng.randrange(50)}" for _ in range(40)]
        if k % 4 == 0:
            text[7] = rng.choice(["vile", "foul"])
        rows.append((k, " ".join(text), "en"))
        marks.append((k, 1, int(k % 4 == 0)))
    marks += [(None, 1, 1), (5, None, None), (6, 1, 7), (9999, 1, 1)]
    docs = documents(spark, rows + [(*o, None) for o in ODD])
    weights = fit_toxicity(docs, labelled(spark, marks), every())
    got = {r.doc_id: r.score for r in toxicity(docs, weights).collect()}
    assert toxicity(docs, weights).count() == len(rows) + len(ODD)
    assert all((got[k] >= 0.3) == (k % 4 == 0) for k in range(400))
    assert got[900] == got[901] == got[902] and all(0 <= s <= 1 for s in got.values())
    assert len(weights.buckets) < 200  # sparse
    assert toxicity(docs.limit(0), weights).collect() == []
    none = fit_toxicity(docs, labelled(spark, []), every())
    assert {r.score for r in toxicity(docs, none).collect()} == {0.5}


def test_follow_the_leader_gives_zero_weight_to_noise():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 500).astype(float)
    rows = [np.unique(np.append(rng.integers(10, 1000, 20), 3 if t else 4)) for t in y]
    table = ftrl(rows, y, bits=10).table()
    assert table[3] > 1 and table[4] < 0 and np.abs(np.delete(table, [3, 4])).max() < table[3]


def test_language_of_texts(spark):
    rng = random.Random(6)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["eau", "é", "oi"]}
    rows = []
    for k in range(450):
        lang = "abc"[k % 3] * 2
        rows.append((k, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(12)), lang if k % 10 else None))
    docs = documents(spark, rows + [(*o, None) for o in ODD] + [(906, "123 !", "aa")])
    model = fit_language(docs, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in predict_language(docs, model).collect()}
    assert predict_language(docs, model).count() == docs.count()
    assert sum(got[k].lang_pred == "abc"[k % 3] * 2 for k in range(0, 450, 5)) == 90
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (900, 901, 902, 903, 906))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert predict_language(docs.limit(0), model).collect() == []
    nothing = fit_language(docs.where("lang IS NULL"), every())
    assert {r.lang_pred for r in predict_language(docs, nothing).collect()} == {"und"}


def test_subwords_do_not_cross_texts_or_depend_on_neighbours():
    texts = ["Ab cd", "", "x", "É1b", None]
    together = subword_counts(texts)
    assert all((together[i] == subword_counts([t])[0]).all() for i, t in enumerate(texts))
    assert together[0].sum() == 4 + (1 + 2) * 2 + (1 + 1 + 0) * 2 + 2  # widths 1, 2, 3, 4


def test_quality_separates_and_calibrates(spark):
    rng = random.Random(7)
    rows, marks = [], []
    for k in range(400):
        good = k % 3 != 0
        text = " ".join(f"{'abcdefgh'[: rng.randrange(2, 8)]}" for _ in range(60))
        rows.append((k, text if good else text.upper().replace(" ", "!! "), "en"))
        marks.append((k, int(good), 0))
    marks += [(None, 1, 1), (7, None, None), (8, 5, 5)]
    docs = documents(spark, rows + [(*o, None) for o in ODD])
    stats = measured(docs)
    model = fit_quality(stats, labelled(spark, marks), every())
    got = {r.doc_id: r.score for r in quality(stats, model).collect()}
    assert quality(stats, model).count() == docs.count()
    assert all((got[k] >= 0.7) == (k % 3 != 0) for k in range(400)) and all(0 <= s <= 1 for s in got.values())
    none = fit_quality(stats, labelled(spark, []), every())
    assert {r.score for r in quality(stats, none).collect()} == {0.5}
    one = fit_quality(stats, labelled(spark, [(1, 1, 0), (2, 1, 0)]), every())
    assert {r.score for r in quality(stats, one).collect()} == {1.0}
    assert quality(measured(docs.limit(0)), model).collect() == []


def test_statistics_of_a_text_in_pieces(monkeypatch):
    from tagtrail.llm import quality as module

    text = "Some words, HERE | and 12 there.\n" * 300
    whole = text_statistics([None, text, ""])
    monkeypatch.setattr(module, "STEP", len("Some words, HERE | and 12 there.\n") * 20)
    assert np.allclose(text_statistics([text])[0], whole[1]) and not whole[0].any() and not whole[2].any()


def test_isotonic_is_the_best_rising_fit():
    levels = isotonic(np.array([4.0, 4, 4, 4]), np.array([1.0, 3, 2, 4]))
    assert levels.tolist() == [0.25, 0.625, 0.625, 1.0]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p>";</script></head><body>{menu}
<main><h1>Head &amp; line</h1><p>First&nbsp;  part <b>bold</b><br>next<p>Second &lt;b&gt; number {n}
<form><input value=1>Name</form><div class="ad">Buy</div></main>{foot}</body></html>"""


def test_site_templates_go_and_articles_stay(spark):
    menu, foot = '<div><a href="/">Start</a><p>Weather today</p></div>', "<div><p>All rights kept</p></div>"
    rows = [(k, f"http://Site.example/{k}", PAGE.format(n=k, menu=menu, foot=foot).replace("<main>", "<div>").replace("</main>", "</div>")) for k in range(20)]
    rows += [(100, "http://other.example/", PAGE.format(n=100, menu=menu, foot=foot).replace("main>", "div>"))]
    rows += [(101, None, PAGE.format(n=101, menu=menu, foot=foot)), (102, "x", None), (103, "http://site.example/z", ""), (104, "http://site.example", "<p>" + "a " * 300_000)]
    pages = spark.createDataFrame([(*r, "h", "k") for r in rows], "page_id long, url string, html string, host string, template string")
    got = {r.page_id: r for r in main_text(pages).collect()}
    article = "Head & line\nFirst part bold next\nSecond <b> number {}"
    assert all(got[k].text == f"Second <b> number {k}" or got[k].text == article.format(k) for k in range(20))
    assert "Weather" not in got[3].text and "rights" not in got[3].text
    assert got[100].text == "Start\nWeather today\n" + article.format(100) + "\nAll rights kept"  # one page is no site
    assert got[101].text == article.format(101) and got[102].text == got[103].text == ""
    assert got[104].n_chars == 599_999 and all(r.n_chars == len(r.text) for r in got.values())
    assert main_text(pages.limit(0)).collect() == []


def test_copies_and_shared_lines_are_no_template(spark):
    layout = "<nav>Start</nav><div><p>Weather today</p></div>{}<div><p>All rights kept</p></div><script>var id = {}</script>"
    story = "<{0}><h1>Head</h1><p>Lead</p><section><p>Body</p></section></{0}>"
    rows = [(k, "http://copies.example/", layout.format(story.format("article"), k)) for k in range(12)]
    rows += [(20 + k, "http://plain.example/", layout.format(story.format("div"), k)) for k in range(12)]
    for host, tag in enumerate(("article", "main", "div")):  # a third are copies; all share a lead, in div only as part of copies
        url, base = f"http://{tag}.example/", 100 * (host + 1)
        rows += [(base + k, url, layout.format(story.format(tag), k)) for k in range(12)]
        lead = "<p>Lead</p>" if tag != "div" else ""
        rows += [(base + k, url, layout.format(f"<{tag}><h1>Title {k}</h1>{lead}<p>Own {k}</p></{tag}>", k)) for k in range(12, 36)]
    cards = "<div><article>Card one</article><article>Card two</article></div>"
    rows += [(500 + k, "http://cards.example/", layout.format(f"<article><p>Story of page {k}</p></article>{cards}", k)) for k in range(12)]
    same = "<div><article><p>The same long story on each row</p></article></div>"
    rows += [(600 + k, "http://turns.example/", layout.format(f"{same}<article>Card {k}</article>", k)) for k in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in main_text(pages).collect()}
    whole = "Head\nLead\nBody"
    for k in range(12):
        assert got[k] == whole and got[20 + k] == f"Weather today\n{whole}\nAll rights kept"  # copies of one page are no site
        assert got[100 + k] == got[200 + k] == got[300 + k] == whole
        assert got[500 + k] == f"Story of page {k}" and got[600 + k] == f"The same long story on each row\nCard {k}"
    for k in range(12, 36):
        assert got[100 + k] == got[200 + k] == f"Title {k}\nLead\nOwn {k}" and got[300 + k] == f"Title {k}\nOwn {k}"


@pytest.mark.parametrize("hosts", [{"ten.example": 10, "forty.example": 40, "many.example": 300}])
def test_subtree_counts_alone_find_the_text(spark, hosts):
    """Pages without article, main or a telling name, whose boxes stand before, after and between their own blocks."""
    rows, want = [], {}
    for host, size in hosts.items():
        box = f"<div><table><tr><td>Top of {host}<td>Prices</table></div>"
        for k in range(size):
            key = len(rows)
            own = [f"Title {key}", f"First part of text {key}, " + "some words " * 10 + "end", f"Second part of text {key}"]
            rows.append((key, f"https://{host}/{k}", f"<body>{box}<div><div><h1>{own[0]}</h1><p>{own[1]}</p>"
                         f"<div>Stay in touch, {host}</div><p>{own[2]}</p></div></div><div><div>Made by {host}</div><p>Turn page</p></div>"))  # fmt: skip
            want[key] = "\n".join(own)
    small = len(rows)  # nine pages are too few for a site
    rows += [(small + k, "https://nine.example/", f"<div>Box</div><p>Text {k}</p>") for k in range(9)]
    want |= {small + k: f"Box\nText {k}" for k in range(9)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r.page_id: r for r in main_text(pages).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.shown_chars == 0 and (r.site_chars > 0) == (r.page_id < small) for r in got.values())


def test_templates_inside_articles_go_by_their_links_and_versions_stay(spark):
    more = "<div><ul><li><a href=1>Read this too</a><li><a href=2>And this</a></ul></div>"
    rows = [(k, "http://a.example/", f"<article><h1>Title {k}</h1><p>Words of number {k} and some more of them</p>{more}<p>Licence</p></article>") for k in range(12)]
    rows += [(20 + k, "http://b.example/", "<div>" + "".join(f"<p>Paragraph {i} of the text, {'version ' + str(k) if i == 3 else 'as ever'}</p>" for i in range(20)) + "</div>") for k in range(12)]
    rows += [(40 + k, "http://c.example/", f"<main>{more}<p>{k}</p></main>") for k in range(12)]
    rows += [(60 + k, "http://d.example/", f"<aside>Beside</aside><aside>{k}</aside><p>Text {k}</p>") for k in range(12)]
    got = {r.page_id: r for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(12):
        assert got[k].text == f"Title {k}\nWords of number {k} and some more of them\nLicence" and got[k].site_chars == 21
        assert len(got[20 + k].text.split("\n")) == 20 and got[20 + k].site_chars == 0
        assert got[40 + k].text == f"Read this too\nAnd this\n{k}"
        assert (got[60 + k].text, got[60 + k].site_chars, got[60 + k].shown_chars) == (f"Text {k}", 6, len(str(k)))


@pytest.mark.parametrize(
    "unit",
    ["<script ", "<a ", "<a b='", "</x", "<div>", '<a b=">"', "<p><button><i>", "<li>x", "<td><table>", "<!--", "<?", "<p>x", "&am", "<b>x", "<div>x"],
)
def test_odd_pages_take_time_in_proportion(unit):
    """A page of a megabyte is read in seconds; with quadratic work it would take hours."""
    for source in (unit * (1_000_000 // len(unit)), unit * (1_000_000 // len(unit)) + "'\">"):
        began = time.process_time()
        Page(source).text()
        assert time.process_time() - began < 10


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>a<p>b<div>c<span>d</span></div>e", "a\nb\ncd\ne"),
        ("<ul><li>1<li>2</ul><table><tr><td>x<td>y</table>", "1\n2\nx\ny"),
        ("<nav>m</nav><header>h</header><article><header><h1>t</h1></header><p>b</article><aside>s</aside><footer>f</footer>", "t\nb"),
        ("<article>one<section id=comments><article>reply</article></section></article>", "one"),
        ("<p>x <!-- <p>gone --> y<p title='a>b'>z &copy &am", "x y\nz © &am"),
        ("<p>open <a href='x\">never closed", "open <a href='x\">never closed"),
        ("<style>p{}</style><p>k</p><script>", "k"),
        ("a < b and c", "a < b and c"),
        ("<p>a <math><mi>x</mi></math> b <label>c</label><svg><text>d</text></svg>", "a x b cd"),
        ("<article><section class=promotion><p>a</p></section><audio>b</audio><object>c</object><xmp>d</xmp></article>", "a\nbc\nd"),
        ("<p title=it's>a</p><p>b's</p>", "a\nb's"),
        ("<p>a <a b='>c</p><p>d</p>", "a <a b='>c\nd"),
        ("<p>a <a b='>c</p><p title='>'>d", "a '>d"),
        ("<p>a <a b='>c</p><p title=x>d", "a <a b='>c\nd"),
        ("a <!-- b", "a"),
        ("a <!-- b > c", "a"),
        ("a <1> b <", "a <1> b <"),
    ],
)
def test_blocks(source, want):
    assert Page(source).text() == want


STORY = "The story itself has many words, and this is all of it" * 9


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<div class='page has-sidebar with-comments'><article><p>whole</p></article></div>", "whole"),
        ("<div class=no-sidebar><p>plain</p></div>", "plain"),
        ("<article><section id=related-work>a</section><h2 id='search-algorithms'>b</h2><p class=share-price>c</article>", "a\nb\nc"),
        ("<article><h2 class='search'>a</h2><section id=search><p>b</section><div class='x share'>no</div></article>", "a\nb"),
        ("<main><header><h1 id=menu>a</h1></header><p>b</main>", "a\nb"),
        ("<div class=overlay><article>a<p class=ad>no</article></div>", "a"),
        ("<div class=overlay>no</div><div class='site-footer'>no</div><p>a", "a"),
        ("<p title='hidden gem' data-id=search data-role='menu'>a</p><p hidden>no</p><p aria-hidden=true>no</p>", "a"),
        (f"<main><p>{STORY}</p></main><div><article>Card one</article><article>Card two</article></div>", STORY),
        (f"<main><p>{STORY}</p><article>Card one</article></main>", f"{STORY}\nCard one"),
        (f"<div><p>{STORY}</p></div><article>Card one</article>", f"{STORY}\nCard one"),
        (f"<main>Title</main><div><p>{STORY}</p></div>", f"Title\n{STORY}"),
        (f"<main><p>Share</p><article><p>{STORY}</p></article></main><p>Some links</p>", STORY),
        ("<article>one</article><article>two</article>", "one\ntwo"),
    ],
)
def test_names_are_whole_and_the_root_is_where_the_text_is(source, want):
    assert Page(source).text() == want


def test_archives_come_back(spark):
    big = "<p>" + "ä" * 200
    rows = [(5, "http://a b/\n", big), (3, "http://c", big), (9, None, big), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""), (7, "u", "WARC/1.0\r\n\r\n" * 30), (8, "u", "\n0 1 2\n" * 40)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, key int")
    got = {r.page_id: r for r in pages_through_archives(pages.repartition(3), "page_id", "url", "html").collect()}
    assert sorted(got) == sorted(r[0] for r in rows)
    for i, _, text in rows:
        raw = (text or "").encode()
        want = ("revisit", 3) if i in (5, 9) else ("response", None)
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == want and got[i].payload_ok in (True, None)
    assert pages_through_archives(pages.limit(0), "page_id", "url", "html").collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions_and_broken_records(spark, version):
    first = f"filedesc://x 0.0.0.0 20200101000000 text/plain 10\n{version} 0 owner\n".encode()
    body = first + b"\n" + arc_record("http://x/a b", b"\x00\xff\npayload", version, "19991231235959", "image/gif") + b"\n\n"
    body += arc_record("http://y", b"cut here", version, "20000101000000")[:-3]
    got = list(arc_records(io.BytesIO(body), "f"))
    assert [(r[0], r[2], r[3], r[5], r[6]) for r in got] == [
        ("http://x/a%20b", "19991231235959", "image/gif", b"\x00\xff\npayload", False),
        ("http://y", "20000101000000", "text/html", b"cut h", True),
    ]
    with pytest.raises(ValueError, match="f: no ARC header"):
        list(arc_records(io.BytesIO(first + b"\nno header at all\n"), "f"))
    path = scratch_path(spark, "arc-test")
    write_arc(spark.createDataFrame([(1, "http://u", "text")], "k long, u string, p string"), path, "k", "u", "p", version)
    row = read_arc(spark, path).head()
    assert (row.url, row.version, row.key, row.payload_bytes) == ("http://u", version, 1, 4) and row.block.endswith(b"\r\n\r\ntext")


def test_warc_members_are_read_in_a_row():
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    both = gzip.decompress(gzip.compress(one) + gzip.compress(one))
    assert [(f["warc-type"], b, c) for f, b, c in warc_records(io.BytesIO(both))] == [("resource", b"abc", False)] * 2


def test_cascade_is_exact_on_every_key_of_the_corpus(spark):
    corpus = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = corpus.where("hash(key) % 7 = 0").unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS key UNION ALL SELECT 'other'"))
    cascade = build_cascade(listed, corpus)
    assert len(cascade.levels) >= 2
    asked = cascade.attached(corpus, "c").select("key", cascade.lists(F.col("key"), "c").alias("in"))
    assert asked.where("`in` <> (hash(key) % 7 = 0)").count() == 0
    empty = build_cascade(listed.limit(0), corpus)
    assert empty.levels == () and empty.attached(corpus, "c").where(empty.lists(F.col("key"), "c")).count() == 0


def brute_verdict(url, rules, hosts):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    return host, path, None, "block" if host in hosts else "allow"


def test_url_rules_equal_brute_force(spark):
    rules = [("allow", "org", "/"), ("block", "a.org", "/es/"), ("block", "org", "/e"), ("allow", "x.a.org", "/es/1"), ("block", "net", "")]
    hosts = ["http://", "HTTPS://X.A.", "ftp://a.", "s://b.a.", "://", "http://é.", ""]
    tails = ["org", "ORG/", "org/es/", "org/es/12?q#f", "org/e#/", "org?x=://y", "org#", "net", "net/1", "com/q", ""]
    urls = [a + b for a, b in itertools.product(hosts, tails)] + [None, "", "no scheme", "http://" + "a." * 200 + "org/"]
    pages = spark.createDataFrame([(i, u, "z", "w") for i, u in enumerate(urls)] + [(None, "http://org/", "z", "w")], "page_id long, url string, host string, key string")
    table = spark.createDataFrame(rules, "action string, host string, path string")
    listed = spark.createDataFrame([("a.com",), ("b.a.com",), (None,)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, table, listed).collect()}
    assert got.pop(None) == ("org", "/", "org/", "allow")
    assert got == {i: brute_verdict(u, rules, {"a.com", "b.a.com"}) for i, u in enumerate(urls)}
    assert judge_urls(pages.limit(0), table, listed).collect() == []


def every_way(word, pieces):
    if not word:
        yield ()
    for size in range(1, len(word) + 1):
        if word[:size] in pieces:
            yield from ((word[:size], *rest) for rest in every_way(word[size:], pieces))


@pytest.fixture(scope="module")
def vocabulary(spark):
    return load_vocabulary(spark)


def test_segmentations_follow_the_distribution_of_all_ways(vocabulary):
    text, n = "an in", 6000
    log_p = {p.decode(): vocabulary.weights[i] for i, p in enumerate(vocabulary.pieces) if vocabulary.weights[i] > -np.inf}
    ways = [a + b for a in every_way(" an", log_p) for b in every_way(" in", log_p)]
    weight = np.exp([sum(log_p[p] for p in w) for w in ways])
    share = dict(zip(ways, weight / weight.sum(), strict=True))
    firsts, pairs = {}, set()
    for found in sample([text] * n, np.arange(n, dtype=np.uint64), vocabulary, 2):
        spelled = [tuple(vocabulary.pieces[i].decode() for i in ids) for ids, *_ in found]
        for way, (_, log_prob, _, inclusion) in zip(spelled, found, strict=True):
            assert abs(math.exp(log_prob) - share[way]) < 1e-4 and 0 < inclusion <= 1
        assert spelled[0] != spelled[1] and found[0][2] > found[1][2]
        firsts[spelled[0]] = firsts.get(spelled[0], 0) + 1
        pairs.add(tuple(spelled))
    for way, p in share.items():
        assert abs(firsts.get(way, 0) / n - p) < 4 * math.sqrt(p / n) + 1e-3
    assert len(pairs) > 3


def test_all_ways_of_a_short_text_come_once(vocabulary):
    log_p = {p.decode() for i, p in enumerate(vocabulary.pieces) if vocabulary.weights[i] > -np.inf}
    ways = set(every_way(" the", log_p))
    found = sample(["the"], np.array([5], np.uint64), vocabulary, 50)[0]
    assert {tuple(vocabulary.pieces[i].decode() for i in ids) for ids, *_ in found} == ways and len(found) == len(ways)
    assert all(x[3] == 1.0 for x in found) and abs(sum(math.exp(x[1]) for x in found) - 1) < 1e-5


def test_round_trip_of_every_kind_of_text(spark, vocabulary):
    texts = ["", None, " ", "  two  spaces ", "tab\tnew\nline\r\n", "é ñ ß 漢字 😀 ﷽", "\x00\x01", "a" * 70_000, "word " * 60_000, "same", "same"]
    rows = [(k if k < 10 else 9, t, None) for k, t in enumerate(texts)] + [(None, "no id", None)]
    docs = documents(spark, rows)
    ways = segmentations(docs, vocabulary)
    back = decoded(ways, vocabulary).select("doc_id", "rank", "decoded", "text_key", "inclusion", F.xxhash64("decoded").alias("got")).collect()
    assert all(r.got == r.text_key for r in back if r.doc_id != 1)
    assert {(r.doc_id, r["rank"], r.decoded, r.inclusion) for r in back if r.doc_id in (0, 1)} == {(0, 1, "", 1.0), (1, 1, "", 1.0)}
    again = {(r.doc_id, r["rank"], tuple(r.ids)) for r in segmentations(docs.repartition(4), vocabulary).collect()}
    assert again == {(r.doc_id, r["rank"], tuple(r.ids)) for r in ways.collect()}
    assert segmentations(docs.limit(0), vocabulary).collect() == []
