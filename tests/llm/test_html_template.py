"""Main text of template pages, of pages without a template, and of broken ones."""

import time
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.llm import html_template as ht

PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{x:1}}</style><script>var t="</p><p>no";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">Item {i}</a></li></ul></nav><!-- ad --><div class="ad">Buy {i}</div>
{open}<h1>Head {i} &amp; more</h1><p><b>First&nbsp;line {i}.<br><p>Second  para
{i} <a href="x">link</a> &lt;tag&gt;</p><ul><li>one {i}<li>two</ul><p>{long}</p><div class="share-box">Share this</div><p>Same words.</p>{close}
<section id="comments"><p>Nice {i}!</p></section><form><p>Sign up</p></form><footer>&copy; site {i}</footer>{end}"""


def page(i, kind="article", end="</body></html>"):
    open_, close = {"article": ("<article>", "</article>"), "div": ('<div class="story">', "</div>")}[kind]
    return PAGE.format(i=i, open=open_, close=close, end=end, long=f"Long varying words of page {i}. " * 8)


def want(i):
    return "\n\n".join([f"Head {i} & more", f"First line {i}.", f"Second para {i} link <tag>", f"one {i}", "two", (f"Long varying words of page {i}. " * 8).strip(), "Same words."])


@pytest.mark.parametrize("kind", ["article", "div"])
def test_pages_of_a_host(spark, kind):
    rows = [(i, f"https://H{i % 2}.example.org:80/{i}?a#b", page(i, kind, "</body></html>" if i % 3 else "")) for i in range(14)]
    rows += [(100, None, page(100, kind)), (101, "not a url", page(101, kind)), (102, "https://h0.example.org/x", None), (103, "https://h0.example.org/y", ""), (3, rows[3][1], rows[3][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    pages = pages.where("html is null or html <> ''") if kind == "div" else pages
    got = ht.extracted(spark, pages.where("page_id < 102 or page_id is null") if kind == "div" else pages).toPandas()
    for r in got.itertuples():
        expected = "" if r.page_id in (102, 103) else want(int(r.page_id))
        assert r.text == expected and r.n_chars == len(expected)


def test_odd_pages_do_not_switch_a_large_host_off(spark):
    body = lambda i: f"<div class='zq'><p>Chrome of the site.</p></div><div class='story'><h1>Head {i}</h1><p>{f'Varying words {i}. ' * 9}</p></div>"
    rows = [(i, f"https://big.example.org/{i}", f"<html><body>{body(i)}<div class='zx'>Made by us.</div></body></html>") for i in range(60)]
    rows += [(100, "https://big.example.org/null", None), (101, "https://big.example.org/empty", ""), (102, "https://big.example.org/plain", "gone"), (103, "https://big.example.org/404", "<html><body><p>Not found</p></body></html>")]
    got = {r.page_id: r.text for r in ht.extracted(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(60):
        assert got[i].endswith((f"Varying words {i}. " * 9).strip()) and "Chrome" not in got[i] and "Made" not in got[i]
    assert [got[i] for i in range(100, 104)] == ["", "", "gone", "Not found"]


def test_title_and_lead_stay_with_the_body(spark):
    body = lambda i: f"<div class='zq'><p>Chrome of the site.</p></div><div class='story'><h1>Head {i}</h1><div class='lead'>Lead {i}.</div><div class='body'><p>{f'Varying words {i}. ' * 9}</p></div></div>"
    rows = [(i, f"https://big.example.org/{i}", f"<html><body>{body(i)}<div class='zx'>Made by us.</div></body></html>") for i in range(20)]
    rows += [(103, "https://big.example.org/404", "<html><body><p>Not found</p></body></html>")]
    got = {r.page_id: r.text for r in ht.extracted(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):
        assert got[i] == f"Head {i}\n\nLead {i}.\n\n" + (f"Varying words {i}. " * 9).strip()


def test_words_and_forms_do_not_hide_the_article():
    text = lambda s: ht.main_text(ht.parse(s), "", [])
    assert text("<article class='post category-social'><p>a</p></article>") == "a"
    assert text("<div class='content has-sidebar'><article>a</article></div><div class='sidebar'>no</div>") == "a"
    assert text("<main class='layout no-sidebar comments-open'>a<div class='share-box'>no</div></main>") == "a"
    assert text("<form><nav>no</nav><h1>t</h1><div>a</div></form><form>no</form>") == "t\n\na"
    assert text("<form><article class='promo'>a</article></form>") == "a"
    assert text("<article>a</article><div class='comments'><article>no</article></div>") == "a"
    assert text("<article hidden>no</article><p>a</p>") == "a"


def test_single_pages_and_broken_markup():
    text = lambda s: ht.main_text(ht.parse(s), "", [])
    assert text(None) == text("") == text("<p></p>") == ""
    assert text("plain  words\nonly") == "plain words only"
    assert text("<main>a < b &amp;&amp; c<p>d</main>tail") == "a < b && c\n\nd"
    assert text("<p>x<script>var a='<p>'") == "x"
    assert text("<article><p>one <b>two</p><p>three</b> four</p></article><aside>no</aside>") == "one two\n\nthree four"
    assert text("<div>a<div class='cookie-notice'>no</div>b<!-- <p>no</p> --></div>") == "a\n\nb"
    assert text("<article>" + "<div>" * 3000 + "deep" + "</article>after") == "deep"
    assert text("<article><header><h1>Kept</h1></header><p>z</p></article>") == "Kept\n\nz"


@pytest.mark.parametrize("source", [
    "<div class='content no-sidebar'><p>a</p></div>", "<div class='md:overflow-hidden'><p>a</p></div>", "<main class='has-comments'><article><p>a</p></article></main>",
    "<div id='share-price-report'><p>a</p></div>", "<div data-id='ad'><p>a</p></div>", "<section data-src='/x?id=search'><p>a</p></section>",
    "<form id=aspnetForm><div><p>a</p></div></form>", "<object><p>a</p></object>", "<div paid='promo' href=\"/x?class=menu\"><p>a</p></div>",
])
def test_articles_that_look_like_something_else(source):
    assert ht.main_text(ht.parse(f"<html><body>{source}</body></html>"), "", []) == "a"


@pytest.mark.parametrize("piece", ["<div x='", "<a \"'", "<![CDATA[", "<!-", "</b>", "<div><b>", "<h1><div>", "<form><div><article>", "<li>", "<td><p>", "<script>", "<b></div>", "< ", "<?", "<p></i>"])
def test_broken_pages_take_linear_time(piece):
    for source in (piece * (1_000_000 // len(piece)), "<b>" * 100_000 + "<div>" * 100_000 + "</b>" * 100_000 + ">", piece * 50_000 + ">"):
        began = time.process_time()
        ht.parse(source)
        assert time.process_time() - began < 8


def test_classes_against_occurrence_vectors_written_out():
    pages = [page(i, "div") + "<i>x</i>" * (i % 3) for i in range(12)] + ["<html><body><div class='ad'>a</div><div class='ad'>b</div></body></html>"]
    vectors: dict[str, Counter] = {}
    for n, source in enumerate(pages):
        for token, times in Counter(e.path for e in ht.parse(source).elements).items():
            vectors.setdefault(token, Counter())[n] = times
    batch = ht.pa.RecordBatch.from_arrays([ht.pa.array(["h"] * len(pages)), ht.pa.array(range(len(pages))), ht.pa.array(pages)], names=["host", "page_id", "html"])
    seen = pd.concat([b.to_pandas() for b in ht._observe(iter([batch]))])
    told = ht.classes(seen[seen.token != ""])
    assert set(told.token) == set(vectors)
    for _, one in told.groupby("cls"):
        assert len({tuple(sorted(vectors[t].items())) for t in one.token}) == 1
    assert told.cls.nunique() == len({tuple(sorted(v.items())) for v in vectors.values()})
    for r in told.itertuples():
        ups = [r.token[:k] for k, c in enumerate(r.token) if c == "/"] + [r.token]
        assert r.valid == all(set(vectors[u].values()) == {1} for u in ups)


def test_empty_table(spark):
    assert ht.extracted(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
