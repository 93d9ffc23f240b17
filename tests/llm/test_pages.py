"""HTML extraction: hand-made pages, the given pages against a plain reading of their articles, edges."""

import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stampline.llm import pages as P
from stampline.llm import queries

SF = "/root/testdata/sf0.01"
LONG = "A paragraph of the article with quite some words in it, as they use to have."


@pytest.fixture(scope="module")
def extract(spark):
    def run(*texts):
        df = spark.createDataFrame([(i, f"http://a/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
        return [r.text for r in P.main_text(df).orderBy("page_id").collect()]

    return run


def test_given_pages(spark):
    """All of them, against the article cut out by hand."""
    got = queries.QUERIES["op12_html_extraction"](spark, SF).collect()
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(raw)
    for r in got:
        article = raw[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_what_surrounds_an_article_goes(extract):
    parts = ["<nav><ul><li><a href=x>Menu</a></ul></nav>", f"<header><p>{LONG}</p></header>", f"<aside>{LONG}</aside>",
             f"<div class='ad'>{LONG}</div>", f"<div id=cookie-notice>{LONG}</div>", f"<form><label>{LONG}</label></form>",
             f"<script>var a = '<p>{LONG}</p>';</script>", f"<style>p {{ x: '{LONG}' }}</style>", f"<!-- {LONG} -->",
             f"<section class=comments><article class=comment>{LONG}</article></section>", f"<footer>{LONG}</footer>",
             f"<div class='userComments'>{LONG}</div>", f"<div role=complementary>{LONG}</div>", f"<div class=sidebar>{LONG}</div>"]
    article = f"<h1>Title</h1><p>{LONG}<p>Yes.</p><ul><li>one<li>two</ul>"
    want = f"Title\n{LONG}\nYes.\none\ntwo"
    for wrap in ("<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>", "<div class='has-sidebar'>{}</div>"):
        for part in parts:
            body = wrap.format(article)
            assert extract(f"<body>{part}{body}{part}</body>") == [want], (wrap, part)
    inner = "<article>" + "".join(parts[2:]) + article + "".join(parts[2:]) + "</article>"
    assert extract(f"<html><head><title>T</title></head><body>{inner}") == [want]


def test_blocks_and_white_space(extract):
    got = extract("<article><p> a\n\t b&nbsp;c <b>d</b>e<br>f</p>&lt;g&gt; &amp;&eacute;&#x41;<div>h<p>i</div>j</article>",
                  "plain &amp; simple", "<p>a<p>b<table><tr><td>1<td>2<tr><td>3</table>", "<p>a <span class=ad>no</span>b",
                  "<article>one</article><div class=x>two</div><article>three</article>",
                  "<article><header><h1>T</h1></header>x</article><header>no</header>")
    assert got == ["a b c de f\n<g> &éA\nh\ni\nj", "plain & simple", "a\nb\n1\n2\n3", "a b", "one\nthree", "T\nx"]


def test_broken_pages(extract):
    got = extract("<article><p>a</b></div></article>", "</p></p>x<", "<nav>only a menu", "<script>never closed <p>x", "<div>" * 3000 + "deep",
                  "<p><b>" * 20_000 + "x", "<b>" * 5000 + "</i>" * 5000 + "y", "<article><p>" + "word " * 200_000)
    assert got == ["a", "x<", "", "", "deep", "x", "y", " ".join(["word"] * 200_000)]


def test_odd_rows(spark):
    schema = "page_id long, url string, html string"
    rows = [(None, None, "<p>x</p>"), (1, "u", None), (2, None, ""), (3, "u", " \n "), (3, "u", " \n "), (4, "u", "<p>x</p>")]
    df = spark.createDataFrame(rows, schema).withColumns({n: F.lit(7) for n in ("text", "n_chars", "id", "line")})
    got = sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in P.main_text(df).collect()))
    assert got == [(0, "", "x", 1), (1, "u", "", 0), (2, "", "", 0), (3, "u", "", 0), (3, "u", "", 0), (4, "u", "x", 1)]
    assert P.main_text(spark.createDataFrame([], schema)).collect() == []


def test_smoothing_stays_within_pages():
    rng = np.random.default_rng(0)
    ratios, pages = rng.random(20), np.repeat([0, 1, 3], [1, 12, 7])
    got = P.smoothed(ratios, pages, 1.0)
    for i in range(20):
        near = [j for j in range(max(0, i - 3), min(20, i + 4)) if pages[j] == pages[i]]
        w = np.array([np.exp(-0.5 * (i - j) ** 2) for j in near])
        assert abs(got[i] - (w * ratios[near]).sum() / w.sum()) < 1e-12


def test_lines_of_text_stand_out():
    chars, tags = np.array([5.0, 4, 6, 300, 250, 400, 5, 6]), np.array([3.0, 3, 3, 2, 2, 2, 4, 4])
    assert P.content_lines(chars, tags, np.zeros(8, int), 1)[3:6].all()
    assert not P.content_lines(chars, tags, np.zeros(8, int), 1)[[0, 7]].any()
