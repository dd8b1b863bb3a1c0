from __future__ import annotations

import itertools
import re
import time

import numpy as np
import pytest

from driftloom.llm import html_extract
from driftloom.llm.html_blocks import leaf_blocks
from driftloom.llm.html_extract import Chains, default_model, main_texts, marginals, viterbi
from driftloom.llm.page_layouts import labelled_pages
from tests.conftest import SF


def texts(page):
    return [b.text for b in leaf_blocks(page)[0]]


def test_leaf_blocks():
    assert texts("a <b>b</b>\n c<div>d<p>e<p>f</div>g") == ["a b c", "d", "e", "f", "g"]
    assert texts("<ul><li>a<li>b <i>c</ul>d<br>e<hr>f") == ["a", "b c", "d e", "f"]
    assert texts("<table><tr><td>a<td><p>b</div>c</table>d") == ["a", "b", "c", "d"]
    assert texts("<title>t &lt;</title><style>p{}</style><script>var t='</p>';</script>x<noscript>n</noscript>y<svg><title>q</title></svg>z") == ["xyz"]
    assert texts("1 < 2 &amp; 3 &lt; 4 &am &#x41;&nbsp; <!-- <p>no --> yes <!doctype x> <?p?> </3 >") == ["1 < 2 & 3 < 4 &am A yes"]
    assert texts('<a title="a > b">in</a> <p data-x=\'"\' class=">">out<h2>h</h3>after') == ["in", "out", "h", "after"]
    assert texts("done<p>cut <a href='x") == ["done", "cut"] and texts("") == [] and texts("<") == ["<"] and texts("é</é>f") == ["éf"]
    assert leaf_blocks("<head><title> A\n&amp;  B</title><p>c")[1] == "A & B"
    blocks, _ = leaf_blocks('<nav class="topNav x-1"><a href=1>ab</a> c</nav><article id=main><section>d</section></article>')
    assert blocks[0].linked == 2 and {"in:nav", "c:top", "c:nav"} <= blocks[0].marks and {"in:article", "in:section", "c:main"} <= blocks[1].marks


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<p><b>", "<", "&amp", "<!--", '<a b="', "<li>", "<td><p>", "</div>", "<svg>", "<div class='a b'><p>x"])
def test_time_is_linear(piece):
    start = time.time()
    main_texts([piece * 60_000], default_model())
    assert time.time() - start < 20


def test_chain_equals_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(0, 6, 4)
        n = int(lengths.sum())
        c = Chains(np.zeros(0, np.int64), np.zeros(n, np.int64), lengths, rng.integers(0, 2, n))
        odds, steps = rng.normal(size=n), rng.normal(size=(2, 2, 2))
        label, (p, pairs) = viterbi(c, odds, steps), marginals(c, odds, steps)
        expected = np.zeros((2, 2, 2))
        for end, size in zip(np.cumsum(lengths), lengths, strict=True):
            at = range(end - size, end)
            total, mass, best = 0.0, np.zeros(size), (-np.inf, ())
            moved = np.zeros((2, 2, 2))
            for y in itertools.product((0, 1), repeat=int(size)):
                value = sum(odds[k] * v for k, v in zip(at, y, strict=True)) + sum(steps[c.same[k], a, b] for k, a, b in zip(at[1:], y, y[1:], strict=False))
                weight = np.exp(value)
                total, mass, best = total + weight, mass + weight * np.array(y), max(best, (value, y))
                for k, a, b in zip(at[1:], y, y[1:], strict=False):
                    moved[c.same[k], a, b] += weight
            assert np.allclose(p[list(at)], mass / total) and tuple(label[list(at)]) == best[1]
            expected += moved / total
        assert np.allclose(pairs, expected)


def test_held_out_layouts():
    pages = labelled_pages(250, seed=41)  # drawn by another seed than those for training
    hits = wrong = missed = 0
    for page, got in zip(pages, main_texts([re.sub(r' data-main="."', "", p) for p in pages], default_model()), strict=True):
        want = " ".join(b.text for b in leaf_blocks(page)[0] if b.main).split()
        same = len(want) if got.split() == want else sum(a == b for a, b in zip(got.split(), want, strict=False))
        hits, wrong, missed = hits + same, wrong + len(got.split()) - same, missed + len(want) - same
    assert hits / (hits + wrong) > 0.9 and hits / (hits + missed) > 0.9


def test_parts_that_are_not_the_article():
    page = """<body><header><h1>The Daily</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies.</div>
      <main><article><h1>Big news today</h1><p>First paragraph of the story, long enough to be read as one.</p><div class="ad">Buy now.</div>
      <p>Short.</p><h2>More of it</h2><p>Second &amp; last
      paragraph, which goes on for some time as well, and then it ends.</p></article>
      <section class="comments"><h3>Comments</h3><div class="comment"><p>I do not think that this is right at all, as I said before.</p></div></section></main>
      <aside class="sidebar"><h3>Related</h3><p>Other things happened.</p></aside><form class="newsletter"><p>Sign up for updates.</p></form><footer>&copy; 2024</footer>"""
    want = "Big news today First paragraph of the story, long enough to be read as one. Short. More of it Second & last paragraph, which goes on for some time as well, and then it ends."
    assert main_texts([page], default_model()) == [want]


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_extract.extract_main(pages, keep=("page_id", "url", "html")[:2]).join(pages, ["page_id", "url"]).collect():
        assert r.text == " ".join(b.text for b in leaf_blocks(r.html)[0] if "in:article" in b.marks)


def test_odd_rows(spark):
    rows = [(1, None, None, "k"), (2, "u", "", "k"), (3, "u", " \n ", "k"), (None, "u", "plain text only, and a lot of it. " * 500, "k"), (5, "u", "<p>" + "x" * 200_000, "k"), (6, "u", "<nav>a</nav>", "k"), (6, "u", "<nav>a</nav>", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, score string")
    out = html_extract.extract_main(pages).collect()
    assert len(out) == len(rows) and all(r.text is not None for r in out)
    assert {r.text for r in out if r.page_id in (1, 2, 3, 6)} == {""}
    assert html_extract.extract_main(pages.limit(0)).collect() == []
    untrained = html_extract.train([])
    assert [r.text for r in html_extract.extract_main(pages, untrained).collect()] == [""] * len(rows)
