import html
import os
import re
import time

import numpy as np
import pytest

from leafgrid.llm import html_extraction as x
from leafgrid.llm.html_blocks import blocks


def test_blocks_and_references():
    page = "<html><head><title>T</title><style>p{}</style></head><body><!-- no --><script>var a='</p>';</script><h1>A &amp; B&copy;</h1><p>one<br>two\n  &nbsp;three<p><b>four</b> <a href=x>link</a><ul><li>x<li>y</ul>a < b"
    found = blocks(page)
    assert [b.text for b in found] == ["A & B©", "one two three", "four link", "x", "y", "a < b"]
    assert found[2].in_links == 4 and found[3].last == "li"
    assert blocks(None) == [] and blocks("") == [] and [b.text for b in blocks("<p>open &am")] == ["open &am"]


def test_held_out_layouts():
    field = x.trained()
    right = total = 0
    for seed in range(50_000, 50_080):
        own, labels = x.labelled(seed)
        right += sum(a == b for a, b in zip(labels, field.decode(own), strict=True))
        total += len(labels)
    assert right >= 0.98 * total


def test_viterbi_and_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    from itertools import product

    for n in (1, 2, 5):
        field = x.Field({str(k): k for k in range(n)}, rng.normal(size=(n, 2)), rng.normal(size=(2, 2)))
        own = [{str(k)} for k in range(n)]
        score = lambda ys: sum(field.weights[k][y] for k, y in enumerate(ys)) + field.moves[0][ys[0]] + sum(field.moves[a][b] for a, b in zip(ys, ys[1:], strict=False))  # noqa: B023, E731
        every = list(product((0, 1), repeat=n))
        assert tuple(field.decode(own)) == max(every, key=score)
        w = np.exp([score(y) for y in every])
        p, _ = x.marginals(field.weights, field.moves)
        assert np.allclose(p[:, 1], [sum(a for a, y in zip(w, every, strict=True) if y[k]) / w.sum() for k in range(n)])


def test_template_and_odd_rows(spark):
    page = '<body><nav><ul><li><a href="/a">Home page</a></li></ul></nav><div class="ad">Buy it now.</div><article><h1>Title of it</h1><p>First part of the text, with words.</p><p>Second part. <br></article><section class="comments"><p>I liked this, says a reader.</p></section><footer>&copy; site &middot; words.</footer></body>'
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (1, "u", page), (None, None, "<p")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in x.extract(pages).collect()}
    assert out[1].text == "Title of it\n\nFirst part of the text, with words.\n\nSecond part." and out[1].n_chars == len(out[1].text)
    assert out[2].text == "" == out[3].text and x.extract(pages).count() == 5
    assert x.extract(pages.where("false")).count() == 0


P = "In the spring of that year the river rose, and the lower fields were under water for weeks. The old people said that it had never been so high."
Q = "When the water fell again, the soil was black and rich. They sowed late, but the harvest was good, and nobody left."
#: Pages in layouts that the generator does not make, and their article.
PAGES = [
    (f"<html><body bgcolor=white><center><font face=arial><b>The river</b><br><br>{P}<br><br>{Q}</font></center></body></html>", f"The river {P} {Q}"),
    (f"<table><tr><td width=120><a href=a>Home</a><br><a href=b>Links</a></td><td>{P}<p>{Q}</td></tr></table>", f"{P}\n\n{Q}"),
    (f"<div id=wrapper><div id=top><a href=/>Site</a></div><div class=post-content><h2>The river</h2><p>{P}</p><div class='advertisement'>Buy shoes now!</div><p>{Q}</p></div>"
     "<div class='user-replies'><h4>Replies</h4><p>Great story, thank you for this.</p></div></div>", f"The river\n\n{P}\n\n{Q}"),
    (f"<main role=main><h1>T</h1><p>{P}</p><pre>x = 1</pre><p>{Q}</p></main><footer><p>Copyright 2020 by us. All rights reserved.</p></footer>", f"T\n\n{P}\n\nx = 1\n\n{Q}"),
    (P, P),
    (f"<div class=page><div class=left-menu><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div class=text>{P}<br>{Q}</div></div>", f"{P} {Q}"),
    (f"<article><p>{P} <math><mi>E</mi><mo>=</mo><mi>m</mi></math> <svg><title>icon</title><text>label</text></svg> <object>x</object><video>y</video></p></article>", f"{P} E=m label xy"),
]


@pytest.mark.parametrize("page, article", PAGES)
def test_unseen_layouts(page, article):
    assert x.main_text(page, x.trained()) == article


def test_whole_pages_of_held_out_seeds():
    """The text of a page is that of its labelled blocks, on nearly all pages."""
    field, right = x.trained(), 0
    for seed in range(60_000, 60_060):
        parts = x.labelled_page(seed)
        page, want, before = "", [], 0
        for text, label in parts:
            page += text
            found = blocks(page)
            want += [label] * (len(found) - before)
            before = len(found)
        want = "\n\n".join(b.text for b, y in zip(blocks(page), want, strict=False) if y)
        right += x.main_text(page, field) == want
    assert right >= 50


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables here")
def test_given_pages(spark):
    """The pages of the tables hold their article between tags of that name: cut by these, block by block."""
    for r in x.op2_html_extraction(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.sub(r"<!--.*?-->", "", re.search(r"<article>(.*?)</article>", r.html, re.S)[1], flags=re.S)
        inside = re.sub(r'<div class="ad">.*?</div>', "<p>", inside, flags=re.S).replace("<br>", " ")
        cut = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in re.split(r"</?(?:p|h1)[^>]*>", inside)]
        assert r.text == "\n\n".join(c for c in cut if c)


def test_page_emissions_are_those_of_the_sets():
    field = x.trained()
    for seed in range(70_000, 70_010):
        found = blocks("".join(t for t, _ in x.labelled_page(seed)))
        assert np.allclose(field.of_page(found), field.emissions(x.features(found)))


@pytest.mark.parametrize("make", [
    lambda n: "<div><p>x" * n, lambda n: "<div>" * n + "</p>" * n, lambda n: "<li><div>" + "<h1>" * n + "<li></li>" * n, lambda n: '<a "' * n, lambda n: "<a ='" * n,
    lambda n: "<" * n, lambda n: "<!-" * n, lambda n: "".join(f'<div class="{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}">x' for i in range(n)), lambda n: "<a href=x>y" * n,
])
def test_deep_and_broken_pages_take_time_by_their_size(make):
    took = []
    for n in (5_000, 50_000):
        began = time.process_time()
        x.main_text(make(n), x.trained())
        took.append(time.process_time() - began)
    assert took[1] < 40 * max(took[0], 0.02)


def test_quotes_and_scopes():
    text = lambda page: [b.text for b in blocks(page)]
    assert text("<p title='a > b'>x</p><p class=it's>y</p>z'") == ["x", "y", "z'"]
    assert text('<p class="open>x</p>y') == ["x", "y"]
    assert [b.tags for b in blocks("<ul><li>a<div><p>b<li>c</ul>d")] == [("ul", "li"), ("ul", "li", "div", "p"), ("ul", "li", "div", "p", "li"), ()]
