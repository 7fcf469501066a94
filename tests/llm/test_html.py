"""Main text of pages: the scanner, the field against enumeration, layouts."""

import html
import itertools
import time

import numpy as np
import pytest

from waymark.llm import htmltext

SAID = "Several ordinary sentences stand here, one after the other, and they make up a paragraph of some length."
KEPT = [SAID, "Second " + SAID]


@pytest.mark.parametrize(("body", "want"), [
    (f"<nav><a href=x>Home</a></nav><article><h1>Title here</h1><p class=it's>{KEPT[0]}</p><p title=\"it's\">{KEPT[1]}</p></article>", ["Title here", *KEPT]),
    (f'<article><h1>Title here</h1><p>{KEPT[0]}</p><p>{KEPT[1]}</p><div id="disqus_thread"><p>I like this a lot, thanks.</p><p>Me too.</p></div></article>', ["Title here", *KEPT]),
    (f"<main><h1>Title here</h1><p>{KEPT[0]}</p><aside><p>Read this other piece, it is good.</p></aside><p>{KEPT[1]}</p></main>", ["Title here", *KEPT]),
    (f'<div id="wrap"><div id="c2"><p>{KEPT[0]}</p><p>{KEPT[1]}</p></div></div>', KEPT),
    (f"<div><div class=qz><p>{KEPT[0]}</p><p>{KEPT[1]}</p></div><div class='sidebar'><p>Other things.</p></div></div>", KEPT),
])
def test_layouts(body, want):
    assert htmltext.main_text(f"<html><body>{body}</body></html>", htmltext.trained()).split("\n") == want


def test_scanner_reads_tags_as_browsers_do():
    texts = lambda page: [b.text for b in htmltext.leaf_blocks(page)]
    assert texts("<p class=it's>one</p><p x='a>b' y=\"<p>\">two</p>") == ["one", "two"]
    assert texts("a < b <3 <p>c</p>") == ["a < b <3", "c"]
    assert texts('<p>x<a href="y"z>link</a> <img src=q/>end') == ["xlink end"]
    assert texts("<p>one<!-- <p>no --><!doctype x><p>two<script>if (a<b) '</p>'</SCRIPT >three") == ["one", "twothree"]
    assert texts("<p>kept<a href=") == ["kept"] and texts('<p>one<b title="never closed>two</b>') == ["onetwo"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>") == list("abcdefg")
    assert [b.link_chars for b in htmltext.leaf_blocks("<p>ab<a>cde</a>f</p>")] == [3]


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>x" * 60_000, '<a x="' * 90_000 + "<a x='" * 90_000, "<p><table>" + "<span>" * 60_000 + "<hr>" * 60_000, "<b>" * 80_000 + "</i>" * 80_000, "<ul>" + "<span>" * 60_000 + "<li></li>" * 60_000, "<script>" * 120_000, "<!--" * 250_000, "<a b" + " " * 500_000 + "=" + " " * 500_000, "<" * 500_000], ids=str.__len__)
def test_a_megabyte_of_anything_takes_seconds(page):
    start = time.perf_counter()
    htmltext.leaf_blocks(page)
    assert time.perf_counter() - start < 8  # a quadratic scan takes hours


def random_field(r):
    f = htmltext.Field()
    f.step = r.normal(size=(2, 2))
    return f


def total(e, step, path):
    return sum(e[i, y] for i, y in enumerate(path)) + sum(step[a, b] for a, b in itertools.pairwise(path))


def test_decoding_against_all_paths(monkeypatch):
    r = np.random.default_rng(4)
    for n in (1, 2, 5, 8):
        for _ in range(10):
            f, e = random_field(r), np.column_stack([np.zeros(n), r.normal(size=n)])
            monkeypatch.setattr(htmltext.Field, "emission", lambda _, b, e=e: float(e[b, 1]))
            best = max(itertools.product((0, 1), repeat=n), key=lambda p: total(e, f.step, p))
            assert tuple(f.decode(list(range(n)))) == best


def test_training_step_against_all_paths():
    """One step of AdaGrad from nothing has the sign of the likelihood's gradient, counted over all labellings."""
    r = np.random.default_rng(5)
    page = [([f"f{k}" for k in r.choice(6, 2, replace=False)], int(r.integers(0, 2))) for _ in range(6)]
    f = htmltext.Field()
    f.train([page], rounds=3, ridge=0.0)
    before, weight = f.step.copy(), dict(f.weight)
    e = np.array([[0.0, sum(weight.get(x, 0.0) for x in fs)] for fs, _ in page])
    paths = list(itertools.product((0, 1), repeat=6))
    p = np.exp([total(e, before, x) for x in paths])
    p /= p.sum()
    expected = np.array([sum(q for q, x in zip(p, paths, strict=True) if x[i] == 1) for i in range(6)])
    step = np.zeros((2, 2))
    for q, x in zip(p, paths, strict=True):
        for a, b in itertools.pairwise(x):
            step[a, b] -= q
    for a, b in itertools.pairwise([y for _, y in page]):
        step[a, b] += 1
    fore_aft, pull = f.expectations(e, page)
    assert np.allclose(fore_aft, expected) and np.allclose(pull, step)


def test_html_held_out_pages():
    field, wrong, all_ = htmltext.trained(), 0, 0
    for page, main in htmltext.labelled_pages(60, 77):
        want = [" ".join(html.unescape(m).split()) for m in main]
        got = htmltext.main_text(page, field).split("\n")
        wrong += len(set(want) ^ set(got))
        all_ += len(want)
    assert wrong <= 0.06 * all_


def test_html_rows(spark):
    article = "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>First  para&#233;\n one.<p>Second <b>bold</b> one.<!-- <p>no --></article><footer>&copy; x</footer></body>"
    pages = spark.createDataFrame([(1, "u", article, 1), (2, None, None, 2), (3, "v", "", 3), (None, "w", "<p>Unclosed " * 50, 4), (5, "x", "a < b <", 5)], "page_id long, url string, html string, n_chars long")
    got = {r["page_id"]: r for r in htmltext.extract(pages).collect()}
    assert got[1]["text"] == "A & B\nFirst paraé one.\nSecond bold one." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "" == got[3]["text"] and len(got) == 5
    assert htmltext.extract(pages.limit(0)).collect() == []


