"""Shapes of articles that pages really have, marked and unmarked, the best stretch by brute force, and pages built to be slow."""

import itertools
import random
import time

import pytest

from tidewatch.llm import main_text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def weights(spark):
    return main_text.learn(spark.read.parquet(f"{SF}/pages.parquet"))


def text(n, k=itertools.count()):
    return " ".join(f"w{next(k)}" for _ in range(n))


def element(name, n):
    t = text(n)
    return f"<{name}>{t}</{name.split()[0]}>", [t]


def many(outer, items, inner="{}"):
    html, words = "", []
    for h, w in items:
        html += inner.format(h)
        words += w
    return f"<{outer}>{html}</{outer}>", words


INNER = {
    "list 5x5": lambda: many("ul", [element("li", 5) for _ in range(5)]),
    "list 8x13": lambda: many("ol", [element("li", 13) for _ in range(8)]),
    "list 20x3": lambda: many("ul", [element("li", 3) for _ in range(20)]),
    "table": lambda: many("table", [many("tr", [element("td", 2), element("td", 1), element("td", 1)]) for _ in range(20)]),
    "table with head": lambda: many("table", [many("thead", [many("tr", [element("th", 1), element("th", 1)])]), many("tbody", [many("tr", [element("td", 1), element("td", 2)]) for _ in range(9)])]),
    "definitions": lambda: many("dl", [x for _ in range(8) for x in (element("dt", 2), element("dd", 9))]),
    "figure": lambda: many("figure", [element("figcaption", 12)], "<img src='x'>{}"),
    "quote": lambda: many("blockquote", [element("p", 20)]),
    "sections": lambda: many("section", [x for _ in range(3) for x in (element("h2", 4), element("p", 12))]),
    "linked paragraph": lambda: (f"<p>{(a := text(4))} <a href='#'>{(b := text(5))}</a> {(c := text(3))}</p>", [f"{a} {b} {c}"]),
}
NAV = "<div><ul>" + "".join(f"<li><a href='/{i}'>menu{i}</a></li>" for i in range(7)) + "</ul></div>"


@pytest.mark.parametrize("shape", INNER)
@pytest.mark.parametrize("wrapper", ["article", "div", 'div class="share-page"', 'div class="form-page"', 'div id="notice-page"', 'div class="legal-page"', 'div class="content"', "form"])
@pytest.mark.parametrize("lead", [15, 100])
def test_whole_articles(weights, shape, wrapper, lead):
    """Lists, tables, definitions, figures and quotes stay, whatever the page's wrapper is called; menus, adverts and footers go."""
    parts = [element("h1", 6), element("p", lead), INNER[shape](), element("p", 30)]
    inside, want = "".join(h for h, _ in parts), "\n".join(t for _, w in parts for t in w)
    footer = f"<footer>{text(9)}</footer>"
    for page in (f"<nav>{NAV}</nav><div class='ad'>{text(7)}</div><{wrapper}>{inside}</{wrapper.split()[0]}>{footer}", f"{NAV}<{wrapper}>{inside}</{wrapper.split()[0]}>{footer}"):
        assert main_text.extract(f"<html><body>{page}</body></html>", weights) == want


@pytest.mark.parametrize("name", ["comment-body", "post-comments", "sidebar-content", "newsletter-text", "main-footer", "entry-related"])
@pytest.mark.parametrize("inside", [True, False])
def test_other_parts_whatever_else_they_are_called(weights, name, inside):
    (h1, a), (p, b), (q, c) = element("h1", 5), element("p", 40), element("p", 20)
    part = f"<div class='{name}'><p>{text(60)}</p></div>"
    page = f"<div class='main'>{h1}{p}{part if inside else ''}{q}</div>{'' if inside else part}"
    assert main_text.extract(page, weights) == "\n".join([*a, *b, *c])


def test_wrappers_without_headings(weights):
    """Nearly all of a page is no part of it, but for comments."""
    p, want = element("p", 85)
    for name in ("share-page", "form-page", "notice", "x-page"):
        assert main_text.extract(f"<div class='{name}'>{p}</div>", weights) == want[0]
    assert main_text.extract(f"<div class='comments'><p>{text(500)}</p></div>{p}", weights) == want[0]


def test_best_stretch_by_brute_force(weights):
    """The scan's sum is the greatest of all stretches."""
    rnd = random.Random(4)
    for _ in range(150):
        page = "".join(rnd.choice(["<p>", "</p>", "<li>", "<a>", "</a>", "<div class='ad'>", "</div>", "<td>", "<nav>", "</nav>", "<article>", "</article>", " one two ", "x", "<script>y z</script>"]) for _ in range(40))
        seen = main_text.Page(page)
        begin, end = main_text.stretch(seen, weights)
        values = list(main_text.scores(seen, weights))
        best = max((sum(values[i:j]) for i in range(len(values) + 1) for j in range(i, len(values) + 1)), default=0.0)
        assert abs(sum(values[begin:end]) - max(best, 0.0)) < 1e-9


@pytest.mark.parametrize("unit", ['<div class="a b c d e">', "<b>", "</i>", "<p><b>", "<div><p>x", "<ul><li><a>y"])
def test_linear_in_depth(weights, unit):
    def seconds(n):
        began = time.process_time()
        main_text.extract(unit * n, weights)
        return time.process_time() - began

    seconds(500)
    assert seconds(20_000) < 6 * seconds(5_000) + 0.5
