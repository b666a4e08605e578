"""Which regions of a page are its article: cases that lost text once, and a brute-force choice of the region."""

import random

import numpy as np
import pytest

from talusgrid.llm import html_main


def p(n, word="text"):
    return f"<p>{f'some {word} stands here. ' * n}</p>"


def lines(n, *rows):
    return [x for x in (f"some {word} stands here. " * n for word in rows)]


CASES = {
    "a short block beside the long one": (f"<div id=w><div class=intro>{p(4, 'intro')}</div><div class=txt>{p(15, 'a')}{p(15, 'b')}</div></div>", ["intro", "a", "b"]),
    "two blocks side by side": (f"<div>{p(5, 'a')}</div><div>{p(26, 'b')}</div>", ["a", "b"]),
    "a remark as an article": (f"<main><h1>Head</h1>{p(20, 'a')}{p(9, 'b')}<div class=discussion><article>{p(9, 'remark')}</article></div></main>", ["Head", "a", "b"]),
    "a remark longer than the article": (f"<main><h1>Head</h1>{p(8, 'a')}<div class=discussion><article>{p(10, 'remark')}</article></div></main>", ["Head", "a"]),
    "an article in main": (f"<main><h1>Head</h1><p>By me</p><article>{p(15, 'a')}{p(15, 'b')}</article></main>", ["a", "b"]),
    "layout marks around the page": (f"<div class='page nav'><div id=content>{p(15, 'a')}{p(15, 'b')}</div></div>", ["a", "b"]),
    "a modal that is the page": (f"<div class='modal content'>{p(15, 'a')}{p(15, 'b')}</div>", ["a", "b"]),
    "alerts around the page": (f"<div class=alerts>{p(15, 'a')}{p(15, 'b')}</div>", ["a", "b"]),
    "a notice beside the article": (f"<div class=notice>{p(3, 'notice')}</div><div>{p(15, 'a')}{p(15, 'b')}</div>", ["a", "b"]),
    "comments longer than the article": (f"<article>{p(8, 'a')}</article><div class=comments>{p(40, 'remark')}</div>", ["a"]),
    "comments longer than a page without article": (f"<div>{p(8, 'a')}</div><div class=comments>{p(40, 'remark')}</div>", ["a"]),
    "a label in a sentence": (f"<article>{p(15, 'a')}<p>Price <label>per unit</label> is 3.</p></article>", ["a", "Price per unit is 3."]),
    "a fieldset outside forms": (f"<article>{p(15, 'a')}<fieldset>{p(4, 'b')}</fieldset></article>", ["a", "b"]),
    "a label in a form": (f"<article>{p(15, 'a')}<form><label>Mail</label><input></form></article>", ["a"]),
}


@pytest.mark.parametrize("case", CASES)
def test_region(case):
    html, want = CASES[case]
    got = html_main.main_lines(f"<html><body>{html}</body></html>")
    assert len(got) == len(want)
    for line, word in zip(got, want):
        assert line.startswith(f"some {word} ") or line == word


def test_clusters_must_be_apart():
    """Lines of one kind are all content, however they are split."""
    near, far = np.log1p(np.array([20.0, 30, 25, 45])), np.log1p(np.array([2.0, 3, 200, 150]))
    assert html_main.threshold(near) == near.min()
    assert (far >= html_main.threshold(far)).tolist() == [False, False, True, True]


def tree(rnd, depth=0):
    """Nested divs with paragraphs of two kinds, which a page of links surrounds."""
    out = ""
    for _ in range(rnd.randint(1, 3)):
        kind = rnd.random()
        if kind < 0.4 and depth < 3:
            out += f"<div>{tree(rnd, depth + 1)}</div>"
        elif kind < 0.8:
            out += p(rnd.randint(10, 30), f"w{rnd.randint(0, 10**6)}")
        else:
            out += "<ul>" + "".join(f"<li><a href=x>k{rnd.randint(0, 10**6)}</a></li>" for _ in range(4)) + "</ul>"
    return out


def test_region_is_the_common_ancestor_of_content():
    """Without articles: the innermost element around all content lines, found by walking up from every line."""
    rnd = random.Random(8)
    for _ in range(150):
        page = html_main.Lines().finish(f"<body>{tree(rnd)}</body>")
        if not page.lines:
            continue
        html = f"<body>{tree(rnd)}</body>"
        page = html_main.Lines().finish(html)
        if not page.lines:
            continue
        content = html_main.is_content(page.lines)

        def above(c, parents=page.parents):
            return [c, *above(parents[c])] if c >= 0 else []

        shared = set.intersection(*(set(above(x.container)) for x, y in zip(page.lines, content) if y))
        region = max(shared)
        first, last = np.flatnonzero(content)[[0, -1]]
        want = [x.text for k, x in enumerate(page.lines) if region in above(x.container) and not (x.linked * 2 > len(x.text) and not first <= k <= last)]
        assert html_main.main_lines(html) == want
