"""Main text by densities against a second, recursive version of the formulas, on pages as they are and without names."""

import math
import re
import sys

import duckdb
import pytest
from conftest import TESTDATA

from panelforge.llm import density

PAGES = duckdb.sql(f"SELECT page_id, html FROM '{TESTDATA}/sf0.01/pages.parquet' ORDER BY page_id").fetchall()


def nameless(html):
    """All sections are plain ``div`` elements without class, id or role."""
    html = re.sub(r"<(/?)(article|nav|footer|header|main|aside|section)\b", r"<\1div", html or "")
    return re.sub(r""" (class|id|role)=("[^"]*"|'[^']*')""", "", html)


class Node:
    def __init__(self, page, i):
        self.i, self.tag, self.out = i, page.tags[i], page.beside[i]
        self.children = [Node(page, j) for j in range(i + 1, len(page.tags)) if page.parents[j] == i]
        self.own = sum(len(re.sub(r"\s", "", text)) for (e, text) in page.texts if e == i and text)

    def texts(self, in_link=False):
        """(characters, characters in links) of the subtree without what is left out."""
        in_link = in_link or self.tag == "a"
        below = [c.texts(in_link) for c in self.children if not c.out]
        return sum(b[0] for b in below) + self.own, sum(b[1] for b in below) + self.own * in_link

    def elements(self):
        return [e for c in self.children if not c.out for e in (c, *c.elements())]

    def numbers(self, inside=False):
        c, lc = self.texts(inside)
        below = self.elements()
        return c, len(below), lc, sum(e.tag == "a" for e in below)


def formula(c, t, lc, lt, share):
    if c == 0:
        return 0.0
    one = lambda x: x if x else 1
    base = max(1.0, math.log(max(math.log(c / one(c - lc) * lc + share * c + math.e), 1e-9)))
    return c / one(t) * max(0.0, math.log(c / one(lc) * one(t) / one(lt))) / base


def held_by_recursion(page):
    root = Node(page, 0)
    share = root.numbers()[2] / max(root.numbers()[0], 1)
    nodes, value, total, inside = {}, {}, {}, {}

    def visit(node, linked):
        linked = linked or node.tag == "a"
        nodes[node.i], inside[node.i] = node, linked
        value[node.i] = 0.0 if node.out else formula(*node.numbers(linked), share)
        for c in node.children:
            visit(c, linked)
        parts = [value[c.i] for c in node.children]
        total[node.i] = sum(parts) if any(parts) else value[node.i]

    def largest(node):
        """The element of the subtree with the largest sum, the outermost and last of equals."""
        best = node.i
        for c in reversed(node.children):
            below = largest(c)
            if total[below] >= total[best] and total[below] > total[node.i]:
                best = below
        return best

    visit(root, False)
    path = [largest(root)]
    while path[-1]:
        path.append(page.parents[path[-1]])
    threshold = min(value[i] for i in path)
    frame = path[0]
    for child, parent in zip(path, path[1:]):
        c, t, lc, lt = (a - b for a, b in zip(nodes[parent].numbers(inside[parent]), nodes[child].numbers(inside[child])))
        if lc and formula(c, t - 1, lc, lt - (nodes[child].tag == "a"), share) < density.REST * value[path[0]]:
            break
        frame = parent
    chosen = {frame} | {largest(nodes[i]) for i in nodes if i and value[i] and value[i] >= threshold}

    def spread(node, above):
        now = (above or node.i in chosen) and not node.out
        held[node.i] = now
        for c in node.children:
            spread(c, now)

    held = {}
    spread(root, False)
    return [held[i] for i in range(len(page.tags))]


def parsed(html):
    page = density.Page()
    page.feed(html or "")
    page.close()
    return page


@pytest.mark.parametrize("change", [lambda h: h, nameless])
def test_densities_equal_the_recursive_version(change):
    sys.setrecursionlimit(20_000)
    for _, html in PAGES[::2]:
        page = parsed(change(html))
        assert density.content(page) == held_by_recursion(page) or page.texts == []


def test_no_tag_name_holds_the_article():
    """What is kept of a page is kept without the names, too; only unnamed side texts may come along."""
    for _, html in PAGES:
        text, plain = (density.main_text(h).split("\n") for h in (html, nameless(html)))
        assert set(text) <= set(plain) and len(plain) <= len(text) + 8
        renamed = re.sub(r"<(/?)article\b", r"<\1div", html or "")
        assert density.main_text(renamed).split("\n") == text


def test_links_are_left_out_by_density_alone():
    words = "Some plain words of the article that go on for a while. " * 4
    menu = "<div>" + "".join(f"<div><a href='/{i}'>Menu entry {i}</a></div>" for i in range(30)) + "</div>"
    html = f"<body>{menu}<div><div>Headline</div><div><div>{words}</div><div>{words}</div><div>Short.</div></div></div>{menu}</body>"
    line = " ".join(words.split())
    assert density.main_text(html) == "\n".join(["Headline", line, line, "Short."])


def test_numbers_of_a_small_page_by_hand():
    page = parsed("<div><p>abcd <a>ef</a></p><p>gh</p></div>")
    counted = dict(zip(page.tags, density.counts(page)))
    assert counted["div"] == (8, 3, 2, 1) and counted["a"] == (2, 0, 2, 0)
    base = math.log(math.log(8 / 6 * 2 + 2 / 8 * 8 + math.e))
    assert density.composite(8, 3, 2, 1, 0.25) == pytest.approx(8 / 3 * math.log(8 / 2 * 3 / 1) / max(base, 1))
    assert density.composite(0, 0, 0, 0, 0.5) == 0


def test_a_very_long_page_is_whole():
    html = "<body><nav><a>m</a></nav>" + "<p>word and more words</p>" * 60_000
    assert density.main_text(html).count("word and more words") == 60_000
