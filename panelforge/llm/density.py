"""Main text of web pages by composite text density.

For every element of the page, characters per tag are weighed by links: with C characters, T tags, LC characters and LT
tags inside links, and Cb, LCb those of the body, the density is

    C / T * log(C / LC * T / LT) / log(ln(C / (C - LC) * LC + LCb / Cb * C + e))

(zero denominators count as one). An element's density sum is the sum over its children. The element with the largest sum
holds the article; the lowest density on its path to the body is the threshold from which on other elements count as
content too, each with its own largest-sum subtree. Headlines and short paragraphs beside that element have low densities of
their own: on the way to the body, a parent takes its place if the rest of the parent has no link or, as one element, at least the share ``REST`` of that
element's density. Lists of links and scattered lines among them have not.

Before that, elements go that are no text (scripts, menus). Headers, forms and elements whose class, id or role names a
menu, sidebar, notice, advert or reader comments go only while they hold less than half of the page's text, no ``main`` and
no ``article`` of a quarter of it; otherwise, and if nothing else would be left, the densities decide. A name is a whole
token of such words, so that ``has-sidebar`` and ``entry-header`` are none. Null, empty and text-free pages give the empty text. Pages may be cut off or
nested wrongly; the tree is built without recursion. Work is per row, so that repeated rows and hot hosts need no care.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from panelforge.llm.common import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
NO_TEXT = frozenset(
    "applet audio button canvas datalist dialog embed footer frame frameset head iframe input map math menu nav noframes "
    "noscript object script select style svg template textarea title video aside".split()
)
#: Words in a class, id or role that name something beside the article.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner bannerad cookie cookies "
    "consent gdpr notice notices alert sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs comment "
    "comments commentlist disqus reply replies respond footer header masthead share sharing social related recommended "
    "newsletter subscribe subscription signup login popup modal overlay widget widgets pagination pager toolbar skip complementary "
    "contentinfo search".split()
)
#: Words that add no meaning to a name made of them and of ``BESIDE``.
NEUTRAL = frozenset(
    "site global main primary secondary left right top bottom box block bar wrapper wrap container inner outer slot unit area list "
    "item items links link buttons button icons posts articles stories form".split()
)
#: Share of the chosen element's density that the rest of a parent with links must have to belong to the article.
REST = 0.1
#: Shares of the page's text from which on a named element, or an article in it, is not left out.
LARGE, ARTICLE = 0.5, 0.25
FRAME = frozenset(("html", "body", "main", "article"))
#: A start tag closes these open elements, up to the nearest of the second list.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
SCOPES = frozenset("table td th caption button object html body".split())

_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _hidden(tag: str, attributes: list[tuple[str, str | None]]) -> bool:
    """Whether an element is never text of the page."""
    return tag in NO_TEXT or tag not in FRAME and any(name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attributes)


def _beside(tag: str, attributes: list[tuple[str, str | None]], framed: bool) -> bool:
    """Whether an element is named as something other than article text."""
    if tag == "form" or tag == "header" and not framed:
        return True
    if tag in FRAME:
        return False
    for name, value in attributes:
        if name in ("class", "id", "role") and value:
            for token in value.split():
                parts = {p.lower() for p in _PARTS.findall(token)}
                named = parts & BESIDE
                if named and parts <= BESIDE | NEUTRAL and not (framed and named == {"header"}):
                    return True
    return False


class Page(HTMLParser):
    """Elements of a page in document order, and its texts with the element that holds them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags = ["#page"]
        self.parents = [-1]
        #: Elements that are never text, those named as something else, and those left out in the end.
        self.hidden = [False]
        self.named = [False]
        self.beside = [False]
        self.open = [0]
        #: (element, text); None for a border between blocks.
        self.texts: list[tuple[int, str | None]] = []

    def _close(self, names: tuple[str, ...], scope) -> None:
        """Close the nearest open element of these names unless a scope element comes first."""
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[depth]]
            if tag in names:
                del self.open[depth:]
                return
            if tag in scope:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.texts.append((self.open[-1], None))
            self._close(("p",), SCOPES)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        parent = self.open[-1]
        framed = any(self.tags[i] in ("article", "main") for i in self.open) if tag == "header" or attrs else False
        self.tags.append(tag)
        self.parents.append(parent)
        self.hidden.append(self.hidden[parent] or _hidden(tag, attrs))
        self.named.append(_beside(tag, attrs, framed))
        if tag == "br":
            self.texts.append((parent, " "))
        elif tag not in VOID:
            self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.texts.append((self.open[-1], None))
        elif tag == "br":
            self.texts.append((self.open[-1], " "))
        self._close((tag,), () if tag in BLOCKS else ("td", "th", "table", "article", "body", "html"))

    def handle_data(self, data: str) -> None:
        self.texts.append((self.open[-1], data))

    def close(self) -> None:
        super().close()
        n = len(self.tags)
        #: Characters of every text without white space.
        self.sizes = [len("".join(text.split())) if text else 0 for _, text in self.texts]
        chars, frames = [0] * n, [False] * n
        for (i, _), size in zip(self.texts, self.sizes):
            if not self.hidden[i]:
                chars[i] += size
        for i in range(n - 1, 0, -1):
            chars[self.parents[i]] += chars[i]
        for i in range(n - 1, 0, -1):
            frames[i] = frames[i] or not self.hidden[i] and (self.tags[i] == "main" or self.tags[i] == "article" and chars[i] >= ARTICLE * chars[0])
            frames[self.parents[i]] = frames[self.parents[i]] or frames[i]
        self.beside = [False] * n
        for i in range(1, n):
            small = chars[i] < LARGE * chars[0] and not frames[i]
            self.beside[i] = self.hidden[i] or self.beside[self.parents[i]] or self.named[i] and small
        if not any(size and not self.beside[i] for (i, _), size in zip(self.texts, self.sizes)):
            self.beside = self.hidden


def composite(c: float, t: float, lc: float, lt: float, share: float) -> float:
    """Density of ``c`` characters and ``t`` tags, ``lc`` and ``lt`` of them in links; ``share`` is the body's share of link characters."""
    if not c:
        return 0.0
    inner = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
    base = math.log(inner) if inner > 1 else 0.0
    ratio = math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0))
    # A page without links has the logarithm's base e: the denominator is one.
    return c / max(t, 1) * ratio / (base if base > 1 else 1.0)


def counts(page: Page) -> list[tuple[int, int, int, int]]:
    """Characters, tags, and characters and tags in links of every element, without what is left out."""
    n = len(page.tags)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[page.parents[i]] or page.tags[i] == "a"
    for (i, _), size in zip(page.texts, page.sizes):
        if size and not page.beside[i]:
            chars[i] += size
            link_chars[i] += size if linked[i] else 0
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        if not page.beside[i]:
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (page.tags[i] == "a")
    return list(zip(chars, tags, link_chars, link_tags))


def densities(page: Page, counted: list[tuple[int, int, int, int]]) -> tuple[list[float], list[float]]:
    """Composite density and density sum of every element; an element without dense children is its own sum."""
    n = len(page.tags)
    share = counted[0][2] / max(counted[0][0], 1)
    density = [0.0 if page.beside[i] else composite(*counted[i], share) for i in range(n)]
    sums, leaf = [0.0] * n, [True] * n
    for i in range(1, n):
        sums[page.parents[i]] += density[i]
        leaf[page.parents[i]] = leaf[page.parents[i]] and not density[i]
    return density, [density[i] if leaf[i] else s for i, s in enumerate(sums)]


def content(page: Page) -> list[bool]:
    """Which elements hold the main text."""
    n = len(page.tags)
    counted = counts(page)
    density, sums = densities(page, counted)
    best = list(range(n))  # the element with the largest sum of each subtree, the outermost of equals
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        if sums[best[i]] >= sums[best[p]] and sums[best[i]] > sums[p]:
            best[p] = best[i]
    path = [best[0]]
    while path[-1]:
        path.append(page.parents[path[-1]])
    threshold = min(density[i] for i in path)
    share = counted[0][2] / max(counted[0][0], 1)
    frame = path[0]
    for below, parent in zip(path, path[1:]):
        c, t, lc, lt = (a - b for a, b in zip(counted[parent], counted[below]))
        # The element itself and its link, if it is one, are no part of the rest.
        rest = composite(c, t - 1, lc, lt - (page.tags[below] == "a"), share)
        if lc and rest < REST * density[path[0]]:
            break
        frame = parent
    held = [False] * n
    held[frame] = True
    for i in range(1, n):
        if density[i] and density[i] >= threshold:
            held[best[i]] = True
    for i in range(1, n):
        held[i] = (held[i] or held[page.parents[i]]) and not page.beside[i]
    return held


def main_text(html: str | None) -> str:
    """The article of a page: blocks in page order, one per line."""
    if not html:
        return ""
    page = Page()
    page.feed(html)
    page.close()
    held = content(page)
    blocks, now = [], []
    for i, text in page.texts:
        if text is None:
            blocks.append(now)
            now = []
        elif held[i]:
            now.append(text)
    blocks.append(now)
    lines = (" ".join("".join(block).split()) for block in blocks)
    return "\n".join(line for line in lines if line)


def extract(df: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row: the key columns, ``text`` and ``n_chars``; other columns are not read."""
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__html", 1 << 23):
            texts = [main_text(value) for value in batch.column("__html").to_pylist()]
            kept = [batch.column(f"__{k}") for k in keys]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return df.select(*[df[k].alias(f"__{k}") for k in keys], df[html].alias("__html")).mapInArrow(run, schema)
