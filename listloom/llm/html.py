"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page; where a container (div, section, article, main, table
cell, body) begins or ends, blank lines stand between. A line weighs as many characters as it has, those of links a
quarter, and half of that if it stands bare in a container and in no paragraph, heading, list item or the like. Lines
of scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms and reader comments count nothing; a
header inside an article is part of it. What only a form or a word of a class, id or role says is believed of parts that
hold less than half of the page's weight, or stand beside an article or main element: many pages stand in one form, or in a box
whose class names their layout. Reader comments, and parts with no class but such words (`ad`, `sidebar`), are none of the
article however much they hold. The weights are summed over windows of WINDOW lines; text surges where the sum
is above the threshold, the smaller of SURGE and half of the largest sum, and dives where it falls to it or below.

The heaviest stretch between a surge and its dive, with others at least half as heavy, is the text. It is extended by
what is short at its edges (headline, byline, last paragraph): to all counted lines of the innermost container that
holds all of these stretches, or of the article or main element around that; if it is the page itself, each stretch is
extended to its own container, and in the page itself to lines that stand there directly; where two or more containers of them
are siblings of one shape (name and class), others of that shape with nothing but paragraphs belong to them. Kept lines are given in page
order, with the text of their links.

Null pages and pages without text give an empty string. Repeated pages give repeated rows. Very long pages are read
whole. Other columns pass through. An empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import table

#: Lines in a window.
WINDOW = 3
#: Weight in a window that begins a text on pages that have more than twice of it somewhere.
SURGE = 120
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>")
_WORDS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CLASS = re.compile(r"\bclass\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PARTS = re.compile(r"[-_0-9]+")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NOT_TEXT = frozenset("nav header footer aside button select menu dialog head".split())
_MAIN = frozenset("article main".split())
_CONTAINERS = frozenset("article body center div main section td".split())
_PAGE = frozenset(("", "html", "body"))
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote figcaption caption summary address".split())
#: Words of class, id and role attributes of parts that aren't the article.
_ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead topbar footer bottombar sidebar sidebars aside related recommended widget widgets cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments replies disqus "
    "form search pagination pager toolbar contentinfo complementary".split()
)
#: Those of reader comments.
_COMMENT_WORDS = frozenset("comment comments replies disqus".split())
#: Words that may stand beside them in a name (cookie-bar, site-header); beside others (share-price) they tell nothing.
_BESIDE_WORDS = frozenset(
    "area bar block bottom box btn button col column container content fixed frame global group holder inner item items label left link links list main module outer page panel "
    "primary right row secondary section site slot sticky thread top unit wrap wrapper zone".split()
)


class Line(NamedTuple):
    text: str
    weight: float
    container: int
    #: The innermost part that may be no part of the article, NONE, or NEVER where it is none for sure.
    doubt: int
    #: In a paragraph or the like, and without a link.
    plain: bool


NONE, NEVER = -1, -2


def _aside(name: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element may be no part of the article, by its name or a class, id or role; whether that is for sure."""
    if name in _NOT_TEXT:
        found = not (name == "header" and in_main)
        return found, found
    if name in _MAIN or name in ("body", "html"):
        return False, False
    found, sure = name == "form", False
    for m in _WORDS.finditer(attributes) if "=" in attributes else ():
        only = name != "form"
        for word in (m[1] or m[2] or m[3] or "").lower().split():
            parts = [p for p in _PARTS.split(word) if p]
            if any(p in _ASIDE_WORDS for p in parts) and all(p in _ASIDE_WORDS or p in _BESIDE_WORDS for p in parts):
                found, sure = True, sure or any(p in _COMMENT_WORDS for p in parts)
                only &= all(p in _ASIDE_WORDS for p in parts)
            else:
                only = False
        sure |= found and only
    return found, sure


class Page(NamedTuple):
    """The blocks of a page with their innermost containers (two blank ones where a container begins or ends); name, class
    and parent of every container, and the part around each doubtful part, in the order in which they begin; the doubtful
    part around each article and main element."""

    lines: list[Line]
    names: list[str]
    shapes: list[str]
    parents: list[int]
    around: list[int]
    mains: list[int]


def lines(page: str) -> Page:
    page = _RAW.sub(" ", page)
    out: list[Line] = []
    piece: list[str] = []
    names, shapes, parents, inner = [""], [""], [-1], 0
    around: list[int] = []
    articles: list[int] = []
    opened: Counter[str] = Counter()
    stack: list[tuple[str, int, bool]] = []  # open elements: name, doubt around it, article or main
    at = mains = textual = links = linked = 0
    doubt = NONE

    def end() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(piece)).split())
        if text:
            weight = (len(text) - 0.75 * min(linked, len(text))) * (1 if textual else 0.5)
            out.append(Line(text, weight, inner, doubt, bool(textual) and not linked))
        piece.clear()
        linked = 0

    def close() -> None:
        nonlocal doubt, mains, textual, inner
        name, doubt, main = stack.pop()
        opened[name] -= 1
        mains, textual = mains - main, textual - (name in _TEXT)
        if name in _CONTAINERS:
            inner = parents[inner]
            blank()

    def blank() -> None:
        if out and out[-1].text:
            out.extend([Line("", 0.0, -1, NONE, False)] * (WINDOW - 1))

    for m in _TAG.finditer(page):
        if m.start() > at:
            piece.append(page[at : m.start()])
            if links:
                linked += len(piece[-1].strip())
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name == "a":
            links = 0 if m[1] else 1
        if name in _INLINE and not (m[3] and not m[1] and _aside(name, m[3], mains > 0)[0]) and not (m[1] and opened[name]):
            continue
        end()
        if name in _VOID or (m[3] and m[3].rstrip().endswith("/")):
            continue
        if not m[1]:
            if name == "p" and stack and stack[-1][0] == "p":  # a paragraph ends the one before it
                close()
            stack.append((name, doubt, name in _MAIN and doubt != NEVER))
            opened[name] += 1
            if stack[-1][2]:
                articles.append(doubt)
            found, sure = _aside(name, m[3], mains > 0)
            if doubt != NEVER and found:
                if sure:
                    doubt = NEVER
                else:
                    around.append(doubt)
                    doubt = len(around) - 1
            mains, textual = mains + stack[-1][2], textual + (name in _TEXT)
            if name in _CONTAINERS:
                blank()
                parents.append(inner)
                inner = len(names)
                names.append(name)
                shapes.append(kind[1].strip("\"'").lower() if (kind := _CLASS.search(m[3] or "")) else "")
        elif opened[name]:
            links = 0
            while True:
                last = stack[-1][0]
                close()
                if last == name:
                    break
    piece.append(page[at:])
    end()
    return Page(out, names, shapes, parents, around, articles)


def counted(page: Page) -> list[bool]:
    """Which lines count: those in no part that is none of the article for sure, nor in a doubtful one that holds less than
    half of the weight or not all article and main elements."""
    held, mains = [0.0] * len(page.around), [0] * len(page.around)
    for k in page.mains:
        if k >= 0:
            mains[k] += 1
    total = 0.0
    for x in page.lines:
        if x.doubt != NEVER:
            total += x.weight
            if x.doubt >= 0:
                held[x.doubt] += x.weight
    for k in range(len(held) - 1, -1, -1):
        if page.around[k] >= 0:
            held[page.around[k]] += held[k]
            mains[page.around[k]] += mains[k]
    dropped: list[bool] = []
    for k, up in enumerate(page.around):
        dropped.append(2 * held[k] < total or mains[k] < len(page.mains) or (up >= 0 and dropped[up]))
    return [bool(x.text) and x.doubt != NEVER and not (x.doubt >= 0 and dropped[x.doubt]) for x in page.lines]


def stretches(weight: np.ndarray, window: int, surge: float) -> list[tuple[int, int]]:
    """The ranges (end exclusive) from each surge of the windows' sums to its dive."""
    sums = np.convolve(weight, np.ones(window))[window - 1 :]  # of each line and those after it
    least = min(surge, float(sums.max()) / 2)
    high = sums > least
    out, k = [], 0
    while k < len(weight):
        if high[k] and weight[k]:
            first = k
            while k < len(weight) and high[k]:
                k += 1
            out.append((first, k))
        else:
            k += 1
    return out


def main_text(page: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    read = lines(page or "")
    all_, names, parents = read.lines, read.names, read.parents
    counts = counted(read)
    weight = np.array([x.weight if c else 0.0 for x, c in zip(all_, counts, strict=True)])
    if not weight.any():
        return ""
    found = stretches(weight, window, surge)
    heavy = [float(weight[a:b].sum()) for a, b in found]
    texts = [range(a, b) for (a, b), w in zip(found, heavy, strict=True) if 2 * w >= max(heavy)]

    def around(some: list[range]) -> int:
        """The innermost container of all lines of some stretches, or the article or main element around it."""
        own = [all_[k].container for r in some for k in r if counts[k]]
        a, b = min(own), max(own)
        while a != b:  # a container begins after those around it
            a, b = sorted((a, parents[b]))
        up = a
        while up > 0 and names[up] not in _MAIN:
            up = parents[up]
        return up if up > 0 else a

    whole = around(texts)
    roots = {whole}
    if names[whole] in _PAGE:
        roots = {around([r]) for r in texts}
        shape = lambda k: (parents[k], names[k], read.shapes[k])
        tops = {all_[k].container for r in texts for k in r if counts[k]}
        while deep := {k for k in tops if names[parents[k]] not in _PAGE}:
            tops = tops - deep | {parents[k] for k in deep}
        series = {s for s, n in Counter(map(shape, tops)).items() if n > 1 and s[1] not in _PAGE}
        if series:
            roots |= {k for k in range(1, len(names)) if shape(k) in series and names[k] not in _PAGE} - _not_plain(read, counts)
    within = [k in roots for k in range(len(names))]
    for k in range(1, len(names)):
        within[k] |= within[parents[k]] and names[parents[k]] not in _PAGE
    keep = np.zeros(len(all_), bool)
    for r in texts:
        keep[r.start : r.stop] = True
    return " ".join(x.text for k, x in enumerate(all_) if counts[k] and (keep[k] or within[x.container]))


def _not_plain(page: Page, counts: list[bool]) -> set[int]:
    """Containers with anything but paragraphs without links."""
    found = {x.container for x, c in zip(page.lines, counts, strict=True) if x.text and not (c and x.plain)}
    for k in range(len(page.names) - 1, 0, -1):
        if k in found:
            found.add(page.parents[k])
    return found


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with a column of main texts; a column of that name in pages is replaced."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None)

    return pages.withColumn(text, run(F.coalesce(F.col(html), F.lit(""))))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
