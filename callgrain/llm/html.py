"""Main text of web pages by the distribution of line blocks.

Mark-up is stripped so that each block of a page becomes one line; scripts, styles, forms and other parts that hold no
text, and parts that are named as navigation, advertising, notices or comments, give none; a name counts as a whole, and not
where the part holds an article or main element that isn't inside another one. Hidden elements, and nav, footer, aside, menu
and dialog elements, give no text whatever they hold. Lines outside the article
count a quarter where the page marks one. The lengths of the lines are summed over sliding windows of ``WINDOW`` lines. The
text begins at the surge, where a sum first passes the threshold, and ends at the dive, after which the sums stay below
it; what lies between is kept, short lines included, and short lines beside it that aren't links. The threshold follows the
page's own sums.

A null or empty page has the empty text. Pages are independent, so ties and repeated rows give the same text again. Text
is never cut. Parsing is linear in the length of a page; broken mark-up is read as far as it goes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is not text, elements that are not part of an article, and elements within a line.
SILENT = frozenset("script style noscript template svg math iframe object canvas video audio select option textarea button title head".split())
ASIDE = frozenset("nav footer aside form menu dialog fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose end may be left out: the open ones that each closes as it begins, and the elements that keep what is open outside of them.
BLOCKS = frozenset("ul ol menu dl table td th article main section nav aside header footer form blockquote figure fieldset details dialog".split())
CELLS = frozenset("td th".split())
CLOSES = {"li": ({"li"}, BLOCKS), "dt": ({"dt", "dd"}, BLOCKS), "dd": ({"dt", "dd"}, BLOCKS), "td": (CELLS, {"table", "tr"}), "th": (CELLS, {"table", "tr"}),
          "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
#: Words in the class, id or role of an element that is not part of the article, and words that may stand beside them in a name.
_WORDS = (
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|comment-?list|consent|cookies?|disqus|footer|gdpr|masthead|menu|modal|nav|navbar|navigation"
    r"|newsletter|notices?|pager|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|site-?header|social|sponsor\w*|subscribe|toolbar|widgets?"
)
_BESIDE = r"site|page|global|main|primary|secondary|top|bottom|left|right|area|bar|block|box|buttons?|form|icons?|items?|links?|list|posts?|section|slot|unit|\d+"
NAMED = re.compile(rf"[_-]*(?:(?:{_BESIDE})[_-]+)*(?:{_WORDS})(?:[_-]+(?:{_WORDS}|{_BESIDE}))*[_-]*", re.I)
WINDOW = 3
LONG_LINE = 40
#: What a letter outside the article counts less where a page marks one.
OUTSIDE = 4

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|[\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "textarea", "title", "noscript", "iframe")}


def _is_aside(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is not part of the article, and whether it is one even if it holds an article."""
    if tag in ASIDE or (tag == "header" and not in_article):
        return True, tag not in ("form", "header", "fieldset")
    if not attributes or attributes.isspace() or tag in ("html", "body") or tag in ARTICLE:
        return False, False
    named = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" and value.lower() != "until-found" or name == "aria-hidden" and value.strip().lower() == "true":
            return True, True
        if name == "style" and re.search(r"display:\s*none", value, re.I):
            return True, True
        if name in ("class", "id", "role"):
            named = named or any(map(NAMED.fullmatch, value.split()))
        elif name == "aria-label":
            named = named or bool(NAMED.fullmatch("-".join(value.split())))
    return named, False


class Aside:
    """An element that is not part of the article unless one is found in it, and that around it."""

    def __init__(self, outer: Aside | None) -> None:
        self.outer, self.quiet = outer, True


class Line(NamedTuple):
    """Text of a block, and whether it stands in the article, is a heading, stands in a list, and has letters outside of links."""

    text: str
    article: bool
    heading: bool
    item: bool
    unlinked: bool


def lines(page: str) -> list[Line]:
    """The text of each block in page order."""
    out: list[Line] = []
    inside: list[Aside | None] = []  # of each line
    asides: list[Aside] = []
    aside: Aside | None = None
    piece: list[str] = []
    stack: list[tuple[str, bool, Aside | None]] = []
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each name
    muted = articles = 0
    at = 0
    unlinked = False

    def block() -> None:
        nonlocal piece, unlinked
        if piece:
            text = " ".join(unescape("".join(piece)).split())
            if text:
                out.append(Line(text, articles > 0, any(name in HEADINGS for name, _, _ in stack[-4:]), bool(places.get("li")), unlinked))
                inside.append(aside)
            piece, unlinked = [], False

    def close(depth: int) -> None:
        """Closes the element at this depth and all that is open inside it."""
        nonlocal muted, articles, aside
        while len(stack) > depth:
            name, quiet, own = stack.pop()
            if own:
                block()
                aside = own.outer
            places[name].pop()
            muted -= quiet
            articles -= name in ARTICLE

    def last(names: Iterable[str]) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=-1)

    while True:
        found = _TAG.search(page, at)
        if not muted:
            piece.append(page[at : found.start() if found else len(page)])
            unlinked = unlinked or not places.get("a") and any(map(str.isalnum, piece[-1]))
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            block()
        elif tag == "br" and not muted:
            piece.append(" ")
        if found[1]:
            # closes the nearest open element of that name, and what was left open inside it
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID or found[3].endswith("/") and tag not in ARTICLE:
            continue
        if tag == "p" and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in CLOSES:
            depth = last(CLOSES[tag][0])
            if depth > last(CLOSES[tag][1]):
                close(depth)
        quiet, own = tag in SILENT, None
        if not quiet:
            quiet, always = _is_aside(tag, found[3], articles > 0)
            if quiet and not always and tag not in INLINE:
                quiet, own = False, Aside(aside)
                aside = own
                asides.append(own)
        if tag in ARTICLE and not articles and not muted:
            around = aside
            while around and around.quiet:
                around.quiet, around = False, around.outer
        places[tag].append(len(stack))
        stack.append((tag, quiet, own))
        muted += quiet
        articles += tag in ARTICLE
    block()
    for x in asides:  # those outside come first
        x.quiet = x.quiet or bool(x.outer and x.outer.quiet)
    return [x for x, own in zip(out, inside) if not (own and own.quiet)]


def between(sizes: list[int]) -> tuple[int, int]:
    """First line of the text and the one after its last: the surge and the dive of the window sums."""
    if not any(sizes):
        return 0, 0
    sums = np.convolve(sizes, np.ones(WINDOW, int), "valid") if len(sizes) >= WINDOW else np.array([sum(sizes)])
    # half the sum around a usual letter of this page, so that pages of short lines have a surge too
    threshold = min(LONG_LINE * WINDOW, (sums.astype(float) ** 2).sum() / sums.sum() / 2)
    over = np.flatnonzero(sums >= threshold)
    # a window surges or dives with the lines at its edge that hold text worth a window's share
    long = [k for k in range(int(over[0]), min(int(over[-1]) + WINDOW, len(sizes))) if sizes[k] >= threshold / WINDOW]
    return long[0], long[-1] + 1


def _goes_on(line: Line, below: bool) -> bool:
    """Whether a short line beside the text belongs to it: lines of several words that aren't links, headings above, lists below."""
    return line.unlinked and (" " in line.text or below and line.item and len(line.text) > 1) or not below and line.heading


def main_text(page: str) -> str:
    found = lines(page)
    marked = any(x.article for x in found)
    first, last = between([len(x.text) if x.article or not marked else len(x.text) // OUTSIDE for x in found])
    # a text that begins or ends in an article goes on to the edge of that
    for end, below in ((0, False), (len(found), True)):
        at = last if below else first
        edge = last - 1 if below else first
        while at != end:
            line = found[at if below else at - 1]
            if not (line.article if found[edge].article else _goes_on(line, below)):
                break
            at += 1 if below else -1
        first, last = (first, at) if below else (at, last)
    return "\n\n".join(x.text for x in found[first:last])


def extract(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Adds the main text of each page. A column of that name in the input is replaced."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array((main_text(x.as_py() or "") for x in column), pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(text, F.arrow_udf(run, "string")(F.col(html)))
