"""Main text of web pages from parser events, text-to-tag ratios and a clustered threshold.

html.parser streams events. Block-level tags cut the text into lines (pages often come as one physical
line); each line keeps its text, the number of tags met since the line before, its characters within
links and the element that holds it. A line's text-to-tag ratio is its characters outside links over
its tags. Ratios are smoothed by a Gaussian over neighbouring lines and split by the two-means
threshold of their logarithms; lines above it are seeds.

Seeds select the content regions: the article and main elements that hold one, or on pages without
such elements the innermost element that holds all seeds (text elements such as p, ul, pre aside). The
region's other lines stay too, so short paragraphs between long ones are kept, but for blocks without a
seed that are mostly links (menus within the region), and, where the region is the page's body, blocks
of it without a seed.

Markup can only veto lines. Elements that are boilerplate by tag (nav, footer, form, ...), role or being
hidden always do, and so does what lies outside all article and main elements where these have text. A
class or id does if it names a boilerplate block (ad, sidebar, cookie-notice, comments, ...; not
has-sidebar or nav-open), unless the element is a wrapper: it holds all the page's article and main
elements (or h1 headings, if there are none), or without it nothing would be left of a page with at
least two paragraphs or headings in it.

Open elements are kept as a stack with the places of each tag, and every element knows its parent, so
work and memory are linear in the page, however deep it nests.

Defined cases: a null or empty html, and one without content, give an empty text; what is not closed
is closed by the page's end; broken markup is read as html.parser reads it; rows are treated one by
one, so repeated rows and null keys come out as they came in; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from probestack.llm.shared import read_table

#: Tags that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td template textarea tfoot th thead title tr ul video audio canvas iframe noscript object".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never content.
BOILER_TAGS = frozenset("nav header footer aside form script style noscript template head title button select textarea menu iframe object svg canvas dialog fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
#: Words of a class or id that mark boilerplate.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promos banner banners sidebar "
    "sidebars rail widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer foot masthead topbar "
    "toolbar header cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond discussion "
    "skip search copyright legal disclaimer tags taglist byline-share".split()
)
#: Beginnings of such words (commentlist, cookiebar, ...).
BOILER_STARTS = ("comment", "cookie", "sidebar", "advert", "newsletter", "breadcrumb", "disqus", "sponsor")
#: Words that make a class say how a page looks, not what a block is (has-sidebar, nav-open).
STATE_WORDS = frozenset("has no with without is open opened closed active enabled disabled fixed sticky off on".split())
#: Words that mark an article as boilerplate; others may well name its kind or topic.
ARTICLE_WORDS = frozenset("comment comments reply related promo sponsored ad advert".split())
#: Tags that end an open p, as the html standard has it.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre search section table ul".split()
)
P_STOPS = frozenset("button article section div td th li".split())
#: An open element of the first kind is ended by the start of one of the second.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "head": {"body"}}
#: What each tag ends, and what such an end does not reach beyond.
ENDS = {tag: [own for own, by in ENDED_BY.items() if tag in by] for by in ENDED_BY.values() for tag in by}
LIST_STOPS = frozenset("ul ol dl table select".split())
SIGMA = 1.5
OWN = 2 / 3
_NAMES = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: A block without a seed with more than this part of its text in links, and so many lines, is a menu.
LINK_SHARE = 0.6
MENU_LINES = 3
#: Elements that are a piece of a text, never the whole of it.
TEXT_TAGS = frozenset("p b i u s a em strong small sub sup mark code kbd q cite abbr time span font label li ul ol dl dt dd pre blockquote h1 h2 h3 h4 h5 h6 figure figcaption".split())
LANDMARKS = ("article", "main")
PAGE = frozenset(("#page", "html", "body"))


class Line(NamedTuple):
    text: str
    tags: int
    element: int
    links: int  # characters within links


def named_boilerplate(tag: str, value: str) -> bool:
    """Whether a class or id names a boilerplate block."""
    for name in value.split():
        words = {x.lower() for x in _NAMES.split(name) if x}
        if words & STATE_WORDS:
            continue
        words.add("".join(c for c in name if c.isalnum()).lower())  # sideBar: side, bar and sidebar
        if tag == "article":
            if words & ARTICLE_WORDS:
                return True
        elif words & BOILER_WORDS or any(w.startswith(BOILER_STARTS) for w in words):
            return True
    return False


def vetoes(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
    """Whether an element is boilerplate for certain, and whether its class or id says so."""
    sure, named = tag in BOILER_TAGS, False
    for name, value in attrs:
        if name == "hidden":
            sure = True
        if not value:
            continue
        if name == "role" and value.strip().lower() in BOILER_ROLES or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            sure = True
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            named = named or named_boilerplate(tag, value)
    return sure, named


class Events(HTMLParser):
    """Turns parser events into lines and a tree of elements (children have higher numbers than their parents)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.names, self.parent, self.sure, self.named = ["#page"], [0], [False], [False]  # by element number
        self.open = [0]
        self.places: dict[str, list[int]] = {}  # of each open tag in the stack
        self.blocks = [0]  # places of open blocks
        self.parts: list[str] = []
        self.tags = self.links = 0

    def flush(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.lines.append(Line(text, self.tags, self.open[-1], self.links))
                self.tags = 0
            self.parts, self.links = [], 0

    def top(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def cut(self, place: int) -> None:
        """Close the elements from this place of the stack on."""
        while len(self.open) > place:
            self.places[self.names[self.open.pop()]].pop()
        while self.blocks[-1] >= max(place, 1):
            self.blocks.pop()

    def end_within(self, tag: str, stops: frozenset[str] | set[str]) -> None:
        place = self.top(tag)
        if place and place > max(map(self.top, stops), default=0):
            self.cut(place)

    def handle_starttag(self, tag, attrs) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        if tag in ENDS_P:
            self.end_within("p", P_STOPS)
        for own in ENDS.get(tag, ()):
            self.end_within(own, LIST_STOPS - {tag})
        sure, named = vetoes(tag, attrs)
        self.names.append(tag)
        self.parent.append(self.open[-1])
        self.sure.append(sure)
        self.named.append(named)
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append(len(self.names) - 1)

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path", "use", "g"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        place = self.top(tag)
        if place and (tag in BLOCKS or self.blocks[-1] < place):  # an inline end tag doesn't close blocks opened since
            self.cut(place)

    def handle_data(self, data) -> None:
        self.parts.append(data)
        if self.top("a"):
            self.links += len(data.strip())


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; weights are renewed at the ends."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k in range(-reach, reach + 1):
            if 0 <= i + k < len(values):
                total += kernel[k + reach] * values[i + k]
                weight += kernel[k + reach]
        out.append(total / weight)
    return out


def two_means(values: list[float]) -> float:
    """The threshold between the two clusters of values (one-dimensional k-means from the extremes)."""
    low, high = min(values), max(values)
    for _ in range(50):
        cut = (low + high) / 2
        below, above = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not above or not below:
            return cut
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _below(page: Events, own: list[int]) -> list[int]:
    """Sums over each element and all below it."""
    total = list(own)
    for e in range(len(total) - 1, 0, -1):
        total[page.parent[e]] += total[e]
    return total


def _inherited(page: Events, own: list[bool]) -> list[bool]:
    out = list(own)
    for e in range(1, len(out)):
        out[e] = out[e] or out[page.parent[e]]
    return out


def vetoed_elements(page: Events) -> list[bool]:
    """Of each element, whether its text is boilerplate by markup; class names give way to wrappers."""
    sure = _inherited(page, page.sure)
    named = list(page.named)
    names = page.names
    marks: list[int] = []
    for kinds in (LANDMARKS, ("h1",)):
        marks = [int(names[e] in kinds and not sure[e] and not (names[e] == "article" and named[e])) for e in range(len(names))]
        if any(marks):
            held, whole = _below(page, marks), sum(marks)
            named = [x and held[e] < whole for e, x in enumerate(named)]
            break
    pieces = _below(page, [int(names[e] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and not sure[e]) for e in range(len(names))])
    while True:
        out = _inherited(page, [a or b for a, b in zip(sure, named, strict=True)])
        if any(not out[line.element] for line in page.lines):
            return out
        above = _inherited(page, named)
        outermost = [e for e, x in enumerate(named) if x and not sure[e] and pieces[e] >= 2 and not above[page.parent[e]]]
        if not outermost:
            return out
        for e in outermost:
            named[e] = False


def seeds_of(lines: list[Line], useful: list[int]) -> set[int]:
    """Lines not mostly of links whose smoothed text-to-tag ratio lies in the upper of two clusters.

    Of these, the ones whose own ratio comes near the threshold of the ratios themselves (OWN of it, in
    logarithms), as smoothing lifts the neighbours of a long line; all useful lines where none is left.
    """
    ratios = [0.0] * len(lines)
    for i in useful:
        ratios[i] = max(0, len(lines[i].text) - lines[i].links) / max(1, lines[i].tags)
    smooth = [math.log1p(x) for x in smoothed(ratios)]
    cut = two_means(smooth)
    upper = {i for i in useful if smooth[i] > cut and lines[i].links <= LINK_SHARE * len(lines[i].text)}
    own = OWN * two_means([math.log1p(ratios[i]) for i in useful])
    return {i for i in upper if math.log1p(ratios[i]) > own} or upper or set(useful)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Events()
    page.feed(html)
    page.close()
    page.flush()
    lines, names, parent = page.lines, page.names, page.parent
    vetoed = vetoed_elements(page)
    useful = [i for i, line in enumerate(lines) if not vetoed[line.element]]
    marked = _inherited(page, [names[e] in LANDMARKS and not vetoed[e] for e in range(len(names))])
    if any(marked[lines[i].element] for i in useful):
        useful = [i for i in useful if marked[lines[i].element]]
    if not useful:
        return ""
    seeds = seeds_of(lines, useful)

    def sums(values) -> list[int]:
        own = [0] * len(names)
        for i in useful:
            own[lines[i].element] += values(i)
        return _below(page, own)

    n_seeds, n_lines = sums(lambda i: i in seeds), sums(lambda i: 1)
    chars, links = sums(lambda i: len(lines[i].text)), sums(lambda i: min(lines[i].links, len(lines[i].text)))
    region = [names[e] in LANDMARKS and not vetoed[e] and n_seeds[e] > 0 for e in range(len(names))]
    plain = not any(region)
    whole_page = False
    if plain:  # the innermost element that holds all seeds
        inner = max(e for e in range(len(names)) if n_seeds[e] == len(seeds) and names[e] not in TEXT_TAGS)
        region[inner], whole_page = True, names[inner] in PAGE
    inside = _inherited(page, region)
    out = [False] * len(names)
    for e in range(1, len(names)):
        if inside[e] and not region[e] and n_lines[e] and not n_seeds[e]:
            menu = links[e] > LINK_SHARE * chars[e] and (plain or names[e] in BLOCKS and n_lines[e] >= MENU_LINES)
            out[e] = menu or whole_page and region[parent[e]] and names[e] not in TEXT_TAGS
    out = _inherited(page, out)
    kept = [i for i in useful if inside[lines[i].element] and not out[lines[i].element]]
    if plain:
        kept = [i for i in kept if lines[i].links <= LINK_SHARE * len(lines[i].text)]
    return " ".join(lines[i].text for i in kept)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["text"] = [main_text(x) for x in pdf.pop("html")]
        pdf["n_chars"] = pdf["text"].str.len().astype("int64")
        yield pdf


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of pages (page_id, url, html)."""
    return pages.select("page_id", "url", "html").mapInPandas(_extract, "page_id long, url string, text string, n_chars long")


def op3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
