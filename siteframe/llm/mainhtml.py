"""Main text of HTML pages.

Events of the streaming parser of the standard library become lines: text between block borders, with the tags met on the way and
the containers around it. The text-to-tag ratio of the lines is smoothed with a Gaussian, and lines above a
threshold (k-means of two clusters on the ratios) are content. Content lines choose the region: the
smallest element that holds all of their text. It is kept whole, so that short paragraphs and headings
inside an article stay; of the lines around it those stay that are not mostly links. An article or main part is one element, whatever is inside.
Parts that are never content (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of readers) are told by element,
role, class or id and are no candidates. If a page marks an article or main part, only lines inside such parts are candidates, unless
nine tenths of the text of content lines are elsewhere, as where a short teaser is marked. Work grows with the length of a page, however deep its elements.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from siteframe.llm.common import map_texts

SIGMA = 1.0
#: Fixed values of HTML: elements without end, elements that flow inside a line, elements whose content is no text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt rtc ruby s samp small "
                   "span strike strong sub sup time tt u var wbr img".split())
SILENT = frozenset("script style noscript template head title svg math canvas iframe object video audio select textarea option button "
                   "datalist meter progress map".split())
OUTSIDE = frozenset("nav header footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
MAIN = frozenset(("article", "main"))
#: Elements that an element of the list closes when it begins inside them.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Words of class and id that mark page parts which are no content.
PART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget widgets related recommended share sharing social newsletter subscribe signup login popup modal "
    "overlay cookie cookies consent gdpr notice notices alert disclaimer comment comments disqus reply replies respond form search pagination pager "
    "toolbar skip copyright".split())
#: Of these, those that also tell of an article that it is none; and words in front that negate.
NO_ARTICLE = frozenset("comment comments reply replies related ad ads advert promo sponsored".split())
NEGATING = frozenset("no has with without".split())
#: A first word that one of these follows is part of a name, as in "search results" or "form of life".
FOLLOWED = frozenset("of in on to and or for from by the at work works result results".split())
#: Words that tell wherever they stand in a mark; the others do as its first or last word.
STRONG = frozenset("comment comments advert adverts advertisement sponsored cookie cookies consent gdpr newsletter disqus navbar breadcrumb breadcrumbs".split())
#: Elements that hold lines and not other elements; regions are elements around them.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre".split())
_PART = re.compile(r"[a-z]+")


@dataclass
class Line:
    """Text between two block borders."""

    text: list[str] = field(default_factory=list)
    tags: int = 0
    main: bool = False
    region: int = 0
    linked: int = 0
    words: str = ""


def names_part(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether attributes tell that an element is a page part without content."""
    values = dict(attrs)
    if (values.get("role") or "").strip().lower() in ROLES or "hidden" in values or values.get("aria-hidden") == "true":
        return True
    telling = NO_ARTICLE if tag in MAIN or tag in INLINE else PART_WORDS
    for mark in f"{values.get('class') or ''} {values.get('id') or ''}".split():
        words = _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", mark).lower())
        if not words or words[0] in NEGATING:
            continue
        first = words[0] in telling and not FOLLOWED.intersection(words[1:2])
        if first or words[-1] in telling or not telling.isdisjoint(STRONG.intersection(words)):
            return True
    return False


class Lines(HTMLParser):
    """Cuts a page into lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.line = Line()
        self.open: list[tuple[str, bool, bool, int]] = []  # element, hides its content, is a main part, number as a region
        self.depth: Counter = Counter()  # open elements of a name
        self.hidden = self.main = self.region = 0
        self.around, self.last = [0], [0]  # of each region, the one around it and the last one inside it; 0 is the page

    def _border(self) -> None:
        if self.line.text:
            self.line.words = " ".join("".join(self.line.text).split())
            if self.line.words:
                self.lines.append(self.line)
        self.line = Line(main=self.main > 0, region=self.region)

    def _pop(self) -> None:
        tag, hides, main, region = self.open.pop()
        self.depth[tag] -= 1
        self.hidden -= hides
        self.main -= main
        if region:
            self.last[region] = len(self.last) - 1
            self.region = self.around[region]
            self._border()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self._border()
        self.line.tags += 1
        if tag in VOID:
            return
        closes = CLOSED_BY.get(tag, ())
        while self.open and self.open[-1][0] in closes:
            self._pop()
        inner = tag == "header" and self.main > 0  # the heading of an article
        hides = tag in SILENT or (tag in OUTSIDE and not inner) or (tag not in ("html", "body") and not inner and names_part(tag, attrs))
        main = tag in MAIN and not hides and not self.hidden
        # Inside a main part there are no smaller regions.
        region = 0
        if tag not in INLINE and tag not in LEAVES and not self.main:
            region = len(self.around)
            self.around.append(self.region)
            self.last.append(region)
            self.region = region
        self.open.append((tag, hides, main, region))
        self.depth[tag] += 1
        self.hidden += hides
        self.main += main
        if region:
            self._border()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in SILENT:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._border()
        self.line.tags += 1
        left = self.depth[tag] - 1
        while left >= 0 and self.depth[tag] > left:
            self._pop()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.line.text.append(data)
            if self.depth["a"] > 0:
                self.line.linked += len("".join(data.split()))

    def finish(self) -> None:
        self.close()
        while self.open:
            self._pop()
        self._border()


def ratios(lines: list[Line]) -> np.ndarray:
    """Characters of a line for each tag, smoothed over the lines around it."""
    raw = np.array([len(x.words) / max(1, x.tags) for x in lines], float)
    reach = int(np.ceil(3 * SIGMA))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    return np.convolve(np.pad(raw, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """Border between the two clusters of the values."""
    low, high = float(values.min()), float(values.max())
    while True:
        border = (low + high) / 2
        below, above = values[values <= border], values[values > border]
        new = (float(below.mean()), float(above.mean())) if len(below) and len(above) else (low, high)
        if new == (low, high):
            return border
        low, high = new


def main_text(html: str) -> str:
    """The lines of the region with content, joined by a space; empty if there are none."""
    parser = Lines()
    last = html.rfind("<")
    if last >= 0 and ">" not in html[last:] and (html[last + 1:last + 2].isalpha() or html[last + 1:last + 2] in ("/", "!")):
        html = html[:last]  # the page breaks off inside a tag
    parser.feed(html)
    parser.finish()
    lines = parser.lines
    if not lines:
        return ""
    content = content_lines(lines)
    marked = [x for x in lines if x.main]
    if marked:
        whole = sum(len(x.words) for x, c in zip(lines, content, strict=True) if c)
        inside = sum(len(x.words) for x, c in zip(lines, content, strict=True) if c and x.main)
        if 10 * inside > whole:
            lines, content = marked, content if len(marked) == len(lines) else content_lines(marked)
    held = [0] * len(parser.around)
    for line, c in zip(lines, content, strict=True):
        held[line.region] += len(line.words) if c else 0
    for r in range(len(held) - 1, 0, -1):  # regions are numbered from the outside to the inside
        held[parser.around[r]] += held[r]
    region = max(r for r, size in enumerate(held) if size == held[0])
    return " ".join(x.words for x in lines if region <= x.region <= parser.last[region] or not region or not mostly_links(x))


def content_lines(lines: list[Line]) -> list[bool]:
    smooth = ratios(lines)
    return (smooth >= threshold(smooth)).tolist()


def mostly_links(line: Line) -> bool:
    return 2 * line.linked > len("".join(line.words.split()))


TEXT_FIELD = StructType([StructField("text", StringType())])


def extract(pages: DataFrame, keep: list[Column], html: str = "html") -> DataFrame:
    """The columns `keep` and the main text of every row.

    A null or empty page has an empty text, as has one without content. Pages count whole, whatever their
    length; repeated rows get equal texts, an empty table an empty result.
    """
    return map_texts(pages, html, TEXT_FIELD, lambda texts: [[main_text(t.decode("utf-8", "replace")) if t else "" for t in texts]], keep)
