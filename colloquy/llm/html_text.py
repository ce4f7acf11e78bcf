"""Main text of HTML pages: flat text blocks classified by a small decision tree.

A page becomes a flat list of text blocks, one between two block-level tags. A decision tree, grown by
Gini impurity from the small labelled table below, classifies each block by its word count and link
density, those of its two neighbours, whether it is a heading, whether it stands inside an article or
main element, what marks it as page furniture, which share of the page's words stands where it stands (in
articles or outside), and how long a run of blocks of links it belongs to. The text is the chosen blocks in page order: a teaser in an
article element doesn't put out the text beside it, and a list of links goes or stays as a whole.

A block's mark is the strongest of the elements around it: 1 for an element whose class or id names
furniture, a hint that long blocks among long neighbours overrule; 2 for tags and roles of furniture
and for reader comments. An element's mark counts only if the element can be furniture: one that wraps
the article, or most of the page's words outside links, is a frame around the content.

Defined results: null and empty pages, and pages without content, give empty text and 0 characters.
Unclosed tags, cut pages and stray markup are read leniently, in time that grows with their length and not with
how deeply they nest. Repeated rows give repeated results. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, freeing, small_batches

SCHEMA = "page_id long, url string, text string, n_chars long"

INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
SKIPPED = set("script style title noscript template textarea iframe object svg math select option button head audio video canvas".split())
FURNITURE_TAGS = set("nav header footer aside form menu dialog".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of a class or id that name page furniture, and those that name reader comments.
FURNITURE_WORDS = set(
    "ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
COMMENT_WORDS = set("comment comments commentlist disqus replies reply respond".split())
HINTED, MARKED = 1, 2
#: Blocks of this link density or more count as links.
DENSE = 0.8

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^>"'<]|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/><]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.DOTALL)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)


@dataclass
class Element:
    """An open or closed element that bears a mark or holds an article."""

    mark: int  # 0, HINTED or MARKED
    comments: bool
    article: bool  # article or main itself
    late: bool  # begins after the page's first article
    parent: int  # place of the nearest element around it, or -1
    within: bool  # in an article, or one itself
    wraps: bool = False  # an article begins inside
    words: float = 0.0  # outside links; at first its own, then with those of the elements inside
    hinted: int = 0  # marks of each kind on itself and around it
    marked: int = 0


@dataclass
class Block:
    text: str
    words: int
    density: float
    heading: bool
    inside: int  # place of the nearest element around it, or -1
    title: bool = False  # a first-level heading in an article's own header
    article: bool = False
    mark: int = 0
    links: int = 0  # length of the run of blocks of links that it belongs to


def _mark(tag: str, attributes: str) -> tuple[int, bool]:
    """The mark of an element by its tag and attributes, and whether it names reader comments."""
    if tag in FURNITURE_TAGS:
        return MARKED, False
    if tag in ("body", "html") or "=" not in attributes:
        return 0, False
    found = 0
    for name, value in NAMED.findall(attributes):
        words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())
        if name.lower() == "role":
            if words[:1] and words[0] in FURNITURE_ROLES:
                return MARKED, False
        elif not COMMENT_WORDS.isdisjoint(words):
            return MARKED, True
        elif not FURNITURE_WORDS.isdisjoint(words):
            found = HINTED
    return found, False


class Blocks:
    """Reads a page into its flat blocks."""

    def __init__(self, page: str):
        self.found: list[Block] = []
        self.elements: list[Element] = []
        self.open: list[tuple[str, int]] = []  # tag, place of its element or of the nearest one around it, or -1
        self.tags = Counter[str]()  # how often each tag is open
        self.unclosed: set[str] = set()  # skipped elements that aren't closed in the rest of the page
        self.pieces: list[tuple[str, bool]] = []  # text, in a link
        self.in_link = self.heading = self.articles = False
        at = 0
        while match := MARKUP.search(page, at):
            self.say(page[at : match.start()])
            at = match.end()
            closing, tag, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
            if tag:
                tag = tag.lower()
                if tag in SKIPPED and not closing:
                    at = self.skipped(page, tag, at)
                else:
                    self.tag(tag, bool(closing), attributes or "")
        self.say(page[at:])
        self.end()
        self.weigh()

    def skipped(self, page: str, tag: str, at: int) -> int:
        """Where a skipped element ends: after its closing tag; without one, a page's head ends at its body, others at the page's end."""
        if tag not in self.unclosed:
            if end := _closing(tag).search(page, at):
                return end.end()
            self.unclosed.add(tag)  # nor will a later one find its end: each search that fails is made once
        if tag == "head" and "body" not in self.unclosed:
            if body := re.compile(r"<body\b", re.IGNORECASE).search(page, at):
                return body.start()
            self.unclosed.add("body")
        return len(page) if tag in ("script", "style", "title", "textarea") else at

    def say(self, text: str) -> None:
        if text:
            self.pieces.append((text, self.in_link))

    def tag(self, tag: str, closing: bool, attributes: str) -> None:
        if tag == "a":
            self.in_link = not closing
        elif tag in INLINE:
            if not closing and _mark(tag, attributes)[0] or closing and self.tags[tag]:
                self.block(tag, closing, attributes)
        elif tag in VOID:
            if tag in ("br", "hr"):
                self.say("\n")
        else:
            self.block(tag, closing, attributes)

    def block(self, tag: str, closing: bool, attributes: str) -> None:
        self.end()
        self.in_link = False
        if closing:
            while self.tags[tag]:
                if self.closed() == tag:
                    break
        else:
            self.opened(tag, attributes)
        self.heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()

    def closed(self) -> str:
        """Takes the innermost open tag off."""
        tag, _ = self.open.pop()
        self.tags[tag] -= 1
        return tag

    def opened(self, tag: str, attributes: str) -> None:
        mark, comments = _mark(tag, attributes)
        article = tag in ("article", "main") or not mark and any(n.lower() == "role" and v.strip("\"'").lower() in ("main", "article") for n, v in NAMED.findall(attributes))
        parent = self.open[-1][1] if self.open else -1
        if mark or article:
            at = parent if article else -1
            while at >= 0 and not self.elements[at].wraps:  # those around one that wraps wrap already
                self.elements[at].wraps = True
                at = self.elements[at].parent
            self.begin(tag, len(self.elements))
            self.elements.append(Element(mark, comments, article, self.articles, parent, article or parent >= 0 and self.elements[parent].within))
            self.articles = self.articles or article
        elif tag not in ("p", "li", "dt", "dd", "td", "th", "tr", "option"):
            self.begin(tag, parent)
        elif self.open and self.open[-1][0] == tag:
            self.closed()  # <p class=x>..<p>: an open one ends here

    def begin(self, tag: str, at: int) -> None:
        self.open.append((tag, at))
        self.tags[tag] += 1

    def end(self) -> None:
        """Closes the block at hand."""
        if self.pieces:
            text = " ".join(html.unescape("".join(t for t, _ in self.pieces)).split())
            if text:
                words = len(text.split())
                linked = min(words, sum(len(html.unescape(t).split()) for t, link in self.pieces if link))
                tag, inside = self.open[-1] if self.open else ("", -1)
                if inside >= 0:
                    self.elements[inside].words += words - linked
                title = self.heading and tag == "h1" and self.tags["header"] > 0 and inside >= 0 and self.elements[inside].within
                self.found.append(Block(text, words, linked / words, self.heading, inside, title))
            self.pieces = []

    def weigh(self) -> None:
        """Takes the marks off elements that frame the content, and gives each block its place."""
        total = sum(b.words * (1 - b.density) for b in self.found)
        for e in reversed(self.elements):  # from the inside out: parents come first
            if e.parent >= 0:
                self.elements[e.parent].words += e.words
        for e in self.elements:
            share = e.words / total if total else 0.0
            if e.wraps and not e.late and share >= 0.3 or share >= (0.95 if e.comments else 0.5) and not (e.article or self.articles and not e.wraps):
                e.mark = 0
            around = self.elements[e.parent] if e.parent >= 0 else None
            e.hinted = (e.mark == HINTED) + (around.hinted if around else 0)
            e.marked = (e.mark == MARKED) + (around.marked if around else 0)
        for b in self.found:
            if b.inside >= 0:
                own = self.elements[b.inside]
                marked = 0 if b.title and own.marked == 1 else own.marked  # an article's own header holds its title
                b.mark, b.article = MARKED if marked else HINTED if own.hinted else 0, own.within
        for (dense, _, _), own in groupby(self.found, lambda b: (b.density >= DENSE, b.mark, b.article)):
            if dense:
                run = list(own)
                for b in run:
                    b.links = len(run)


@lru_cache(maxsize=64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.IGNORECASE)


Features = tuple[float, ...]


def features(blocks: list[Block]) -> list[Features]:
    """Words and link density of each block and its neighbours, heading or not, in an article or not, its mark, the
    share of the page's words (outside links and marked blocks) that stands in its place, articles or the rest, and its run of links."""
    plain = [(b.words * (1 - b.density), b.article) for b in blocks if not b.mark]
    share = sum(w for w, article in plain if article) / (sum(w for w, _ in plain) or 1.0)
    none = Block("", 0, 0.0, False, -1)
    around = [none, *blocks, none]
    return [
        (float(b.words), b.density, float(before.words), before.density, float(after.words), after.density, float(b.heading), float(b.article), float(b.mark), share if b.article else 1 - share, float(b.links))
        for before, b, after in zip(around, blocks, around[2:], strict=False)
    ]


#: The labelled table. Columns: words, link density, the same of the block before and of the one
#: after, heading, in an article, mark (1 hinted by a name, 2 by tag, role or as comments), share of
#: the page's words in its place, length of its run of links, and 1 for main text.
LABELLED = """
 12 0.00   0 0.00  60 0.00  1 1 0 1.00 0   1
 60 0.00  12 0.00  45 0.00  0 1 0 1.00 0   1
 45 0.02  60 0.00   3 0.00  0 1 0 1.00 0   1
  3 0.00  45 0.02   9 0.00  0 1 0 1.00 0   1
  1 0.00  80 0.00  70 0.00  0 1 0 1.00 0   1
  1 0.00   2 0.00   1 0.00  0 1 0 1.00 0   1
  9 0.00   3 0.00   0 0.00  0 1 0 1.00 0   1
  2 0.00  55 0.00  18 0.00  1 1 0 1.00 0   1
 18 0.30   2 0.00  90 0.00  0 1 0 1.00 0   1
  6 1.00  90 0.00  40 0.00  0 1 0 1.00 1   1
 10 1.00   1 1.00  70 0.00  1 1 0 1.00 1   1
 20 0.90  35 0.05  60 0.10  0 1 0 1.00 1   1
150 0.00  12 0.00   2 1.00  0 1 0 1.00 0   1
  8 0.00   7 0.00  30 0.00  1 1 0 1.00 0   1
 14 0.00  40 0.00   9 0.00  0 1 0 1.00 0   1
  5 0.00  90 0.00   4 1.00  0 1 0 1.00 0   1
 11 0.00   7 0.00  21 0.00  1 1 0 1.00 0   1
  3 0.00  13 0.00   3 0.00  1 1 0 1.00 0   1
 66 0.00  65 0.00   1 0.00  0 1 0 1.00 0   1
  3 0.00 104 0.00   3 0.00  0 1 0 1.00 0   1
 63 0.00  54 0.00   0 0.00  0 1 0 1.00 0   1
120 0.00   0 0.00   0 0.00  0 1 0 1.00 0   1
 35 0.00   3 0.00   0 0.00  0 1 0 1.00 0   1
 28 0.00   1 0.00   0 0.00  0 1 0 1.00 0   1
 45 0.00   1 1.00   0 0.00  0 1 0 1.00 0   1
 50 0.00   3 1.00  60 0.00  0 1 0 1.00 0   1
  2 0.00   2 1.00   9 0.00  1 1 0 1.00 0   1
 12 0.00   4 1.00   8 0.00  0 1 0 1.00 0   1
  3 1.00   3 1.00   3 1.00  0 1 0 1.00 3   0
  4 1.00   5 1.00   6 1.00  0 1 0 1.00 3   0
  2 1.00   2 1.00   1 1.00  0 1 0 1.00 3   0
  6 0.95   5 1.00   7 0.90  0 1 0 1.00 3   0
  7 0.00   1 1.00  10 0.00  0 1 1 1.00 0   0
 10 0.00  60 0.00  50 0.00  0 1 1 1.00 0   0
 30 0.00  60 0.00  50 0.00  0 1 1 1.00 0   0
 14 0.10   8 0.00   6 0.50  0 1 1 1.00 0   0
  4 0.00  70 0.00   3 1.00  1 1 1 1.00 0   0
  2 1.00   2 1.00   2 1.00  0 1 1 1.00 3   0
 25 0.60  40 0.00  20 0.80  0 1 1 1.00 0   0
  7 0.00  80 0.00  90 0.00  0 1 1 1.00 0   0
 12 0.00   1 1.00 100 0.00  0 1 1 1.00 0   0
 30 0.00  90 0.00 100 0.00  0 1 1 1.00 0   0
 20 0.00  70 0.00  95 0.00  0 0 1 0.00 0   0
 45 0.00  30 0.00  85 0.00  0 1 1 1.00 0   0
 40 0.00  70 0.00  90 0.00  0 0 1 1.00 0   0
 70 0.00  60 0.00  50 0.02  0 1 1 1.00 0   1
 55 0.05  70 0.00  90 0.00  0 1 1 1.00 0   1
120 0.00  55 0.00  60 0.00  0 1 1 1.00 0   1
 60 0.00   3 1.00   4 1.00  0 1 1 1.00 0   0
 80 0.00   5 0.00   3 0.80  0 1 1 1.00 0   0
  1 1.00   1 1.00   1 1.00  0 0 2 0.00 3   0
  1 1.00   0 0.00   1 1.00  0 0 2 0.00 2   0
  1 1.00   1 1.00  12 0.00  0 0 2 0.00 2   0
 12 0.00   1 1.00  10 0.00  0 0 2 0.00 0   0
 40 0.00   1 1.00  10 0.00  0 0 2 0.00 0   0
 70 0.00  45 0.00  80 0.00  0 1 2 1.00 0   0
 45 0.00  70 0.00  30 0.00  0 1 2 1.00 0   0
  5 0.00  20 0.00  30 0.00  1 1 2 1.00 0   0
 60 0.00  60 0.00  80 0.00  0 1 2 1.00 0   0
120 0.00  90 0.00 100 0.00  0 1 2 1.00 0   0
 55 0.05  70 0.00  90 0.00  0 1 2 1.00 0   0
 70 0.00  60 0.00  50 0.02  0 1 2 1.00 0   0
120 0.00  55 0.00  60 0.00  0 1 2 1.00 0   0
 52 0.00  60 0.00  55 0.00  0 1 2 1.00 0   0
 57 0.00  55 0.00  70 0.00  0 0 2 0.00 0   0
 65 0.00  60 0.00  50 0.00  0 0 2 1.00 0   0
 90 0.00  65 0.00  70 0.00  0 0 2 1.00 0   0
 75 0.00  90 0.00  60 0.00  0 0 2 0.00 0   0
110 0.00  70 0.00  65 0.00  0 0 2 1.00 0   0
 90 0.00  60 0.00  90 0.00  0 0 2 0.00 0   0
  8 0.00  20 0.00  90 0.00  0 0 2 0.00 0   0
 60 0.00  70 0.00  90 0.00  0 1 2 1.00 0   0
 70 0.00  60 0.00  50 0.00  0 0 2 1.00 0   0
 95 0.00  80 0.00  90 0.00  0 0 2 1.00 0   0
 25 0.10  90 0.00  25 0.10  0 0 2 0.00 0   0
 14 0.00  45 0.00   0 0.00  0 0 1 0.00 0   0
 90 0.00  60 0.00  70 0.00  0 0 1 0.00 0   0
 65 0.00  80 0.00  60 0.00  0 0 1 0.00 0   0
 70 0.00  45 0.00  80 0.00  0 0 1 0.00 0   0
  8 0.00   1 1.00  12 0.00  0 0 1 0.00 0   0
 12 0.00   5 1.00  60 0.00  0 0 0 0.00 0   0
 30 0.00  60 0.00   0 0.00  0 0 0 0.00 0   0
  3 1.00   3 1.00   3 1.00  0 0 0 0.00 3   0
  4 0.00  40 0.00   4 0.00  1 0 0 0.00 0   0
 90 0.00   2 1.00  10 0.00  0 0 0 0.00 0   0
 60 0.00   2 1.00  55 0.00  0 0 0 0.00 0   0
 20 0.00  50 0.00  40 0.00  0 0 0 0.00 0   0
 12 0.00  60 0.00  60 0.00  0 0 0 0.00 0   0
 45 0.00  60 0.00  50 0.00  0 0 0 0.00 0   0
  3 0.00  20 0.00  60 0.00  0 0 0 0.00 0   0
  8 0.00   0 0.00  30 0.00  0 0 0 0.00 0   0
  9 0.00   2 0.00  60 0.00  1 0 0 0.00 0   0
 35 0.00  12 0.00   0 0.00  0 0 0 0.00 0   0
 60 0.00   8 0.00  55 0.00  0 0 0 1.00 0   1
  9 0.00   8 0.00  12 0.00  1 0 0 1.00 0   1
  3 0.00  13 0.00   3 0.00  1 0 0 1.00 0   1
 63 0.00  54 0.00   1 0.00  0 0 0 1.00 0   1
  3 0.00 104 0.00   3 0.00  0 0 0 1.00 0   1
 63 0.00  54 0.00   0 0.00  0 0 0 1.00 0   1
 40 0.00  12 0.00   0 0.00  0 0 0 1.00 0   1
120 0.00   0 0.00   0 0.00  0 0 0 1.00 0   1
 55 0.05  60 0.00  40 0.00  0 0 0 1.00 0   1
 40 0.00  55 0.05   3 1.00  0 0 0 1.00 0   1
 18 0.00  50 0.00  45 0.00  0 0 0 1.00 0   1
 25 0.00   0 0.00   0 0.00  0 0 0 1.00 0   1
  6 0.00  45 0.00  50 0.00  0 0 0 1.00 0   1
  2 0.00  60 0.00  40 0.00  0 0 0 1.00 0   1
  2 0.00  70 0.00   9 0.00  0 0 0 1.00 0   1
  1 0.00   9 0.00  30 0.00  0 0 0 1.00 0   1
  4 0.00  60 0.00  70 0.00  1 0 0 1.00 0   1
  8 0.00   2 1.00  60 0.00  1 0 0 1.00 0   1
  8 0.00   7 0.00  60 0.00  1 0 0 1.00 0   1
  9 0.00   0 0.00  80 0.00  1 0 0 1.00 0   1
 14 0.10  40 0.00  22 0.00  0 0 0 1.00 0   1
  5 1.00  60 0.00  45 0.00  0 0 0 1.00 1   1
  9 0.00  50 0.00  10 0.00  0 0 0 1.00 0   1
 12 0.00  45 0.00   0 0.00  0 0 0 1.00 0   1
  1 1.00   1 1.00   1 1.00  0 0 0 1.00 3   0
  2 1.00   0 0.00   2 1.00  0 0 0 1.00 2   0
  2 1.00   2 1.00  60 0.00  0 0 0 1.00 2   0
  5 0.80   3 1.00   4 1.00  0 0 0 1.00 3   0
 20 0.90  15 0.80  12 1.00  0 0 0 1.00 3   0
 30 0.70  50 0.00  20 0.90  0 0 0 1.00 0   0
  4 0.00   2 1.00   2 1.00  0 0 0 1.00 0   0
  3 0.00   5 1.00   6 1.00  1 0 0 1.00 0   0
  5 0.00   2 1.00   0 0.00  0 0 0 1.00 0   0
  6 0.20   4 1.00   3 1.00  0 0 0 1.00 0   0
  7 0.00   1 1.00   9 0.00  0 0 1 1.00 0   0
 10 0.00  60 0.00  50 0.00  0 0 1 1.00 0   0
 20 0.00  60 0.00   0 0.00  0 0 1 1.00 0   0
 65 0.00  60 0.00  50 0.00  0 0 1 1.00 0   1
 90 0.00  65 0.00  70 0.00  0 0 1 1.00 0   1
 60 0.00   1 1.00  20 0.00  0 0 2 1.00 0   0
 60 0.00  50 0.00  55 0.00  0 0 2 1.00 0   0
  2 1.00   2 1.00   2 1.00  0 0 2 1.00 3   0
 12 0.10  50 0.00   0 0.00  0 0 2 1.00 0   0
  5 0.00   2 1.00  60 0.00  1 0 2 1.00 0   0
  4 0.00 200 0.00   0 0.00  0 1 0 0.00 0   0
  2 0.00 120 0.00   9 0.00  1 1 0 0.10 0   0
  9 0.00   2 0.00 150 0.00  0 1 0 0.10 0   0
 14 0.00   0 0.00  80 0.00  0 1 0 0.10 0   0
 30 0.00   4 0.00  90 0.00  0 1 0 0.10 0   0
  2 1.00   9 0.00  70 0.00  0 1 0 0.10 1   0
 60 0.00  50 0.00   4 0.00  0 0 0 0.90 0   1
 25 0.00   2 0.00  60 0.00  0 0 0 0.90 0   1
200 0.00   0 0.00   3 0.00  0 0 0 0.90 0   1
 90 0.00  12 0.00   9 0.00  0 0 0 0.80 0   1
 70 0.00  60 0.00  50 0.00  0 0 0 0.45 0   0
 40 0.00   2 1.00  55 0.00  0 0 0 0.45 0   0
 12 0.00  50 0.00  60 0.00  0 0 0 0.40 0   0
  2 1.00  80 0.00   2 1.00  0 1 0 1.00 5   0
  2 1.00   2 1.00  90 0.00  0 1 0 1.00 5   0
  1 1.00  60 0.00   1 1.00  0 1 0 1.00 4   0
  5 1.00   6 1.00  40 0.00  0 1 0 1.00 3   0
  4 1.00  70 0.00   5 1.00  0 1 0 1.00 3   0
  6 1.00  50 0.00   6 1.00  0 1 0 1.00 2   1
  6 1.00   6 1.00  45 0.00  0 1 0 1.00 2   1
  2 1.00  60 0.00   2 1.00  0 0 0 1.00 5   0
  2 1.00   2 1.00  60 0.00  0 0 0 1.00 5   0
  1 1.00   0 0.00   1 1.00  0 0 0 1.00 2   0
  1 1.00   1 1.00   8 0.00  0 0 0 1.00 2   0
  2 0.00   1 1.00  60 0.00  1 0 0 1.00 0   1
  3 0.00   2 1.00  45 0.00  1 0 0 1.00 0   1
  2 0.00   3 1.00  90 0.00  1 0 0 0.90 0   1
  3 0.00  45 0.00   2 1.00  0 0 0 1.00 0   1
 10 0.00  70 0.00   1 1.00  0 0 0 1.00 0   1
 28 0.00  25 0.00   2 1.00  0 0 0 0.90 0   1
  2 1.00   0 0.00  60 0.00  0 0 0 1.00 1   0
  3 0.00   1 1.00   3 0.00  1 1 0 1.00 0   1
 60 0.00   2 0.00   2 1.00  0 0 0 1.00 0   1
  9 0.00   2 0.00   1 1.00  0 0 0 1.00 0   1
  2 0.00   2 0.00   2 1.00  0 0 0 1.00 0   1
 50 0.00   6 0.00  40 0.00  0 1 0 0.50 0   1
 18 0.00  50 0.00  20 0.00  0 1 0 0.50 0   1
 60 0.00  50 0.00   4 0.00  0 0 0 0.50 0   1
"""


class Tree:
    """A binary decision tree grown by Gini impurity until its leaves are pure or splits don't help."""

    def __init__(self, rows: list[Features], labels: list[int], depth: int = 8):
        self.value = int(2 * sum(labels) > len(labels))
        self.split: tuple[int, float] | None = None
        if depth and 0 < sum(labels) < len(labels) and (best := self._best(rows, labels)):
            column, cut = self.split = best
            low = [i for i, r in enumerate(rows) if r[column] <= cut]
            high = [i for i, r in enumerate(rows) if r[column] > cut]
            self.low, self.high = (Tree([rows[i] for i in own], [labels[i] for i in own], depth - 1) for own in (low, high))

    @staticmethod
    def _best(rows: list[Features], labels: list[int]) -> tuple[int, float] | None:
        def impurity(own: list[int]) -> float:
            share = sum(own) / len(own)
            return 2 * share * (1 - share) * len(own)

        found = None
        for column in range(len(rows[0])):
            values = sorted({r[column] for r in rows})
            for a, b in zip(values, values[1:], strict=False):
                cut = (a + b) / 2
                low = [y for r, y in zip(rows, labels, strict=True) if r[column] <= cut]
                high = [y for r, y in zip(rows, labels, strict=True) if r[column] > cut]
                cost = impurity(low) + impurity(high)
                if found is None or cost < found[0] - 1e-12:
                    found = (cost, column, cut)
        return found and found[1:]

    def judge(self, row: Features) -> int:
        node = self
        while node.split:
            node = node.low if row[node.split[0]] <= node.split[1] else node.high
        return node.value


@lru_cache(maxsize=1)
def default_tree() -> Tree:
    rows = [tuple(map(float, line.split())) for line in LABELLED.strip().splitlines()]
    return Tree([r[:-1] for r in rows], [int(r[-1]) for r in rows])


def main_text(page: str | None, tree: Tree | None = None) -> str:
    """The main text of a whole page."""
    if not page:
        return ""
    tree = tree or default_tree()
    blocks = Blocks(page).found
    return " ".join(b.text for b, row in zip(blocks, features(blocks), strict=True) if tree.judge(row))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length in code points of every row."""
    small_batches(pages.sparkSession)

    @freeing
    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, SCHEMA)
