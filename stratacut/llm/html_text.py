"""Operator 1: main text of web pages from streaming parser events, text-to-tag ratios and clustering.

The standard library's parser feeds one pass over a page. Its events become blocks (text between the borders of block elements,
white space squeezed), each with the element it stands in and the tags and linked characters it took. Blocks in what is never
the article (menus, headers and footers of the page, sidebars, notices, adverts, forms, comments, hidden parts) are left out.
The others' text-to-tag ratios are smoothed by a Gaussian over the page's order and split in two clusters. Where blocks of the
high cluster stand in article or main elements, these elements are the content, less articles that hold links but nothing of the
high cluster (teasers of other stories); else it is the innermost element around the whole high cluster, with its sibling
sections, less runs of links before or after the high cluster. All blocks of the content are the result, low and short ones too, and
so are first-level headings beside it, one in the page's header only where there is no other and it is no link.

Defined results: a null or empty page and one without such blocks give an empty text; repeated rows are read alike; markup that
is cut short or not closed is read as far as it goes, and takes time in proportion however deep it nests; an empty table gives
an empty result; further columns pass through, and if one is called text, underscores are appended to the new one.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacut.llm.common import fresh, read, settle

SIGMA = 1.5
RUN = 3  # linked blocks in a row that are a menu where they stand outside the article's own blocks

# Element names of the HTML standard, and usual names of parts of pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
WITHIN = frozenset("wbr img input embed area".split())  # without content, in the middle of a line
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var nobr".split())
UNSEEN = frozenset("head title script style noscript template iframe object svg math canvas audio video map".split())
OUTSIDE = frozenset("nav footer aside form button select textarea option dialog menu fieldset".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# An element goes if a class or id consists of these words, and of at least one of the first two lists.
NAMES = frozenset("""legal copyright disclaimer imprint impressum colophon nav navbar navigation menu menubar breadcrumb breadcrumbs share sharing social related recommended promo promotion banner
notice notices alert overlay footer masthead topbar toolbar subscribe subscription signup login search pagination pager widget widgets skip""".split())
STRONG = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors sidebar comment comments commentlist disqus respond
reply replies cookie cookies consent gdpr popup modal newsletter""".split())
BESIDE = frozenset("""box boxes wrap wrapper container inner outer section area block list lists item items link links bar top bottom left right primary
secondary site page post posts story stories articles news more row col column grid panel group holder unit slot zone region buttons button
icons text title head heading media form field module component fixed sticky mobile desktop global to us and the of by""".split())
OWN = frozenset(("content", "body", "main", "article"))
PAGE_ONLY = frozenset(("masthead", "banner"))
PARTS = re.compile(r"[a-z]+")
HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
# Elements that hold a line or a list of the text, and never are the region.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote table tbody thead tfoot tr td th caption figure figcaption hgroup header details summary address center".split())


def left_out(name: str, inside: bool) -> bool:
    """Whether all words of one class or id say that an element isn't of the article."""
    words = set(PARTS.findall(HUMPS.sub(" ", name).lower()))
    strong, found = words & STRONG, words & NAMES
    if not strong and (not found or inside and found <= PAGE_ONLY):
        return False
    return words <= NAMES | STRONG | BESIDE | (OWN if strong or found & {"nav", "navigation", "menu", "social", "search"} else frozenset())


def named(attributes: list[tuple[str, str | None]], inside: bool) -> bool:
    """Whether class, id, role or style say that an element isn't of the article; ``inside``: it stands in one."""
    for key, value in attributes:
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if not value:
            continue
        if key == "style" and HIDDEN.search(value) or key == "role" and value.strip().lower() in ROLES:
            return True
        if key in ("class", "id") and any(left_out(name, inside) for name in value.split()):
            return True
    return False


class Blocks(HTMLParser):
    """Blocks of a page: (text, characters in links, tags since the last block, number of the element it stands in)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, bool]] = []  # name, number, whether it is left out (1: as the page's header only), whether it is or stands in an article
        self.open: Counter = Counter()
        self.elements: list[tuple[str, int, int]] = []  # name, the parent's number, the parents' count
        self.tags = self.links = self.linked = 0
        self.held: list[str] = []
        self.blocks: list[tuple[str, int, int, int]] = []
        self.banner: set[int] = set()  # first-level headings in the page's header
        self.within: dict[int, bool] = {-1: False}  # by element: whether it is or stands in an article or main element

    def border(self) -> None:
        if self.held:
            if text := " ".join("".join(self.held).split()):
                self.blocks.append((text, self.linked, self.tags, self.stack[-1][1] if self.stack else -1))
                self.tags = 0
            self.held, self.linked = [], 0

    def _push(self, tag: str, out: int, inside: bool) -> None:
        number, parent = len(self.elements), self.stack[-1][1] if self.stack else -1
        self.elements.append((tag, parent, len(self.stack)))
        self.within[number] = inside
        self.stack.append((tag, number, out, inside))
        self.open[tag] += 1

    def _cut(self, at: int) -> None:
        for x in self.stack[at:]:
            self.open[x[0]] -= 1
        del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        _, _, out, inside = self.stack[-1] if self.stack else ("", -1, 0, False)
        if tag in WITHIN:
            return
        if tag in INLINE:
            self.links += tag == "a"
            if attrs and tag != "a" and named(attrs, True):
                self._push(tag, 2, inside)
            return
        self.border()
        if tag in VOID:
            return
        if tag in CLOSES_P and self.stack and self.stack[-1][0] == "p":
            self._cut(len(self.stack) - 1)
            _, _, out, inside = self.stack[-1] if self.stack else ("", -1, 0, False)
        self.links = 0
        own = inside or tag in ("article", "main")
        if tag in UNSEEN or tag in OUTSIDE or tag not in ("html", "body", "header") and attrs and named(attrs, own):
            out = 2
        elif tag == "header" and not inside:
            out = max(out, 1)
        elif tag == "header" and attrs and named(attrs, own):
            out = 2
        elif tag == "h1" and out == 1:
            out = 0
            self.banner.add(len(self.elements))
        self._push(tag, out, own)

    def handle_endtag(self, tag):
        self.tags += 1
        inline = tag in INLINE
        if inline:
            self.links = max(0, self.links - (tag == "a"))
        else:
            self.border()
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._cut(k)
                return
            if inline and self.stack[k][0] not in INLINE:
                return

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag not in INLINE:
            self.tags += 1
            self.border()

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][2]):
            self.held.append(data)
            if self.links:
                self.linked += len(data)

    def of(self, page: str) -> list[tuple[str, int, int, int]]:
        self.feed(page)
        self.close()
        self.border()
        return self.blocks

    def around(self, places: list[int]) -> int:
        """The innermost element around all of ``places`` (-1: the page); parents have lower numbers than what stands in them."""
        held = [0] * (len(self.elements) + 1)
        for number in places:
            held[number] += 1
        for number in range(len(self.elements) - 1, -1, -1):
            if held[number] == len(places):
                return number
            held[self.elements[number][1]] += held[number]
        return -1

    def headings(self, blocks: list[tuple[str, int, int, int]], linked: list[bool]) -> list[bool]:
        """As ``below`` for first-level headings: those of the page's header only if there are no others and they aren't links."""
        own = self.below({k for k, x in enumerate(self.elements) if x[0] == "h1"} - self.banner)
        if not self.banner or any(own[b[3]] for b in blocks):
            return own
        links = {b[3] for b, x in zip(blocks, linked, strict=True) if x}
        return self.below(self.banner - links)

    def teasers(self, blocks: list[tuple[str, int, int, int]], high: list[int]) -> set[int]:
        """Articles with links and without a block of the high cluster, where other articles have such blocks."""
        links, chosen = ([0] * (len(self.elements) + 1) for _ in range(2))
        for b in blocks:
            links[b[3]] += b[1]
        for k in high:
            chosen[blocks[k][3]] += 1
        for number in range(len(self.elements) - 1, -1, -1):  # parents have lower numbers
            parent = self.elements[number][1]
            links[parent] += links[number]
            chosen[parent] += chosen[number]
        own = [k for k, x in enumerate(self.elements) if x[0] == "article"]
        return {k for k in own if links[k] and not chosen[k]} if any(chosen[k] for k in own) else set()

    def below(self, region: set[int]) -> list[bool]:
        """For each element (and, last, for the page) whether it is or stands in one of ``region``."""
        out = [False] * len(self.elements) + [-1 in region]
        for number, (_, parent, _) in enumerate(self.elements):
            out[number] = number in region or out[parent]
        return out


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma)
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(x, weight, "full")[reach : reach + len(x)] / np.convolve(np.ones(len(x)), weight, "full")[reach : reach + len(x)]


def high_cluster(x: np.ndarray) -> np.ndarray:
    """Two means in one dimension, from the extremes on; all are high if they hardly differ."""
    low, high = x.min(), x.max()
    if high <= 1.5 * low:
        return np.ones(len(x), bool)
    for _ in range(50):
        cut = (low + high) / 2
        a, b = x[x < cut].mean() if (x < cut).any() else low, x[x >= cut].mean()
        if (a, b) == (low, high):
            break
        low, high = a, b
    return x >= (low + high) / 2


def main_blocks(page: str) -> list[str]:
    parser = Blocks()
    blocks = parser.of(page)
    if not blocks:
        return []
    length = np.array([len(b[0]) for b in blocks], float)
    ratio = smoothed(length / np.array([max(1, b[2]) for b in blocks]))
    linked = [b[1] > 0.8 * len(b[0]) for b in blocks]
    high = [k for k in np.flatnonzero(high_cluster(ratio)).tolist() if not linked[k]] or list(range(len(blocks)))
    headings = parser.headings(blocks, linked)
    if any(parser.within[blocks[k][3]] for k in high):
        other = parser.below(parser.teasers(blocks, high))
        return [b[0] for b in blocks if parser.within[b[3]] and not other[b[3]] or headings[b[3]]]
    region = parser.around([blocks[k][3] for k in high])
    while region >= 0 and parser.elements[region][0] in TEXTUAL:
        region = parser.elements[region][1]
    around = {region}
    if region >= 0 and parser.elements[region][0] == "section":
        around |= {k for k, x in enumerate(parser.elements) if x[:2] == parser.elements[region][:2]}
    inside = parser.below(around)
    keep = [inside[b[3]] or headings[b[3]] for b in blocks]
    k = 0
    while k < len(blocks):  # menus without a name, above or below
        end = k
        while end < len(blocks) and linked[end]:
            end += 1
        if end - k >= RUN and (end <= high[0] or k > high[-1]):
            keep[k:end] = [False] * (end - k)
        k = max(end, k + 1)
    return [b[0] for b, x in zip(blocks, keep, strict=True) if x]


def main_text(page: str | None) -> str:
    return "\n".join(main_blocks(page)) if page else ""


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with the main text of ``column`` as text; if there is a column of that name, underscores are appended."""

    @F.arrow_udf("string")
    def texts(html: pa.Array) -> pa.Array:
        out = [main_text(x) for at in range(0, len(html), 500) for x in html.slice(at, 500).to_pylist()]
        settle()
        return pa.array(out, pa.string())

    return pages.withColumn(fresh("text", pages.columns), texts(column))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op1_html_extraction": query}
ORACLES: dict[str, str] = {}
