"""Main text of web pages from the text-to-tag ratio of their lines.

Python's streaming HTML parser sends events; they become lines, one per block element, each with
its characters, its tags and the container it stands in. A line's ratio of text to tags is
smoothed with a Gaussian over its neighbours, and a threshold (the standard deviation of the
smoothed ratios, or two means by one-dimensional 2-means where that is lower) splits the lines
into content and the rest. Content lines vote, by their characters, for the container that holds
the page's main region: article or main elements, the parts of one article together, else the
smallest element that holds all of the content. Every line of that region which is not
boilerplate is kept, so that short paragraphs and headings of an article are not lost between
long ones.

Elements and names only weigh. Navigation, headers and footers of the page, asides, forms and
names such as ``sidebar`` hide what they hold, unless the page's content lies there: a form or a
wrapper around everything, or a menu that was never closed. Vaguer names (``legal``, ``search``)
hide only what the ratios don't take for content anyway. What readers add is always hidden, and
so are scripts, styles and controls. All steps are linear in the page, however deep it nests.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that start a line of their own.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents are no text of the page.
SKIPPED = frozenset(
    "applet audio button canvas datalist dialog embed head iframe input map noframes noscript object "
    "script select style svg template textarea title video".split()
)
#: Elements that hold boilerplate, unless the page's content lies in them.
ASIDE = frozenset("aside footer form label legend menu nav search".split())
ARTICLE = frozenset(("article", "main"))
#: Words in class, id or role that name boilerplate; those that do so only for what is no running text; what may stand beside them in one name.
WORD = (
    r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|contentinfo|cookies?|disqus|footer|gdpr|masthead|menu|nav|navbar|navigation|"
    r"newsletter|notices?|pagination|popup|popups|promo\w*|promoted|replies|reply|respond|sidebar|signup|sponsor\w*|subscribe)"
)
VAGUE = r"(?:captcha|form|legal|login|modal|paywall|recommend\w*|related|search|share|sharing|skip|social|toolbar|topbar|widgets?)"
BESIDE = (
    r"(?:\d+|area|articles?|bar|block|body|bottom|box|buttons?|container|desktop|entry|global|group|header|icons?|inner|items?|js|left|"
    r"links?|list|main|mobile|outer|page|panel|posts?|primary|right|secondary|section|site|slot|stories|text|to|top|unit|user|wrap|wrapper)"
)
#: A whole name, between spaces, of such words; has-sidebar, no-comments or long-form are none.
NAMED, VAGUELY = (re.compile(rf"(?:^|\s)(?:(?:{BESIDE}|{VAGUE})[_-]+)*{w}(?:[_-]+(?:{WORD}|{VAGUE}|{BESIDE}))*(?:$|\s)") for w in (WORD, VAGUE))
#: Names of what readers add; it may hold most of a page and is still no part of the article.
READERS = re.compile(r"comment|disqus|repl(?:y|ies)|respond")
#: A paragraph starts when one of these starts inside an open one.
CLOSES_P = BLOCKS - {"body", "html", "head", "option", "optgroup", "legend", "li", "td", "th", "tr", "tbody", "tfoot", "thead", "dd", "dt"} | {"p"}
SMOOTH = 1.0
#: Content in an element that boilerplate is named after outweighs that outside such elements by this much where it is the page's own.
OUTWEIGHS = 4
FOLD = re.compile(r"\s+")
PLAIN, HIDES, READ, VAGUE_NAME = range(4)


class Lines(HTMLParser):
    """Turns parser events into lines (text, number of tags, link characters, container) and a tree of elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.parents: list[int] = [-1]  # of each element by number; 0 is the page, parents come before their children
        self.names: list[str] = ["page"]
        self.kinds: list[int] = [PLAIN]
        self.open: list[tuple[str, int, bool]] = [("page", 0, False)]
        self.counts: Counter[str] = Counter()  # open elements by name
        self.hard = 0  # how many open elements hide their contents for good
        self.text: list[str] = []
        self.n_tags = self.link_chars = 0

    def _end_line(self) -> None:
        if self.text:
            text = FOLD.sub(" ", "".join(self.text)).strip()
            if text:
                self.lines.append((text, self.n_tags, self.link_chars, self.open[-1][1]))
                self.n_tags = self.link_chars = 0
            self.text = []

    def _kind(self, tag: str, attrs: list) -> int:
        """What the element and its names say about its contents."""
        if tag in ("html", "body", "article", "main"):
            return PLAIN
        if tag == "header":  # an article's own header holds its headline
            return PLAIN if self.counts["article"] or self.counts["main"] else HIDES
        kind = HIDES if tag in ASIDE else PLAIN
        for name, value in attrs:
            if value and name in ("class", "id", "role"):
                value = value.lower()
                if NAMED.search(value):
                    return READ if READERS.search(value) else HIDES
                if kind == PLAIN and VAGUELY.search(value):
                    kind = VAGUE_NAME
        return kind

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.n_tags += 1
        if tag in BLOCKS:
            self._end_line()
            if self.counts["head"] and tag != "head":
                self._close("head")
            if tag in CLOSES_P and self.counts["p"] and any(name == "p" for name, _, _ in self.open[-6:]):
                self._close("p")
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        hard = tag in SKIPPED or any(name == "hidden" or (name == "aria-hidden" and value == "true") for name, value in attrs)
        kind = self._kind(tag, attrs)
        if kind in (HIDES, READ):  # a line of its own, in a block or not
            self._end_line()
        self.open.append((tag, len(self.parents), hard))
        self.parents.append(self.open[-2][1])
        self.names.append(tag)
        self.kinds.append(kind)
        self.counts[tag] += 1
        self.hard += hard

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str) -> None:
        """Ends the innermost such element and what is open in it; no block ends with an inline element."""
        if not self.counts[tag]:
            return
        at = len(self.open) - 1
        while self.open[at][0] != tag:
            if tag not in BLOCKS and self.open[at][0] in BLOCKS:
                return
            at -= 1
        while len(self.open) > at:
            name, _, hard = self.open.pop()
            self.counts[name] -= 1
            self.hard -= hard

    def handle_endtag(self, tag: str) -> None:
        self.n_tags += 1
        if tag in BLOCKS or (self.open[-1][0] == tag and self.kinds[self.open[-1][1]] in (HIDES, READ)):
            self._end_line()
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.hard:
            self.text.append(data)
            if self.counts["a"]:
                self.link_chars += len(data)

    def close(self) -> None:
        super().close()
        self._end_line()


def smoothed(ratios: np.ndarray, sigma: float = SMOOTH) -> np.ndarray:
    """The ratios under a normalised Gaussian of radius ceil(3 sigma)."""
    radius = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weigh = lambda x: np.convolve(x, kernel)[radius : radius + len(ratios)]
    return weigh(ratios) / weigh(np.ones(len(ratios))) if len(ratios) else ratios


def threshold(ratios: np.ndarray) -> float:
    """Where content begins: the standard deviation, or the 2-means border if that is lower."""
    low, high = float(ratios.min()), float(ratios.max())
    for _ in range(20):
        border = (low + high) / 2
        above = ratios > border
        if not above.any() or above.all():
            break
        new = float(ratios[~above].mean()), float(ratios[above].mean())
        if new == (low, high):
            break
        low, high = new
    return min(float(ratios.std()), (low + high) / 2)


def _hidden(page: Lines, at: np.ndarray, chars: np.ndarray, mass: np.ndarray) -> list[bool]:
    """Of each element whether what it holds is boilerplate. at: containers of lines; mass: their content characters."""
    n, parents, kinds = len(page.parents), page.parents, page.kinds
    near, article, reads = [0] * n, [False] * n, [False] * n  # the nearest element that hides; in an article; of readers
    for e in range(1, n):
        up = parents[e]
        near[e] = e if kinds[e] in (HIDES, READ) else near[up]
        article[e] = article[up] or page.names[e] in ARTICLE
        reads[e] = reads[up] or kinds[e] == READ
    own = np.where(np.array(reads)[at], 0.0, mass)
    if (inside := np.where(np.array(article)[at], own, 0.0)).any():
        own = inside
    pockets = np.bincount(np.array(near)[at], own, n)
    most, spared = int(pockets.argmax()), set()
    if most and pockets[most] > OUTWEIGHS * pockets[0]:
        while most > 0:
            spared.add(most)
            most = parents[most]
    whole, good = np.bincount(at, chars, n), np.bincount(at, mass, n)
    for e in range(n - 1, 0, -1):
        whole[parents[e]] += whole[e]
        good[parents[e]] += good[e]
    hidden = [False] * n
    for e in range(1, n):
        hides = kinds[e] in (HIDES, READ) and e not in spared or kinds[e] == VAGUE_NAME and 2 * good[e] < whole[e]
        hidden[e] = hidden[parents[e]] or hides
    return hidden


def extract(html: str) -> str:
    """The main text of a page: kept lines in page order, joined by single spaces."""
    page = Lines()
    page.feed(html)
    page.close()
    if not page.lines:
        return ""
    at = np.array([x[3] for x in page.lines])
    chars = np.maximum(np.array([len(x[0]) - x[2] for x in page.lines], dtype=float), 0)
    ratio = smoothed(chars / np.array([max(1, x[1]) for x in page.lines]))
    content = ratio >= threshold(ratio)
    hidden = _hidden(page, at, np.array([len(x[0]) for x in page.lines], dtype=float), np.where(content, chars, 0.0))
    seen = ~np.array(hidden)[at]
    n, parents, names = len(page.parents), page.parents, page.names
    votes = np.bincount(at, np.where(content & seen, chars, 0.0), n)
    if not votes.any():  # a page of few words: whatever is not boilerplate
        votes = np.bincount(at, np.where(seen, chars, 0.0), n)
    depth = [0] * n
    for e in range(1, n):
        depth[e] = depth[parents[e]] + 1
    for e in range(n - 1, 0, -1):
        votes[parents[e]] += votes[e]
    if not votes[0]:
        return ""
    regions = [e for e in range(n) if names[e] in ARTICLE and votes[e] > 0]
    if regions:
        # the outermost article that has most, and its siblings: the parts of one article belong together
        best = max(regions, key=lambda e: (votes[e], -depth[e]))
        chosen = {e for e in regions if votes[e] >= 0.5 * votes[best] or parents[e] == parents[best]}
    else:
        region = max((e for e in range(n) if votes[e] == votes[0]), key=lambda e: depth[e])
        while names[region] not in BLOCKS - {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "tr", "dt", "dd"} and region:
            region = parents[region]
        chosen = {region}
    held, top = [False] * n, list(range(n))  # in a region; the region's child that holds it
    for e in range(n):
        up = parents[e]
        held[e] = e in chosen or (e > 0 and held[up])
        if e and held[up] and up not in chosen:
            top[e] = top[up]
    kept = []
    for (text, _, _, e), shown, own in zip(page.lines, seen, chars, strict=True):
        # without an article, a block of nothing but links beside the content is a menu
        if shown and held[e] and not (not regions and e not in chosen and not votes[top[e]] and own <= 0):
            kept.append(text)
    return " ".join(kept)

def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(html.as_py() or "") for html in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html).

    Character references are decoded, white space inside a block becomes one space, blocks are
    joined in page order by one space. Null or empty html gives empty text; a page of any length or
    depth is parsed whole, in linear time; unclosed and stray tags are taken as browsers do as far
    as lines go. Null and repeated ids pass through, an empty table gives an empty one, other
    columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op9_html_extract(spark, sf_dir):
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
