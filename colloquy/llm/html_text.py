"""Main text of web pages.

The standard library's parser streams through a page. Block tags cut its text into lines; a
line's text-to-tag ratio is its characters over the tags met since the line before. Menus,
headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles are left out
by their tags, roles and class names. The ratios are smoothed with a Gaussian, and two-means
clustering splits them at a threshold; lines above it are content. What the ratios select:

* of the article and main elements those that hold content, all of them, in page order;
* without such an element, the smallest container with most of the content, from its first to
  its last content line;
* in either, lines that are mostly links stay only where their own ratio is above the threshold:
  a long sentence in a link is kept, a block of links isn't.

Short lines between or beside content (headings, one-line paragraphs) fill the gaps and stay.

Defined cases: null and empty pages give an empty text; unclosed and stray tags are read as
browsers do, roughly; repeated rows each get their row; an empty table gives an empty result;
other columns are not read. Memory holds one page's text at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the Gaussian, in lines.
SIGMA = 1.0
#: Fewer lines than this are content, all of them.
FEWEST = 4
#: Share of the content a container must hold to be chosen over the one around it.
MOST = 0.9
#: Share of a line's characters in links from which it counts as a menu.
LINKED = 0.6

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt "
    "rp s samp small span strike strong sub sup time tt u var wbr img".split()
)
LEFT_OUT = frozenset(
    "head script style noscript template nav footer aside form button select textarea input "
    "iframe object svg math canvas audio video menu dialog map".split()
)
#: Elements that don't end a line.
_WITHIN = INLINE | {"script", "style", "template", "noscript"}
ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu "
    "menubar toolbar".split()
)
#: Parts of class names and ids that mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead comment comments commentlist reply replies respond disqus share "
    "sharing social related recommended recommendations widget toolbar pagination pager".split()
)
#: Marks that inside an article name parts of it: its own heading, and text to be shared.
OWN_MARKS = frozenset("header masthead share sharing banner".split())
ARTICLE = frozenset(("article", "main"))
CONTAINERS = frozenset("html body div section article main td".split())
#: A start tag of the left closes an open element of the right.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
#: Elements that an implied end doesn't reach beyond.
_FENCES = frozenset("html body div section article main table ul ol dl td th blockquote".split())
_PART = re.compile(r"[^a-z0-9]+")


def _marked(names: str | None, inside: bool) -> bool:
    """Whether a class or id marks what isn't text; ``inside`` an article some marks don't."""
    for name in (names or "").lower().split():
        parts = [p for p in _PART.split(name) if p]
        if parts and parts[0] not in ("has", "with", "no", "is"):
            found = MARKS.intersection(parts)
            if found and not (inside and found <= OWN_MARKS):
                return True
    return False


class _Element:
    __slots__ = ("tag", "skip", "path", "article", "link")

    def __init__(self, tag, skip, path, article, link):
        self.tag, self.skip, self.path, self.article, self.link = tag, skip, path, article, link


class Page(HTMLParser):
    """Lines of a page: text, tags before and within, characters in links, container path."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [_Element("", False, (), None, False)]
        self.lines: list[tuple[str, int, int, tuple[int, ...], int | None, bool]] = []
        self.text: list[str] = []
        self.tags = self.linked = self.made = 0
        self.heading = False

    def cut(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                top = self.open[-1]
                self.lines.append(
                    (line, self.tags, self.linked, top.path, top.article, self.heading)
                )
                self.tags = 0
            self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs) -> None:
        self.tags += 1
        if tag not in _WITHIN:
            self.cut()
        if tag in VOID:
            return
        implied = CLOSES.get(tag, {"p"} if tag not in INLINE else ())
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in implied:
                del self.open[i:]
                break
            if self.open[i].tag in _FENCES:
                break
        top = self.open[-1]
        given = dict(attrs) if attrs else {}
        skip = top.skip or tag in LEFT_OUT or (tag == "header" and top.article is None)
        if not skip and given and tag not in ("html", "body", "article", "main"):
            skip = (
                "hidden" in given
                or given.get("aria-hidden") == "true"
                or (given.get("role") or "").lower() in ROLES
                or "display:none" in (given.get("style") or "").replace(" ", "").lower()
                or _marked(given.get("class"), top.article is not None)
                or _marked(given.get("id"), top.article is not None)
            )
        path, article = top.path, top.article
        if tag in CONTAINERS:
            self.made += 1
            path = (*path, self.made)
            if article is None and (tag in ARTICLE or given.get("role") == "main"):
                article = self.made
        self.open.append(_Element(tag, skip, path, article, top.link or tag == "a"))
        self.heading = tag in ("h1", "h2") or (self.heading and tag in INLINE)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in _WITHIN:
            self.cut()
            self.heading = False
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break
            if tag in INLINE and self.open[i].tag in _FENCES:
                break

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if not top.skip:
            self.text.append(data)
            if top.link:
                self.linked += len(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    around = np.convolve(np.ones(len(ratios)), kernel, "full")[reach:-reach]
    return np.convolve(ratios, kernel, "full")[reach:-reach] / around


def threshold(smooth: np.ndarray) -> float | None:
    """Where two-means clustering splits the smoothed ratios; None if it doesn't."""
    if len(smooth) < FEWEST:
        return None
    low, high = smooth.min(), smooth.max()
    for _ in range(50):
        cut = (low + high) / 2
        above = smooth > cut
        if above.all() or not above.any():
            return None
        means = smooth[~above].mean(), smooth[above].mean()
        if means == (low, high):
            break
        low, high = means
    return float((low + high) / 2)


def content_lines(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Which lines are content: smoothed ratios above the threshold; without one, all."""
    smooth = smoothed(ratios, sigma) if len(ratios) else ratios
    cut = threshold(smooth)
    return np.ones(len(ratios), bool) if cut is None else smooth > cut


def strong_lines(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Which lines are above the threshold by themselves, whatever stands around them."""
    cut = threshold(smoothed(ratios, sigma)) if len(ratios) else None
    return np.zeros(len(ratios), bool) if cut is None else ratios > cut


def main_lines(html: str | None) -> list[str]:
    """The lines of a page's main text, in page order."""
    if not html:
        return []
    page = Page()
    page.feed(html)
    page.close()
    page.cut()
    lines = page.lines
    if not lines:
        return []
    sizes = np.array([len(x[0]) for x in lines])
    ratios = sizes / np.array([max(1, x[1]) for x in lines])
    content, strong = content_lines(ratios), strong_lines(ratios)
    few_links = np.array([x[2] < LINKED * len(x[0]) for x in lines])
    holding = {x[4] for x, good in zip(lines, content & few_links, strict=True) if good} - {None}
    if holding or any(x[4] is not None for x in lines):
        # no article above the threshold: then the one with most text
        if not holding:
            share: Counter[int] = Counter()
            for x, size in zip(lines, sizes, strict=True):
                if x[4] is not None:
                    share[x[4]] += int(size)
            holding = {max(share, key=lambda a: (share[a], -a))}
        return [
            x[0] for x, good, plain in zip(lines, strong, few_links, strict=True)
            if x[4] in holding and (good or plain)
        ]
    # no article: the smallest container with most of the content, and with its headings
    inside: Counter[int] = Counter()
    for x, size, good in zip(lines, sizes, content, strict=True):
        for c in x[3]:
            inside[c] += int(size) * bool(good)
    total = int(sizes[content].sum())
    paths = [x[3] for x in lines]
    fit = [c for c, n in inside.items() if n >= MOST * total]
    heads = [x[3] for x, good in zip(lines, content, strict=True) if x[5]]
    fit = [c for c in fit if all(c in p for p in heads)] or fit[:1]
    within = np.array([not fit or fit[-1] in p for p in paths])
    own = np.flatnonzero(within & (content | np.array([x[5] for x in lines])))
    if not len(own):
        own = np.flatnonzero(within)
    stay = few_links | strong
    return [x[0] for i, x in enumerate(lines) if within[i] and own[0] <= i <= own[-1] and stay[i]]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_lines(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"),
                batch.column("url"),
                pa.array([" ".join(x) for x in found], pa.string()),
                pa.array([len(x) for x in found], pa.int64()),
            ],
            names=["key", "url", "text", "n_blocks"],
        )


def main_texts(
    pages: DataFrame, *, html: str = "html", key: str = "page_id", url: str = "url"
) -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_blocks`` of every page."""
    rows = pages.select(
        F.col(key).cast("long").alias("key"),
        F.col(url).cast("string").alias("url"),
        F.col(html).alias("html"),
    )
    return rows.mapInArrow(_extract, "key long, url string, text string, n_blocks long")
