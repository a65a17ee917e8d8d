"""Main text of web pages by tag-path ratios.

Each block of text has a path of tags from the root. Over a page, the blocks of a path give its ratios:
characters outside links per block, raised by punctuation. A path's ratio is fused with that of the
paths beside it (those with the same parent) and with the ratios of the blocks around its blocks,
smoothed along the page by a bell curve; what names say of the path is one more factor. A path is
content if its fused ratio reaches a share of the page's mean, and the main text is the blocks of the
content paths. Nothing else decides on a block.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>", re.S)
MARKS = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORDS = re.compile(r"[a-z0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？]")

# Groups of element names as in the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
P_SCOPE = frozenset("applet caption html table td th marquee object template button".split())
SIBLINGS = {"li": "li", "option": "option", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "thead": "thead tbody tfoot tr td th", "tbody": "thead tbody tfoot tr td th", "tfoot": "thead tbody tfoot tr td th"}
SIBLINGS = {k: frozenset(v.split()) for k, v in SIBLINGS.items()}
SIBLING_SCOPE = frozenset("ul ol dl table select menu html body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Names that mark a part of a page as other than its main text, or as main text.
OTHER_TAGS = frozenset("nav footer aside form button select dialog menu head svg math canvas object template noscript audio video map datalist fieldset".split())
OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead sidebar aside widget cookie cookies consent gdpr "
    "notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus reply replies respond search toolbar pagination pager skip paywall copyright legal hidden "
    "complementary contentinfo alertdialog".split()
)
LAYOUT_NAMES = frozenset("has with no without content main article entry post story body text wrapper container page layout root app".split())
MAIN_NAMES = frozenset("content main article entry post story articlebody".split())
MAIN_TAGS = frozenset("article main".split())
WHOLE = frozenset("html body article main".split())
#: Tags that only hold blocks of a flow; without a name they are no step of a path.
FLOW = frozenset("ul ol dl table thead tbody tfoot tr".split())

#: What names make of a ratio: those of other parts, and those of main text.
OTHER_FACTOR, MAIN_FACTOR = 0.02, 2.0
#: Exponents of the ratio of a path, of the paths beside it and of the blocks around it.
OWN, BESIDE, AROUND = 0.4, 0.3, 0.3
#: Weights of the blocks 0, 1, 2, ... places away: a bell curve.
BELL = [math.exp(-(k * k) / 4.5) for k in range(5)]
#: The share of the mean of fused ratios, and that of plain ratios, that a path has to reach. Means are over characters.
SHARE, PLAIN_SHARE = 0.4, 0.1


class Page:
    """The blocks of text of a page, in page order, and its paths, numbered from 0, the root."""

    def __init__(self, source: str):
        self.paths: dict[tuple[int, str], int] = {}
        self.parent, self.heading, self.names = [-1], [False], [1.0]
        self.blocks: list[tuple[str, int, int]] = []  # text, path, characters in links
        self._parse(source)

    def _path(self, parent: int, label: str, heading: bool, names: float) -> int:
        path = self.paths.setdefault((parent, label), len(self.parent))
        if path == len(self.parent):
            self.parent.append(parent)
            self.heading.append(heading)
            self.names.append(names)
        return path

    def _parse(self, source: str) -> None:
        # name, path, marked as other, inside main text, block, hidden
        stack: list[tuple[str, int, bool, bool, bool, bool]] = [("#root", 0, False, False, True, False)]
        open_tags: dict[str, int] = {}
        text: list[str] = []
        links = link_chars = at = 0

        def flush() -> None:
            nonlocal link_chars
            if text:
                words = " ".join(html.unescape("".join(text)).split())
                if words and not stack[-1][5]:
                    self.blocks.append((words, stack[-1][1], min(link_chars, len(words))))
                text.clear()
            link_chars = 0

        def pop() -> None:
            nonlocal links
            name = stack[-1][0]
            if name == "a":
                links -= 1
            open_tags[name] -= 1
            if stack[-1][4]:
                flush()
            stack.pop()

        def pop_to(k: int) -> None:
            while len(stack) > k:
                pop()

        while True:
            m = TAG.search(source, at)
            piece = source[at : m.start()] if m else source[at:]
            if piece:
                text.append(piece)
                if links:
                    link_chars += len(piece.strip())
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                if open_tags.get(name):
                    while stack[-1][0] != name:
                        pop()
                    pop()
                elif name == "p":
                    flush()
                continue
            attributes = m[3] or m[6] or ""
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else len(source)
                continue
            if name == "br":
                text.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            if name in ENDS_P and open_tags.get("p"):
                k = len(stack) - 1
                while stack[k][0] != "p" and stack[k][0] not in P_SCOPE and k:
                    k -= 1
                if stack[k][0] == "p":
                    pop_to(k)
            if name in SIBLINGS:
                k = len(stack) - 1
                while k and stack[k][0] not in SIBLING_SCOPE and stack[k][0] not in SIBLINGS[name]:
                    k -= 1
                if stack[k][0] in SIBLINGS[name]:
                    pop_to(k)
            _, path, other, main, _, hidden = stack[-1]
            label, marked, named, gone = self._kind(name, attributes, main)
            # a part marked as other is a block, whatever its tag
            block = name not in INLINE or marked or gone
            if block:
                flush()
                other, main, hidden = other or marked, main or named, hidden or gone
                if name not in FLOW or label != name:
                    names = OTHER_FACTOR if other else MAIN_FACTOR if main else 1.0
                    path = self._path(path, label, name in HEADINGS, names)
            if attributes.rstrip().endswith("/") and name not in ENDS_P and name not in INLINE:
                continue  # closed in itself, as in XHTML
            stack.append((name, path, other, main, block, hidden))
            open_tags[name] = open_tags.get(name, 0) + 1
            if name == "a":
                links += 1
        flush()
        pop_to(1)

    @staticmethod
    def _kind(name: str, attributes: str, main: bool) -> tuple[str, bool, bool, bool]:
        """An element's label in paths; whether names mark it as other, or as main text; and whether it is hidden."""
        label, other, named = name, name in OTHER_TAGS or name == "header" and not main, name in MAIN_TAGS
        if attributes:
            marked = False
            for m in MARKS.finditer(attributes):
                value = (m[2] or m[3] or m[4] or "").lower()
                if m[1].lower() != "id":
                    label += "." + value
                for one in value.split():
                    words = set(WORDS.findall(one))
                    marked = marked or bool(words & OTHER_NAMES) and not words & LAYOUT_NAMES
                    named = named or bool(words & MAIN_NAMES) and name not in HEADINGS and name not in INLINE
            if name == "article" or name not in WHOLE:
                other = other or marked
            if HIDDEN.search(attributes):
                return label + "#hidden", other, named, True
        return label + "#other" * other + "#main" * named, other, named and not other, False


def ratio(n: int, size: int, marks: int, linked: int) -> float:
    """Characters a block without those in links, raised by the share of punctuation among the characters."""
    return (size - linked) / n * (1 + 10 * marks / size)


def path_ratios(page: Page) -> list[float]:
    """The ratio of each path by its own blocks; 0 for a path without any."""
    sums = [[0, 0, 0, 0] for _ in page.parent]
    for text, path, linked in page.blocks:
        for k, v in enumerate((1, len(text), len(PUNCTUATION.findall(text)), linked)):
            sums[path][k] += v
    return [ratio(*s) if s[0] else 0.0 for s in sums]


def beside(page: Page) -> list[float]:
    """The ratio of each path's blocks taken together with those of the paths that have its parent, headings apart."""
    sums: dict[int, list[int]] = {}
    for text, path, linked in page.blocks:
        if not page.heading[path]:
            s = sums.setdefault(page.parent[path], [0, 0, 0, 0])
            for k, v in enumerate((1, len(text), len(PUNCTUATION.findall(text)), linked)):
                s[k] += v
    return [ratio(*sums[p]) if p in sums else 0.0 for p in page.parent]


def smoothed(row: list[float]) -> list[float]:
    """Each number averaged with those up to four places away, by the bell curve."""
    out = []
    for k in range(len(row)):
        total = weight = 0.0
        for i in range(max(0, k - 4), min(len(row), k + 5)):
            w = BELL[abs(i - k)]
            total += w * row[i]
            weight += w
        out.append(total / weight)
    return out


def averaged(page: Page, row: list[float]) -> list[float]:
    """The mean for each path of a number for each block."""
    sums = [[0.0, 0] for _ in page.parent]
    for (_, path, _), v in zip(page.blocks, row, strict=True):
        sums[path][0] += v
        sums[path][1] += 1
    return [s / n if n else 0.0 for s, n in sums]


def path_scores(page: Page) -> tuple[list[float], float]:
    """The fused ratio of each path, and the threshold. A heading has the ratios of the text that comes after it."""
    own, near = path_ratios(page), beside(page)
    own_row, near_row, follows = [], [], (0.0, 0.0)
    for _, path, _ in reversed(page.blocks):
        if not page.heading[path]:
            follows = own[path], near[path]
        own_row.append(follows[0])
        near_row.append(follows[1])
    own_row.reverse()
    near_row.reverse()
    parts = [averaged(page, row) for row in (own_row, near_row, smoothed(own_row))]
    plain = [a**OWN * b**BESIDE * c**AROUND for a, b, c in zip(*parts, strict=True)]
    fused = [v * names for v, names in zip(plain, page.names, strict=True)]
    size = sum(len(t) for t, _, _ in page.blocks)
    mean = lambda scores: sum(len(t) * scores[path] for t, path, _ in page.blocks) / size
    return fused, max(SHARE * mean(fused), PLAIN_SHARE * mean(plain))


def main_text(source: str | None) -> str:
    """The blocks whose paths' scores reach the threshold; empty for null, for no text and for pages of nothing but other parts."""
    if not source:
        return ""
    page = Page(source)
    if not page.blocks:
        return ""
    scores, threshold = path_scores(page)
    return " ".join(text for text, path, _ in page.blocks if scores[path] > 0 and scores[path] >= threshold)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html).

    A null or empty html gives an empty text. Null ids and urls are given as they are, repeated rows
    give a row each, and an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
