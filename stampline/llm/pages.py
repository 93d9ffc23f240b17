"""Main text of web pages: parser events, text-to-tag ratios per line, smoothing, threshold, regions.

The standard library's parser reads a page as a stream of events. A line is the text between two boundaries of block
elements, with the number of tags met on it; its ratio is code points by tags. Ratios are smoothed along the page by
a Gaussian, and lines at or above a threshold, the deviation of the smoothed ratios, are content. Menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are told by element, role, class or
id and never are content. The content lines select the region: the page's `article` elements that hold any, else
its `main` element, else the smallest element with nearly all of their text. Every line of the region that lies in
nothing excluded is returned, however short: the ratios choose a region, they do not drop its headings.

Defined results: null or empty html, and pages without text, have an empty text; unclosed and stray tags are allowed,
a block ends where the next one begins; a line break element counts as white space; rows are independent, so repeated
ones give repeated results; nulls in the id or url stay; other columns are ignored.
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

from stampline.llm.texts import Slice, arrow_batches, slices

#: Width of the Gaussian in lines.
SIGMA = 1.0
#: Share of the content lines' text that a region without `article` or `main` holds at least.
HOLDS = 0.9

BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search
section summary table tbody td template tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open one of the same set when they begin, inside the nearest other block.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"),
           "tr": ("td", "th", "tr")}
EXCLUDED = frozenset("""aside button canvas dialog footer form iframe input menu nav noscript object script search
select style svg template textarea title""".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
HINTS = frozenset("""ad ads adsense advert advertisement advertisements advertising adverts alert aside banner breadcrumb
breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus footer form gdpr login masthead menu
menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted
promotion replies reply respond responses share sharing sidebar signup social sponsor sponsored subscribe toolbar
topbar widget widgets""".split())
REMARKS = frozenset("comment comments discussion disqus replies reply respond responses".split())
#: Words before a hint that turn it into a remark about the layout.
LAYOUT = frozenset("has no with without".split())
_TOKEN = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


def hinted(attrs: list[tuple[str, str | None]], hints: frozenset[str]) -> bool:
    for name, value in attrs:
        if name in ("class", "id") and value:
            for part in value.split():
                tokens = [t.lower() for t in _TOKEN.findall(part)]
                if any(t in hints and not (i and tokens[i - 1] in LAYOUT) for i, t in enumerate(tokens)):
                    return True
    return False


class PageLines(HTMLParser):
    """The lines of one page, from parser events.

    lines: (text, tags, excluded, element), element being a number whose parent is `parents[number]` and whose tag
    is `tags[number]`; numbers grow in page order.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, int]] = []
        self.parents, self.tags = [-1], ["#page"]
        self.open: list[tuple[str, int, bool]] = [("#page", 0, False)]  # (tag, element, excluded)
        self.count: Counter[str] = Counter()  # of the open elements by tag
        self.inline_excluded = 0
        self.parts: list[str] = []
        self.met = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, element, excluded = self.open[-1]
            self.lines.append((text, self.met, excluded, element))
            self.met = 0
        self.parts.clear()

    def is_excluded(self, tag: str, attrs) -> bool:
        if tag in ("html", "body", "main"):
            return False
        inside = self.count["article"] or self.count["main"]
        if tag in EXCLUDED or (tag == "header" and not inside):
            return True
        if tag == "article":
            return hinted(attrs, REMARKS)
        if any(n == "role" and (v or "").strip().lower() in ROLES for n, v in attrs):
            return True
        return hinted(attrs, HINTS if inside else HINTS | {"header"})

    def handle_starttag(self, tag: str, attrs) -> None:
        self.met += 1
        if tag == "br":
            self.parts.append(" ")
        block = tag in BLOCKS
        if tag in VOID:
            if block:
                self.flush()
            return
        if block:
            self.flush()
            self.imply(tag)
        above = self.open[-1][2]
        excluded = above or self.is_excluded(tag, attrs)
        if block:
            self.parents.append(self.open[-1][1])
            self.tags.append(tag)
            self.open.append((tag, len(self.tags) - 1, excluded))
            self.count[tag] += 1
        elif excluded and (not above or self.inline_excluded):
            self.inline_excluded += 1
            self.open.append((tag, self.open[-1][1], True))
            self.count[tag] += 1

    def imply(self, tag: str) -> None:
        """Ends blocks that cannot hold this one: a paragraph, or an item by its next sibling."""
        ends = IMPLIED.get(tag, ())
        while len(self.open) > 1 and (self.open[-1][0] == "p" or self.open[-1][0] in ends
                                      or self.open[-1][0] not in BLOCKS):
            self.pop()

    def pop(self) -> None:
        tag, _, _ = self.open.pop()
        self.count[tag] -= 1
        if tag not in BLOCKS:
            self.inline_excluded -= 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)
            self.met -= 1

    def handle_endtag(self, tag: str) -> None:
        self.met += 1
        if tag in VOID:
            return
        if tag in BLOCKS:
            self.flush()
        if not self.count[tag]:
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                while len(self.open) > at:
                    self.pop()
                return
            if tag not in BLOCKS and self.open[at][0] in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1][2] and self.inline_excluded:
            return  # inside a line, but no part of it
        self.parts.append(data)

    def read(self, html: str) -> PageLines:
        self.feed(html)
        self.close()
        self.flush()
        return self


def smoothed(ratios: np.ndarray, pages: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian means along each page's lines; `pages` numbers the page of each line."""
    reach = int(np.ceil(3 * sigma))
    total, weight = np.zeros(len(ratios)), np.zeros(len(ratios))
    for step in range(-reach, reach + 1):
        w = np.exp(-0.5 * (step / sigma) ** 2)
        to = slice(max(0, -step), len(ratios) - max(0, step))
        of = slice(max(0, step), len(ratios) + min(0, step))
        if to.stop <= to.start:
            continue
        same = pages[to] == pages[of]
        total[to] += w * ratios[of] * same
        weight[to] += w * same
    return total / np.maximum(weight, 1e-300)


def content_lines(chars: np.ndarray, tags: np.ndarray, pages: np.ndarray, n_pages: int) -> np.ndarray:
    """Lines whose smoothed ratio reaches the deviation of their page's smoothed ratios."""
    smooth = smoothed(chars / np.maximum(tags, 1), pages)
    n = np.maximum(np.bincount(pages, minlength=n_pages), 1)
    mean = np.bincount(pages, smooth, n_pages) / n
    spread = np.sqrt(np.bincount(pages, (smooth - mean[pages]) ** 2, n_pages) / n)
    return smooth >= spread[pages]


def region(page: PageLines, content: np.ndarray) -> list[str]:
    """Texts of all lines of the selected region that lie in nothing excluded."""
    kept = [(text, element) for text, _, excluded, element in page.lines if not excluded]
    seeds = [(element, len(text)) for (text, _, excluded, element), c in zip(page.lines, content) if c and not excluded]
    if not seeds:
        seeds = [(element, len(text)) for text, element in kept]
    held = [0] * len(page.tags)
    for element, size in seeds:
        held[element] += size
    for e in range(len(held) - 1, 0, -1):  # children come after their parents
        held[page.parents[e]] += held[e]
    for name in ("article", "main"):
        roots = {e for e, tag in enumerate(page.tags) if tag == name and held[e]}
        if roots:
            break
    else:
        enough = HOLDS * held[0]
        roots = {max((e for e in range(len(held)) if held[e] >= enough), default=0)}
    inside = [False] * len(page.tags)
    for e in range(len(inside)):
        inside[e] = e in roots or (e > 0 and inside[page.parents[e]])
    return [text for text, element in kept if inside[element]]


def _texts(part: Slice, html: str) -> list[str]:
    pages = [PageLines().read(h or "") for h in part.batch.column(part.batch.schema.get_field_index(html)).to_pylist()]
    lines = [line for page in pages for line in page.lines]
    owner = np.repeat(np.arange(len(pages)), [len(p.lines) for p in pages])
    content = content_lines(np.array([len(t) for t, *_ in lines], float), np.array([n for _, n, *_ in lines], float),
                            owner, len(pages))
    cuts = np.searchsorted(owner, np.arange(len(pages) + 1))
    return ["\n".join(region(p, content[a:b])) for p, a, b in zip(pages, cuts[:-1], cuts[1:])]


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    kept = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"), pages[html].alias("html"))
    schema = f"page_id {kept.schema['page_id'].dataType.simpleString()}, url string, text string"

    def run(batches: Iterator[pa.RecordBatch]):
        for part in slices(batches, "html"):
            yield pa.RecordBatch.from_arrays(
                [part.batch.column("page_id"), part.batch.column("url"), pa.array(_texts(part, "html"), pa.string())],
                names=["page_id", "url", "text"])

    return arrow_batches(kept).mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
