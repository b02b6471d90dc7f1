"""Main text of web pages from the standard library's streaming parser.

Parser events become lines: one per block of text, with the tags met while it was read and the place in the tree. Each
line's text-to-tag ratio (characters outside links over tags) is smoothed along the page with a Gaussian kernel; lines above a
threshold (a share of the standard deviation) form the content cluster, if some line of their container passes it by itself too.
The region is the innermost container that holds nearly all of the cluster's text; an article or main element inside it that
holds much of it is taken instead. The text is what lies in the region between the cluster's ends, and lines near them.

Tags, roles and class words that tell menus, headers, footers, sidebars, adverts, notices and reader comments apart only take lines
away: their lines count in the smoothed ratios, but neither choose the region nor stay in it. Scripts, forms and other
elements without article text are not read at all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "button", "textarea", "form", "dialog"}
APART = {"nav", "footer", "aside", "header", "menu"}
BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | APART
#: Opening the key closes an open element of these kinds, as browsers do.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "aside", "nav", "footer", "header", "blockquote"}
BAD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adv|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|subscription|signup|login|sidebar|side-?bar|nav|navbar|navigation|menu|breadcrumbs?|footer|foot|masthead|toolbar|share|sharing|social|related|recommend\w*|comments?|comment-?list|disqus|replies|reply|respond|pagination|pager|widget\w*|skip|toc|tags|copyright|disclaimer|alert)(?:$|[\s_-])", re.I)
#: Class names that say what a container may have, not what it is.
ABOUT = re.compile(r"^(?:has|is|no|not|with|without|js)[_-]|[_-](?:with|has|no|without)[_-]", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
WHITE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Collects lines: text, tags, link characters, container, whether hints tell against it. All steps are linear in depth."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, int]] = []  # tag, silent below, hinted below, container
        self.open: Counter[str] = Counter()
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.parent: list[int] = [-1]  # of each container, always before it
        self.named: list[str] = ["html"]
        self.buf: list[str] = []
        self.tags = self.links = 0

    def end_line(self) -> None:
        if self.buf:
            text = WHITE.sub(" ", "".join(self.buf)).strip()
            if text:
                _, _, hinted, box = self.stack[-1] if self.stack else ("", False, False, 0)
                self.lines.append((text, self.tags, min(self.links, len(text)), box, hinted))
                self.tags = 0
            self.buf.clear()
        self.links = 0

    def close_from(self, i: int) -> None:
        for tag, *_ in self.stack[i:]:
            self.open[tag] -= 1
        del self.stack[i:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.buf.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.end_line()
            return
        if ends := CLOSES.get(tag):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in ends:
                    self.end_line()
                    self.close_from(i)
                    break
                if self.stack[i][0] in BOUNDS and self.stack[i][0] not in ends:
                    break
        silent, hinted, box = self.stack[-1][1:] if self.stack else (False, False, 0)
        if tag in BLOCK:
            self.end_line()
            if tag in BOUNDS:
                self.parent.append(box)
                self.named.append(tag)
                box = len(self.parent) - 1
        silent = silent or tag in SILENT
        bad = tag in APART
        for k, v in attrs:
            if k == "hidden" or (k == "aria-hidden" and v == "true"):
                silent = True
            elif v and k in ("class", "id"):
                bad = bad or (tag not in ("html", "body", "main", "article") and any(BAD.search(w) and not ABOUT.search(w) for w in v.split()))
            elif v and k == "role":
                bad = bad or v.lower() in ROLES
                if v.lower() in ("main", "article") and tag in BOUNDS:
                    self.named[box] = v.lower()
            elif v and k == "itemprop" and v.lower() == "articlebody" and tag in BOUNDS:
                self.named[box] = "article"
            elif v and k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
                silent = True
        # a hinted part of a line isn't read; a hinted block is read as lines that are told apart
        self.stack.append((tag, silent or (bad and tag not in BLOCK), hinted or bad, box))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:  # HTML gives the slash no meaning
            self.handle_starttag(tag, attrs)
            if tag not in BLOCK and tag not in SILENT:
                self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br":
            self.buf.append(" ")
        if self.open[tag] <= 0:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if any(x[0] in BLOCK for x in self.stack[i:]):
                    self.end_line()
                self.close_from(i)
                return
            if tag not in BLOCK and self.stack[i][0] in BOUNDS:
                return  # a stray end of an inline element

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][1]:
            return
        self.buf.append(data)
        if self.open["a"] > 0:
            self.links += len(data)


def smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian kernel over three sigmas, scaled at the ends to the part inside."""
    r = max(1, round(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(x, k)[r : r + len(x)] / np.convolve(np.ones(len(x)), k)[r : r + len(x)]


def cluster(raw: np.ndarray, box: np.ndarray, boxes: int, sigma: float, share: float) -> np.ndarray:
    """Which lines' smoothed ratios pass the threshold, in containers where one passes it by itself."""
    ratio = smooth(raw, sigma)
    least = max(share * float(ratio.std()), 1e-9)
    core = ratio >= least
    alone = core & (raw >= least)
    if not alone.any():
        core = alone = raw >= raw.max()
    rich = np.zeros(boxes, bool)
    rich[box[alone]] = True
    return core & rich[box]


def main_text(html: str, sigma: float = 1.0, share: float = 0.5, nearly: float = 0.8, much: float = 0.3) -> str:
    """Blocks of the article joined by an empty line; empty where there is none."""
    p = Lines()
    p.feed(html)
    p.close()
    p.end_line()
    if not p.lines:
        return ""
    size, tags, linked, box = (np.array(c) for c in zip(*((len(t), n, k, b) for t, n, k, b, _ in p.lines), strict=True))
    clear = ~np.array([h for *_, h in p.lines])
    raw = (size - linked) / (tags + 1.0)
    core = np.zeros(len(raw), bool)
    for read in (np.arange(len(raw)), np.flatnonzero(clear)):  # without the lines told apart, where the cluster is among those alone
        if len(read) and not core.any():
            core[read] = cluster(raw[read], box[read], len(p.parent), sigma, share)
            core &= clear
    if not core.any():
        return ""
    weight = np.bincount(box, np.where(core, size - linked, 0.0), len(p.parent))
    for b in range(len(p.parent) - 1, 0, -1):  # containers come after the ones they are in
        weight[p.parent[b]] += weight[b]
    region = 0
    for b in range(1, len(p.parent)):
        if p.parent[b] == region and weight[b] >= nearly * weight[0] > 0:
            region = b
    inside = np.zeros(len(p.parent), bool)
    marked = np.zeros(len(p.parent), bool)  # the outermost article or main that holds much of the cluster
    above = np.zeros(len(p.parent), bool)
    best = max((weight[b] for b in range(len(p.parent)) if p.named[b] in ("article", "main")), default=0.0)
    for b in range(len(p.parent)):
        up = p.parent[b]
        inside[b] = b == region or (up >= 0 and inside[up])
        above[b] = up >= 0 and (above[up] or marked[up])
        marked[b] = not above[b] and p.named[b] in ("article", "main") and weight[b] >= max(0.5 * best, much * weight[0], 1e-9)
    if marked.any():
        kept = (marked | above)[box] & clear
    else:
        at = np.flatnonzero(core & inside[box])
        place = np.arange(len(box))
        joined = (place >= at[0]) & (place <= at[-1])
        if p.named[region] not in ("html", "body"):  # near the cluster and in its own container
            near = round(3 * sigma)
            joined |= (place >= at[0] - near) & (place <= at[-1] + near) & ((box == box[at[0]]) | (box == box[at[-1]]))
        kept = inside[box] & clear & (core | (joined & (linked < 0.5 * size)))
    return "\n\n".join(p.lines[i][0] for i in np.flatnonzero(kept))


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length in code points of every row, from the whole html; null or empty html: empty text.

    Ill-formed or deeply nested markup never fails: unclosed elements end with their container, and no step recurses. Repeated
    rows give repeated rows; other columns are ignored. One narrow pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, hs in texts(batches, "page_id", "url", "html"):
            found = [main_text(h) for h in hs]
            yield pa.RecordBatch.from_pydict({"page_id": pa.array(ids, pa.int64()), "url": pa.array(urls, pa.string()), "text": pa.array(found, pa.string()), "n_chars": pa.array([len(t) for t in found], pa.int64())})

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
