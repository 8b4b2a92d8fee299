"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, and threshold clustering.

The standard library's streaming parser turns a page into lines, one per block element, each with its text, the number
of tags met while it was read, and the place where it stands. Lines in elements that hold no prose (scripts, forms, menus, page
headers and footers) go. Each other line's ratio of unlinked text to tags, lowered where a class, id or role tells of an advert, a notice
or the like, is smoothed with a Gaussian kernel; lines whose smoothed ratio passes the threshold are the core. The content region
is made of the core's runs in the smallest element that holds most of its text: from the first to the last of its lines, what stands between
them, and on either side the neighbours that stand in the same element and aren't links; an ``article`` or ``main`` around it is taken whole. In the region
all lines stay, short ones too, but those of lowered ratio that don't pass the threshold by themselves. Reader comments are prose as well, so
that no ratio can tell them: their lines count as empty.

Scale: a page is worked on alone, in the task that reads it; there is no shuffle, and memory is bounded by an Arrow batch.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Elements that end the line before them and begin a new one.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
#: Elements whose text is never content.
NEVER = frozenset(
    "head title script style noscript template nav footer aside form button select textarea input iframe object embed svg canvas "
    "audio video map dialog menu search datalist label fieldset header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that tell what isn't content; what tells of reader comments; and words that may stand beside them.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar sidebars aside footer foot header masthead topbar cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations search toolbar "
    "pager pagination widget widgets copyright disclaimer hidden".split())
COMMENTS = frozenset("comment comments commentlist reply replies disqus respond".split())
BESIDE = frozenset(
    "area article bar block body bottom box button buttons container content entry footer global group header inner item items left line link links list main "
    "message new news outer page panel post posts primary reader readers region right row secondary section site slot stories text thread top unit user users "
    "warning wrap wrapper js id".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Width of the kernel in lines; the core passes this share of the mean smoothed ratio; the region holds this share of the core;
#: a class or id doesn't count on an element that holds this share of the text of a page without article or main; what it leaves of a ratio.
SIGMA, THRESHOLD, MOST_OF, WRAPPER, LOWERED = 1.0, 0.5, 0.6, 0.7, 0.25


def hint(value: str) -> int:
    """What a class or id tells: 2 that its element isn't content, 3 that it holds comments, 0 nothing. All words of a name must tell so or be
    neutral ones: ``comment-list`` does, ``comments-off`` and ``social-history`` don't."""
    found = 0
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if all(w in HINTS or w in COMMENTS or w in BESIDE for w in words):
            found = max([found, *[3 if w in COMMENTS else 2 for w in words if w in COMMENTS or w in HINTS and (w not in BESIDE or len(words) == 1)]])
    return found


class _Lines(HTMLParser):
    """Collects elements (parent, name, set aside) and lines (element, text, unlinked characters, tags)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.name, self.aside = [-1], ["#root"], [0]  # aside: 1 by element or role, 2 or 3 by class or id
        self.open = [0]
        self.lines: list[tuple[int, str, int, int]] = []
        self.parts: list[str] = []
        self.linked = self.tags = self.links = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((self.open[-1], text, max(0, len(text) - self.linked), max(1, self.tags)))
        self.parts, self.linked, self.tags = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            if self.name[self.open[-1]] == "p":
                self.close_top()
            self.end_line()
            if tag in ("li", "dt", "dd", "option", "tr") and self.name[self.open[-1]] == tag:
                self.close_top()
        elif tag == "br":
            self.parts.append(" ")
        elif tag in ("td", "th"):
            self.parts.append(" ")
        elif tag == "a":
            self.links += 1
        if tag in VOID:
            return
        aside = 1 if tag in NEVER else 0
        for key, value in attrs:
            if key == "role" and (value or "").lower() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
                aside = 1
            elif key == "style" and value and "display:none" in value.replace(" ", "").lower():
                aside = 1
            elif key in ("class", "id") and value and aside != 1 and tag not in ("html", "body", "main", "article"):
                aside = max(aside, hint(value))
        if tag in BLOCKS or aside:
            if tag not in BLOCKS:
                self.end_line()
            self.parent.append(self.open[-1])
            self.name.append(tag)
            self.aside.append(aside)
            self.open.append(len(self.name) - 1)

    def close_top(self) -> None:
        self.end_line()
        self.open.pop()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML has no self-closing elements but the void ones

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        for k in range(len(self.open) - 1, 0, -1):
            if self.name[self.open[k]] == tag:
                while len(self.open) > k:
                    self.close_top()
                return
        if tag in BLOCKS:
            self.end_line()

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.links:
            self.linked += len(data)

    def done(self, html: str) -> None:
        self.feed(html)
        self.close()
        while len(self.open) > 1:
            self.close_top()
        self.end_line()


def _smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]
    return np.convolve(ratios, kernel)[reach:-reach] / weights


def _ratios(lines: list[tuple[int, str, int, int]], share: list[float]) -> np.ndarray:
    """Unlinked text to tags, lowered where a class tells so."""
    return np.array([share[at] * unlinked / tags for at, _, unlinked, tags in lines], float)


def main_text(html: str | None) -> str:
    """The page's main text: blocks in page order, joined by an empty line; empty if there is none."""
    if not html:
        return ""
    page = _Lines()
    page.done(html)
    parent, name, aside = page.parent, page.name, page.aside
    n = len(name)
    never = [False] * n
    for k in range(1, n):
        never[k] = never[parent[k]] or aside[k] == 1
    size = [0] * n
    for at, text, _, _ in page.lines:
        size[at] += 0 if never[at] else len(text)
    for k in range(n - 1, 0, -1):
        size[parent[k]] += size[k]
    # A class that tells of a sidebar may stand on the element around everything: it doesn't count around the article.
    holds = [False] * n
    for k in range(n - 1, 0, -1):
        if name[k] in ("article", "main"):
            holds[k] = True
        if holds[k]:
            holds[parent[k]] = True  # in the end also the root's
    out, inside, share = [False] * n, [False] * n, [1.0] * n
    for k in range(1, n):
        inside[k] = inside[parent[k]] or name[k] in ("article", "main")
        share[k] = share[parent[k]]
        if aside[k] > 1 and not holds[k] and (holds[0] or size[k] < WRAPPER * size[0]):
            share[k] = min(share[k], LOWERED if aside[k] == 2 else 0.0)
        out[k] = out[parent[k]] or aside[k] == 1
        # The article's own header: its headings are content.
        if name[k] in HEADINGS and out[k] and aside[k] != 1 and inside[k]:
            p, only = parent[k], True
            while p and name[p] not in ("article", "main"):
                only = only and (aside[p] != 1 or name[p] == "header")
                p = parent[p]
            out[k] = not only or out[p]
            share[k] = share[p] if only else share[k]
    lines = [x for x in page.lines if not out[x[0]]]
    ratio = _ratios(lines, share)
    if not ratio.any():
        return ""
    smooth = _smooth(ratio)
    least = THRESHOLD * smooth.mean()
    core = (smooth >= least) & (ratio > 0)
    weight = [0.0] * n
    for x, is_core in zip(lines, core, strict=True):
        if is_core:
            weight[x[0]] += share[x[0]] * x[2]
    total = sum(weight)
    for k in range(n - 1, 0, -1):
        weight[parent[k]] += weight[k]
    # Parents come before children: the last element with enough of the core is the smallest.
    region = max((k for k in range(n) if weight[k] >= MOST_OF * total), default=0)
    whole, k = False, region
    while k and not whole:
        whole = name[k] in ("article", "main")
        region, k = (k if whole else region), parent[k]
    if name[region] in ("p", "li", "td", *HEADINGS):
        region = parent[region]
    within = [False] * n
    within[region] = True
    for k in range(region + 1, n):
        within[k] = within[parent[k]]
    own = [i for i, x in enumerate(lines) if within[x[0]]]
    if not whole:
        own = _cluster(own, lines, core, parent)
    return "\n\n".join(lines[i][1] for i in own if share[lines[i][0]] == 1 or core[i] and ratio[i] >= least)


def _cluster(own: list[int], lines: list[tuple[int, str, int, int]], core: np.ndarray, parent: list[int]) -> list[int]:
    """From the first to the last core line of the region, and neighbours in the same element that are mostly unlinked."""
    at = [j for j, i in enumerate(own) if core[i]]
    first, last = at[0], at[-1]
    joins = lambda j, home: parent[lines[own[j]][0]] == home and 2 * lines[own[j]][2] > len(lines[own[j]][1])
    home = parent[lines[own[first]][0]]
    while first and joins(first - 1, home):
        first -= 1
    home = parent[lines[own[last]][0]]
    while last + 1 < len(own) and joins(last + 1, home):
        last += 1
    return own[first : last + 1]


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: id, url, text, n_chars (code points). Other columns are left out.

    Defined cases: null or empty html, and pages without content, give an empty text; null ids and urls are kept; repeated
    rows give repeated results; markup that never closes ends with the page; very long pages are parsed whole; of elements that hold equally
    much of the core the innermost counts; an empty table gives no rows.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=[id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(work, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
