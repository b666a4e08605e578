"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines: one a block
element, with the characters and tags met in it and the container around it.
The ratio of text to tags is smoothed over neighbouring lines with a Gaussian;
two-means clustering of the smoothed ratios gives the threshold between content
and the rest.  The regions are the article and main elements of which the
content lines hold the larger part of the text (of nested ones the innermost
that holds all of it, unless the outer one has text of its own before it: then
the nested one is a reader's remark), or where there is none the innermost container around
all content; there, link lists before the first and after the last
content line are left out.  All other lines of the regions are returned but
those inside menus, headers, footers, sidebars, notices, adverts, forms and
comments.  A form, or an element marked as layout, with more than half of a page's text is the page's frame.
Of regions with equal content the one with more text counts, then the later.

Defined results: null and empty pages give an empty text, as do pages without
text; broken or cut-off markup is read as far as it goes: end tags that HTML
lets pages omit are supplied, an unclosed comment or tag ends the page.  A page
without any container is a region itself.  Time is in proportion to the page,
however deep its elements are nested.  Repeated pages give equal rows; other
columns are never read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pieces

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style noscript template iframe object svg math canvas audio video".split())
#: What may stand in a head; anything else ends one without an end tag.
HEAD = frozenset("html head title base basefont bgsound link meta style script noscript noframes template".split())
ASIDE = frozenset("nav footer aside menu dialog button select textarea datalist".split())
CONTAINER = frozenset("article main section div td body html center form".split())
BLOCK = CONTAINER | ASIDE | frozenset(
    "address blockquote dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr li ol p pre summary table tbody thead tfoot tr th ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends the open elements named first, unless one of those named second is open inside them.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "body": (("head",), ()),
}
#: Parts of class names, ids and roles that mark what is not the article, whatever stands beside them.
MARKS = frozenset(
    "advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr sidebar navbar breadcrumb breadcrumbs comments disqus newsletter "
    "subscribe subscription pagination masthead complementary contentinfo".split()
)
#: Parts that mark it alone or beside neutral parts only.
WEAK_MARKS = frozenset(
    "ad ads promo promotion banner notice notices alert alerts popup modal overlay aside menu nav navigation comment reply replies respond share sharing social related "
    "recommended signup login search pager footer toolbar hidden".split()
)
NEUTRAL = frozenset(
    "a b c area bar block body bottom box btn button buttons card center col column container content count dialog element field footer form frame global group head header icon icons inner "
    "item items js large layer left link links list main mobile module nav new outer page panel post posts primary right row secondary section site slot small sticky tab tabs thread title "
    "top unit user widget widgets wrap wrapper".split()
)
#: Marks that hold whatever share of the page they are on.
STRICT = MARKS - {"sidebar", "navbar", "masthead"} | frozenset("ad ads promo promotion comment reply replies respond related recommended hidden".split())
#: Marks that whole pages carry on their outer elements too: there they do not reach an article inside.
LAYOUT = frozenset("sidebar menu nav navbar navigation banner header footer masthead toolbar social share sharing modal overlay popup".split())
_PARTS = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")
_CUT_OFF = re.compile(r"<[!/?a-zA-Z]")


def marks(attributes: list[tuple[str, str | None]]) -> set[str]:
    """The marks that an element's attributes carry."""
    found: set[str] = set()
    for name, value in attributes:
        if name in ("class", "id", "role") and value:
            for token in value.lower().split():
                parts = {x for x in _PARTS.split(token) if x and not x.isdigit()}
                found.update(parts & MARKS)
                if parts <= WEAK_MARKS | NEUTRAL | MARKS:
                    found.update(parts & WEAK_MARKS)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "")):
            found.add("hidden")
    return found


@dataclass
class Line:
    text: str
    tags: int
    container: int
    #: In something that is not the article; whether the innermost form counts is told later.
    aside: bool
    form: int
    #: The elements around it whose marks may be those of the page's frame.
    frames: tuple[int, ...]
    heading: bool
    linked: int


class Lines(HTMLParser):
    """Collects the lines of a page and its containers: their ``kinds`` and, smaller, the numbers of the ``parents`` around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, int, bool, tuple]] = []  # tag, container or -1, unseen, change of aside, firm, frames before
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.blocks: list[int] = []
        self.kinds: list[str] = []
        self.parents: list[int] = []
        self.inside: list[int] = []  # containers that are open
        self.inside_at: list[int] = []  # their places in the stack
        self.forms: list[int] = []
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.unseen = self.aside = self.firm = 0
        self.frames: tuple[int, ...] = ()
        self.n_frames = 0
        self.heading = False

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these, -1 if there is none."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        self.parts.clear()
        if text:
            self.lines.append(Line(text, self.tags, self.inside[-1] if self.inside else -1, self.aside > 0, self.forms[-1] if self.forms else -1, self.frames, self.heading, self.linked))
            self.tags = self.linked = 0

    def pop_to(self, size: int) -> None:
        while len(self.stack) > size:
            tag, container, unseen, aside, firm, self.frames = self.stack.pop()
            self.open[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            self.unseen -= unseen
            self.aside -= aside
            self.firm -= firm
            if container >= 0:
                self.inside.pop()
                self.inside_at.pop()
                if tag == "form":
                    self.forms.pop()

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
            self.heading = tag in HEADINGS
        elif tag == "br":
            self.parts.append(" ")
        if tag not in HEAD and self.open.get("head"):
            self.pop_to(self.open["head"][-1])
        if tag in ENDS:
            ended, kept = ENDS[tag]
            at = min((x for x in (self.last(t) for t in ended) if x > self.last(*kept)), default=-1)
            if at >= 0:
                self.pop_to(at)
        if tag in BLOCK and tag != "li":
            # a block ends an open paragraph
            at = self.last("p")
            if at > (self.inside_at[-1] if self.inside_at else -1):
                self.pop_to(at)
        if tag in VOID:
            return
        articles = len(self.open.get("article", ())) + len(self.open.get("main", ()))
        container = -1
        if tag in CONTAINER:
            container = len(self.kinds)
            self.kinds.append("main" if ("role", "main") in attrs else tag)
            self.parents.append(self.inside[-1] if self.inside else -1)
            self.inside.append(container)
            self.inside_at.append(len(self.stack))
            if tag == "form":
                self.forms.append(container)
        firm = tag in ASIDE or (tag == "header" and not articles)
        before = self.frames
        if tag in ("article", "main") and not (found := marks(attrs)):
            # an outer element's layout marks end here
            aside = 0 if articles or self.firm else -self.aside
            if not (articles or self.firm):
                self.frames = ()
        else:
            found = marks(attrs) if tag not in ("html", "body") else set()
            framed = bool(found) and not firm and not found & STRICT
            firm = firm or (not framed and not found <= LAYOUT)
            aside = int(firm or (bool(found) and not framed))
            if framed:
                self.frames = (*before, self.n_frames)
                self.n_frames += 1
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, container, tag in UNSEEN, aside, firm, before))
        self.unseen += tag in UNSEEN
        self.aside += aside
        self.firm += firm

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        at = self.last(tag)
        # an inline end tag reaches no further than its block
        if at >= 0 and (tag in BLOCK or tag in UNSEEN or not self.blocks or at > self.blocks[-1]):
            self.pop_to(at)

    def handle_data(self, data):
        if not self.unseen:
            self.parts.append(data)
            if self.open.get("a"):
                self.linked += len(data)

    def finish(self, html: str) -> Lines:
        self.feed(html)
        if _CUT_OFF.match(self.rawdata):
            self.rawdata = ""
        self.close()
        self.flush()
        return self


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(values, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


#: Two clusters' centres differ by this factor at least, else all lines are of one kind.
APART = 3.0


def threshold(values: np.ndarray, rounds: int = 30) -> float:
    """The middle between the centres of two clusters, the least value if they are no further than ``APART``; ratios are compared as logarithms."""
    low, high = values.min(), values.max()
    for _ in range(rounds):
        cut = (low + high) / 2
        upper = values >= cut
        if upper.all() or not upper.any():
            return float(values.min())
        a, b = values[~upper].mean(), values[upper].mean()
        if (a, b) == (low, high):
            break
        low, high = a, b
    return float((low + high) / 2) if high - low >= np.log(APART) else float(values.min())


def is_content(lines: list[Line]) -> np.ndarray:
    """Whether each line's smoothed text-to-tag ratio reaches the threshold between the two clusters."""
    level = smooth(np.log1p(np.array([len(x.text) / max(1, x.tags) for x in lines])))
    return level >= threshold(level)


def _subtree_sums(values: np.ndarray, parents: list[int]) -> np.ndarray:
    """Adds each container's value to those around it; a container's number is larger than its parent's."""
    out = values.copy()
    for c in range(len(parents) - 1, -1, -1):
        if parents[c] >= 0:
            out[parents[c]] += out[c]
    return out


#: Text of its own, in characters and as a share of the nested article's, that makes what is nested after it a reader's remark.
REMARK_CHARS, REMARK_SHARE = 60, 0.25


def _own_before(lines: list[Line], parents: list[int], kinds: list[str], use: np.ndarray) -> np.ndarray:
    """For each nested article the text of the article around it, outside nested ones, that stands before it; headings and links do not count."""
    n = len(kinds)
    home = np.full(n, -1)  # the innermost article of each container
    for c in range(n):
        home[c] = c if kinds[c] in ("article", "main") else home[parents[c]] if parents[c] >= 0 else -1
    said, out, met = np.zeros(n + 1), np.zeros(n), np.zeros(n + 1, bool)
    for x, used in zip(lines, use):
        h = home[x.container] if x.container >= 0 else -1
        k = h
        while k >= 0 and not met[k]:
            met[k] = True
            around = home[parents[k]] if parents[k] >= 0 else -1
            out[k] = said[around] if around >= 0 else 0
            k = around
        if used and h >= 0 and not x.heading and x.linked * 2 <= len(x.text):
            said[h] += len(x.text)
    return out


def main_lines(html: str | None) -> list[str]:
    """The lines of the main text in page order."""
    if not html:
        return []
    page = Lines().finish(html)
    lines, parents, kinds = page.lines, page.parents, page.kinds
    if not lines:
        return []
    n = len(kinds)
    content = is_content(lines)
    at = np.array([x.container for x in lines])
    size = np.array([len(x.text) for x in lines])
    aside = np.array([x.aside for x in lines])
    form = np.array([x.form for x in lines])
    # a form or a marked element with most of the page's text is its frame
    total = size[~aside].sum()
    in_form = np.bincount(form[~aside & (form >= 0)], weights=size[~aside & (form >= 0)], minlength=n)
    in_frame = np.zeros(page.n_frames)
    for x, k, out in zip(lines, size, aside):
        for f in () if out else x.frames:
            in_frame[f] += k
    marked = np.array([any(in_frame[f] * 2 <= total for f in x.frames) for x in lines])
    aside = aside | marked | ((form >= 0) & ((in_form * 2 <= total)[form] if n else False))
    use = ~aside & (at >= 0)
    weight = _subtree_sums(np.bincount(at[use & content], weights=size[use & content], minlength=n), parents)
    whole = _subtree_sums(np.bincount(at[use], weights=size[use], minlength=n), parents)
    outer, best = np.full(n, -1), {}  # the outermost article around each container
    own = _own_before(lines, parents, kinds, use)
    remarks: set[int] = set()
    for c in range(n):
        around = parents[c]
        outer[c] = outer[around] if around >= 0 else -1
        if outer[c] < 0 and kinds[c] in ("article", "main"):
            outer[c] = c
        if around >= 0 and around in remarks:
            remarks.add(c)
        elif kinds[c] in ("article", "main") and whole[c] > 0:
            # of nested ones the innermost with all of the content, but for those that follow the outer one's own text
            o = int(outer[c])
            if o != c and own[c] >= max(REMARK_CHARS, REMARK_SHARE * whole[c]):
                remarks.add(c)
            elif o not in best or (weight[c], c) > (weight[best[o]], best[o]):
                best[o] = c
    regions: set[int] = set()
    if best:
        most = max(best.values(), key=lambda c: (weight[c], whole[c], c))
        regions = {most} | {c for c in best.values() if weight[c] * 2 > whole[c]}
    else:
        total = size[use & content].sum()
        full = [c for c in range(n) if total and weight[c] >= total]  # around all content lines
        if full:
            regions = {max(full)}
            here = np.flatnonzero(content & ~aside)
            linked = np.array([x.linked * 2 > len(x.text) for x in lines])
            place = np.arange(len(lines))
            aside |= linked & ((place < here[0]) | (place > here[-1]))
    if not regions:
        return [x.text for x, a in zip(lines, aside) if not a]
    inside = np.zeros(n, bool)
    for c in range(n):
        inside[c] = c not in remarks and (c in regions or (parents[c] >= 0 and inside[parents[c]]))
    return [x.text for x, a, c in zip(lines, aside, at) if not a and c >= 0 and inside[c]]


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per page: the id, ``text`` and its number of code points ``n_chars``."""
    rows = pages.select(F.col(id_col), F.col(html_col).cast("string").alias("html"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                texts = ["\n".join(main_lines(x)) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[id_col, "text", "n_chars"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, text string, n_chars long")
