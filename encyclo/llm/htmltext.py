"""Main text of HTML pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters.

A page is read once as the event stream of the standard library's parser.
The events are cut into lines: a line is the text of one block (the source's
own line breaks say nothing, a page may come as a single one).  For every
line the stream gives its text, its characters inside links, the tags seen
since the line before, its place in the element tree, and whether an element
around it marks it as something other than the article: by tag (menu, header,
footer, sidebar, form, script, style...), by role, by being hidden, or by a
word of its class or id (advert, cookie notice, comments...).

The ratio of a line is its characters outside links per tag, zero for marked
lines.  Ratios are smoothed over neighbouring lines with a Gaussian kernel;
the lines whose smoothed ratio reaches the threshold (a share of the standard
deviation of the page's ratios, at most the largest one) are the text clusters.
They select the content region: the ``article`` elements, else the ``main``
elements, when these hold most of the clusters' text; else the smallest element
that holds nearly all of it.  The result is the region's whole unmarked text,
so a short paragraph beside long ones stays; in a region found by its size
alone, lines that are mostly links outside every cluster go as well.

How it scales: one map over the pages, nothing is shuffled or broadcast;
memory is a multiple of one page.

Defined cases: a null or empty page, and one without unmarked text, give the
empty text with 0 characters.  Unclosed and stray tags are read as browsers
do (a block ends an open paragraph, an end tag closes what it holds); an
unclosed script runs to the end of the page.  Character references are decoded,
Unicode white space counts as white space, a line break is a space.  Long pages
are read whole.  Kept columns named like a new one give way to it.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_batches

SIGMA = 1.0
RADIUS = 2
SHARE = 0.25       # of the standard deviation: threshold of the smoothed ratio
MOST = 0.5         # of the clusters' text: articles or main elements with more are the region
NEARLY_ALL = 0.95  # of the clusters' text: the smallest element with more is the region

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym audio b bdi bdo big br button canvas cite code data del dfn em embed font i
    iframe img input ins kbd label map mark meter noscript object param picture progress q rp rt ruby s samp script
    select option small source span strike strong style sub sup svg template textarea time track tt u var video
    wbr""".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOT_ARTICLE = frozenset("""head title nav header footer aside form script style noscript template iframe object applet svg
    canvas math audio video button select option textarea dialog menu frameset noframes""".split())
# an open element of the key ends where one of its values starts
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}}
HOLDERS = frozenset("ul ol dl table select article main section div body".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
# words of class and id names
MARKING = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion
    cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup modal overlay
    sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager
    header masthead topbar footer share sharing social related recommended toolbar
    comment comments commentlist disqus reply replies respond hidden""".split())
READERS = frozenset("ad ads advert advertisement sponsored comment comments commentlist disqus reply replies respond".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Lines(HTMLParser):
    """Lines of one page and the tree of its elements.

    ``text``, ``links``, ``tags``, ``place``, ``marked``, ``heading`` describe the lines;
    ``parent`` and ``tag`` the elements (0 is the page).
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag = [0], [""]
        self.open: list[tuple[str, int, str]] = [("", 0, "")]  # tag, element, mark
        self.text, self.links, self.tags, self.place, self.marked = [], [], [], [], []
        self.now: list[str] = []  # text of the line that is going on
        self.aside: list[str] = []  # and text of marked elements inside it
        self.linked = self.seen = self.in_link = 0

    # -- events ---------------------------------------------------------
    def handle_starttag(self, tag, attrs):
        self.seen += 1
        if self.open[-1][0] == "head" and tag not in IN_HEAD:
            self.flush()
            self.open.pop()
        if tag not in INLINE:
            self.flush()
            self.imply(tag)
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        if tag == "a":
            self.in_link += 1
        mark = self.open[-1][2] or ""
        own = self.mark_of(tag, attrs)
        if tag in HEADINGS and mark == "article header":
            mark = ""  # the headline is part of the article
        elif tag in ("main", "article") and mark == "layout" and not own:
            mark = ""  # a wrapper's name said too much
        self.parent.append(self.open[-1][1])
        self.tag.append(tag)
        self.open.append((tag, len(self.parent) - 1, mark or own))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math", "path"):  # only foreign elements end here
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.seen += 1
        if tag not in INLINE:
            self.flush()
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                if any(x[0] == "a" for x in self.open[i + 1:]):
                    self.in_link = 0
                del self.open[i:]
                return
            if tag in INLINE and self.open[i][0] not in INLINE:
                return  # an inline end tag closes nothing outside its block

    def handle_data(self, data):
        if self.open[-1][2]:
            self.aside.append(data)
            return
        self.now.append(data)
        if self.in_link:
            self.linked += len(data)

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    # -- lines ----------------------------------------------------------
    def imply(self, tag):
        """End what the start of a block ends by itself: an open paragraph, a list item before the next one."""
        for i in range(len(self.open) - 1, 0, -1):
            was = self.open[i][0]
            if was == "p" or tag in CLOSED_BY.get(was, ()):
                if any(x[0] == "a" for x in self.open[i:]):
                    self.in_link = 0
                del self.open[i:]
                return
            if was in HOLDERS:
                return

    def mark_of(self, tag, attrs) -> str:
        """Why the element is not part of an article; empty if nothing says so."""
        inside = any(x[0] in ("article", "main") for x in self.open)
        if tag == "header" and inside:
            return "article header"
        if tag in NOT_ARTICLE:
            return "tag"
        if tag in ("html", "body", "main") or not attrs:
            return ""
        a = dict(attrs)
        if a.get("role") in ROLES or "hidden" in a or a.get("aria-hidden") == "true" \
                or "display:none" in (a.get("style") or "").replace(" ", "").lower():
            return "tag"
        words = {w.lower() for w in _WORD.findall(f"{a.get('class') or ''} {a.get('id') or ''}")}
        if tag == "article":
            words &= READERS
        if words & READERS:
            return "tag"
        if words & MARKING:
            return "article header" if inside and words & MARKING == {"header"} else "layout"
        return ""

    def flush(self):
        """The text since the last block boundary is a line, unless it is blank; marked text is one of its own."""
        for pieces, linked, marked in ((self.aside, 0, True), (self.now, self.linked, False)):
            text = " ".join("".join(pieces).split())
            if text:
                self.text.append(text)
                self.links.append(min(linked, len(text)))
                self.tags.append(self.seen)
                self.place.append(self.open[-1][1])
                self.marked.append(marked)
                self.seen = 0
            pieces.clear()
        self.linked = 0


def smooth(x: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian mean over ``radius`` neighbours on each side; beyond the ends there is nothing."""
    kernel = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma * sigma))
    whole = np.convolve(x, kernel)[radius:len(x) + radius]
    return whole / np.convolve(np.ones(len(x)), kernel)[radius:len(x) + radius]


def clusters(page: Lines) -> np.ndarray:
    """Which lines belong to a text cluster."""
    marked = np.array(page.marked)
    chars = np.array([len(t) for t in page.text]) - np.array(page.links)
    ratio = np.where(marked, 0.0, chars / np.maximum(page.tags, 1))
    smoothed = np.where(marked, 0.0, smooth(ratio))
    if not smoothed.max(initial=0.0):
        return ~marked  # nothing but links outside the marked lines
    return smoothed >= min(SHARE * smoothed.std(), smoothed.max()) if len(smoothed) > 1 else ~marked


def main_text(html: str | None) -> str:
    """The article of a page, its blocks in page order joined by an empty line."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    if all(page.marked):
        return ""
    chosen = clusters(page) & ~np.array(page.marked)
    size = np.array([len(t) for t in page.text])
    place = np.array(page.place)

    # text of the clusters in every element, its children included (children come after their parents)
    mass = np.bincount(place, weights=np.where(chosen, size, 0), minlength=len(page.parent))
    for e in range(len(page.parent) - 1, 0, -1):
        mass[page.parent[e]] += mass[e]
    region, named = _region(page, mass)

    inside = np.zeros(len(page.parent), dtype=bool)
    for e in range(len(page.parent)):
        inside[e] = region[e] or (e > 0 and inside[page.parent[e]])
    keep = inside[place] & ~np.array(page.marked)
    if not named:
        keep &= chosen | (np.array(page.links) * 2 < size)
    return "\n\n".join(page.text[i] for i in np.flatnonzero(keep))


def _region(page: Lines, mass: np.ndarray) -> tuple[np.ndarray, bool]:
    """The region's outermost elements, and whether they were named article or main."""
    tags = np.array(page.tag)
    for name in ("article", "main"):
        found = (tags == name) & (mass > 0)
        outer = found.copy()
        for e in np.flatnonzero(found):
            up = page.parent[e]
            while up:
                if found[up]:
                    outer[e] = False
                    break
                up = page.parent[up]
        if mass[outer].sum() > MOST * mass[0]:
            return outer, True
    best = 0
    for e in range(1, len(page.parent)):  # parents come first: the last one is the deepest
        if page.tag[e] not in INLINE and page.tag[e] != "p" and mass[e] >= NEARLY_ALL * mass[0]:
            best = e
    region = np.zeros(len(tags), dtype=bool)
    region[best] = True
    return region, False


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (default: all but the html) with ``text`` and ``n_chars`` (its code points)."""
    made = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    keep = [c for c in (pages.columns if keep is None else keep) if c != html and c not in made.names]

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(h) for h in batch.column(batch.schema.get_field_index("_html")).to_pylist()]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(pages.select(*keep, pages[html].alias("_html")), run, made, keep=keep)
