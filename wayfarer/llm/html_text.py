"""Main text of web pages by the line-block distribution.

A page's markup is stripped into lines, one a block of text (a paragraph, heading,
cell or list item, or the part of it before a line break).  What the markup itself
names as something else than the article (menus, headers and footers of the page,
sidebars, notices, adverts, forms, comments, scripts, styles) leaves blank lines, and
so does the end of a container that held more than text.  The text lengths of
``WINDOW`` neighbouring lines are summed for every line; a stretch of main text
begins where the sum surges to the threshold and ends where it dives to nothing, and
the text between is kept.

Where a page marks its article (``article``, ``main``), only that part has lines and
any text in it is a surge.  Elsewhere a surge takes ``SURGE`` characters outside of
links (half the page's highest sum, if that is less), lines that are mostly links
weigh nothing, stretches far shorter than the longest are left out unless they lie
between others, and a main heading ahead of the text belongs to it.  If forms leave
nothing, they are read as containers.

One map over the pages; a page is read once, in time linear in its length.

Defined results: null or empty html, and a page without text, give an empty string;
an unclosed tag, comment or script at the end of a page is dropped; character
references are decoded as browsers do; all Unicode white space counts as such.
Repeated rows are extracted row by row, an empty table gives an empty result, extra
columns stay and a clashing result name is prefixed with underscores.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.llm.tables import fresh

WINDOW = 3
SURGE = 86
#: Share of the longest stretch that a stretch outside of marked articles needs.
SHORTEST = 0.2

TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)
    |<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[A-Za-z][^>]*(?:>|\Z)""", re.S | re.X)
NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)\b
    (?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.X)
WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+")

# Element names of HTML, and words by which pages name their parts.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
OTHER = frozenset("nav aside footer form menu dialog noscript template svg math canvas audio video object "
                  "select button datalist".split())
CONTAINERS = frozenset("div section article main header footer nav aside form fieldset table ul ol dl menu "
                       "blockquote figure details dialog body center td th".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr thead tbody tfoot caption figcaption pre "
                                "address summary hr br legend option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that the start of an element ends, up to the next container.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
        "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
PARTS = frozenset("""
ad ads adv advert adverts advertisement advertisements advertising alert banner bottombar breadcrumb breadcrumbs
bylinks comment comments consent cookie cookies copyright disclaimer disqus discussion dropdown footer gdpr header
hidden login masthead menu menus modal nav navbar navi navigation newsletter notice notices notification
notifications overlay pager pagination paywall popup promo promoted promotion related recommendation
recommendations recommended replies reply respond search share sharebar sharing sidebar sidenav signup skiplink
social sponsor sponsored subscribe subscription teaser teasers toolbar topbar warning widget widgets
""".split())
REMARKS = frozenset("ad ads advert comment comments related reply replies teaser teasers promo sponsored".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar "
                  "status".split())


def named_apart(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element's class, id or role names it as something else than the article."""
    if tag in ("html", "body", "main", "h1"):
        return False
    for kind, *values in NAMES.findall(attributes):
        kind, value = kind.lower(), next((v for v in values if v), "")
        if kind == "hidden" or kind == "aria-hidden" and value == "true" or \
                kind == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if kind == "role" and value.lower() in ROLES:
            return True
        if kind in ("class", "id"):
            for name in value.split():
                words = [w.lower() for w in WORDS.findall(name)]
                if not words or words[0] in ("has", "with", "no", "is", "js"):
                    continue
                # An article's own header holds its heading.
                own = inside or not {"article", "post", "entry", "story"}.isdisjoint(words)
                wanted = REMARKS if tag == "article" else PARTS
                if any(w in wanted and not (own and w == "header") for w in words):
                    return True
    return False


class Line:
    __slots__ = ("text", "linked", "inside", "heading")

    def __init__(self, inside: bool = False, heading: bool = False):
        self.text, self.linked, self.inside, self.heading = [], 0, inside, heading


class Page:
    """Lines of a page: ``Line`` objects, None for a blank one."""

    def __init__(self, html: str, forms: bool = False):
        self.lines: list[Line | None] = []
        self.open: list[list] = []  # [tag, apart, inside, place of its blank line or None, had blocks]
        self.count: Counter = Counter()
        self.apart = self.inside = self.links = 0
        self.now: Line | None = None
        self.forms = forms
        self.read(html)

    def read(self, html: str) -> None:
        at = 0
        while True:
            m = TAG.search(html, at)
            if m is None:
                self.add(html[at:])
                return
            self.add(html[at:m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self.end(tag)
                else:
                    self.start(tag, m[3])
                    if tag in RAW:
                        close = re.compile(f"</{tag}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I).search(html, at)
                        at = close.end() if close else len(html)

    def add(self, text: str) -> None:
        if not text or self.apart:
            return
        if self.now is None:
            if text.isspace():
                return
            heading = bool(self.open) and any(e[0] == "h1" for e in self.open[-3:])
            self.now = Line(self.inside > 0, heading)
            self.lines.append(self.now)
        text = unescape(text) if "&" in text else text
        self.now.text.append(text)
        if self.links:
            self.now.linked += len("".join(text.split()))

    def start(self, tag: str, attributes: str) -> None:
        if tag in RAW:
            return
        if tag in BLOCKS:
            self.now = None
            if self.open:
                self.open[-1][4] = True
        self.end_implied(tag)
        if tag in VOID:
            return
        if tag in ("article", "main") and not named_apart(tag, attributes, True):
            self.leave_menus()
        apart = tag in OTHER and not (tag == "form" and self.forms) or tag == "header" and not self.inside \
            or bool(attributes) and named_apart(tag, attributes, self.inside > 0)
        if not (apart or tag in BLOCKS or tag == "a") or attributes.endswith("/") and tag not in BLOCKS:
            return
        inside, blank = tag in ("article", "main") and not apart and not self.apart, None
        if apart and tag in BLOCKS:
            self.lines += [None] * WINDOW
        elif tag in CONTAINERS:
            blank = len(self.lines)
            self.lines.append(None)
        self.open.append([tag, apart, inside, blank, False])
        self.count[tag] += 1
        self.apart += apart
        self.inside += inside
        self.links += tag == "a"

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.now = None
        if not self.count[tag]:
            return
        for place in range(len(self.open) - 1, -1, -1):
            if self.open[place][0] == tag:
                while len(self.open) > place:
                    self.pop()
                return
            if tag not in CONTAINERS and self.open[place][0] in CONTAINERS:
                return

    def pop(self) -> None:
        tag, apart, inside, blank, had_blocks = self.open.pop()
        self.count[tag] -= 1
        self.apart -= apart
        self.inside -= inside
        self.links -= tag == "a"
        if blank is not None and had_blocks:
            self.lines += [None] * WINDOW
        elif blank is not None:
            self.lines[blank] = Line()  # it held text alone: a paragraph, no blank line before

    def end_implied(self, tag: str) -> None:
        """End the elements that the start of ``tag`` ends without a closing tag."""
        over = {"p"} if tag in CONTAINERS or tag in ("p", "hr", "pre") or tag[0] == "h" and tag[1:].isdigit() else ()
        over = ENDS.get(tag, over)
        while self.open and self.open[-1][0] in over:
            self.pop()

    def leave_menus(self) -> None:
        """An article does not lie in a menu or a header: those were not closed."""
        for place, (tag, apart, *_) in enumerate(self.open):
            if apart and tag in ("nav", "header", "menu"):
                while len(self.open) > place:
                    self.pop()
                return


def block_sums(weights: np.ndarray) -> np.ndarray:
    """Text lengths over the ``WINDOW`` lines from each line on."""
    total = np.concatenate([[0], np.cumsum(weights)])
    return total[np.minimum(np.arange(len(weights)) + WINDOW, len(weights))] - total[:-1]


def stretches(weights: np.ndarray, surge: float) -> list[tuple[int, int]]:
    """(first line, end) of the stretches from a surge of the line-block sums to their dive."""
    sums, found, at = block_sums(weights), [], 0
    rising, fallen = np.flatnonzero(sums >= max(surge, 1)), np.flatnonzero(sums == 0)
    while True:
        k = np.searchsorted(rising, at)
        if k == len(rising):
            return found
        first = int(rising[k])
        k = np.searchsorted(fallen, first)
        at = int(fallen[k]) if k < len(fallen) else len(weights)
        found.append((first, at))


def main_text(html: str | None, forms: bool = False) -> str:
    """The article of a page, its blocks joined by one space."""
    if not html:
        return ""
    lines = Page(html, forms).lines
    texts = [" ".join("".join(line.text).split()) if line is not None else "" for line in lines]
    inside = [line is not None and line.inside for line in lines]
    if any(t and i for t, i in zip(texts, inside)):
        weights = np.array([len(t) if i else 0 for t, i in zip(texts, inside)])
        kept = stretches(weights, 1)
        return " ".join(texts[k] for first, end in kept for k in range(first, end) if weights[k])
    weights = np.array([len(t) if t and 2 * line.linked <= len(t) else 0 for t, line in zip(texts, lines)], np.int64)
    kept = stretches(weights, min(SURGE, block_sums(weights).max(initial=0) / 2))
    if not kept:
        return "" if forms else main_text(html, True)
    sizes = [int(weights[first:end].sum()) for first, end in kept]
    enough = SHORTEST * max(sizes)
    long = [s for s, size in zip(kept, sizes) if size >= enough]
    first, end = long[0][0], long[-1][1]
    before = [k for k in range(first) if weights[k] and lines[k].heading]
    return " ".join(texts[k] for k in [*before, *range(first, end)] if weights[k])


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages`` and ``main_text``, the article of each page."""
    out = fresh(pages, "main_text")[0]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                found = [main_text(page) for page in some.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(found, pa.string())],
                                                 [*batch.schema.names, out])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(out, T.StringType())]))


def query(spark, sf_dir) -> DataFrame:
    """op11: the main text of every page."""
    from wayfarer.session import read_table

    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", F.col("main_text").alias("text"),
                                      F.char_length("main_text").cast("long").alias("n_chars"))
