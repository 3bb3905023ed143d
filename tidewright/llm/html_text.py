"""Main text of HTML pages by text-to-tag ratio.

A streaming parser of the standard library turns a page into *lines*, the
blocks of text between block-level tags.  What elements say of a line is a
feature of its ratio only: text of menus, headers, footers, sidebars, notices,
adverts, forms, comments and hidden parts counts as none, link text counts
little, and so does text beside an ``article`` or ``main``.  The logarithm of
text characters to tags is smoothed by a Gaussian over neighbouring lines of
the same part of the page and split in two clusters by a threshold
(one-dimensional 2-means, with the document's head as a line without text).

Lines of the upper cluster are content.  Content regions are then closed:
a marked line of an ``article`` or ``main`` stands for all of its text; on
pages without one, lines between and beside marked ones in their element join
them unless they are mostly links.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewright.llm.common import annotate

SIGMA = 1.5
#: How much a character counts: of link text, and beside an article or main.
LINKED, BESIDE = 0.1, 1 / 64
#: A named element with more than this many times the other text is a wrapper, not what its name says.
WRAPS = 10
#: Characters given to the parser at a time.
FEED = 1 << 16

# Elements by their role in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary"
    " table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset(
    "script style noscript template svg math iframe object canvas audio video select option button textarea"
    " datalist head title applet map".split()
)
#: Silent elements without blocks inside: a block's tag ends them.
SILENT_INLINE = frozenset("select option button textarea datalist svg math title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav footer aside menu dialog search".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split()
)
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors".split())
READERS = frozenset("comment comments disqus reply replies".split())
NOT_TEXT = ADVERTS | READERS | frozenset(
    "promo promos promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay"
    " newsletter subscribe subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar"
    " sidebars widget widgets related recommended share sharing social footer copyright pagination pager toolbar"
    " search form".split()
)
#: Names that mean a page's head outside an article, but an article's own head inside one.
HEADS = frozenset("header masthead".split())
#: Parts that say nothing at a name's end, and those that only tell what an element has.
VAGUE = frozenset("list wrap wrapper container box area block slot item items inner section bar link links unit".split())
WITH = frozenset("no has have with without hide show".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE_PAGE = frozenset(("#", "html", "body"))
#: Parts of lists, tables and quotations: the element around them is the place of their text.
INNER = frozenset("ul ol dl li dt dd dir table tbody thead tfoot tr td th blockquote figure figcaption".split()) | PROSE
#: A start tag of the key ends an open element of the values.
ENDS = {
    **{h: HEADINGS for h in HEADINGS},
    **{k: frozenset(("li",)) for k in ("li",)},
    **{k: frozenset(("dt", "dd")) for k in ("dt", "dd")},
    **{k: frozenset(("td", "th")) for k in ("td", "th")},
}
_NAME = re.compile("[a-z0-9]+")
_CUT = re.compile("<[a-zA-Z/!?]")


def _means(name: str) -> str:
    """The part of a class or id that tells what the element is: of ``site-footer`` the footer."""
    parts = _NAME.findall(name)
    if not parts or parts[0] in WITH:
        return ""
    while len(parts) > 1 and (parts[-1] in VAGUE or parts[-1].isdigit()):
        parts.pop()
    return parts[-1]


def _names(attrs: dict[str, str | None]) -> set[str]:
    return {_means(n) for n in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split()}


def _hidden(attrs: dict[str, str | None]) -> bool:
    return (
        "hidden" in attrs
        or attrs.get("aria-hidden") == "true"
        or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()
    )


class Page(HTMLParser):
    """A page's lines and blocks; every step takes time in proportion to its input.

    Lines: ``text``, ``tags`` since the line before, characters of ``links``, and the block ``at`` which they stand.
    Blocks, in page order, 0 is the page: ``kind``, ``parent``, ``out`` (never article text, whatever is inside) and
    ``named`` (a form, or so by its class or id; 2 for reader comments).
    """

    def __init__(self, html: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.tags: list[int] = []
        self.links: list[int] = []
        self.at: list[int] = []
        self.kind, self.parent, self.out, self.named = ["#"], [-1], [False], [0]
        self._open = [0]  # blocks
        self._opened: dict[str, int] = {}  # open blocks by tag
        self._articles = 0
        self._inline: list[tuple[str, int, bool]] = []  # tag, open blocks around it, hidden
        self._inlined: dict[tuple[str, int], int] = {}
        self._hidden = self._linked = 0
        self._silent: list[str] = []
        self._inside: dict[str, int] = {}  # blocks opened inside the silent element
        self._data: list[str] = []
        self._tags = self._links = 0
        html = html or ""
        for k in range(0, len(html), FEED):
            self.feed(html[k : k + FEED])
        if _CUT.match(self.rawdata):  # a tag or comment that never ends holds no text
            self.rawdata = ""
        self.close()
        self._flush()

    def _flush(self) -> None:
        text = " ".join("".join(self._data).split())
        if text:
            self.text.append(text)
            self.tags.append(self._tags)
            self.links.append(min(self._links, len(text)))
            self.at.append(self._open[-1])
            self._tags = 0
        self._data, self._links = [], 0

    def _drop_inline(self, least: int) -> None:
        """Forget open inline elements from place ``least`` on."""
        while len(self._inline) > least:
            tag, depth, hidden = self._inline.pop()
            self._inlined[tag, depth] -= 1
            self._hidden -= hidden
            self._linked -= tag == "a"

    def _end_block(self) -> None:
        """Close the innermost block and what is open in it."""
        depth = len(self._open)
        k = len(self._inline)
        while k and self._inline[k - 1][1] >= depth:
            k -= 1
        self._drop_inline(k)
        tag = self.kind[self._open.pop()]
        self._opened[tag] -= 1
        self._articles -= tag in ("article", "main")

    def _start_block(self, tag: str, attrs: dict[str, str | None]) -> None:
        self._flush()
        if self.kind[self._open[-1]] == "p" or self.kind[self._open[-1]] in ENDS.get(tag, ()):
            self._end_block()
            if self.kind[self._open[-1]] in ENDS.get(tag, ()):
                self._end_block()
        if tag in ("html", "body"):
            out, named = False, 0
        else:
            names = _names(attrs)
            out = (
                tag in ASIDE
                or (tag == "header" and not self._articles)
                or (attrs.get("role") or "").lower() in ROLES
                or _hidden(attrs)
            )
            named = 2 if names & READERS else int(tag == "form" or bool(names & NOT_TEXT) or (not self._articles and bool(names & HEADS)))
        self.kind.append(tag)
        self.parent.append(self._open[-1])
        self.out.append(out or self.out[self._open[-1]])
        self.named.append(named)
        self._open.append(len(self.kind) - 1)
        self._opened[tag] = self._opened.get(tag, 0) + 1
        self._articles += tag in ("article", "main")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self._silent:
            if tag == "body" or (tag in BLOCKS and self._silent[-1] in SILENT_INLINE):
                while self._silent and (tag == "body" or self._silent[-1] in SILENT_INLINE):
                    self._silent.pop()
            if self._silent:
                if tag in BLOCKS:
                    self._inside[tag] = self._inside.get(tag, 0) + 1
                elif tag == self._silent[-1] or (tag in SILENT and tag not in SILENT_INLINE):
                    self._silent.append(tag)
                return
        if tag in SILENT:
            self._silent, self._inside = [tag], {}
            return
        self._tags += 1
        if tag in BLOCKS:
            self._start_block(tag, dict(attrs))
        elif tag == "hr":
            self._flush()
        elif tag == "br":
            self._data.append(" ")
        elif tag not in VOID:
            have = dict(attrs)
            hidden = _hidden(have) or bool(_names(have) & ADVERTS)
            depth = len(self._open)
            self._inline.append((tag, depth, hidden))
            self._inlined[tag, depth] = self._inlined.get((tag, depth), 0) + 1
            self._hidden += hidden
            self._linked += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            return
        self.handle_starttag(tag, attrs)
        if not self._silent and tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self._silent:
            if tag == self._silent[-1]:
                self._silent.pop()
                return
            if self._inside.get(tag, 0):
                self._inside[tag] -= 1
                return
            if not self._opened.get(tag, 0):
                return
            self._silent = []  # never closed, but what is around it is
        self._tags += 1
        if tag in BLOCKS:
            self._flush()
            if self._opened.get(tag, 0):
                while self.kind[self._open[-1]] != tag:
                    self._end_block()
                self._end_block()
        elif self._inlined.get((tag, len(self._open)), 0):
            k = len(self._inline) - 1
            while self._inline[k][0] != tag:
                k -= 1
            self._drop_inline(k)

    def handle_data(self, data: str) -> None:
        if not self._silent and not self._hidden:
            self._data.append(data)
            if self._linked:
                self._links += len(data)


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean of neighbouring lines; the ends use the lines there are."""
    reach = int(3 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratios, weights)[reach : reach + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), weights)[reach : reach + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """Border of two clusters (2-means); lines at or above it are content."""
    low, high = float(values.min()), float(values.max())
    if high - low <= 1e-9 * max(1.0, abs(high)):
        return low
    border = (low + high) / 2
    for _ in range(50):
        upper = values >= border
        if upper.all():
            return low
        moved = (values[upper].mean() + values[~upper].mean()) / 2
        if moved == border:
            break
        border = float(moved)
    return border


def _left_out(page: Page) -> list[bool]:
    """By block: whether its text is never article text.

    A named block is what its name says unless it is a wrapper: one around the
    only articles of the page, or, on a page without articles, one with nearly
    all text (all of it where the name means reader comments).
    """
    n, kind, parent = len(page.kind), page.kind, page.parent
    own = [0] * n
    for t, h in zip(page.text, page.at, strict=True):
        if not page.out[h]:
            own[h] += len(t)
    mass, open_mass = own[:], own[:]  # text below; and that outside named blocks further below
    for h in range(n - 1, 0, -1):
        mass[parent[h]] += mass[h]
        if not page.named[h]:
            open_mass[parent[h]] += open_mass[h]
    deep = [0] * n  # named blocks around, itself included
    for h in range(1, n):
        deep[h] = deep[parent[h]] + (page.named[h] > 0)
    real = [h for h in range(1, n) if kind[h] in ("article", "main") and mass[h] and not page.named[h]]
    released = [False] * n
    if real:
        least = min(deep[h] for h in real)
        for h in real:
            if deep[h] == least:
                while h > 0 and not released[h]:
                    released[h] = True
                    h = parent[h]
        if least == 0:
            released = [False] * n
    else:
        free = open_mass[0]
        shut = [False] * n
        for h in range(1, n):
            shut[h] = shut[parent[h]]
            if page.named[h] and not shut[h]:
                wraps = mass[h] > WRAPS * free and 2 * mass[h] > mass[0] and (page.named[h] == 1 or not free)
                released[h] = wraps
                shut[h] = not wraps
                free += open_mass[h] if wraps else 0
    out = page.out[:]
    for h in range(1, n):
        out[h] = out[h] or out[parent[h]] or (page.named[h] > 0 and not released[h])
    return out


def parts(page: Page) -> list[int]:
    """The part of the page each line belongs to: -1 never text, 0 beside the article, else an article's or main's block."""
    n, kind, parent = len(page.kind), page.kind, page.parent
    out = _left_out(page)
    article, main, has = [0] * n, [0] * n, [False] * n
    for h in range(1, n):
        up = parent[h]
        article[h] = article[up] or (h if kind[h] == "article" and not out[h] else 0)
        main[h] = main[up] or (h if kind[h] == "main" and not out[h] else 0)
        if article[h] and main[h]:
            has[main[h]] = True
    found = []
    for k, h in enumerate(page.at):
        if out[h]:
            found.append(-1)
        elif main[h] and (article[h] or not has[main[h]] or (kind[h] in PROSE and not _linked(page, k))):
            found.append(main[h])
        else:
            found.append(article[h])
    return found


def _linked(page: Page, k: int) -> bool:
    return 2 * page.links[k] > len(page.text[k])


def ratios(page: Page, part: list[int]) -> np.ndarray:
    """Logarithm of text characters to tags, by line."""
    chars = np.array([len(t) for t in page.text], float) - (1 - LINKED) * np.array(page.links, float)
    where = np.array(part)
    if (where > 0).any():
        chars[where == 0] *= BESIDE
    chars[where < 0] = 0.0
    return np.log2(1 + chars / np.maximum(1, page.tags))


def marks(page: Page, part: list[int]) -> np.ndarray:
    """Which lines the upper cluster holds; none on a page without text that counts."""
    values = ratios(page, part)
    if not len(values) or values.max() <= 0:
        return np.zeros(len(values), bool)
    smoothed = np.empty_like(values)
    where = np.array(part)
    for p in np.unique(where):
        smoothed[where == p] = smooth(values[where == p])
    return smoothed >= threshold(np.append(smoothed, 0.0))


def _around(page: Page, lines: list[int]) -> int:
    """The innermost block around all ``lines``, beyond parts of lists, tables and quotations."""
    parent, kind = page.parent, page.kind
    count = [0] * len(kind)
    for k in lines:
        count[page.at[k]] += 1
    for h in range(len(kind) - 1, 0, -1):
        count[parent[h]] += count[h]
    best = max(h for h in range(len(kind)) if count[h] == len(lines))
    while best > 0 and kind[best] in INNER:
        best = parent[best]
    return best


def closed(page: Page, part: list[int], marked: np.ndarray) -> list[int]:
    """Lines of the content regions that the marked lines make."""
    chosen = {p for p, m in zip(part, marked, strict=True) if m and p > 0}
    loose = [k for k, p in enumerate(part) if p == 0 and marked[k] and not _linked(page, k)]
    keep = {k for k, p in enumerate(part) if p in chosen or (p < 0 and marked[k])} | set(loose)
    if loose:
        parent, kind = page.parent, page.kind
        top = _around(page, loose)
        path, h = set(), top
        while h >= 0:
            path.add(h)
            h = parent[h]
        below = [h == top for h in range(len(kind))]
        for h in range(top + 1, len(kind)):
            below[h] = below[parent[h]]
        place = [-1] * len(kind)  # the block in which a block of text stands
        for h in range(len(kind)):
            place[h] = h if h == 0 or kind[h] not in PROSE else place[parent[h]]
        beside = bool(chosen) or any(p > 0 for p in part)
        for k, p in enumerate(part):
            if p or beside or _linked(page, k):
                continue
            h = page.at[k]
            within = below[h] and (kind[top] not in WHOLE_PAGE or loose[0] < k < loose[-1])
            if within or (kind[h] in PROSE and place[h] in path):
                keep.add(k)
    return sorted(keep)


def main_text(html: str | None) -> str:
    """Article text of ``html``: blocks joined by an empty line; empty if there is none."""
    page = Page(html)
    part = parts(page)
    return "\n\n".join(page.text[k] for k in closed(page, part, marks(page, part)))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, the page's main text, and ``n_chars``, its code points.

    Null, empty and text-less pages, and those of menus and the like alone,
    give an empty text.  Elements that are never closed end with the element
    around them; a comment or tag that never ends hides the rest of the page.
    Columns with the new names are replaced, others pass; one row in, one row
    out; repeated rows stay; empty tables stay empty.
    """

    def make():
        def kernel(pages: list[str | None]) -> list[list]:
            texts = [main_text(p) for p in pages]
            return [texts, [len(t) for t in texts]]

        return kernel

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return annotate(pages, [html_col], fields, make)
