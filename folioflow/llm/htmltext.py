"""Main text of web pages from a stream of parser events.

The standard library's parser reports tags and text. Text between two block tags is a line. Its ratio is its running
text over the tags in it: characters outside links less those in links, none if that is below zero; all text of a menu counts as
link text. The ratios of a page's lines are smoothed by a Gaussian; a line with running text whose smoothed ratio reaches the
threshold, half the page's mean, is dense. Lines are clustered into regions: an article as a whole, a menu, otherwise the nearest
division, section, main element or body (a table belongs to the region round it). Dense lines choose the regions:

* Where one lies in an article or main element, all regions in such elements that have running text are content.
* Else the regions with a dense line are, and those with running text that stand between two of them or in the
  smallest division that holds them all.
* A page without running text is nothing but links and headings of such; what its articles and main elements hold, menus aside, is all it has.

All lines of a region that is content count, short ones too. What has running text and still isn't wanted never becomes a line:
page headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments of readers, known by element, role, or a class or id
made of such a word (with others that only tell place or shape, so that ``ad-slot-2`` is an advert and ``share-prices`` isn't furniture).
A form that holds an article, or most of the running text of a page without one, is the page's frame and no form.

Defined results: null and empty html give an empty text, as do pages of tags only; an empty table gives no rows; markup that is cut off
or not closed ends with the page; a page of any length is read whole, by one pass over its events; repeated rows are parsed
each for itself; other columns are kept, a column called as the result is replaced.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import map_arrow, texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section select summary
table tbody td textarea tfoot th thead title tr ul""".split())
CONTAINERS = frozenset("body div section center details".split())
SKIPPED = frozenset("""aside footer script style noscript template iframe svg button label select textarea dialog object canvas
video audio map head title applet datalist""".split())
SKIPPED_ROLES = frozenset("banner contentinfo complementary search form dialog alertdialog alert".split())
SKIPPED_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion sidebar sidebars
cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup share sharing social related recommended
comment comments commentlist respond disqus replies login widget widgets""".split())
MENUS = frozenset("nav menu".split())
MENU_ROLES = frozenset("navigation menu menubar toolbar".split())
MENU_WORDS = frozenset("nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar".split())
#: Words that mean page furniture outside an article only; inside, they may hold its title.
OUTER_WORDS = frozenset("header masthead footer banner topbar".split())
#: Of an outermost article or main element only these count.
READER_WORDS = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo related".split())
#: Words that tell place or shape; they leave the meaning of the others in a class or id.
SHAPE_WORDS = frozenset("""area bar block bottom box button buttons center column container content desktop div footer form global google header holder icon icons
inline inner item items label leaderboard left link links list main media mobile native nested news outer page panel posts primary articles right row secondary section
site slot space sticky stories text thread title top unit wrap wrapper""".split())
#: Elements whose start ends an open paragraph.
CLOSES_P = BLOCK - {"option", "optgroup", "head", "html", "body", "title"}
SIGMA, REACH = 1.0, 2
KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-REACH, REACH + 1)]
#: How far an open element is kept from becoming lines, and in what kind of element of content it stands.
SHOWN, IN_FORM, HIDDEN = 0, 1, 2
OUTSIDE, IN_MAIN, IN_ARTICLE = 0, 1, 2

_parts = re.compile(r"[^a-z0-9]+").split
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])").sub


def named(value: str, words: frozenset) -> bool:
    """Whether a class or id is made of such a word and nothing that changes its meaning."""
    for token in value.split():
        parts = [p.rstrip("0123456789") for p in _parts(_camel("-", token).lower())]
        if not words.isdisjoint(parts) and all(not p or p in words or p in SHAPE_WORDS for p in parts):
            return True
    return False


class Line:
    __slots__ = ("text", "ratio", "region", "root", "form")

    def __init__(self, text: str, ratio: float, region: int, root: int, form: int):
        self.text, self.ratio, self.region, self.root, self.form = text, ratio, region, root, form


class Page(HTMLParser):
    """Lines of a page, and for each region the one round it (region 0 is the page)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # Tag, whether it is hidden, region, element of content round it, whether its text is a link's or a menu's, whether a menu is round it.
        self.stack: list[tuple[str, int, int, int, bool, bool]] = [("", SHOWN, 0, OUTSIDE, False, False)]
        self.lines: list[Line] = []
        self.around, self.menus = [0], set()
        self.text: list[str] = []
        self.linked = self.tags = self.form = self.forms = 0

    def flush(self):
        if self.text:
            line = " ".join("".join(self.text).split())
            _, hidden, region, root, _, menu = self.stack[-1]
            if line and hidden != HIDDEN:
                running = 0 if menu else max(0, len(line) - 2 * self.linked)
                self.lines.append(Line(line, running / max(1, self.tags), region, root, self.form if hidden == IN_FORM else 0))
            self.text = []
        self.tags = self.linked = 0

    def region(self, inside: int) -> int:
        self.around.append(inside)
        return len(self.around) - 1

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
            if tag in CLOSES_P and any(e[0] == "p" for e in self.stack[-8:]):
                self.shut("p")
        elif tag == "a" and any(e[0] == "a" for e in self.stack[-8:]):
            self.shut("a")  # links don't nest
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        _, hidden, region, root, linked, menu = self.stack[-1]
        content = tag in ("article", "main")
        if content and hidden and not root and (hidden == IN_FORM or not any(e[0] in ("div", "section") and e[1] == HIDDEN for e in self.stack)):
            hidden = SHOWN  # a form is the page's frame; a menu or header before it wasn't closed
        if content and menu and not any(e[0] in ("div", "section") and e[5] for e in self.stack):
            linked = menu = False
        if hidden != HIDDEN:
            if tag in SKIPPED or tag == "header" and not root:
                hidden = HIDDEN
            elif tag == "form":
                if root:
                    hidden = HIDDEN
                else:
                    hidden, self.forms = IN_FORM, self.forms + 1
                    self.form = self.forms
            elif attrs and tag not in ("html", "body"):
                found = self.furniture(tag, attrs, root)
                hidden, menu_here = (HIDDEN, False) if found == HIDDEN else (hidden, bool(found))
                if menu_here and not menu and not content:
                    region, linked, menu = self.region(region), True, True
                    self.menus.add(region)
        if tag in MENUS and not menu:
            region, linked, menu = self.region(region), True, True
            self.menus.add(region)
        elif not menu:
            if tag == "article" and root != IN_ARTICLE:
                region, root = self.region(region), IN_ARTICLE
            elif tag == "main" and not root:
                region, root = self.region(region), IN_MAIN
            elif tag in CONTAINERS and root != IN_ARTICLE and self.stack[-1][2] == region:
                region = self.region(region)
        self.stack.append((tag, hidden, region, root, linked or tag == "a", menu))

    def furniture(self, tag, attrs, root) -> int:
        """HIDDEN for furniture, 1 for a menu, else 0."""
        for name, value in attrs:
            if name == "hidden":
                return HIDDEN
            if not value:
                continue
            if name == "aria-hidden" and value.strip().lower() == "true":
                return HIDDEN
            if name == "role":
                role = value.strip().lower()
                if role in SKIPPED_ROLES:
                    return HIDDEN
                if role in MENU_ROLES:
                    return 1
            elif name == "style" and "display:none" in value.lower().replace(" ", ""):
                return HIDDEN
            elif name in ("class", "id"):
                if tag in ("article", "main") and not root:
                    if named(value, READER_WORDS):
                        return HIDDEN
                elif named(value, SKIPPED_WORDS) or not root and named(value, OUTER_WORDS):
                    return HIDDEN
                elif named(value, MENU_WORDS):
                    return 1
        return 0

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def shut(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        self.shut(tag)

    def handle_data(self, data):
        top = self.stack[-1]
        if top[1] != HIDDEN:
            self.text.append(data)
            if top[4]:
                self.linked += len(" ".join(data.split()))


def smoothed(values: list[float]) -> list[float]:
    n, out = len(values), []
    for i in range(n):
        total = weight = 0.0
        for d, w in zip(range(-REACH, REACH + 1), KERNEL):
            if 0 <= i + d < n:
                total += w * values[i + d]
                weight += w
        out.append(total / weight)
    return out


def framed(lines: list[Line]) -> list[Line]:
    """Lines without those of forms; a form that holds over half of the running text of a page without article and main element is no form."""
    if not any(x.form for x in lines):
        return lines
    weight: dict[int, int] = {}
    for x in lines:
        weight[x.form] = weight.get(x.form, 0) + (len(x.text) if x.ratio else 0)
    total = sum(weight.values())
    rooted = any(x.root for x in lines)
    return [x for x in lines if not x.form or not rooted and 2 * weight[x.form] > total]


def holding(regions: set[int], around: list[int]) -> int:
    """The smallest region that holds all the given ones."""
    paths = []
    for r in regions:
        path = [r]
        while path[-1]:
            path.append(around[path[-1]])
        paths.append(path[::-1])
    return [same[0] for same in zip(*paths) if len(set(same)) == 1][-1]


def content(lines: list[Line], around: list[int], menus: set[int]) -> list[Line]:
    """The lines of the regions that the dense lines choose."""
    if not lines:
        return lines
    smooth = smoothed([x.ratio for x in lines])
    threshold = sum(smooth) / len(smooth) / 2
    dense = [i for i, x in enumerate(lines) if x.ratio and smooth[i] >= threshold]
    running = {x.region for x in lines if x.ratio}
    if not dense:
        return [x for x in lines if x.root and x.region not in menus]
    if any(lines[i].root for i in dense):
        return [x for x in lines if x.root and x.region in running]
    chosen = {lines[i].region for i in dense}
    within = holding(chosen, around)
    inside = [False] * len(around)
    for r in range(1, len(around)):  # a region is numbered after the one round it
        inside[r] = r == within or inside[around[r]]
    first, last = {}, {}
    for i, x in enumerate(lines):
        first.setdefault(x.region, i)
        last[x.region] = i
    whole = around[within] != 0  # smaller than the page and its body
    chosen |= {r for r in running if whole and inside[r] or dense[0] < first[r] and last[r] < dense[-1]}
    return [x for x in lines if x.region in chosen]


def read(html: str) -> Page:
    page = Page()
    page.feed(html)
    page.close()
    page.flush()
    return page


def main_text(html: str) -> str:
    """Blocks of the content regions in page order, joined by a blank line."""
    if not html:
        return ""
    page = read(html)
    return "\n\n".join(x.text for x in content(framed(page.lines), page.around, page.menus))


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the html."""
    kept = [f for f in pages.schema.fields if f.name not in (html, out)]
    schema = T.StructType([*kept, T.StructField(out, T.StringType())])

    def run(batches):
        for batch in batches:
            found = pa.array([main_text(x) for x in texts(batch, html)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), found], names=[*(f.name for f in kept), out])

    return map_arrow(pages.select(*(F.col(f"`{f.name}`") for f in kept), html), run, schema)
