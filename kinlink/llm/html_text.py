"""Main text of web pages by composite text density.

The page is parsed to a small DOM.  For every node: characters C, tags T, link characters LC and
link tags LT of its subtree give the link-adjusted density

    C/T * log_base(C/LC * T/LT),  base = ln(C/(C-LC) * LC + LCbody/Cbody * C + e)

(zero denominators count as one).  A node's density sum adds its children's densities.  The node of the
largest sum is the core; the least density on the path from it to body is the threshold.  Every node that reaches
the threshold marks the node of the largest sum below it (or itself); the text is that of the marked subtrees, each
taken whole.  Where the core lies in an ``article`` or ``main`` element, the page says itself where its article
begins and ends: the densities then decide which of these elements it is, and all of it is taken.

Elements that never are article text (scripts, forms, navigation, asides, footers) don't take part, nor do those
whose class, id or role consists of words for adverts, menus, notices, comments and the like; a name that has other
words too (share-price, social-history) doesn't count.  Lists and boxes that hold nothing but links are menus.

Defined cases: null or empty html gives an empty text; broken markup is repaired as browsers do for the common
cases (unclosed p, li, td; stray end tags; an unfinished tag at the end is dropped); character references are
decoded once; of equal sums the first node in the page is the core; repeated rows give equal rows; an empty table
gives no rows; pages of any length are taken whole, and the work grows linearly with their length and depth;
other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.words import portions
from kinlink.plans.scratch import ship

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROPPED = frozenset("script style textarea title noscript template iframe xmp noembed noframes head nav footer aside form button select option menu dialog svg canvas object audio video map datalist".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption li dd dt legend summary figcaption".split())
#: An element ends open ones of these kinds, up to the given container.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
# Words in class, id or role that mark what isn't the article, and words that may go with them.
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner sidebar sidenav menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond widget pagination pager copyright contentinfo complementary search skip".split()
)
BOX_WORDS = frozenset(
    "site page global top bottom left right inner outer box boxes block blocks area bar container wrapper wrap list item items link links button buttons slot unit panel "
    "module section form icon icons policy posts articles stories thread media follow us main primary secondary sticky js".split()
)
#: Of these, an article's own class may hold only the words below; the others keep any class.
ARTICLE_SIDE = frozenset("comment comments reply related recommended ad advert advertisement promo sponsored".split())
KEEPS_CLASS = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
#: Where an open p isn't closed from.
P_STOPS = frozenset("td th button table".split())
_MARKUP = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[\"'>]")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
MENUS = frozenset("ul ol menu dir div section table".split())
#: A list or box with more of its characters in links than this (see _is_menu) is a menu.
LINK_SHARE = 0.66


class _Node:
    __slots__ = ("tag", "parent", "items", "dropped", "near", "cleared", "c", "t", "lc", "lt", "density", "total", "best")

    def __init__(self, tag: str, parent: "_Node | None", dropped: bool):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.items: list = []  # child nodes and strings in page order
        self.near: dict[str, _Node | None] = parent.near if parent else {}
        self.cleared = False
        self.c = self.t = self.lc = self.lt = 0
        self.density = self.total = 0.0
        self.best = self


def _names_side(value: str, side: frozenset[str]) -> bool:
    """Whether one of the names is made of words for such parts, with box words at most beside them."""
    for name in value.split():
        words = set(_WORDS.findall(name))
        if words & side and words <= SIDE_WORDS | BOX_WORDS:
            return True
    return False


def _is_side(tag: str, attrs: str) -> bool:
    if not attrs or tag in KEEPS_CLASS:
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role") and _names_side(value, ARTICLE_SIDE if tag == "article" else SIDE_WORDS):
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


class _Parser:
    """A page read once from left to right; what is open is counted, so no search goes up the tree in vain."""

    def __init__(self, page: str):
        self.page = page
        self.body = self.node = _Node("body", None, False)
        self.open: dict[str, int] = {}
        self.unquoted: set[str] = set()  # quotes that occur no more

    def tag_end(self, at: int) -> int:
        """Where the tag's ``>`` is, outside of quoted values; -1 if the page ends before."""
        while m := _STOP.search(self.page, at):
            if m[0] == ">":
                return m.start()
            at = m.end()
            if m[0] not in self.unquoted:
                end = self.page.find(m[0], at)
                if end < 0:
                    self.unquoted.add(m[0])
                else:
                    at = end + 1
        return -1

    def leave(self, node: _Node) -> None:
        """Close all elements down to this one, and it."""
        while self.node is not node.parent:
            self.open[self.node.tag] -= 1
            self.node = self.node.parent

    def end(self, tag: str) -> None:
        if self.open.get(tag):
            node = self.node
            while node.tag != tag:
                node = node.parent
            self.leave(node)
        elif tag == "br":
            self.node.items.append(" ")

    def start(self, tag: str, attrs: str, at: int) -> int:
        """Open the element; the place to go on from."""
        if tag in CLOSES_P and (p := self.node.near.get("p")):
            self.leave(p)
        if tag in IMPLIED and (first := self.node.near.get(tag)):
            self.leave(first)
        dropped = tag in DROPPED or _is_side(tag, attrs)
        if tag == "header":  # one inside the article keeps its headings only, see _gather
            dropped = not (self.open.get("article") or self.open.get("main"))
        if tag in ("article", "main") and not dropped:
            up = self.node  # a wrapper whose class has such a word isn't a side part itself
            while up is not None and not up.cleared:
                up.dropped, up.cleared = up.dropped and up.tag in DROPPED, True
                up = up.parent
        child = _Node(tag, self.node, dropped)
        self.node.items.append(child)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, at)
            return end.end() if end else len(self.page)
        if tag not in VOID and not (attrs.rstrip().endswith("/") and tag not in BLOCK):
            self.node = child
            self.open[tag] = self.open.get(tag, 0) + 1
            changes = {"p": child} if tag == "p" else {"p": None} if tag in P_STOPS else {}
            for key, (ends, until) in IMPLIED.items():
                if tag in until:
                    changes[key] = None
                elif tag in ends and not child.near.get(key):
                    changes[key] = child
            if changes:
                child.near = child.near | changes
        return at

    def run(self) -> _Node:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            m = _MARKUP.search(page, at)
            if m is None:
                self.node.items.append(page[at:])
                break
            if m.start() > at:
                self.node.items.append(page[at : m.start()])
            if m[2] is None:
                close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
                end = page.find(close, m.end())
                if m[0] == "<![CDATA[":
                    self.node.items.append(_html.escape(page[m.end() : end if end >= 0 else n]))
                at = end + len(close) if end >= 0 else n
                continue
            end = self.tag_end(m.end())
            if end < 0:
                break
            tag, at = m[2].lower(), end + 1
            if tag not in ("html", "body"):
                if m[1]:
                    self.end(tag)
                else:
                    at = self.start(tag, page[m.end() : end], at)
        return self.body


def parse(page: str) -> _Node:
    """The body of the page (made up if it has none)."""
    return _Parser(page).run()


def _measure(body: _Node) -> list[_Node]:
    """Counts, densities and sums, without recursion; the nodes in page order."""
    order, stack = [], [body]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(y for y in reversed(x.items) if isinstance(y, _Node) and not y.dropped)
    for x in reversed(order):
        c = sum(len(y.strip()) for y in x.items if isinstance(y, str))
        for y in x.items:
            if isinstance(y, _Node) and not y.dropped:
                c += y.c
                x.t += y.t + 1
                x.lc += y.lc
                x.lt += y.lt + (y.tag == "a")
        x.c = c
        if x.tag == "a":
            x.lc = c
    cb, lcb = body.c or 1, body.lc
    for x in reversed(order):
        if x.c:
            t, lc, lt = x.t or 1, x.lc or 1, x.lt or 1
            base = math.log(x.c / ((x.c - x.lc) or 1) * x.lc + lcb / cb * x.c + math.e)
            x.density = x.c / t * (math.log(max(x.c / lc * t / lt, 1.0 + 1e-9)) / math.log(base) if base > 1.0 + 1e-12 else math.log(max(x.c / lc * t / lt, 1.0 + 1e-9)))
        below = [y for y in x.items if isinstance(y, _Node) and not y.dropped]
        x.total = sum(y.density for y in below)
        for y in below:
            if y.best.total > x.best.total:
                x.best = y.best
    return order


def _select(body: _Node, order: list[_Node]) -> set[int]:
    """The nodes (by their identity) whose subtrees are the main text."""
    core = body.best
    if core.total <= 0:
        return {id(body)}
    path = []
    up: _Node | None = core
    while up is not None:
        if up.tag in ("article", "main"):
            return {id(up)}
        path.append(up)
        up = up.parent
    threshold = min(x.density for x in path)
    return {id(x.best) for x in order if x.density >= threshold}


def _is_menu(x: _Node) -> bool:
    """Whether a list or box has two links or more and hardly another character, and no paragraph or heading."""
    if x.tag not in MENUS or x.lt < 2 or x.c - x.lc > (1 - LINK_SHARE) * x.c / 2:
        return False
    stack = [x]
    while stack:
        for y in stack.pop().items:
            if isinstance(y, _Node) and not y.dropped:
                if y.tag == "p" or y.tag in HEADINGS:
                    return False
                stack.append(y)
    return True


def _gather(body: _Node, chosen: set[int]) -> list[str]:
    """Blocks of the chosen subtrees in page order."""
    blocks, now = [], []

    def flush() -> None:
        if now:
            if text := _SPACE.sub(" ", _html.unescape("".join(now))).strip():
                blocks.append(text)
            now.clear()

    stack: list = [(body, iter(body.items), id(body) in chosen, False)]
    while stack:
        x, items, inside, header = stack[-1]
        y = next(items, None)
        if y is None:
            stack.pop()
            if x.tag in BLOCK:
                flush()
        elif isinstance(y, str):
            if inside and not header:
                now.append(y)
        elif y.tag in ("br", "hr"):
            flush() if y.tag == "hr" else now.append(" ")
        elif not y.dropped and not (inside and _is_menu(y)):
            if y.tag in BLOCK:
                flush()
            stack.append((y, iter(y.items), inside or id(y) in chosen, (header or y.tag == "header") and y.tag not in HEADINGS))
    flush()
    return blocks


def main_text(page: str | None) -> str:
    if not page:
        return ""
    body = parse(page)
    return "\n\n".join(_gather(body, _select(body, _measure(body))))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars.  One pass, no exchange; a row at a time in memory."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "html"):
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
