"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks (runs of text between block-level tags). A linear
classifier over a block's words, links, tag and enclosing elements gives the
cost of calling it boilerplate (capacity from the source) or content (capacity
to the sink). Smoothness edges join a block with the next one in page order and
with the next one below the same parent, stronger the nearer the two are in the
document tree. The minimum cut, found by maximum flow, labels all blocks at
once; blocks on the source's side are the main text, in page order. A page
without any content block by these costs (a few bare words) is cut once more by
names, enclosing elements and links alone.

One page is worked on at a time; pages need no shuffle.

Defined cases: null and empty pages have an empty text; broken markup (unclosed
tags, quotes, comments) is read as far as it goes; a page of boilerplate only
has an empty text; repeated rows give repeated rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?])")
_STOP = re.compile("[\"'>]")
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")

#: fixed values: element names and name parts
SKIPPED = frozenset("script style noscript template iframe object svg canvas select textarea title button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section "
                  "summary table tbody td tfoot th thead tr ul".split())
#: an opening tag ends an open element of these
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "body": {"head"}}
#: end tags of these do not reach beyond a table or article
INLINE = frozenset("p li b i a span em strong".split())
APART = frozenset("nav footer aside form menu dialog fieldset".split())
MAIN = frozenset("article main".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar "
    "navigation menu breadcrumb breadcrumbs pagination pager sidebar widget widgets related recommended footer "
    "masthead comment comments disqus replies respond reactions discussion cookie cookies consent gdpr notice notices "
    "alert newsletter subscribe signup login share sharing social search popup modal overlay toolbar copyright legal "
    "contentinfo complementary skip byline tags".split())
#: names of wrappers whose articles are other texts than the page's; all other names may also name a page's layout
OTHERS = frozenset("ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion related "
                   "recommended comment comments disqus replies respond reactions discussion".split())
CONTENT_NAMES = frozenset("article content entry main post story text body articlebody".split())

#: classifier: weight of a content word, a full stop, the share of linked text, tags and enclosing elements
WORD, WORDS_MOST, STOP, LINKED = 0.05, 60, 0.6, -4.0
#: the same weight of linked text for running text of an article, whose words may well be links
LINKED_TEXT, RUNNING = -1.5, frozenset("p h1 h2 h3 pre blockquote".split())
#: what a block costs on a page where no block looks like content, beside its names and links
UNKNOWN = 2.0
TAG = {"p": 0.6, "h1": 0.8, "h2": 0.3, "h3": 0.3, "pre": 0.5, "blockquote": 0.4, "li": -0.3, "td": -0.2, "div": -0.2}
IN_MAIN, OUT_OF_MAIN, IN_APART, IN_HEADER, BAD_NAME, GOOD_NAME, BIAS = 2.5, -2.0, -8.0, -5.0, -6.0, 1.0, -0.6
#: smoothness of neighbours below one parent; halved for every step further apart in the tree
NEAR, LEAST = 0.8, 0.1
#: steps beyond which the smoothness stays the least
FAR = 8


@dataclass
class Element:
    name: str
    depth: int
    parent: "Element | None"
    kind: float  # what tags and hiding add to the cost of every block in it
    named: float  # what names add
    others: bool  # below a name of OTHERS
    article: bool
    main: bool

    def adds(self) -> float:
        return min(self.kind, self.named) if self.kind < 0 else self.named


@dataclass
class Block:
    text: str
    linked: int
    element: Element


def _names(attrs: str) -> tuple[set[str], bool]:
    found = {p for m in _NAMES.finditer(attrs) for p in _PARTS.split(next(filter(None, m.groups()), "").lower())}
    return found, bool(_HIDDEN.search(attrs))


def _opened(name: str, attrs: str, parent: Element | None) -> Element:
    kind, named, others, article, main = ((parent.kind, parent.named, parent.others, parent.article, parent.main)
                                          if parent else (0.0, 0.0, False, False, False))
    names, hidden = _names(attrs) if attrs and not attrs.isspace() else (set(), False)
    if name in ("html", "body"):
        names, hidden = set(), False
    if name in APART or hidden:
        kind = min(kind, IN_APART)
    if name == "header" and not main:
        kind = min(kind, IN_HEADER)
    body = "articlebody" in names
    enters = name in MAIN or body
    others = others or bool(names & OTHERS)
    # a wrapper's name is the layout's, not the article's
    if enters and (name == "main" or not others and (body or not article)):
        named = max(named, 0.0)
    if names & BOILERPLATE_NAMES and not enters:
        named = BAD_NAME
    elif names & CONTENT_NAMES and named >= 0 and kind >= 0:
        named = GOOD_NAME
    return Element(name, parent.depth + 1 if parent else 0, parent, kind, named, others, article or name == "article" or body,
                   main or name in MAIN)


class Tags:
    """The page's tags from left to right: (begin, end, closing, name, attributes); markup without a name has none.

    Every character is looked at a bounded number of times: a quote that is
    never closed, or a tag that never ends, is found out once for the page.
    """

    def __init__(self, html: str):
        self.html, self.last, self.quotes = html, html.rfind(">"), True
        self.unclosed: set[str] = set()

    def _end(self, at: int) -> int:
        """Where the tag whose attributes begin at ``at`` ends; a ">" within quotes does not end it."""
        place = at
        while self.quotes:
            m = _STOP.search(self.html, place)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            place = self.html.find(m[0], m.end()) + 1
            if not place:
                break
        self.quotes = False
        return self.html.find(">", at)

    def __iter__(self):
        at = 0
        while (m := _OPEN.search(self.html, at)) and m.end() <= self.last:
            name = m[2]
            if name is None:
                comment = self.html.startswith("<!--", m.start())
                end = self.html.find("-->", m.start() + 4) + 2 if comment else self.html.find(">", m.end())
                at = len(self.html) if comment and end < 2 else end + 1
                yield m.start(), at, False, None, ""
                continue
            end = self._end(m.end())
            name = name.lower()
            at = end + 1
            if not m[1] and name in SKIPPED:
                at = self._after(name, at)
            yield m.start(), at, bool(m[1]), name, self.html[m.end(): end]
        if m and m[2] is None and self.html.startswith("<!--", m.start()):
            yield m.start(), len(self.html), False, None, ""

    def _after(self, name: str, at: int) -> int:
        """Behind the closing tag of a skipped element; a script or style without one takes the rest."""
        end = None if name in self.unclosed else re.compile(rf"</{name}\b[^>]*>", re.I).search(self.html, at)
        if end:
            return end.end()
        self.unclosed.add(name)
        return len(self.html) if name in ("script", "style") else at


class Open:
    """The open elements, with the places of every name and of the block-level ones."""

    def __init__(self):
        self.stack = [Element("#page", 0, None, 0.0, 0.0, False, False, False)]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]

    def push(self, element: Element) -> None:
        self.places.setdefault(element.name, []).append(len(self.stack))
        if element.name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(element)

    def innermost(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def close(self, names, stop) -> None:
        """Pop up to the innermost open element of these names, not beyond ``stop``."""
        place = self.innermost(names)
        if place > self.innermost(stop):
            while len(self.stack) > place:
                name = self.stack.pop().name
                self.places[name].pop()
                if name in BLOCK:
                    self.blocks.pop()

    def owner(self) -> Element:
        return self.stack[self.blocks[-1]]


def blocks_of(html: str) -> list[Block]:
    """The page's text blocks in page order."""
    page = Open()
    out: list[Block] = []
    parts: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, linked, page.owner()))
        parts.clear()
        linked = 0

    def read(raw: str) -> None:
        nonlocal linked
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if page.places.get("a"):
                linked += len("".join(text.split()))

    for begin, end, closing, name, attrs in Tags(html):
        read(html[at:begin])
        at = end
        if name is None:
            continue
        if name in BLOCK:
            flush()
        elif name == "br":
            parts.append(" ")
        if closing:
            page.close((name,), ("table", "article", "main") if name in INLINE else ())
        elif name in SKIPPED:
            parts.append(" ")
        elif name not in VOID:
            if name in BLOCK:
                if page.owner().name == "p":
                    page.close(("p",), ())
                if name in ENDS:
                    page.close(ENDS[name], ("ul", "ol", "dl", "table"))
            page.push(_opened(name, attrs, page.stack[-1]))
    read(html[at:])
    flush()
    return out


def links(block: Block) -> float:
    """What the share of linked text adds."""
    e = block.element
    running = e.article and e.name in RUNNING and e.adds() >= 0
    return (LINKED_TEXT if running else LINKED) * min(block.linked / max(len(block.text) - block.text.count(" "), 1), 1.0)


def cost(block: Block, has_main: bool) -> float:
    """Above zero: how much dearer it is to call the block boilerplate than content."""
    text, e = block.text, block.element
    value = BIAS + WORD * min(text.count(" ") + 1, WORDS_MOST) + TAG.get(e.name, 0.0)
    value += STOP * (text[-1] in ".!?…。\"”»")
    value += links(block) + e.adds()
    if has_main:
        value += IN_MAIN if e.main else OUT_OF_MAIN
    return value


def distance(a: Element, b: Element) -> int:
    """Steps from the two elements up to their common ancestor, the longer way; at most ``FAR``."""
    steps = 0
    x, y = a, b
    while x is not y and steps < FAR:
        if x.depth >= y.depth and x.parent is not None:
            x, y, steps = x.parent, (y.parent if y.depth == x.depth and y.parent is not None else y), steps + 1
        else:
            y, steps = y.parent, steps + 1
    return steps


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges (i, j, capacity) by page order and by common parent."""
    edges, last = {}, {}
    for j, b in enumerate(blocks):
        parent = id(b.element.parent)
        for i in {j - 1, last.get(parent, j - 1)} - {-1}:
            edges[i, j] = max(NEAR / 2 ** max(distance(blocks[i].element, b.element) - 1, 0), LEAST)
        last[parent] = j
    return [(i, j, c) for (i, j), c in edges.items()]


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut (Dinic's maximum flow).

    A node's cost is its capacity from the source if positive, else to the sink.
    """
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to)), to.append(b), room.append(there)
        out[b].append(len(to)), to.append(a), room.append(back)

    for i, c in enumerate(costs):
        join(source, i, c, 0.0) if c > 0 else join(i, sink, -c, 0.0)
    for i, j, c in edges:
        join(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        todo = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if room[e] <= 1e-12)
                a = to[path[first] ^ 1]
                del path[first:]
            while todo[a] < len(out[a]):
                e = out[a][todo[a]]
                if room[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    break
                todo[a] += 1
            if todo[a] < len(out[a]):
                path.append(out[a][todo[a]])
                a = to[path[-1]]
            elif a == source:
                break
            else:
                todo[to[path[-1] ^ 1]] += 1
                a = to[path.pop() ^ 1]


def main_text(html: str | None) -> str:
    """The main text: content blocks joined by a blank line."""
    blocks = blocks_of(html or "")
    if not blocks:
        return ""
    has_main, edges = any(b.element.main for b in blocks), smoothness(blocks)
    label = minimum_cut([cost(b, has_main) for b in blocks], edges)
    if not any(label):
        # no block looks like an article's: what neither names nor links speak against
        label = minimum_cut([UNKNOWN + links(b) + b.element.adds() + (OUT_OF_MAIN if has_main and not b.element.main else 0)
                             for b in blocks], edges)
    return "\n\n".join(b.text for b, content in zip(blocks, label) if content)


class Extract:
    """Task function: page_id, url, text, n_chars."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return pages.select("page_id", "url", "html").mapInArrow(
        Extract(), "page_id bigint, url string, text string, n_chars bigint")
