"""Main text of web pages by minimum-cut labelling of blocks (operator 4).

A page is cut into blocks of text at its block-level tags. The nodes of a graph are the blocks and the
regions, the elements whose tag or name speaks for or against content. A logistic model of the text
gives every block a log odds, its capacity to one of the two terminals; a region's evidence, times the
blocks in it, is the region's. Edges are the smoothness: a block and the next one, and the next one
below the same parent, stronger the closer they are in the tree; a block and its region; a region
and the region around it. The minimum cut, found by maximum flow, is the labelling of least total
cost. So names decide nothing by themselves: they pull the blocks inside, neighbours pull each
other, and the text pulls back.

The text model is fitted to the pages at hand: blocks in regions of clear evidence, of a bounded
hashed sample of pages, are its examples, and it sees nothing of tags or names that made them so.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import slices

# Names of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("iframe noembed noframes noscript object script style svg template textarea title audio video canvas".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open tag of the key's kind is closed by an open tag of these kinds.
_P_CLOSERS = BLOCK_TAGS - {"button", "caption", "option", "optgroup", "legend", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "head", "body"}
_CLOSED_BY = {
    "p": _P_CLOSERS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"}, "head": {"body"},
    "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "th": {"td", "th", "tr", "tbody", "thead", "tfoot"},
}
#: The kinds of open tags that an open tag closes.
_CLOSES = {tag: [kind for kind, by in _CLOSED_BY.items() if tag in by] for tag in BLOCK_TAGS}
#: Searching for an open tag to close stops at these.
_SCOPES = frozenset("table td th ul ol dl select article section div body html button form".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s=/]|\Z)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

#: Weight of an open element by tag; positive speaks for content.
TAG_WEIGHT = {
    "article": 3.0, "main": 2.0, "nav": -9.0, "footer": -9.0, "aside": -9.0, "header": -6.0, "form": -9.0, "button": -9.0, "select": -9.0, "menu": -9.0,
    "dialog": -9.0, "fieldset": -6.0, "label": -4.0, "legend": -6.0, "search": -9.0, "head": -20.0, "option": -9.0, "address": -2.0,
}
_BAD_NAMES = (
    r"ads?|adsbygoogle|adverts?|advertisements?|advertising|adsense|adslot|sponsor(?:ed|s)?|promos?|promotion|banner|cookies?|consent|gdpr|notices?|notification|alert|popup|overlay|modal|newsletter|"
    r"subscribe|subscription|signup|signin|login|register|share|sharing|social|sidebar|side|aside|related|recommend(?:ed|ation|ations)?|breadcrumbs?|menus?|navbar|nav|navigation|"
    r"footer|header|masthead|topbar|toolbar|copyright|legal|disclaimer|comments?|commentlist|replies|reply|respond|disqus|discussion|reactions?|search|widgets?|pagination|pager|"
    r"taglist|toc|skip|hidden|form|paywall|trending|popular|complementary|contentinfo"
)
_BAD_NAME = re.compile(rf"(?:^|[^a-z])(?:{_BAD_NAMES})(?:$|[^a-z])")
#: Names that only say what else the page has, and names of the head of an article itself.
_NO_NAME = re.compile(r"^(?:has|with|without|no|is|not)(?:$|[^a-z])|(?:article|entry|post|story|content|page)[^a-z]*(?:header|head|title)$")
_GOOD_NAME = re.compile(r"(?:^|[^a-z])(?:article|articlebody|story|post|entry|content|main|maincontent|body|text|prose)(?:$|[^a-z])")
BAD_NAME_WEIGHT, GOOD_NAME_WEIGHT, HIDDEN_WEIGHT = -9.0, 1.0, -9.0
#: What an example's inherited evidence must reach to count as content or as boilerplate.
CLEAR_CONTENT, CLEAR_BOILERPLATE = 2.0, -4.0
#: The model of a block's text: how its features add up to log odds where there is nothing to learn from, which is also the prior of learning.
FEATURES = ("bias", "log words", "ends as a sentence", "share in links", "marks a word")
DEFAULT = (-1.75, 0.75, 0.8, -2.5, 0.0)
#: A block's log odds lie within this, so that what is around it can turn it.
MOST = 3.0
#: Edges to the next block and the next sibling, divided by the tree distance.
NEXT, SIBLING = 1.5, 1.5
#: What a heading's tag adds to its text's log odds.
HEADING = 0.6
#: What it costs, a block, that content lies in a boilerplate region, that boilerplate lies in a content region, and that a content region lies in a boilerplate one.
INSIDE, OUTSIDE, NESTED = 6.0, 2.0, 4.0
#: The model is learned from about this many pages, and from this many blocks of each at most, spread over the page.
FIT_PAGES, FIT_BLOCKS = 300, 64
_MARKS = re.compile(r"[.,;:!?]")


class Element:
    __slots__ = ("below", "depth", "own", "parent", "region", "tag", "weight")

    def __init__(self, tag: str, parent: Element | None, own: float) -> None:
        self.tag, self.parent, self.own = tag, parent, own
        self.weight = own + (parent.weight if parent else 0.0)
        self.depth = parent.depth + 1 if parent else 0
        self.region = self if own else parent.region if parent else None
        self.below = 0  # blocks in this region


class Block:
    __slots__ = ("holder", "links", "text")

    def __init__(self, text: str, links: int, holder: Element) -> None:
        self.text, self.links, self.holder = text, links, holder


def _evidence(tag: str, attributes: str, parent: Element) -> float:
    """What an element's tag and names say for (positive) or against content."""
    own = TAG_WEIGHT.get(tag, 0.0)
    if tag == "header" and parent.weight > 0:
        own = 0.0  # an article's own header holds its headline
    if tag not in ("html", "body") and ("=" in attributes or "hidden" in attributes):
        for m in _NAMES.finditer(attributes):
            # a camelCase name counts as its parts
            names = [x for x in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[1] or m[2] or m[3] or "").lower().split() if not _NO_NAME.search(x)]
            if any(map(_BAD_NAME.search, names)):
                own += BAD_NAME_WEIGHT
            elif any(map(_GOOD_NAME.search, names)):
                own += GOOD_NAME_WEIGHT
        if _HIDDEN.search(attributes):
            own += HIDDEN_WEIGHT
    return own


class _Open:
    """The open elements, with the places of each tag, of block elements and of scopes, so that a tag finds its partner at once."""

    def __init__(self) -> None:
        self.stack = [Element("", None, 0.0)]
        self.places: dict[str, list[int]] = {}
        self.blocks, self.scopes = [0], [0]

    def push(self, element: Element) -> None:
        at = len(self.stack)
        self.stack.append(element)
        self.places.setdefault(element.tag, []).append(at)
        if element.tag in BLOCK_TAGS:
            self.blocks.append(at)
        if element.tag in _SCOPES:
            self.scopes.append(at)

    def last(self, tag: str) -> int:
        """The place of the innermost open element of the tag, 0 without one."""
        found = self.places.get(tag)
        return found[-1] if found else 0

    def cut(self, at: int) -> None:
        """Close the element at a place and all within it."""
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()
        for kind in (self.blocks, self.scopes):
            while kind[-1] >= at:
                kind.pop()


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page in order, with character references decoded and white space as one blank.

    The work is in proportion to the page, whatever its tags: a tag looks up the one that it closes.
    """
    open_ = _Open()
    found: list[Block] = []
    held: list[str] = []
    links = in_link = 0
    at = 0

    def close_block() -> None:
        nonlocal links
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                found.append(Block(text, links, open_.stack[open_.blocks[-1]]))
            held.clear()
        links = 0

    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            held.append(text)
            links += len(text) if in_link else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if not m[0].endswith(">"):
            break  # the page ends within a tag
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag == "br" or tag == "wbr":
            held.append(" " if tag == "br" else "")
        elif closing:
            place = open_.last(tag)
            if tag in BLOCK_TAGS:
                close_block()
                if place:
                    open_.cut(place)
            elif place > open_.blocks[-1]:  # an inline tag's end does not close a block
                open_.cut(place)
            if tag == "a":
                in_link = max(0, in_link - 1)
        elif tag in RAW_TAGS:
            if not attributes.rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
        else:
            if tag in BLOCK_TAGS:
                close_block()
                place = max(map(open_.last, _CLOSES.get(tag, ())), default=0)
                if place and place >= open_.scopes[-1]:
                    open_.cut(place)
            if tag not in VOID_TAGS:
                parent = open_.stack[-1]
                open_.push(Element(tag, parent, _evidence(tag, attributes, parent)))
            if tag == "a":
                in_link += 1
    close_block()
    for block in found:
        if region := block.holder.region:
            region.below += 1
    return found


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block of a page: its text alone, as tags, names and neighbours have their say in the graph."""
    words = np.array([b.text.count(" ") + 1 for b in found], float)
    linked = [min(1.0, b.links / len(b.text)) for b in found]
    marks = np.array([len(_MARKS.findall(b.text)) for b in found]) / words
    ends = [b.text[-1] in ".!?…:;\"'”»)" for b in found]
    return np.column_stack([np.ones(len(found)), np.log1p(words), ends, linked, np.minimum(marks, 1.0)])


def leaning(found: list[Block], model: tuple[float, ...] = DEFAULT) -> list[float]:
    """How far the text of each block leans to content (positive) or boilerplate (negative)."""
    if not found:
        return []
    heading = np.array([HEADING if b.holder.tag in HEADINGS else 0.0 for b in found])
    return np.clip(features(found) @ np.array(model) + heading, -MOST, MOST).tolist()


def _distance(a: Element, b: Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(found: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness: each block with the next, and with the next one whose holder has the same parent."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            out[i - 1, i] = NEXT / (1 + _distance(found[i - 1].holder, b.holder))
        key = id(b.holder.parent)
        if key in last and last[key] != i:
            pair = (last[key], i)
            out[pair] = out.get(pair, 0.0) + SIBLING / (1 + _distance(found[pair[0]].holder, b.holder))
        last[key] = i
    return out


def regions(found: list[Block]) -> tuple[list[float], dict[tuple[int, int], float]]:
    """The capacities of the regions, which are numbered after the blocks, and the one-way edges from blocks and regions.

    An edge (a, b) is paid if a is content and b is not. All blocks below a region count for it.
    """
    number: dict[int, int] = {}
    order: list[Element] = []
    oneway: dict[tuple[int, int], float] = {}
    for i, block in enumerate(found):
        region = block.holder.region
        if not region:
            continue
        inner = region
        while region and id(region) not in number:
            number[id(region)] = len(found) + len(order)
            order.append(region)
            region = region.parent.region if region.parent else None
        oneway[i, number[id(inner)]] = INSIDE
        oneway[number[id(inner)], i] = OUTSIDE
    total = [r.below for r in order]
    for k in sorted(range(len(order)), key=lambda k: -order[k].depth):
        around = order[k].parent.region if order[k].parent else None
        if around:
            outer = number[id(around)]
            total[outer - len(found)] += total[k]
            oneway[number[id(order[k])], outer] = NESTED * total[k]
    return [r.own * n for r, n in zip(order, total, strict=True)], oneway


def min_cut(lean: list[float], joined: dict[tuple[int, int], float], oneway: dict[tuple[int, int], float] | None = None) -> list[bool]:
    """True for the nodes on the source's side of the minimum cut; a tie goes to the sink's side.

    ``joined`` is paid if the two nodes differ, ``oneway`` if the first is on the source's side and the
    second is not. A node whose terminal capacity is at least that of all edges that it could have
    to pay on that side is there in some minimum cut, so it is decided at once and its edges become
    terminal capacities of its neighbours. What is left is solved by maximum flow.
    """
    n = len(lean)
    lean = list(lean)
    out: list[dict[int, float]] = [{} for _ in range(n)]
    into: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in (oneway or {}).items():
        out[a][b] = into[b][a] = out[a].get(b, 0.0) + w
    for (a, b), w in joined.items():
        for x, y in ((a, b), (b, a)):
            out[x][y] = into[y][x] = out[x].get(y, 0.0) + w
    leaving, coming = ([sum(x.values()) for x in way] for way in (out, into))
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is not None or not (lean[i] > leaving[i] or -lean[i] >= coming[i]):
            continue
        side[i] = lean[i] > leaving[i]
        for j, w in out[i].items():
            if side[j] is None:
                coming[j] -= w
                lean[j] += w if side[i] else 0.0
                todo.append(j)
        for j, w in into[i].items():
            if side[j] is None:
                leaving[j] -= w
                lean[j] -= 0.0 if side[i] else w
                todo.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        links = [(place[i], place[j], w, out[j].get(i, 0.0) if i < j else 0.0) for i in rest for j, w in out[i].items() if side[j] is None and (i < j or i not in out[j])]
        for i, s in zip(rest, max_flow([lean[i] for i in rest], links), strict=True):
            side[i] = s
    return [bool(s) for s in side]


def max_flow(lean: list[float], links: list[tuple[int, int, float, float]]) -> list[bool]:
    """Dinic's algorithm from the source (capacity: positive leanings) to the sink (negative ones); the source's side.

    Links are (a, b, capacity forth, capacity back).
    """
    n = len(lean)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def link(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b), room.append(forth)
        head[b].append(len(to))
        to.append(a), room.append(back)

    for i, x in enumerate(lean):
        link(source, i, max(x, 0.0), 0.0)
        link(i, sink, max(-x, 0.0), 0.0)
    for a, b, forth, back in links:
        link(a, b, forth, back)
    least = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nth = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= least)
                del path[cut + 1 :]
                at = to[path.pop() ^ 1]
                continue
            while nth[at] < len(head[at]):
                e = head[at][nth[at]]
                if room[e] > least and level[to[e]] == level[at] + 1:
                    break
                nth[at] += 1
            if nth[at] < len(head[at]):
                path.append(head[at][nth[at]])
                at = to[path[-1]]
            elif path:
                level[at] = -1
                at = to[path.pop() ^ 1]
            else:
                break


def labels(found: list[Block], model: tuple[float, ...] = DEFAULT) -> list[bool]:
    """Which blocks of a page are content."""
    weights, oneway = regions(found)
    return min_cut(leaning(found, model) + weights, edges(found), oneway)[: len(found)]


def main_text(page: str, model: tuple[float, ...] = DEFAULT) -> str:
    """The content blocks of a page, in page order, with an empty line between them."""
    found = blocks(page)
    return "\n\n".join(b.text for b, yes in zip(found, labels(found, model), strict=True) if yes)


def fit_model(x: np.ndarray, y: np.ndarray, decay: float = 10.0) -> tuple[float, ...]:
    """Logistic regression with a squared penalty on the distance from DEFAULT, by Newton steps."""
    prior = np.array(DEFAULT)
    w = prior.copy()
    if not 0 < y.sum() < len(y):
        return DEFAULT
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + decay * np.eye(len(w)), x.T @ (p - y) + decay * (w - prior))
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
    return tuple(w.tolist())


def fit(pages: DataFrame, html_col: str = "html", fit_pages: int = FIT_PAGES, fit_blocks: int = FIT_BLOCKS) -> tuple[float, ...]:
    """The text model from blocks of clear evidence in about ``fit_pages`` pages, chosen by a hash.

    At most ``fit_blocks`` rows of features of a page come to the driver. Without examples of both
    kinds the model is DEFAULT.
    """
    one = 1 << 30
    source = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    share = int(one * min(1.0, fit_pages / max(1, pages.count())))
    chosen = pages.select(source.alias("html")).where(F.pmod(F.xxhash64(F.lit(4), "html"), F.lit(one)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column(0).to_pylist():
                found = blocks(page)
                clear = [i for i, b in enumerate(found) if not CLEAR_BOILERPLATE < b.holder.weight < CLEAR_CONTENT]
                clear = clear[:: -(-len(clear) // fit_blocks) or 1]
                if clear:
                    x, y = features(found)[clear], [found[i].holder.weight > 0 for i in clear]
                    yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(y)], ["x", "y"])

    rows = sorted(chosen.mapInArrow(run, "x array<double>, y boolean").collect())  # fit_pages times fit_blocks rows
    if not rows:
        return DEFAULT
    return fit_model(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float))


def extract(pages: DataFrame, html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all but the html by default), text and n_chars of every row.

    A null or empty page has an empty text. Rows are independent once the text model is learned:
    repeated rows give a row each, and an empty table an empty table. Columns named text or n_chars
    are replaced.
    """
    names = [c for c in (pages.columns if carry is None else carry) if c not in (html_col, "text", "n_chars")]
    model = fit(pages, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(1).to_pylist()
            for a, b in slices([len(x) for x in sources]):
                texts = [main_text(x, model) for x in sources[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["row", "text", "n_chars"])

    kept = F.struct(F.lit(True).alias("_"), *(pages[c] for c in names))
    rows = pages.select(kept.alias("row"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    out = rows.mapInArrow(run, StructType([rows.schema["row"]]).add("text", "string").add("n_chars", "long"))
    return out.select(*(F.col("row")[c].alias(c) for c in names), "text", "n_chars")
