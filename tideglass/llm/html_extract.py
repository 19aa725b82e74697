"""Main text of web pages by minimum-cut labelling.

A page is read into blocks: runs of text between block-level tags, with the elements around them. A linear classifier gives
each block its log-odds of being content from the elements and their class, id and role words, the share of linked
text, length and punctuation. The labelling minimises the sum of what the classifier charges for each label (edges to the
terminals) and of smoothness (edges between neighbours in page order and in the tree, stronger the nearer they are in the
tree, cut when their labels differ). Max-flow finds the minimum; blocks on the source's side are content.

Scripts, styles, comments and other raw elements hold no text; formulas do, and so does the fallback of an object in an article. Character references are decoded, white space inside a block
becomes one space, and content blocks are joined by line ends in page order. A null or empty page has an empty text. Every page is
labelled by itself, so repeated rows, null keys and empty tables need no care; other columns pass through. Long pages are
handled whole, with edges in proportion to their blocks.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideglass.llm.common import slices

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|([^<]+|<)""", re.S)
_ATTRIBUTE = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements by their role (names fixed by HTML).
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg annotation annotation-xml object select option datalist canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK
AWAY = frozenset("nav footer aside form menu dialog fieldset button label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that speak for or against content (parameters of the classifier).
AGAINST = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments reply replies disqus discussion pagination pager widget login search toolbar skip copyright legal disclaimer complementary contentinfo alert dialog".split()
)
#: Such words do not pass an only article by; a main element clears all wrappers.
REMARKS = frozenset("comment comments reply replies disqus discussion related recommended recommendations".split())
#: In a name like no-sidebar or content-with-menu what follows the first kind is a state of the page, in menu-open what precedes the second.
STATE_OF, STATE = frozenset("no not has have with without show hide is".split()), frozenset("layout open opened closed enabled disabled".split())
HEAD_WORDS = frozenset("header masthead topbar banner".split())
FOR = frozenset("article content post entry story main body text".split())
#: Weights of the classifier and the smoothness, in log-odds.
WEIGHTS = {
    "bias": -0.6, "article": 3.5, "for": 1.0, "away": -7.0, "against": -6.0, "head": -5.0, "hidden": -6.0, "links": -4.0, "words": 0.7, "sentence": 0.6, "heading": 0.5, "mark": -1.5,
}
ADJACENT, PROXIMITY = 0.5, 1.0
SCALE = 1000


def _roles(name: str) -> list[str]:
    """The words of one class, id or role that tell what its element is, not what state the page is in."""
    words = [w.lower() for w in _WORD.findall(name)]
    words = words[: next((i for i, w in enumerate(words) if w in STATE_OF), len(words))]
    return words[max((i + 1 for i, w in enumerate(words) if w in STATE), default=0) :]


class _Element:
    __slots__ = ("name", "parent", "depth", "words", "wraps", "article", "away", "against", "head", "good", "hidden")

    def __init__(self, name: str, parent: _Element | None, attributes: str):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        words, hidden = frozenset(), False
        if attributes and "=" in attributes:
            found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            words = frozenset(w for k in ("class", "id", "role") if k in found for one in found[k].split() for w in _roles(one))
            hidden = "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("aria-hidden", "").lower() == "true"
        if attributes and re.search(r"(?:^|\s)hidden(?:\s|/|$)", attributes):
            hidden = True
        # The classes of the whole page are no statement about its parts.
        self.words, self.hidden, self.wraps = words, hidden, name in ("html", "body")

    def settle(self) -> None:
        """What the element inherits, once it is known which elements wrap the page's article."""
        top, parent, name, words = self.parent is None, self.parent, self.name, self.words
        self.away = (not top and parent.away) or name in AWAY
        self.against = (not top and parent.against) or (not self.wraps and bool(words & AGAINST))
        # An advert or menu inside an article is no part of it, and a comment is none though it may be an article element.
        self.article = ((not top and parent.article) or name in ("article", "main")) and not (self.away or self.against)
        self.head = (not top and parent.head) or (not self.article and (name == "header" or not self.wraps and bool(words & HEAD_WORDS)))
        self.good = (not top and parent.good) or bool(words & FOR)
        self.hidden = (not top and parent.hidden) or self.hidden


def _settle(elements: list[_Element]) -> None:
    """Settles all elements, parents first; what stands around main, or around the only article, does not count against its parts."""
    mains, articles = ([e for e in elements if e.name == n] for n in ("main", "article"))
    for inner in mains or (articles if len(articles) == 1 else []):
        e = inner.parent
        while e is not None:
            e.wraps = e.wraps or bool(mains) or not e.words & REMARKS
            e = e.parent
    for e in elements:
        e.settle()


class _Block:
    __slots__ = ("text", "linked", "element")

    def __init__(self, text: str, linked: int, element: _Element):
        self.text, self.linked, self.element = text, linked, element


def blocks(page: str) -> list[_Block]:
    """The page's blocks of text in order."""
    root = _Element("html", None, "")
    at, open_, elements = root, [root], [root]
    out: list[_Block] = []
    parts: list[str] = []
    linked, in_link = 0, False

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(_Block(text, linked, at))
        parts.clear()
        linked = 0

    place = 0
    while place < len(page):
        token = _TOKEN.match(page, place)
        if token is None:  # a tag that never ends
            break
        place = token.end()
        closing, name, attributes, text = token.groups()
        if text is not None:
            text = html.unescape(text)
            parts.append(text)
            if in_link:
                linked += len(text)
            continue
        if name is None:
            continue
        name = name.lower()
        if name in RAW and not (name == "object" and any(e.name in ("article", "main") for e in open_)):
            if not closing and not attributes.endswith("/"):
                shut = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, place)
                place = shut.end() if shut else len(page)
            continue
        if name == "a":
            in_link = not closing
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK or name in AWAY:
            end()
            if closing:
                if any(e.name == name for e in open_[1:]):
                    while open_[-1].name != name:
                        open_.pop()
                    open_.pop()
            else:
                if open_[-1].name == "p" and name in CLOSES_P or open_[-1].name == name == "li":
                    open_.pop()
                if name not in VOID and not (name == "html" and len(open_) == 1 and not attributes):
                    open_.append(_Element(name, open_[-1], attributes))
                    elements.append(open_[-1])
            at = open_[-1]
    end()
    _settle(elements)
    return out


def log_odds(block: _Block) -> float:
    e, w = block.element, WEIGHTS
    s = w["bias"] + w["words"] * math.log2(1 + block.text.count(" ") + 1) / 2
    s += w["links"] * min(1.0, block.linked / len(block.text))
    if block.text[-1] in ".!?:;\"'”’»…。！？":
        s += w["sentence"]
    if block.text[0] in "©®™":
        s += w["mark"]
    for name, on in (("article", e.article), ("away", e.away), ("against", e.against), ("head", e.head), ("for", e.good), ("hidden", e.hidden), ("heading", e.name in HEADINGS)):
        if on:
            s += w[name]
    return s


def _distance(a: _Element, b: _Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def _edges(page: list[_Block]) -> dict[tuple[int, int], float]:
    """Smoothness of neighbours in page order, and of each block with the one before it below the same parent."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(page):
        near = {i - 1: ADJACENT} if i else {}
        group = id(b.element.parent or b.element)
        if group in last:
            near[last[group]] = near.get(last[group], 0.0)
        last[group] = i
        for j, base in near.items():
            out[j, i] = base + PROXIMITY / (1 + _distance(page[j].element, b.element))
    return out


def minimum_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """For each node whether it is on the source's side of a minimum cut (Dinic's algorithm, whole capacities)."""
    n = len(odds)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def connect(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(odds):
        c = round(abs(s) * SCALE)
        if s > 0:
            connect(source, i, c, 0)
        elif c:
            connect(i, sink, c, 0)
    for (a, b), w in edges.items():
        c = round(w * SCALE)
        connect(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for v in queue:
            for e in out[v]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        arc = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                keep = next(i for i, e in enumerate(path) if not room[e])
                v = to[path[keep] ^ 1]
                del path[keep:]
                continue
            while arc[v] < len(out[v]):
                e = out[v][arc[v]]
                if room[e] and level[to[e]] == level[v] + 1:
                    break
                arc[v] += 1
            if arc[v] < len(out[v]):
                path.append(out[v][arc[v]])
                v = to[path[-1]]
            elif path:
                v = to[path.pop() ^ 1]
                arc[v] += 1
            else:
                break


def labelled(page: str) -> list[tuple[str, bool]]:
    """Every block's text and whether it is content."""
    found = blocks(page)
    odds = [log_odds(b) for b in found]
    return [(b.text, side) for b, side in zip(found, minimum_cut(odds, _edges(found)), strict=True)]


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(own: the columns ``keep``, text, n_blocks, n_content) of every page."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                found = [labelled(p or "") for p in part.column(1).to_pylist()]
                texts = ["\n".join(t for t, content in page if content) for page in found]
                counts = [pa.array([len(p) for p in found], pa.int64()), pa.array([sum(c for _, c in p) for p in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), *counts], names=["own", "text", "n_blocks", "n_content"])

    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("own"), F.col(html_col).alias("html"))
    return rows.mapInArrow(read, f"own {rows.schema['own'].dataType.simpleString()}, text string, n_blocks bigint, n_content bigint")
