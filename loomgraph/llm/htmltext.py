"""Main text of web pages: blocks labelled by a minimum cut."""

from __future__ import annotations

import functools
import html
import math
import re
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm import labelled_pages

# How HTML elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe object svg math canvas audio video head title select textarea button".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"br", "caption", "body", "html", "legend", "option", "optgroup", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: A start tag on the left ends open elements on the right, up to one of the bounds.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li td th dt dd".split())

# Elements and words in names (class, id, role) that speak for boilerplate or content. How much they say is learned.
BOILER_ELEMENTS = frozenset("nav menu footer header aside form dialog fieldset".split())
CONTENT_ELEMENTS = frozenset("article main".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert comment comments commentlist discussion disqus reply replies respond sidebar menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar toolbar share sharing social related recommended newsletter subscribe subscription signup login modal popup overlay pagination pager widget widgets copyright skip search tags toc outbrain taboola complementary contentinfo dialog".split()
)
CONTENT_WORDS = frozenset("content article post entry story main body text articlebody".split())
#: What an element can say about the blocks in it.
BOILER_ELEMENT, BOILER_NAME, CONTENT_ELEMENT, CONTENT_NAME = range(4)
BOILER = (BOILER_ELEMENT, BOILER_NAME)

#: Ridge of the logistic fit, share of the measured agreement of neighbours that becomes smoothness, largest distance in the element tree.
RIDGE, DAMPING, REACH = 0.3, 0.5, 6
UNIT = 100

_NAME = r"[a-zA-Z][^\s/><]*+"
# No alternative looks past the next `<` outside quotes, so a page of broken tags is read in one pass.
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)({_NAME})((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)({_NAME})([^<>]*+)>|<[!?/][^<>]*+>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s]++))?+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = tuple(".!?:;…。！？\"'”’)»")


@dataclass(slots=True)
class Element:
    name: str
    depth: int
    hidden: bool
    parent: Element | None
    #: for each kind of saying the nearest element around and with it that says it
    voices: dict[int, Element] = field(default_factory=dict)
    #: nearest element around and with it that starts a block
    block: Element | None = None


@dataclass(slots=True)
class Block:
    parent: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _attributes(text: str) -> tuple[str, bool]:
    """What class, id and role say, and whether the attributes hide the element."""
    names, hidden = [], False
    for name, value in _ATTRIBUTE.findall(text):
        name = name.lower()
        if name in ("class", "id", "role"):
            names.append(value)
        elif name == "hidden" or name == "aria-hidden" and "true" in value.lower() or name == "style" and re.search(r"display\s*+:\s*+none", value, re.I):
            hidden = True
    return " ".join(names), hidden


def _sayings(name: str, names: str, around: dict[int, Element]) -> list[int]:
    """What an element says. A header in an article holds its title. Names that speak for both (`main-with-sidebar`) say nothing around
    the content and are boilerplate inside it (`post-footer`)."""
    inside = bool(around) and not any(k in around for k in BOILER)
    own = [CONTENT_ELEMENT] if name in CONTENT_ELEMENTS else [BOILER_ELEMENT] if name in BOILER_ELEMENTS and not (name == "header" and inside) else []
    if names and name not in ("body", "html"):
        words = {w.lower() for w in _WORD.findall(names)}
        bad, good = not words.isdisjoint(BOILER_WORDS), not words.isdisjoint(CONTENT_WORDS)
        if good and (not bad or name in CONTENT_ELEMENTS):
            own.append(CONTENT_NAME)
        elif bad and (not good or inside):
            own.append(BOILER_NAME)
    return own


class _Tree:
    """The open elements, with a stack for each name: what is open is found without walking up."""

    def __init__(self):
        root = Element("", 0, False, None)
        root.block = root
        self.top = root
        self.open: dict[str, list[Element]] = {}
        self.links = 0

    def push(self, name: str, own: list[int], hidden: bool) -> None:
        """Open an element. Boilerplate inside content unsays the content around it."""
        voices = self.top.voices
        element = Element(name, self.top.depth + 1, hidden, self.top, voices)
        if own:
            element.voices = {k: e for k, e in voices.items() if k in BOILER or not any(o in BOILER for o in own)} | dict.fromkeys(own, element)
        element.block = element if name in BLOCK else self.top.block
        self.open.setdefault(name, []).append(element)
        self.links += name == "a"
        self.top = element

    def pop_to(self, element: Element) -> None:
        """Leave `element` and what is open in it."""
        while True:
            top = self.top
            self.open[top.name].pop()
            self.links -= top.name == "a"
            self.top = top.parent
            if top is element:
                return

    def innermost(self, names: Iterable[str]) -> Element | None:
        stacks = [s[-1] for n in names if (s := self.open.get(n))]
        return max(stacks, key=lambda e: e.depth) if stacks else None

    def close(self, names: Iterable[str], bounds: Iterable[str]) -> None:
        """End the innermost open element of these names, if no element of the bounds is open in it."""
        element = self.innermost(names)
        if element is not None and not ((bound := self.innermost(bounds)) and bound.depth > element.depth):
            self.pop_to(element)


_P_BOUNDS = ("button", "td", "th", "caption", "object", "article", "table")
_A_BOUNDS = ("td", "th", "table", "article")
_LIGHT = frozenset("p li a b i span em strong".split())
_HEAVY_BOUNDS = ("article", "table", "body")


def blocks_of(page: str) -> list[Block]:
    """Visible blocks of text in page order, each with its element. Time grows with the length of the page."""
    tree, out = _Tree(), []
    current: Block | None = None
    at, end = 0, len(page)
    while at < end:
        token = _TOKEN.search(page, at)
        text = page[at : token.start() if token else end]
        if text and not tree.top.hidden and (current is not None or not text.isspace()):
            if current is None:
                current = Block(tree.top.block)
                out.append(current)
            current.parts.append(text)
            if tree.links:
                current.linked += len(text)
        if token is None:
            break
        at = token.end()
        name = (token[2] or token[5] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            current = None
        if token[1] or token[4]:
            tree.close((name,), [b for b in _HEAVY_BOUNDS if b != name] if name in _LIGHT else ("html",) if name != "html" else ())
            continue
        attributes = token[3] or token[6] or ""
        if name in CLOSES_P and tree.open.get("p"):
            tree.close(("p",), _P_BOUNDS)
        if name in SIBLINGS:
            tree.close(*SIBLINGS[name])
        if name == "a" and tree.open.get("a"):
            tree.close(("a",), _A_BOUNDS)
        if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            close = _closing(name).search(page, at)
            at = close.end() if close else end
            continue
        names, hidden = _attributes(attributes) if attributes else ("", False)
        tree.push(name, _sayings(name, names, tree.top.voices), hidden or tree.top.hidden or name in HIDDEN)
    for block in out:
        block.text = " ".join(html.unescape("".join(block.parts)).split())
    return [b for b in out if b.text]


@functools.cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*+(?:/\s*+)?>", re.I)


def features(block: Block) -> list[float]:
    """What a block says by itself: words, sentence, share of linked text, kind."""
    return [
        1.0,
        min(math.log2(2 + block.text.count(" ")), 6.0) / 3,
        float(block.text.endswith(_ENDS)),
        min(1.0, block.linked / max(1, sum(map(len, block.parts)))),
        float(block.parent.name in HEADINGS),
        float(block.parent.name in ITEMS),
    ]


def tree_distance(a: Element, b: Element, most: int = REACH) -> int:
    """Steps between two elements, `most` if it is that far or further."""
    steps = 0
    while a is not b and steps < most:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps if a is b else most


def neighbours(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(i, j, kind) of blocks that follow each other on the page, or in one grandparent. The kind is their distance in the element
    tree, and beyond REACH the same for two blocks that different elements speak for."""
    found, last_in = [], {}
    for j, block in enumerate(blocks):
        home = id(block.parent.parent or block.parent)
        for i in {j - 1, last_in.get(home, j - 1)} - {-1}:
            other = blocks[i]
            found.append((i, j, tree_distance(block.parent, other.parent) + (REACH + 1) * (block.parent.voices is not other.parent.voices)))
        last_in[home] = j
    return found


@dataclass(frozen=True)
class Model:
    """All as log-odds: weights of a block's features, what each kind of saying weighs, smoothness of each kind of neighbours."""

    weights: tuple[float, ...]
    voices: tuple[float, ...]
    smooth: tuple[float, ...]

    @staticmethod
    def fit(pages: Iterable[str]) -> Model:
        """From pages whose content blocks open with `§`: a logistic fit with a ridge, and for each kind of neighbours the log-odds that
        they have one label (at least 0, damped)."""
        rows, labels, kinds = [], [], []
        for page in pages:
            blocks = blocks_of(page)
            mine = [b.text.startswith("§") for b in blocks]
            for b in blocks:
                b.text = b.text.removeprefix("§")
            rows += [features(b) + [float(k in b.parent.voices) for k in range(4)] for b in blocks]
            labels += mine
            kinds += [(k, mine[i] == mine[j]) for i, j, k in neighbours(blocks)]
        x, y = np.array(rows), np.array(labels, float)
        weights, ridge = np.zeros(x.shape[1]), RIDGE * np.eye(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-x @ weights))
            weights += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ weights)
        smooth = []
        for kind in range(2 * (REACH + 1)):
            same = [s for k, s in kinds if k == kind]
            smooth.append(max(0.0, DAMPING * math.log((sum(same) + 1) / (len(same) - sum(same) + 1))))
        found = tuple(weights.tolist())
        return Model(found[:-4], found[-4:], tuple(smooth))


@functools.cache
def model() -> Model:
    """The classifier, fitted on the labelled pages: once in a process, the same everywhere."""
    return Model.fit(labelled_pages.pages())


def min_cut(terminals: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source side of the minimum cut with the fewest of them there.

    terminals[i] > 0 is the capacity from the source to i, < 0 that from i to the sink; edges (i, j, capacity) go both ways.
    Nodes whose terminal outweighs all their edges are settled first, and their edges become terminals of their neighbours; a
    maximum flow by shortest augmenting paths, all of one length at a time, settles the others.
    """
    left, near = list(terminals), [[] for _ in terminals]
    slack = [0] * len(left)
    for i, j, c in edges:
        near[i].append((j, c))
        near[j].append((i, c))
        slack[i] += c
        slack[j] += c
    side: list[bool | None] = [None] * len(left)
    waiting = deque(range(len(left)))
    while waiting:
        i = waiting.popleft()
        if side[i] is not None or -slack[i] < left[i] <= slack[i]:
            continue
        side[i] = left[i] > 0 and left[i] > slack[i]
        for j, c in near[i]:
            if side[j] is None:
                slack[j] -= c
                left[j] += c if side[i] else -c
                waiting.append(j)
    rest = [i for i, s in enumerate(side) if s is None]
    number = {i: k for k, i in enumerate(rest)}
    kept = [(number[i], number[j], c) for i, j, c in edges if i in number and j in number]
    for i, source in zip(rest, _max_flow([left[i] for i in rest], kept)):
        side[i] = source
    return side


def _max_flow(left: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes the source still reaches after a maximum flow (level graphs, blocking flows)."""
    arcs: list[list[int]] = [[] for _ in left]
    head: list[int] = []
    capacity: list[int] = []
    for i, j, c in edges:
        arcs[i].append(len(head))
        arcs[j].append(len(head) + 1)
        head += [j, i]
        capacity += [c, c]
    while True:
        level = [0 if c > 0 else -1 for c in left]
        sources = [i for i, c in enumerate(left) if c > 0]
        queue, goal = deque(sources), None
        while queue:
            i = queue.popleft()
            if goal is not None and level[i] >= goal:
                continue
            for e in arcs[i]:
                j = head[e]
                if capacity[e] > 0 and level[j] < 0:
                    level[j] = level[i] + 1
                    if left[j] < 0 and goal is None:
                        goal = level[j]
                    queue.append(j)
        if goal is None:
            return [x >= 0 for x in level]
        tried = [0] * len(left)
        for source in sources:
            path: list[int] = []
            i = source
            while left[source] > 0:
                if left[i] < 0:
                    flow = min(left[source], -left[i], *(capacity[e] for e in path))
                    left[source] -= flow
                    left[i] += flow
                    for e in path:
                        capacity[e] -= flow
                        capacity[e ^ 1] += flow
                    path, i = [], source
                    continue
                while tried[i] < len(arcs[i]):
                    e = arcs[i][tried[i]]
                    if capacity[e] > 0 and level[head[e]] == level[i] + 1 <= goal:
                        break
                    tried[i] += 1
                if tried[i] < len(arcs[i]):
                    path.append(e)
                    i = head[e]
                elif path:
                    i = head[path.pop() ^ 1]
                    tried[i] += 1
                else:
                    break


def label(blocks: list[Block], fitted: Model) -> tuple[list[bool], list[bool]]:
    """Whether each block is content: by the cut, and by the sign of the classifier's odds for it alone, elements included.

    The costs of a block's two labels are -log p of the classifier on its features and on the elements that speak for it; their
    difference, the log-odds, is what a cut can save. Blocks that follow each other are joined the more firmly the nearer they are in the element tree.
    """
    units = lambda x: round(UNIT * x)
    own = [units(sum(w * x for w, x in zip(fitted.weights, features(b))) + sum(fitted.voices[k] for k in b.parent.voices)) for b in blocks]
    edges = [(i, j, c) for i, j, kind in neighbours(blocks) if (c := units(fitted.smooth[kind]))]
    return min_cut(own, edges), [t > 0 for t in own]


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by single spaces; empty for null, empty and text-less pages."""
    blocks = blocks_of(page or "")
    return " ".join(b.text for b, kept in zip(blocks, label(blocks, model())[0]) if kept)


def _texts(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py()) for p in pages], pa.string())


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """`pages` with `text_col` (main text) and n_chars (its code points) in place of the HTML; same-named columns are replaced.

    Every page is parsed whole and by itself: a cut over its blocks, with edges between page neighbours and between successive
    blocks of one parent. Null, empty and text-less pages give an empty text; repeated rows give repeated rows; a very long page is
    one task's work, in time that grows with its length (100,000 blocks take a few seconds).
    """
    extracted = F.arrow_udf(_texts, "string")(F.col(html_col))
    kept = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]
    return pages.withColumn("_text", extracted).select(*kept, F.col("_text").alias(text_col), F.length("_text").cast("long").alias("n_chars"))
