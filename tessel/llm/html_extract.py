"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a node that either holds main text or doesn't. Its own
potential comes from tag, class and id names (its own and its parent's), text
amount, sentence ends and link share; a parent-child potential ties neighbours. Messages go up the tree
and down again (sum-product), which gives the exact marginal of every node; text
whose node is more likely main text than not is kept. Weights are trained from
labelled pages by gradient steps on their exact conditional likelihood.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .html_pages import labelled_pages

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTE_OR_END = re.compile(r"[>\"']")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_MARK = re.compile(r'data-main="([01])"')
_WORD = re.compile(r"[a-z]+")
#: Fixed values of the HTML standard: elements without content, with raw text, inline ones, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_STOPS = re.compile(r"[.!?…]")
NUMERIC = 7


@dataclass
class Page:
    """Nodes in document order (parent, depth, names, numbers) and the runs of text by block."""

    parents: list[int]
    depths: list[int]
    names: list[tuple[str, ...]]
    marks: list[int]
    blocks: list[list[tuple[int, str]]]
    chars: list[int]
    linked: list[int]
    stops: list[int]


class Markup:
    """The next comment, declaration or tag of a page, in time linear in the page.

    A tag ends at the first > outside quotes. Once a quote is found that stays
    open up to the page's end, this and all later tags end at their first >.
    """

    def __init__(self, source: str) -> None:
        self.source, self.quotes = source, True

    def next(self, at: int) -> tuple[int, int, re.Match | None] | None:
        """(start, end, name), with no name for what isn't a tag; None if there is nothing more."""
        source = self.source
        while (start := source.find("<", at)) >= 0:
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                return start, len(source) if end < 0 else end + 3, None
            first = source.find(">", start)
            if first < 0:  # no tag ends any more; a comment runs to the end
                start = source.find("<!--", start)
                return None if start < 0 else (start, len(source), None)
            if source[start + 1] in "!?":
                return start, first + 1, None
            name = _NAME.match(source, start + 1)
            if name is not None:
                return start, self.tag_end(name.end(), first) + 1, name
            at = start + 1
        return None

    def tag_end(self, at: int, first: int) -> int:
        source = self.source
        while self.quotes:
            found = _QUOTE_OR_END.search(source, at)
            if found is None:
                self.quotes = False
                break
            if found[0] == ">":
                return found.start()
            at = source.find(found[0], found.end()) + 1
            if not at:
                self.quotes = False
        return first


class Open:
    """The open elements that are nodes, with the places of each tag and of block elements."""

    def __init__(self) -> None:
        self.tags, self.nodes = ["#root"], [0]
        self.at: dict[str, list[int]] = {}
        self.blocks = [0]

    def push(self, tag: str, node: int) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        if tag not in INLINE:
            self.blocks.append(len(self.tags))
        self.tags.append(tag)
        self.nodes.append(node)

    def cut(self, size: int) -> None:
        """Close all elements from that place on."""
        while len(self.tags) > size:
            self.at[self.tags.pop()].pop()
            self.nodes.pop()
        while self.blocks[-1] >= size:
            self.blocks.pop()

    def close(self, tag: str) -> None:
        """An end tag: of an inline element only up to the nearest block."""
        places = self.at.get(tag)
        if places and (tag not in INLINE or places[-1] > self.blocks[-1]):
            self.cut(places[-1])

    def make_room(self, tag: str) -> None:
        """What the opening tag of a block element closes."""
        for k in reversed(self.blocks):
            closed_by = CLOSED_BY.get(self.tags[k])
            if not closed_by:
                return
            if tag in closed_by:
                self.cut(k)
                return


def parse(source: str) -> Page:
    """A forgiving parse: unknown end tags are ignored, missing ones implied, what is open at the end is closed."""
    page = Page([-1], [0], [("#root",)], [0], [], [0], [0], [0])
    opened, markup = Open(), Markup(source)
    links = 0
    block: list[tuple[int, str]] = []
    at, end = 0, len(source)

    def text(raw: str) -> None:
        if "&" in raw:
            raw = html.unescape(raw)
        node = opened.nodes[-1]
        block.append((node, raw))
        if raw and not raw.isspace():
            n = len(raw)
            page.chars[node] += n
            page.stops[node] += len(_STOPS.findall(raw))
            if links:
                page.linked[node] += n

    def close_block() -> None:
        nonlocal block
        if block:
            page.blocks.append(block)
            block = []

    while at < end:
        found = markup.next(at)
        if found is None:
            text(source[at:])
            break
        start, stop, name = found
        if start > at:
            text(source[at:start])
        at = stop
        if name is None:
            continue
        tag, attrs = name[2].lower(), source[name.end() : stop - 1]
        if name[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag not in INLINE:
                close_block()
            opened.close(tag)
            continue
        if tag in RAW:
            ending = _RAW_END[tag].search(source, at)
            at = ending.end() if ending else end
            continue
        if tag not in INLINE:
            close_block()
            links = 0
            opened.make_room(tag)
        elif tag == "br":
            block.append((opened.nodes[-1], " "))
        if tag == "a":
            links += 1
        if tag in VOID:
            continue
        named = _NAMES.findall(attrs) if attrs and ("class" in attrs or "id" in attrs or "role" in attrs or "CLASS" in attrs) else ()
        if tag in INLINE and not named:
            continue
        parent = opened.nodes[-1]
        mark = _MARK.search(attrs) if "data-main" in attrs else None
        page.parents.append(parent)
        page.depths.append(page.depths[parent] + 1)
        page.names.append((tag, *sorted({w for group in named for part in group for w in _WORD.findall(part.lower())})))
        page.marks.append(int(mark[1]) if mark else page.marks[parent])
        page.chars.append(0)
        page.linked.append(0)
        page.stops.append(0)
        opened.push(tag, len(page.parents) - 1)
    close_block()
    return page


def numbers(chars: np.ndarray, linked: np.ndarray, stops: np.ndarray, below: np.ndarray, below_linked: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """[nodes, NUMERIC]: amounts of own text and of all text below, sentence ends, link shares, depth."""
    own, share = np.log1p(chars) / 6, linked / np.maximum(1, chars)
    return np.stack([own, np.minimum(2.0, 20 * stops / np.maximum(20, chars)), share, np.log1p(below) / 8, below_linked / np.maximum(1, below), np.minimum(depth, 20) / 10, (chars == 0).astype(float)], axis=1)


@dataclass
class Forest:
    """Pages laid out node after node, with parents shifted to match and nodes listed by depth."""

    parent: np.ndarray
    values: np.ndarray
    names: list[tuple[str, ...]]
    levels: list[np.ndarray]

    @staticmethod
    def of(pages: Iterable[Page]) -> Forest:
        pages, parent, at = list(pages), [], 0
        for page in pages:
            parent.extend(p + at if p >= 0 else -1 for p in page.parents)
            at += len(page.parents)
        flat = lambda name: np.array([x for page in pages for x in getattr(page, name)])
        parents, depth = np.array(parent), flat("depths")
        levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])
        chars, linked, stops = (flat(n).astype(float) for n in ("chars", "linked", "stops"))
        below, below_linked = chars.copy(), linked.copy()
        for level in levels[:0:-1]:
            np.add.at(below, parents[level], below[level])
            np.add.at(below_linked, parents[level], below_linked[level])
        return Forest(parents, numbers(chars, linked, stops, below, below_linked, depth), [n for page in pages for n in page.names], levels)


def sum_product(forest: Forest, own: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every node, and the pairwise table [nodes, 2, 2] of (parent, node).

    own: log odds of each node by itself; tie[a, b]: score of parent a with child b.
    """
    up, belief = np.zeros(len(own)), own.copy()
    for level in forest.levels[:0:-1]:
        b = belief[level]
        up[level] = np.logaddexp(tie[1, 0], tie[1, 1] + b) - np.logaddexp(tie[0, 0], tie[0, 1] + b)
        np.add.at(belief, forest.parent[level], up[level])
    total, pairs = belief.copy(), np.zeros((len(own), 2, 2))
    for level in forest.levels[1:]:
        rest = total[forest.parent[level]] - up[level]
        down = np.logaddexp(tie[0, 1], tie[1, 1] + rest) - np.logaddexp(tie[0, 0], tie[1, 0] + rest)
        total[level] = belief[level] + down
        joint = tie[None] + rest[:, None, None] * np.array([0, 1])[None, :, None] + belief[level][:, None, None] * np.array([0, 1])[None, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        pairs[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
    return 1 / (1 + np.exp(-np.clip(total, -50, 50))), pairs


@dataclass
class Model:
    names: dict[str, float]
    values: np.ndarray
    bias: float
    tie: np.ndarray

    def own(self, forest: Forest) -> np.ndarray:
        score = self.names.get
        known: dict[tuple[str, ...], tuple[float, float]] = {}  # by names: what they say of the node and of its children
        for n in set(forest.names):
            words = ("<" + n[0], *n[1:])
            known[n] = sum(score(w, 0.0) for w in words), sum(score("^" + w, 0.0) for w in words)
        both = np.array([known[n] for n in forest.names])
        above = np.where(forest.parent >= 0, both[forest.parent, 1], 0.0)
        return forest.values @ self.values + self.bias + both[:, 0] + above


def fit(sources: list[str], rounds: int = 250, rate: float = 0.2, penalty: float = 5e-4) -> Model:
    """Gradient steps (Adam) on the exact conditional likelihood of the labelled pages."""
    pages = [parse(s) for s in sources]
    forest, label = Forest.of(pages), np.array([m for p in pages for m in p.marks], float)
    words = [("<" + n[0], *n[1:]) for n in forest.names]
    found = [(i, w) for i, own in enumerate(words) for w in own]
    found += [(i, "^" + w) for i, p in enumerate(forest.parent) if p >= 0 for w in words[p]]
    vocabulary = sorted({w for _, w in found})
    place = {w: k for k, w in enumerate(vocabulary)}
    row, column = np.array([i for i, _ in found]), np.array([place[w] for _, w in found])
    dense = np.hstack([forest.values, np.ones((len(label), 1))])
    k = len(vocabulary)
    inner = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[forest.parent[inner]].astype(int), label[inner].astype(int)), 1)
    w, tie = np.zeros(k + dense.shape[1]), np.zeros((2, 2))
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in (w, tie)]
    for step in range(1, rounds + 1):
        own = np.bincount(row, w[column], len(label)) + dense @ w[k:]
        p, pairs = sum_product(forest, own, tie)
        error = label - p
        slope = np.concatenate([np.bincount(column, error[row], k), dense.T @ error])
        gradients = (slope / len(label) - penalty * w / 10, (seen - pairs[inner].sum(axis=0)) / len(label) - penalty * tie)
        for value, gradient, (m, v) in zip((w, tie), gradients, state):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient**2 - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(dict(zip(vocabulary, w.tolist())), w[k:-1], float(w[-1]), tie)


@functools.cache
def default_model() -> Model:
    return fit(labelled_pages())


def main_texts(sources: list[str], model: Model) -> list[str]:
    """The main text of each page: blocks in page order, joined by line feeds."""
    pages = [parse(s) for s in sources]
    if not pages:
        return []
    forest = Forest.of(pages)
    keep = sum_product(forest, model.own(forest), model.tie)[0] > 0.5
    out, at = [], 0
    for page in pages:
        own = keep[at : at + len(page.parents)].tolist()
        lines = (" ".join("".join(raw for node, raw in block if own[node]).split()) for block in page.blocks)
        out.append("\n".join(line for line in lines if line))
        at += len(page.parents)
    return out


def _extract(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = main_texts(part.column("_html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*part.drop_columns(["_html"]).columns, pa.array(texts, pa.string())], names=[*(c for c in part.schema.names if c != "_html"), "_main"])

    return run


def extracted(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: list[str] | None = None) -> DataFrame:
    """One row per page: the id, url, text (main text) and n_chars (its code points).

    labelled: pages marked with data-main to train on; by default the pages that
    html_pages makes.

    Defined cases: a null or empty html, and one without main text, gives the
    empty text; null ids and urls are kept; repeated rows are extracted once
    each; an empty table gives an empty result; other columns are ignored.
    """
    model = default_model() if labelled is None else fit(labelled)
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url"), text_of(F.col(f"`{html_col}`")).alias("_html"))
    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(_extract(model), f"_id {kinds['_id']}, _url {kinds['_url']}, _main string")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.col("_main").alias("text"), F.char_length("_main").cast("long").alias("n_chars"))
