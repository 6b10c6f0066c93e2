"""Main text of web pages by a tree-structured graphical model.

A page is parsed into a tree of elements. Each element has a hidden label,
content or not; potentials of an element rest on its tag, its class and id
names, its own text, links and depth; potentials of a parent and child rest on
the child's kind. Messages go up from the leaves and down from the root (sum
and product), which gives each element its exact marginal. Blocks whose marginal
is a half or more are the main text. Weights are those of greatest likelihood
on labelled pages, by gradient ascent with the same messages; labelled pages
come from a seeded writer of page layouts in this folder.

Text that stands directly in the body (or outside it, as in html without any
tag) is cut at block elements, and each stretch is a node of its own, with a
marginal of its own. What stands in hidden elements (buttons, selects, objects
and the like) is parsed, so that one that is never closed ends with its parent,
but is neither main text nor evidence.

Defined results: a null or empty html has the empty text; broken markup and
pages cut off anywhere are read as far as they go. Rows that repeat each keep a
row; the url is passed on as it is. Only the columns asked for are read, so
further columns of any name do no harm; an empty table has no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .htmlpages import labelled_pages

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "iframe")
HIDDEN = ("head", "noscript", "template", "svg", "math", "select", "button", "object", "canvas", "audio", "video")
#: Hidden elements that hold no blocks: the start of one ends them.
_SHUT = ("select", "button")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
KINDS = ("html", "body", "main", "article", "section", "div", "p", "h", "ul", "li", "blockquote", "pre", "table", "cell", "figure", "header", "footer", "nav", "aside", "form", "hidden", "other")
_KIND = {
    **{k: k for k in ("html", "body", "main", "article", "section", "div", "p", "blockquote", "pre", "table", "figure", "header", "footer", "nav", "aside", "form")},
    **{f"h{n}": "h" for n in range(1, 7)}, "ul": "ul", "ol": "ul", "dl": "ul", "menu": "nav", "li": "li", "dt": "li", "dd": "li",
    "tr": "table", "tbody": "table", "thead": "table", "tfoot": "table", "td": "cell", "th": "cell", "caption": "cell", "figcaption": "figure",
    "fieldset": "form", "dialog": "aside", "details": "section", "summary": "p", **dict.fromkeys((*RAW, *HIDDEN), "hidden"),
}
#: Kinds of names in class, id and role.
NAMES = (
    ("content", r"content|article|entry|post(?!-?(nav|meta|footer))|story|prose|body|main|text"),
    ("menu", r"nav|menu|breadcrumb|tabs|toc|pagination|pager"),
    ("head", r"header|masthead|banner|topbar|logo|branding"),
    ("foot", r"foot|copyright|legal|colophon"),
    ("side", r"side|aside|widget|related|recommend|popular|trending|rail|promo"),
    ("advert", r"\bads?\b|advert|sponsor|\bad[-_]|[-_]ads?\b|banner-?ad|dfp|outbrain|taboola"),
    ("notice", r"cookie|consent|gdpr|notice|alert|modal|popup|overlay|newsletter|subscribe|signup|paywall"),
    ("comment", r"comment|disqus|reply|replies|respond|discussion|feedback"),
    ("share", r"share|social|follow|tweet|byline|meta|tags|author"),
    ("form", r"form|search|login|input"),
)
_NAMES = [(n, re.compile(p)) for n, p in NAMES]
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDE = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: An opening element ends these, if one is open above its container.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


class Page:
    """The tree of one page. Elements are listed before their children; element 0 is the page itself."""

    def __init__(self, source: str):
        self.parent, self.tag, self.attrs = [-1], ["html"], [""]
        self.blocks: list[tuple[int, str]] = []  # (element, raw text) in page order
        self.text, self.link, self.children, self.depth, self.hidden = [0], [0], [0], [0], [False]
        stack, names, inside, owner = [0], ["html"], 0, 0  # open elements' nodes and names
        buffer: list[str] = []
        held = linked = 0  # code points in the buffer, and those of them in links
        pos, end = 0, len(source)

        def node_of(name: str, attrs: str) -> int:
            if self.hidden[stack[-1]]:
                return stack[-1]  # what stands in a hidden element is part of it
            self.parent.append(stack[-1])
            self.children[stack[-1]] += 1
            self.depth.append(self.depth[stack[-1]] + 1)
            self.tag.append(name)
            self.attrs.append(attrs)
            self.hidden.append(name in RAW or name in HIDDEN)
            self.text.append(0)
            self.link.append(0)
            self.children.append(0)
            return len(self.tag) - 1

        def flush() -> None:
            nonlocal held, linked
            if not buffer:
                return
            raw = "".join(buffer)
            if not self.hidden[owner]:
                told = bool(raw) and not raw.isspace()
                at = node_of("p", "") if told and self.tag[owner] in ("html", "body") else owner
                self.text[at] += held
                self.link[at] += linked
                if told:
                    self.blocks.append((at, raw))
            buffer.clear()
            held = linked = 0

        def add(at: int, to: int) -> None:
            nonlocal owner, held, linked
            if at < to:
                if not buffer:
                    owner = stack[-1]
                buffer.append(source[at:to])
                held += to - at
                if inside:
                    linked += to - at

        while pos < end:
            m = _TAG.search(source, pos)
            if not m:
                add(pos, end)
                break
            add(pos, m.start())
            pos = max(m.end(), pos + 1)
            if m[2] is None:
                continue
            name, closing = m[2].lower(), m[1]
            if name == "a":
                inside = 0 if closing else 1
                continue
            if name == "br" or name == "hr":
                if buffer:
                    buffer.append(" ")
                if name == "hr":
                    flush()
                continue
            if name in INLINE or name in VOID:
                continue
            flush()
            if closing:
                for depth in range(len(stack) - 1, 0, -1):
                    if names[depth] == name:
                        del stack[depth:], names[depth:]
                        inside = 0
                        break
                continue
            if name in ("html", "body") and name in self.tag:
                if name == "html":
                    self.attrs[0] = m[3]
                continue
            if name in _ENDS_P:
                if names[-1] == "p":
                    stack.pop()
                    names.pop()
                for depth in range(len(stack) - 1, 0, -1):
                    if names[depth] in _SHUT:
                        del stack[depth:], names[depth:]
                        break
            for other in _CLOSES.get(name, ()):
                if names[-1] == other:
                    stack.pop()
                    names.pop()
            if name == "body" or name == "head":
                del stack[1:], names[1:]
            elif names[-1] == "head" and name not in (*RAW, *HIDDEN):  # the head ends where content starts
                stack.pop()
                names.pop()
            node = node_of(name, m[3])
            if name in RAW:
                if not m[3].rstrip().endswith("/"):
                    # What stands in these is not markup, and is not read.
                    stop = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(source, pos)
                    pos = stop.end() if stop else end
                continue
            if not m[3].rstrip().endswith("/"):
                stack.append(node)
                names.append(name)
        flush()


N_UNARY = len(KINDS) + len(NAMES) + 12
_place: dict[tuple[str, str], int] = {}
_rows: list[np.ndarray] = []


def _named(tag: str, attrs: str) -> int:
    """The place in _rows of the features that rest on tag and names only."""
    place = _place.get((tag, attrs))
    if place is None:
        got = np.zeros(N_UNARY)
        got[KINDS.index(_KIND.get(tag, "other"))] = 1
        words = " ".join(x.strip("\"'") for x in _ATTR.findall(attrs)).lower()
        for n, (_, pattern) in enumerate(_NAMES):
            got[len(KINDS) + n] = bool(words) and bool(pattern.search(words))
        at = len(KINDS) + len(NAMES)
        got[at] = 1
        got[at + 1] = bool(_HIDE.search(attrs))
        place = _place[tag, attrs] = len(_rows)
        _rows.append(got)
    return place


class Forest:
    """Many pages' trees in arrays, by depth."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.tag) for p in pages])
        self.start = np.r_[0, np.cumsum(sizes)]
        n = int(self.start[-1])
        self.parent = np.concatenate([np.array(p.parent) + s for p, s in zip(pages, self.start, strict=False)]) if pages else np.zeros(0, np.int64)
        root = np.zeros(n, bool)
        root[self.start[:-1]] = True
        self.parent[root] = -1
        depth_of = np.concatenate([np.array(p.depth) for p in pages]) if pages else np.zeros(0, np.int64)
        self.levels = [np.flatnonzero(depth_of == d) for d in range(int(depth_of.max()) + 1)] if n else []
        if len(_rows) + n > 100_000:
            _place.clear()
            _rows.clear()
        places = np.array([_named(t, a) for p in pages for t, a in zip(p.tag, p.attrs, strict=True)], np.int64)
        used, places = np.unique(places, return_inverse=True)
        f = np.array([_rows[k] for k in used]).reshape(-1, N_UNARY)[places]
        self.kind = f[:, : len(KINDS)].argmax(axis=1)
        text = np.array([x for p in pages for x in p.text], float)
        link = np.array([x for p in pages for x in p.link], float)
        children = np.array([x for p in pages for x in p.children], float)
        at = len(KINDS) + len(NAMES)
        f[:, at + 2] = text > 0
        f[:, at + 3] = text >= 40
        f[:, at + 4] = text >= 120
        f[:, at + 5] = np.log1p(text) / 8
        share = link / np.maximum(text, 1)
        f[:, at + 6] = share
        f[:, at + 7] = share > 0.5
        f[:, at + 8] = np.minimum(depth_of, 8) / 8
        f[:, at + 9] = np.log1p(children) / 4
        f[:, at + 10] = (children == 0) & (text == 0)
        plain = text - link
        f[:, at + 11] = plain / np.maximum(np.add.reduceat(plain, self.start[:-1]), 1).repeat(sizes) if n else 0
        self.features = f

    def marginals(self, w: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(content) of each element, joint P(parent, child) of each element and its parent: 2 x 2).

        w: weights of label 1 against 0; pair: kind x parent label x child label.
        """
        n = len(self.parent)
        unary = np.zeros((n, 2))
        unary[:, 1] = self.features @ w
        edge = pair[self.kind]
        up = unary.copy()  # own potential and the messages of the children
        message = np.zeros((n, 2))
        for level in reversed(self.levels[1:]):
            x = edge[level] + up[level][:, None, :]
            message[level] = np.logaddexp(x[:, :, 0], x[:, :, 1])
            np.add.at(up, self.parent[level], message[level])
        total = up.copy()  # and the message of the parent
        joint = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            above = total[self.parent[level]] - message[level]
            x = above[:, :, None] + edge[level]
            total[level] = up[level] + np.logaddexp(x[:, 0], x[:, 1])
            j = x + up[level][:, None, :]
            j -= j.max(axis=(1, 2), keepdims=True)
            j = np.exp(j)
            joint[level] = j / j.sum(axis=(1, 2), keepdims=True)
        return 1 / (1 + np.exp(-np.clip(total[:, 1] - total[:, 0], -50, 50))), joint


def train(pages: list[tuple[str, list[bool]]], rounds: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(w, pair) of greatest likelihood; pages: (html, label of each element in the order of Page)."""
    parsed = [Page(source) for source, _ in pages]
    forest = Forest(parsed)
    y = np.concatenate([np.array(labels, float) for _, labels in pages])
    inner = forest.parent >= 0
    seen = np.zeros((len(KINDS), 2, 2))
    np.add.at(seen, (forest.kind[inner], y[forest.parent[inner]].astype(int), y[inner].astype(int)), 1)
    w, pair = np.zeros(N_UNARY), np.zeros((len(KINDS), 2, 2))
    state = [np.zeros_like(w), np.zeros_like(pair)]
    n = len(y)
    for _ in range(rounds):
        p, joint = forest.marginals(w, pair)
        expected = np.zeros_like(seen)
        np.add.at(expected, forest.kind[inner], joint[inner])
        for k, (x, g) in enumerate(((w, forest.features.T @ (y - p) / n - ridge * w), (pair, (seen - expected) / n - ridge * pair))):
            state[k] += g * g
            x += 0.3 * g / (np.sqrt(state[k]) + 1e-8)
    return w, pair


_model: list[tuple[np.ndarray, np.ndarray]] = []


def model() -> tuple[np.ndarray, np.ndarray]:
    if not _model:
        _model.append(train(labelled_pages(Page)))
    return _model[0]


def main_texts(sources: list[str], w: np.ndarray, pair: np.ndarray) -> list[str]:
    """The main text of each page."""
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    forest = Forest(pages)
    p, _ = forest.marginals(w, pair)
    out = []
    for page, start in zip(pages, forest.start, strict=False):
        kept = []
        for node, raw in page.blocks:
            if p[start + node] >= 0.5 and not page.hidden[node]:
                block = " ".join(entities.unescape(raw).split())
                if block:
                    kept.append(block)
        out.append(" ".join(kept))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text): the main text of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, pair = sent.value
        for batch in slices(batches, 2):
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(main_texts(some.column(2).to_pylist(), w, pair), pa.string())], ["id", "url", "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    got = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit(""))).mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string")
    return got.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
