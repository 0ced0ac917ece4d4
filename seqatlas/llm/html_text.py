"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is read into a tree of elements. Trees boosted on the logistic loss score every element
from subtree density, attribute words, depth and sibling statistics. Decoding is hierarchical:
the set of kept elements with the largest total score in which a kept element has only kept
ancestors, so an element and its ancestor never contradict each other.

The trees are fitted on a bounded sample of the pages. Their labels come from what pages say of
themselves (article and main elements against navigation, headers, footers, asides, forms and
the like). Each sampled page is also used with its telling element names replaced by plain
``div`` and classes, and with comments, notices and adverts planted, so that the trees learn
from attributes and densities as well.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seqatlas.llm.common import Sent, bounded_batches

# HTML element names and their roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title meta link svg canvas object".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "summary", "figcaption"}
SAME_LEVEL = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table select article section div body html nav aside main footer header form".split())
# Words in class, id and role attributes.
GOOD = "article content main body post entry story text blog page".split()
BAD = (
    "nav menu header head footer foot sidebar side aside ad ads advert advertisement banner promo sponsor comment comments reply respond "
    "form login search share social related widget cookie notice consent popup modal breadcrumb breadcrumbs pagination pager meta tags newsletter "
    "subscribe copyright legal skip toolbar disclaimer alert".split()
)
TAGS = "html body article main section div p h1 ul ol li a nav header footer aside form table blockquote pre figure span b dialog".split()

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^>\"'])*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|[^<]+|<",
    re.S,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    words: list[str]
    children: list = field(default_factory=list)  # node numbers, and texts as str


def parse(source: str | None) -> list[Node]:
    """The elements of a page in document order; node 0 is the root. Unclosed elements end with their parents."""
    nodes, open_nodes = [Node("#root", -1, 0, [])], [0]
    text = source or ""
    at, size = 0, len(text)
    while at < size:
        m = _TOKEN.match(text, at)
        token, at = m[0], m.end()
        if token[0] != "<" or len(token) == 1:
            nodes[open_nodes[-1]].children.append(html.unescape(token))
            continue
        name = _NAME.match(token)
        if name is None:
            continue
        tag = name[1].lower()
        if token[1] == "/":
            for i in range(len(open_nodes) - 1, 0, -1):
                if nodes[open_nodes[i]].tag == tag:
                    del open_nodes[i:]
                    break
                # An inline end tag doesn't close blocks.
                if tag not in BLOCK and nodes[open_nodes[i]].tag in BLOCK:
                    break
            continue
        if tag in CLOSES_P:
            _close(nodes, open_nodes, {"p"})
        if tag in SAME_LEVEL:
            _close(nodes, open_nodes, SAME_LEVEL[tag])
        words = []
        if "=" in token:
            for _, a, b, c in _ATTRIBUTE.findall(token):
                words += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower())
        parent = open_nodes[-1]
        number = len(nodes)
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, words))
        nodes[parent].children.append(number)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(text, at)
            at = end.end() if end else size
        elif tag not in VOID and not token.endswith("/>"):
            open_nodes.append(number)
    return nodes


def _close(nodes: list[Node], open_nodes: list[int], tags: set[str]) -> None:
    for i in range(len(open_nodes) - 1, 0, -1):
        tag = nodes[open_nodes[i]].tag
        if tag in tags:
            del open_nodes[i:]
            return
        if tag in SCOPE:
            return


_GOOD, _BAD = frozenset(GOOD), frozenset(BAD)
_TAG_NUMBER = {t: i for i, t in enumerate(TAGS)}
_TAG_NUMBER |= {f"h{i}": _TAG_NUMBER["h1"] for i in range(2, 7)}
FEATURES = 20


def node_features(nodes: list[Node]) -> np.ndarray:
    """One row per node: sizes and densities of the subtree, attribute words, depth and siblings."""
    n = len(nodes)
    text, link, tags, paragraphs, items = (np.zeros(n) for _ in range(5))
    good, bad = np.zeros(n), np.zeros(n)
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        if node.tag in UNSEEN:
            continue
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        text[i] += own
        if node.tag == "a":
            link[i] = text[i]
        good[i] = sum(w in _GOOD for w in node.words)
        bad[i] = sum(w in _BAD for w in node.words)
        up = node.parent
        if up >= 0:
            text[up] += text[i]
            link[up] += link[i]
            tags[up] += tags[i] + 1
            paragraphs[up] += paragraphs[i] + (node.tag == "p")
            items[up] += items[i] + (node.tag in ("li", "a"))
    total = max(text[0], 1)
    out = np.zeros((n, FEATURES), np.float32)
    up_good, up_bad, up_link = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, node in enumerate(nodes):
        up = node.parent
        position, siblings, before, same = 0, 1, 0.0, 1
        if up >= 0:
            up_good[i], up_bad[i] = up_good[up] + good[up], up_bad[up] + bad[up]
            up_link[i] = link[up] / max(text[up], 1)
        kids = [c for c in node.children if not isinstance(c, str)]
        largest = max((text[c] for c in kids), default=0)
        out[i, :17] = (
            np.log1p(text[i]), text[i] / total, link[i] / max(text[i], 1), tags[i] / max(text[i], 1) * 100, paragraphs[i], items[i],
            node.depth, len(kids), largest / max(text[i], 1), good[i], bad[i], up_good[i], up_bad[i], up_link[i],
            _TAG_NUMBER.get(node.tag, -1), _TAG_NUMBER.get(nodes[up].tag, -1) if up >= 0 else -1, node.tag in BLOCK,
        )
        sizes, seen = max(len(kids), 1), 0.0
        for place, c in enumerate(kids):
            out[c, 17], out[c, 18] = place / sizes, seen / max(text[i], 1)
            out[c, 19] = text[c] / max(text[i], 1)
            seen += text[c]
    return out


# Elements that hold, and that never hold, main text.
_MAIN = frozenset(["article", "main"])
_APART = frozenset("nav header footer aside form menu dialog button select".split()) | UNSEEN


def told_labels(nodes: list[Node]) -> np.ndarray | None:
    """1 for elements with main text or inside it, 0 for others, by the page's own elements; None if it tells nothing."""
    inside = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        up = node.parent >= 0 and inside[node.parent]
        apart = node.tag in _APART or any(w in _BAD for w in node.words)
        inside[i] = (up or (node.tag in _MAIN and not _under(nodes, i))) and not apart
    if not inside.any():
        return None
    holds = inside.copy()
    for i in range(len(nodes) - 1, 0, -1):
        holds[nodes[i].parent] |= holds[i]
    return holds


# Of a block that counts as running text when nothing tells: characters of its own, and the most of them in links.
LEAST_TEXT, MOST_LINKED = 60, 0.3


def weak_labels(nodes: list[Node]) -> np.ndarray | None:
    """Labels by text and link density, for tables in which no page tells any; None for a page without text.

    Blocks of running text that neither they nor an element around them sets apart, headings beside them,
    and all elements that hold these. A page of short texts only has its longest one.
    """
    n = len(nodes)
    apart = np.zeros(n, bool)
    text, link = np.zeros(n), np.zeros(n)
    for i, node in enumerate(nodes):
        apart[i] = (node.parent >= 0 and apart[node.parent]) or node.tag in _APART or any(w in _BAD for w in node.words)
    # Text of a block itself: what stands in its inline elements counts, what stands in blocks inside it doesn't.
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        text[i] += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            link[i] = text[i]
        if node.parent >= 0 and node.tag not in BLOCK:
            text[node.parent] += text[i]
            link[node.parent] += link[i]
    block = np.array([m.tag in BLOCK or i == 0 for i, m in enumerate(nodes)]) & ~apart
    running = block & (text >= LEAST_TEXT) & (link <= MOST_LINKED * text)
    if not running.any():
        if not (block & (text > 0)).any():
            return None
        running[np.where(block, text, -1).argmax()] = True
    holds = running.copy()
    for i in range(n - 1, 0, -1):
        holds[nodes[i].parent] |= holds[i]
    for i, node in enumerate(nodes):
        heading = len(node.tag) == 2 and node.tag[0] == "h" and node.tag[1].isdigit()
        inline = node.parent >= 0 and holds[node.parent] and node.tag not in BLOCK and not apart[i] and running[node.parent]
        if node.parent >= 0 and (inline or (heading and holds[node.parent] and not apart[i] and text[i] > 0)):
            holds[i] = running[i] = True
    return holds


def _under(nodes: list[Node], i: int) -> bool:
    i = nodes[i].parent
    while i > 0:
        if nodes[i].tag in _APART or any(w in _BAD for w in nodes[i].words):
            return True
        i = nodes[i].parent
    return False


def disguised(nodes: list[Node], labels: np.ndarray, rng: random.Random) -> tuple[list[Node], np.ndarray]:
    """A copy whose telling elements are plain ones with classes, with comments and notices planted."""
    copy, labels = [Node(n.tag, n.parent, n.depth, list(n.words), list(n.children)) for n in nodes], labels.tolist()
    rename = rng.random() < 0.7
    texts = [c for n in nodes for c in n.children if isinstance(c, str) and len(c) > 20] or ["text"]

    def plant(parent: int, tag: str, words: list[str], at: int) -> None:
        number = len(copy)
        copy.append(Node(tag, parent, copy[parent].depth + 1, words, []))
        labels.append(False)
        copy[parent].children.insert(at, number)
        for _ in range(rng.randint(1, 4)):
            inner = len(copy)
            copy.append(Node(rng.choice(["p", "div", "li"]), number, copy[number].depth + 1, [], [rng.choice(texts)[: rng.randint(10, 400)]]))
            labels.append(False)
            copy[number].children.append(inner)

    for i in range(len(nodes)):
        node = copy[i]
        if rename and node.tag in ("article", "main"):
            node.tag, node.words = rng.choice(["div", "section"]), [rng.choice(GOOD)] if rng.random() < 0.8 else []
        elif rename and node.tag in ("nav", "header", "footer", "aside"):
            node.words, node.tag = [rng.choice(BAD)] if node.tag == "aside" else [{"nav": "menu"}.get(node.tag, node.tag)], "div"
        elif rename and labels[i] and node.tag == "p" and rng.random() < 0.1:
            node.tag = rng.choice(["blockquote", "pre", "li", "div", "table"])
    containers = [i for i in range(len(nodes)) if labels[i] and nodes[i].tag in ("article", "main", "body")]
    for i in containers:
        for _ in range(rng.randint(0, 2)):
            tag = rng.choice(["div", "section", "aside", "form"])
            plant(i, tag, [] if tag in ("aside", "form") and rng.random() < 0.5 else [rng.choice(BAD)], rng.randint(0, len(copy[i].children)))
    # Document order: the features expect a parent before its children.
    order, stack = [], [0]
    while stack:
        i = stack.pop()
        order.append(i)
        stack += [c for c in reversed(copy[i].children) if not isinstance(c, str)]
    new = {old: k for k, old in enumerate(order)}
    out = []
    for old in order:
        n = copy[old]
        out.append(Node(n.tag, new.get(n.parent, -1), n.depth, n.words, [c if isinstance(c, str) else new[c] for c in n.children]))
    return out, np.array([labels[i] for i in order])


class BoostedTrees:
    """Binary trees on binned features, boosted on the logistic loss."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.edges: list[np.ndarray] = []
        self.splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, width = self._binned(x), self.bins
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, width)
            leaf = np.zeros(len(y), int)
            for level in range(self.depth):
                n, offset = 2**level, 2**level - 1
                best, choice = np.zeros(n), [(0, width)] * n
                total_g, total_h = np.bincount(leaf, g, n), np.bincount(leaf, h, n)
                for j in range(x.shape[1]):
                    at = leaf * width + b[:, j]
                    left_g = np.bincount(at, g, n * width).reshape(n, width).cumsum(1)
                    left_h = np.bincount(at, h, n * width).reshape(n, width).cumsum(1)
                    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - (total_g**2 / (total_h + 1))[:, None]
                    gain[(left_h < 1) | (right_h < 1)] = 0
                    k = gain.argmax(1)
                    value = gain[np.arange(n), k]
                    for i in np.flatnonzero(value > best + 1e-9):
                        best[i], choice[i] = value[i], (j, int(k[i]))
                feature[offset : offset + n], cut[offset : offset + n] = zip(*choice)
                node = offset + leaf
                leaf = 2 * leaf + (b[np.arange(len(y)), feature[node]] > cut[node])
            n = 2**self.depth
            value = -self.rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + 1)
            score += value[leaf]
            self.splits.append((feature, cut, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        out = np.full(len(x), self.base)
        if not self.edges or not len(x):
            return out
        b, rows = self._binned(x), np.arange(len(x))
        for feature, cut, value in self.splits:
            leaf = np.zeros(len(x), int)
            for level in range(self.depth):
                node = 2**level - 1 + leaf
                leaf = 2 * leaf + (b[rows, feature[node]] > cut[node])
            out += value[leaf]
        return out


def kept_elements(nodes: list[Node], score: np.ndarray) -> np.ndarray:
    """The set of elements, closed under taking the parent, with the largest total score; never unseen ones."""
    n = len(nodes)
    worth = score.copy()
    for i in range(n - 1, 0, -1):
        if nodes[i].tag not in UNSEEN:
            worth[nodes[i].parent] += max(worth[i], 0)
    keep = np.zeros(n, bool)
    keep[0] = True
    for i in range(1, n):
        keep[i] = keep[nodes[i].parent] and worth[i] > 0 and nodes[i].tag not in UNSEEN
    return keep


def main_text(nodes: list[Node], keep: np.ndarray) -> str:
    """The kept text: white space runs as one space, blocks joined by line ends, empty blocks left out."""
    blocks: list[list[str]] = [[]]
    # An explicit stack: pages may nest deeper than Python calls can.
    stack: list = [0]
    while stack:
        x = stack.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        else:
            node = nodes[x]
            edge = [None] if node.tag in BLOCK else []
            if not keep[x]:
                stack += edge
            elif node.tag == "br":
                blocks[-1].append(" ")
            else:
                stack += edge
                stack += reversed(node.children)
                stack += edge
    joined = (_SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n".join(b for b in joined if b)


def training_pages(pages: DataFrame, most_pages: int = 300, labels=told_labels) -> list[str]:
    """The ``most_pages`` first different pages that have ``labels``, in the order of a hash of their html.

    Pages are parsed where they are, in growing ranges of the hash, until enough tell labels or
    all are read. Copies are told by their hash.
    """
    rows = pages.where("html is not null and html <> ''").select("html", F.xxhash64("html").alias("_hash"))

    def telling(batches):
        known: set[int] = set()
        for batch in batches:
            out = []
            for source, h in zip(batch["html"], batch["_hash"].tolist()):
                if h not in known:
                    known.add(h)
                    if labels(parse(source)) is not None:
                        out.append(h)
            yield pd.DataFrame({"_hash": np.array(out, np.int64)})

    chosen: list[int] = []
    low, end = -(1 << 63), 1 << 63
    width = max((1 << 64) * 2 * most_pages // max(rows.count(), 1), 1)
    while low < end and len(chosen) < most_pages:
        high = min(low + width, end)
        part = rows.where(F.col("_hash").between(low, high - 1)).mapInPandas(telling, "_hash long").distinct()
        chosen += [r["_hash"] for r in part.orderBy("_hash").limit(most_pages - len(chosen)).collect()]
        low, width = high, 8 * width
    # At most ``most_pages`` different pages.
    return [r["html"] for r in rows.where(F.col("_hash").isin(chosen)).distinct().orderBy("_hash", "html").limit(most_pages).collect()]


def train(pages: DataFrame, most_pages: int = 300) -> BoostedTrees:
    """Trees fitted on the training pages, by labels of text and link density when no page of the table tells any;
    unfitted trees, which keep nothing, when there is no text at all."""
    rng, xs, ys = random.Random(11), [], []
    label_of, sources = told_labels, training_pages(pages, most_pages)
    if not sources:
        label_of, sources = weak_labels, training_pages(pages, most_pages, weak_labels)
    for source in sources:
        nodes = parse(source)
        labels = label_of(nodes)
        if labels is None:
            continue
        for n, y in ((nodes, labels), disguised(nodes, labels, rng)):
            seen = np.array([i > 0 and m.tag not in UNSEEN for i, m in enumerate(n)])
            xs.append(node_features(n)[seen])
            ys.append(y[seen])
    model = BoostedTrees()
    return model.fit(np.concatenate(xs), np.concatenate(ys).astype(float)) if xs and sum(map(len, xs)) else model


def extract_texts(model: BoostedTrees, sources: list[str | None]) -> list[str]:
    """Main texts of pages; their elements are scored together."""
    trees = [parse(s) for s in sources]
    rows = [node_features(t) for t in trees]
    if not rows:
        return []
    score, out, at = model.score(np.concatenate(rows)), [], 0
    for t, r in zip(trees, rows):
        out.append(main_text(t, kept_elements(t, score[at : at + len(r)])))
        at += len(r)
    return out


def main_texts(pages: DataFrame, most_pages: int = 300) -> DataFrame:
    """page_id, url and text of every page. A null or empty page, and one without main text, has an empty text.

    When no page of the table tells labels by its own elements, text and link density give them.
    """
    bounded_batches(pages.sparkSession)
    shared = Sent(pages.sparkSession, train(pages, most_pages))

    def run(batches):
        for batch in batches:
            sources = batch["html"].tolist()
            texts = [t for a in range(0, len(sources), 256) for t in extract_texts(shared.value, sources[a : a + 256])]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, "page_id long, url string, text string")
