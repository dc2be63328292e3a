"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every element of a page gets features of its subtree (density of text, links, controls), its attribute tokens, its depth, its
siblings and its ancestors. Boosted trees give its odds of being content; decoding keeps the best-scoring set of nodes in which
everything under a dropped node is dropped, so no paragraph is kept inside a dropped menu and no kept container is empty.

No page is labelled, so the trees learn from landmarks: what stands in article or main elements, and what stands in nav, footer
and the like. Each training node is shown three times: as it is, with its landmarks hidden, and with attribute tokens in their
place, so that the trees have to use density, links, depth and siblings as well. Text is also shown below a tag or attribute
token that speaks against it, as not content: comments and notices read like articles.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages learned from (about; chosen by a hash of page_id).
SAMPLE_PAGES = 400
TREES, DEPTH = 12, 4
#: Pages whose nodes are rated at once.
PAGES_AT_ONCE = 200

# Fixed values of the HTML standard: elements without content, of raw text, inline in a line of text, and those that end an open p.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: Opening the key ends an open element of these, up to the nearest of the third.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
    "tbody": (("tr", "td", "th", "thead", "tbody"), ("table",)), "tfoot": (("tr", "td", "th", "thead", "tbody"), ("table",)),
}
#: What may stand in a head; anything else ends it, its end tag being optional.
METADATA = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements of other vocabularies: in them, and only there, "/>" ends an element; in these of their elements HTML stands again.
FOREIGN = frozenset(["svg", "math"])
HTML_AGAIN = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: What never holds the text of an article.
NEVER = frozenset("head script style noscript template iframe object embed svg math canvas select button textarea input option datalist audio video map dialog".split())
GOOD_TAGS, BAD_TAGS = frozenset(["article", "main"]), frozenset("nav footer aside form header menu fieldset".split())
#: Tokens of class, id, role and itemprop.
GOOD_TOKENS = frozenset("article articlebody body content entry main mainbody post story text".split())
BAD_TOKENS = frozenset(
    "ad ads advert advertisement alert author banner bar breadcrumb breadcrumbs byline combx comment comments complementary consent contentinfo cookie cookies copyright disclaimer "
    "disqus dropdown feedback foot footer form gdpr head header login masthead menu message meta modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted "
    "recommended related reply replies rss search share sharing shop sidebar side signup social sponsor sponsored subscribe tags toc toolbar tools top widget".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<(?![a-zA-Z/!?]))", re.DOTALL)
_BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)()()")
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
#: A last attribute without quotes whose value ends in the slash before the ">".
_SLASH_VALUE = re.compile(r"=\s*[^\s\"'>]*/\Z")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FEATURES = [
    "depth", "log_chars", "log_own", "density", "link_share", "log_links", "log_tags", "page_share", "stops", "words_per_stop", "controls", "paragraphs", "lists",
    "place", "siblings", "sibling_index", "same_siblings", "sibling_share", "parent_density", "parent_links", "is_heading", "is_paragraph", "is_item", "is_link",
    "good_tag", "bad_tag", "good_attribute", "bad_attribute", "under_good_tag", "under_bad_tag", "under_good_attribute", "under_bad_attribute",
]
_LANDMARKS = [FEATURES.index(x) for x in ("good_tag", "bad_tag", "good_attribute", "bad_attribute", "under_good_tag", "under_bad_tag", "under_good_attribute", "under_bad_attribute")]


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    good: bool = False
    bad: bool = False
    parts: list = field(default_factory=list)  # own text, and the numbers of children, in page order
    own: int = 0


def _in_foreign(nodes: list[Node], stack: list[int]) -> bool:
    """Whether the next element stands in svg or math."""
    again = False
    for k in range(len(stack) - 1, 0, -1):
        tag = nodes[stack[k]].tag
        if tag in FOREIGN:
            return not again
        again |= tag in HTML_AGAIN
    return False


def _end_head(nodes: list[Node], stack: list[int], opened: str) -> None:
    """Closes an open head, but not from within a template of it, nor from within a noscript unless body opens."""
    for k in range(len(stack) - 1, 0, -1):
        tag = nodes[stack[k]].tag
        if tag == "head":
            del stack[k:]
        if tag in ("head", "template") or tag == "noscript" and opened != "body":
            return


def parse(page: str) -> list[Node]:
    """Elements of a page in page order; the first is the page itself. Broken nesting is mended the way browsers mend it."""
    nodes = [Node("#page", -1, 0)]
    stack = [0]
    raw_until = ""
    in_head = False  # whether a head may be open
    at = 0
    n = len(page)
    while at < n:
        if raw_until:
            end = re.compile(rf"</{raw_until}\b[^>]*>", re.IGNORECASE).search(page, at)
            stack.pop()
            raw_until, at = "", end.end() if end else n
            continue
        m = _TOKEN.match(page, at)
        if m is None:  # a tag with a quote that never ends goes up to the next >, one without it to the end of the page
            end = page.find(">", at)
            if end < 0:
                break
            m, at = _BARE.match(page, at), end + 1
            if m is None:
                continue
        else:
            at = m.end()
        if m[4]:
            if nodes[stack[-1]].tag == "head" and m[4].strip():
                stack.pop()
            nodes[stack[-1]].parts.append(m[4])
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    break
            continue
        if in_head and tag not in METADATA:
            _end_head(nodes, stack, tag)
            in_head = any(nodes[i].tag == "head" for i in stack)
        in_head |= tag == "head"
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == "p":
                    del stack[k:]
                    break
                if nodes[stack[k]].tag not in INLINE:
                    break
        if tag in ENDS:
            closed, fence = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag in fence:
                    break
                if nodes[stack[k]].tag in closed:
                    del stack[k:]
        node = Node(tag, stack[-1], len(stack))
        if m[3]:
            for a in _ATTRIBUTE.finditer(m[3]):
                tokens = {w.lower() for w in _WORD.findall(a[2])}
                node.good |= bool(tokens & GOOD_TOKENS)
                node.bad |= bool(tokens & BAD_TOKENS)
            node.good &= not node.bad
        nodes[stack[-1]].parts.append(len(nodes))
        ended = m[3].endswith("/") and not _SLASH_VALUE.search(m[3]) and (tag in FOREIGN or _in_foreign(nodes, stack))
        if tag not in VOID and not ended:
            stack.append(len(nodes))
            if tag in RAW:
                raw_until = tag
        nodes.append(node)
    return nodes


def node_features(nodes: list[Node]) -> np.ndarray:
    """One row of FEATURES per node."""
    n = len(nodes)
    chars, links, tags, stops, controls, paragraphs, lists, words = (np.zeros(n) for _ in range(8))
    children: list[list[int]] = [[] for _ in range(n)]
    for i, x in enumerate(nodes):
        if x.tag in NEVER:
            continue
        for part in x.parts:
            if isinstance(part, str):
                x.own += len(part.strip())
                stops[i] += part.count(".") + part.count("!") + part.count("?")
                words[i] += part.count(" ")
        chars[i] = x.own
        if i:
            children[x.parent].append(i)
    for i in range(n - 1, 0, -1):
        x, p = nodes[i], nodes[i].parent
        if x.tag == "a":
            links[i] = chars[i]
        for sums in (chars, links, stops, words, controls, paragraphs, lists):
            sums[p] += sums[i]
        tags[p] += tags[i] + 1
        controls[p] += x.tag in ("input", "select", "button", "textarea", "option", "label")
        paragraphs[p] += x.tag == "p"
        lists[p] += x.tag == "li"
    total = max(chars[0], 1.0)
    density = chars / (tags + 1)
    link_share = links / np.maximum(chars, 1)
    out = np.zeros((n, len(FEATURES)))
    under = np.zeros((n, 4))
    before = 0.0
    for i, x in enumerate(nodes):
        p = max(x.parent, 0)
        family = children[p]
        flags = (x.tag in GOOD_TAGS, x.tag in BAD_TAGS, x.good, x.bad)
        if i:
            under[i] = np.maximum(under[p], flags)
        siblings = len(family)
        out[i] = (
            x.depth, math.log1p(chars[i]), math.log1p(x.own), math.log1p(density[i]), link_share[i], math.log1p(links[i]), math.log1p(tags[i]), chars[i] / total,
            math.log1p(stops[i]), words[i] / (stops[i] + 1), controls[i], paragraphs[i], lists[i], before / total, siblings, 0.0, 0.0,
            chars[i] / max(chars[p], 1), math.log1p(density[p]), link_share[p], x.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), x.tag == "p", x.tag == "li", x.tag == "a", *flags, *under[i],
        )
        before += x.own
    for family in children:
        same: dict[str, int] = {}
        for i in family:
            same[nodes[i].tag] = same.get(nodes[i].tag, 0) + 1
        for k, i in enumerate(family):
            out[i, 15] = k / len(family)
            out[i, 16] = same[nodes[i].tag]
    return out


@dataclass
class Boosted:
    """Boosted trees as arrays: for each tree feature (-1: a leaf), threshold, left, right and value of its nodes."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    weights: list[float]

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """Half the log odds; even odds, slightly for keeping, where nothing was learned."""
        if not self.trees:
            return np.full(len(rows), 0.1)
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(rows), np.int64)
            while (inner := feature[at] >= 0).any():
                goes_left = rows[every, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            total += weight * value[at]
        return total


def _tree(root) -> tuple[np.ndarray, ...]:
    rows: list[list[float]] = []

    def walk(node) -> int:
        number = len(rows)
        rows.append([-1, 0.0, number, number, node.prediction()])
        if node.subtreeDepth() > 0:
            rows[number][:2] = [node.split().featureIndex(), node.split().threshold()]
            rows[number][2] = walk(node.leftChild())
            rows[number][3] = walk(node.rightChild())
        return number

    walk(root)
    a = np.array(rows)
    return a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4]


def _training_rows(pages: pd.Series) -> list[list[dict]]:
    out = []
    for page in pages:
        rows = []
        nodes = parse(page or "")
        features = node_features(nodes)
        good, bad = features[:, FEATURES.index("under_good_tag")], features[:, FEATURES.index("under_bad_tag")]
        bad = np.maximum(bad, features[:, FEATURES.index("under_bad_attribute")])
        for i, x in enumerate(nodes):
            if i and (good[i] or bad[i]) and features[i, 1] > 0:
                label = float(good[i] and not bad[i])
                hidden, told = features[i].copy(), features[i].copy()
                hidden[_LANDMARKS] = 0
                told[_LANDMARKS] = 0
                told[_LANDMARKS[2:4]] = features[i, _LANDMARKS[0:2]]
                told[_LANDMARKS[6:8]] = label, 1 - label
                rows += [{"x": r.tolist(), "label": label} for r in (features[i], hidden, told)]
                if label:  # the same text would not count below a node with a mark against it
                    for mark in (5, 7):
                        marked = hidden.copy()
                        marked[_LANDMARKS[mark]] = 1
                        rows.append({"x": marked.tolist(), "label": 0.0})
        out.append(rows)
    return out


def learn(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Boosted:
    """Trees from about `sample` pages of (page_id, html); nothing to learn from gives even odds everywhere."""
    n = pages.where("html IS NOT NULL").count()
    if not n:
        return Boosted([], [])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    training = F.pandas_udf(lambda some: pd.Series(_training_rows(some)), "array<struct<x:array<double>,label:double>>")
    some = pages.where(F.col("html").isNotNull() & (draw < min(1.0, sample / n))).select(training("html").alias("rows")).select(F.explode("rows").alias("r"))
    rows = some.select(array_to_vector("r.x").alias("features"), F.col("r.label").alias("label")).coalesce(4).persist()
    try:
        if len(rows.select("label").distinct().limit(2).collect()) < 2:
            return Boosted([], [])
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5, featureSubsetStrategy="onethird", cacheNodeIds=False).fit(rows)
    finally:
        rows.unpersist()
    return Boosted([_tree(t._call_java("rootNode")) for t in model.trees], list(model.treeWeights))


def decode(nodes: list[Node], margins: np.ndarray) -> list[bool]:
    """The best set of kept nodes in which a kept node's ancestors are kept. A node weighs as the text of its own."""
    gains = np.zeros(len(nodes))
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        if x.tag in NEVER:
            gains[i] = -1
            continue
        weight = 0.25 + math.log1p(x.own) if x.tag not in INLINE else 0.0
        gains[i] += weight * margins[i] if i else 0.0
        if i and gains[i] > 0:
            gains[x.parent] += gains[i]
    kept = [True] * len(nodes)
    for i, x in enumerate(nodes[1:], 1):
        kept[i] = kept[x.parent] and (x.tag in INLINE and x.tag not in NEVER or gains[i] > 0)
    return kept


def blocks(nodes: list[Node], kept: list[bool]) -> str:
    """Kept text: character references decoded, white space in a block one space, blocks in page order parted by two line ends."""
    out: list[str] = []
    open_: list[str] = []

    def close() -> None:
        line = " ".join(html.unescape("".join(open_)).split())
        open_.clear()
        if line:
            out.append(line)

    # (node, next part) of the elements that are open: pages may nest deeper than Python's stack
    path = [(0, 0)]
    while path:
        number, part = path.pop()
        x = nodes[number]
        if part == len(x.parts):
            if x.tag not in INLINE:
                close()
            continue
        path.append((number, part + 1))
        p = x.parts[part]
        if isinstance(p, str):
            open_.append(p)
        elif kept[p]:
            if nodes[p].tag not in INLINE:
                close()
            elif nodes[p].tag == "br":
                open_.append(" ")
            path.append((p, 0))
        elif nodes[p].tag not in INLINE:
            close()
    close()
    return "\n\n".join(out)


def extracted(pages: DataFrame, model: Boosted) -> DataFrame:
    """pages with _text, the main text of html. A null or empty page, or one without content, has the empty text.

    Pages are independent rows: order, repeated rows and columns of other names do not matter and pass through.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # TREES trees of DEPTH levels

    @F.pandas_udf("string")
    def text(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in series:
            texts: list[str] = []
            for first in range(0, len(some), PAGES_AT_ONCE):
                parsed = [parse(page or "") for page in some.iloc[first : first + PAGES_AT_ONCE]]
                rows = [node_features(nodes) for nodes in parsed]
                margins = np.split(shared.value.margins(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
                texts += [blocks(nodes, decode(nodes, m)) for nodes, m in zip(parsed, margins)]
            yield pd.Series(texts, dtype=object)

    return pages.withColumn("_text", text("html"))
