"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every block of text is a node that is content or not. A node's potential
is linear in features of its tag, its class and id words, its text length, link share and
punctuation; parent and child are linked by a 2 x 2 potential. One pass of sum-product messages
upward and one downward give each node's probability of being content, and the text blocks of
at least one half are the main text.

Training: pages that mark their article themselves (`article` or `main`) are labelled pages:
what lies in it and in no menu, header, footer, sidebar, advert, form or comment is content. At
most `FIT_PAGES` of them, by the order of a hash of page_id, fit the potentials by maximum a
posteriori around the initial weights below, which carry what the labelled pages do not show.
Extraction covers every page and the whole html.

Defined results: null and empty html, or html without content, gives the empty text; repeated
rows give repeated results; unclosed and cut-off markup is read as far as it goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_PAGES, FIT_CHARS, FIT_STEPS = 400, 100_000, 120

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|aria-label)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements whose content is no text of the page.
_DROPPED = {"script", "style", "template", "textarea", "title", "svg", "iframe", "noscript", "select", "object", "canvas"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Tags by kind; a tag that is in none is inline and makes no node.
_KINDS = {
    "article": {"article", "main"},
    "section": {"section", "div", "center", "body", "html", "td", "table", "tbody", "thead", "tr", "th", "figure", "details", "summary", "hgroup", "dl", "head"},
    "text": {"p", "pre", "blockquote", "dd", "dt", "figcaption", "address", "caption"},
    "heading": {"h1", "h2", "h3", "h4", "h5", "h6"},
    "list": {"ul", "ol", "li", "dir"},
    "menu": {"nav", "menu"},
    "frame": {"header", "footer"},
    "aside": {"aside", "dialog"},
    "form": {"form", "fieldset", "button", "label", "option", "legend"},
}
_KIND_OF = {tag: kind for kind, tags in _KINDS.items() for tag in tags}
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}}

#: Class, id and role words that name parts of a page.
_GOOD = {"article", "content", "post", "entry", "story", "main", "body", "text", "page"}
_BAD = {
    "menu": {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "skip"},
    "frame": {"header", "footer", "masthead", "topbar", "banner", "copyright", "legal", "contentinfo", "colophon"},
    "aside": {"sidebar", "aside", "complementary", "widget", "related", "recommended", "recommendations", "trending", "tags", "bio"},
    "advert": {"ad", "ads", "adv", "advert", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "promoted"},
    "notice": {"cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "dialog", "newsletter", "subscribe", "subscription", "signup", "paywall"},
    "form": {"form", "login", "search", "share", "sharing", "social", "button", "buttons", "toolbar"},
    "comment": {"comment", "comments", "reply", "replies", "respond", "disqus", "discussion"},
    "hidden": {"hidden"},
}
FEATURES = ["bias", *(f"tag:{k}" for k in _KINDS), "leaf", "good", *(f"word:{k}" for k in _BAD), "links", "length", "sentence", "short"]
_AT = {f: i for i, f in enumerate(FEATURES)}
_START = {"tag:article": 3.0, "good": 1.0, "tag:menu": -6.0, "tag:frame": -6.0, "tag:aside": -6.0, "tag:form": -6.0, "links": -2.0, "length": 1.0, "sentence": 0.5}
START = np.array([_START.get(f, -6.0 if f.startswith("word:") else 0.0) for f in FEATURES])
#: Potentials by (parent's label, child's label): what is outside content holds none of it inside, unless marked.
START_LINK = np.array([[1.0, -2.0], [0.0, 1.5]])


class Page:
    """Nodes of one page in page order: parent, depth, features, own text and self-made labels."""

    __slots__ = ("parent", "depth", "features", "text", "label", "marked")

    def __init__(self):
        self.parent, self.depth, self.features, self.text, self.label = [-1], [0], [{"tag:section"}], [None], [0]
        self.marked = False


def _words(attributes: str) -> set[str]:
    found = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        name = name.lower()
        if name in ("class", "id", "role", "aria-label"):
            found.update(w.lower() for w in _WORDS.findall(value))
        elif (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)) or name == "hidden" or (name == "aria-hidden" and value == "true"):
            found.add("hidden")
    return found


def parse(html: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("#page", 0)]  # open block elements
    links = 0
    run: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                node = stack[-1][1]
                page.parent.append(node)
                page.depth.append(page.depth[node] + 1)
                page.features.append({"leaf": 1.0, "links": min(1.0, linked / len(text)), "length": min(1.5, len(text) / 200), "sentence": float(bool(re.search(r"[.!?:;,]", text))), "short": float(len(text) < 25)})
                page.text.append(text)
                page.label.append(page.label[node])
            run.clear()
        linked = 0

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            run.append(html[at:])
            linked += (n - at) * bool(links)
            break
        if m.start() > at:
            run.append(html[at : m.start()])
            linked += (m.start() - at) * bool(links)
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in _DROPPED:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if tag == "a":
            links = 0 if closing else 1
        kind = _KIND_OF.get(tag)
        if kind is None:
            if tag in ("br", "hr", "img", "input"):
                run.append(" ")
                if tag == "hr":
                    flush()
            elif not closing:
                words = _words(attributes) if attributes else set()
                if any(words & bad for bad in _BAD.values()):  # a marked inline element is a node, too
                    kind = "section"
            elif any(t == tag for t, _ in stack):
                kind = "section"
            if kind is None:
                continue
        flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        closes = _CLOSES.get(tag, {"p"} if kind != "heading" or stack[-1][0] == "p" else set())
        scope = _SCOPES.get(tag, set())
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in closes:
                del stack[i:]
                break
            if stack[i][0] in scope or (not scope and _KIND_OF.get(stack[i][0]) not in ("text", "heading")):
                break
        if attributes.endswith("/") and tag in _VOID:
            continue
        words = _words(attributes) if attributes else set()
        bad = {f"word:{k}" for k, names in _BAD.items() if words & names}
        features = {f"tag:{kind}": 1.0, **dict.fromkeys(bad, 1.0)}
        if words & _GOOD and not bad:
            features["good"] = 1.0
        node = stack[-1][1]
        out = bool(bad) or kind in ("menu", "frame", "aside", "form")
        label = 0 if out else 1 if kind == "article" else page.label[node]
        if label and out is False and kind != "article" and page.label[node] == 0:
            label = 0
        page.marked |= kind == "article"
        page.parent.append(node)
        page.depth.append(page.depth[node] + 1)
        page.features.append(features)
        page.text.append(None)
        page.label.append(label)
        stack.append((tag, len(page.parent) - 1))
    flush()
    return page


def _matrix(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, parents (-1 for roots) and depths of the nodes of all pages."""
    sizes = [len(p.parent) for p in pages]
    x = np.zeros((sum(sizes), len(FEATURES)))
    x[:, 0] = 1
    parents, depths, base = [], [], 0
    for page, size in zip(pages, sizes):
        for i, features in enumerate(page.features):
            for f in features:
                x[base + i, _AT[f]] = features[f] if isinstance(features, dict) else 1.0
        parent = np.array(page.parent)
        parents.append(np.where(parent < 0, -1, parent + base))
        depths.append(page.depth)
        base += size
    return x, np.concatenate(parents), np.concatenate(depths)


def sum_product(unary: np.ndarray, link: np.ndarray, parents: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of content, and expected counts of (parent, child) labels, on a forest.

    `unary` is the log potential of content by node; nodes of one depth are handled together,
    first upward from the deepest, then downward from the roots.
    """
    n = len(unary)
    own = np.column_stack([np.zeros(n), unary])
    up, message, down = own.copy(), np.zeros((n, 2)), np.zeros((n, 2))
    levels = [np.flatnonzero(depths == d) for d in range(int(depths.max()) + 1)] if n else []
    for level in reversed(levels[1:]):
        message[level] = np.logaddexp(up[level, :1] + link[:, 0], up[level, 1:] + link[:, 1])
        np.add.at(up, parents[level], message[level])
    pairs = np.zeros((2, 2))
    for level in levels[1:]:
        above = up[parents[level]] + down[parents[level]] - message[level]
        down[level] = np.logaddexp(above[:, :1] + link[0], above[:, 1:] + link[1])
        joint = above[:, :, None] + link[None] + up[level][:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    both = up + down
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50))), pairs


def fit(pages: list[Page], steps: int = FIT_STEPS, spread: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and link potentials that labelled pages make most likely, near the initial ones."""
    weights, link = START.copy(), START_LINK.copy()
    if not pages:
        return weights, link
    x, parents, depths = _matrix(pages)
    y = np.concatenate([p.label for p in pages]).astype(float)
    inner = parents >= 0
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[parents[inner]].astype(int), y[inner].astype(int)), 1)
    m = v = np.zeros(len(weights) + 4)
    for step in range(1, steps + 1):
        p, pairs = sum_product(x @ weights, link, parents, depths)
        prior = np.concatenate([weights - START, (link - START_LINK).ravel()]) / spread**2
        grad = (np.concatenate([x.T @ (p - y), (pairs - seen).ravel()]) + prior) / len(pages)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights = weights - move[:-4]
        link = link - move[-4:].reshape(2, 2)
    return weights, link


def main_texts(pages: list[Page], weights: np.ndarray, link: np.ndarray) -> list[str]:
    if not pages:
        return []
    x, parents, depths = _matrix(pages)
    p, _ = sum_product(x @ weights, link, parents, depths)
    out, base = [], 0
    for page in pages:
        kept = [t for i, t in enumerate(page.text) if t is not None and p[base + i] >= 0.5]
        out.append("\n\n".join(kept))
        base += len(page.parent)
    return out


def train(pages: DataFrame, fit_pages: int = FIT_PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Fit on a bounded number of pages that mark their article."""
    marked = pages.filter(F.length("html").between(1, FIT_CHARS) & F.col("html").rlike("(?i)<(article|main)[ >]"))
    bound = marked.select(F.xxhash64("page_id").alias("h")).orderBy("h").limit(fit_pages).agg(F.max("h")).first()[0]
    if bound is None:
        return fit([])
    rows = marked.filter(F.xxhash64("page_id") <= bound).select("html").limit(fit_pages).collect()
    parsed = [parse(h) for h in sorted(r["html"] for r in rows)]
    return fit([p for p in parsed if p.marked])


def extract(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages(page_id, url, html)."""
    weights, link = train(pages, fit_pages)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = main_texts([parse(h or "") for h in part.column("html").to_pylist()], weights, link)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
