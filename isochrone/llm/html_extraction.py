"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the hierarchy.

1. ``parse`` reads a page into a tree of elements. Blocks of text are leaves: the text of an element
   without block children, or a run of loose text between block children.
2. ``node_features`` describes each node: tag, depth, siblings, text and link density of its subtree, and
   tokens of its own and its ancestors' class, id and role attributes.
3. Boosted regression trees (logistic loss, histogram splits) give each node the probability that it
   holds main text. They are trained here on pages from ``training_page``: invented layouts whose blocks
   are labelled, with and without telling attribute names, ``TRAINING_PAGES`` of them. The number is a
   parameter and no page of the input is looked at for training.
4. Decoding is exact on the tree: among all choices in which a chosen node's parent is chosen too, the one
   of highest likelihood. So no block is kept inside a rejected container, and none that is chosen hangs
   below one that isn't.

Pages are read inside their task, in Arrow batches; nothing is shuffled. The model is a few thousand
numbers and is sent with the function.

Defined results: NULL or empty html gives empty text; text outside any element counts as a block of the
page; unclosed and stray tags are repaired by the usual rules (a new paragraph ends the open one, text or
any element that can't stand in a head ends it); formulas and fallback content of objects are text;
nesting of any depth and pages of any length are handled without recursion; repeated rows get the same
text; a NULL url is carried; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require

#: Elements without content of their own; elements whose content is never text; elements that break text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg canvas textarea title xmp".split())
#: Raw elements that take the rest of the page if they are never closed; the others are then ordinary ones.
TAKES_REST = frozenset("script style textarea".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html hgroup li main menu nav ol p pre section select option button summary table tbody td tfoot th thead tr ul caption legend label".split())
#: A start tag of the first kind ends an open paragraph; the others end an open element of their kind.
ENDS_P = BLOCK - frozenset("html body button label option select legend caption td th tr tbody thead tfoot".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

# a quote opens a value only right after "="
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)|[^>])*+)>", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")

#: Attribute tokens by meaning. Fixed values.
TOKENS = {
    "main": "article main content post entry story body text maincontent prose articlebody",
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager tabs toc skip",
    "head": "header masthead banner logo branding hero topbar top",
    "foot": "footer copyright legal bottom colophon",
    "side": "sidebar side aside widget rail related recommended recommendations more trending popular tags",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense dfp",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter signup paywall",
    "form": "form search login input captcha register contact",
    "comment": "comment comments reply replies disqus discussion thread respond reader readers",
    "share": "share sharing social follow twitter facebook meta byline author date",
}
_GROUP = {w: i for i, ws in enumerate(TOKENS.values()) for w in ws.split()}
TAGS = ("html", "body", "div", "section", "article", "main", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "table", "td", "blockquote", "pre", "nav", "aside", "header", "footer", "form", "button", "label", "figure", "figcaption", "address", "dl", "#text")
_TAG = {t: i for i, t in enumerate(TAGS)}
TRAINING_PAGES = 400
ROUNDS, DEPTH, RATE, BINS = 60, 4, 0.25, 32


class Tree:
    """Nodes in page order as parallel lists; node 0 is the page."""

    def __init__(self):
        self.tag, self.parent, self.tokens, self.text, self.linked = ["html"], [-1], [frozenset()], [[]], [0]
        #: Open text run of each node; a block child closes it.
        self.run: list[int] = [-1]

    def add(self, tag: str, parent: int, tokens: frozenset) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.tokens.append(tokens)
        self.text.append([])
        self.linked.append(0)
        self.run.append(-1)
        return len(self.tag) - 1


def parse(page: str) -> Tree:
    tree = Tree()
    stack = [("html", 0)]  # block elements, and inline ones that matter ("a")
    links = 0
    unclosed: set[str] = set()

    def put(text: str) -> None:
        at = stack[-1][1]
        if tree.run[at] < 0:
            if not text.strip():
                return
            tree.run[at] = tree.add("#text", at, frozenset())
        tree.text[tree.run[at]].append(text)
        if links:
            tree.linked[tree.run[at]] += len(text)

    def close(names, scope=()) -> None:
        nonlocal links
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                for name, node in stack[i:]:
                    links -= name == "a"
                    if node != stack[i - 1][1]:
                        tree.run[node] = -1
                del stack[i:]
                return
            if stack[i][0] in scope:
                return

    pos, size = 0, len(page)
    while pos < size:
        m = _MARKUP.search(page, pos)
        end = m.start() if m else size
        if end > pos:
            put(html.unescape(page[pos:end]))
        if not m:
            break
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                if tag not in ("html", "body"):
                    close((tag,))
            elif tag == "a":
                close(("a",), BLOCK)
            continue
        if tag == "br" or tag == "hr":
            put(" ")
            if tag == "hr":
                tree.run[stack[-1][1]] = -1
            continue
        if tag in VOID:
            continue
        if tag in RAW and tag not in unclosed:
            if not m[3].endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
                if stop:
                    pos = stop.end()
                elif tag in TAKES_REST:
                    pos = size
                else:  # no later one is closed either
                    unclosed.add(tag)
            continue
        if tag in BLOCK:
            if tag == "html":
                continue
            if tag in ENDS_P:
                close(("p",), BLOCK - {"p"})
            if tag in SAME:
                close(SAME[tag], SCOPE[tag])
            tokens = frozenset(w for a in _ATTRIBUTE.finditer(m[3]) for w in _WORD.findall((a[2] or a[3] or a[4] or "").lower()))
            if tag == "body":
                tree.tokens[0] |= tokens
                continue
            at = stack[-1][1]
            tree.run[at] = -1
            stack.append((tag, tree.add(tag, at, tokens)))
        elif tag == "a":
            stack.append(("a", stack[-1][1]))
            links += 1
    return tree


def block_text(tree: Tree, node: int) -> str:
    return " ".join("".join(tree.text[node]).split())


N_FEATURES = 30


def node_features(tree: Tree, texts: list[str]) -> np.ndarray:
    """One row per node; children come after their parents."""
    n = len(tree.tag)
    parent = tree.parent
    size, linked, blocks, words, stops, elements = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [1] * n
    for i, t in enumerate(texts):
        if t:
            size[i], linked[i], blocks[i] = len(t), min(tree.linked[i], len(t)), 1
            words[i] = t.count(" ") + 1
            stops[i] = t.count(".") + t.count(",") + t.count("!") + t.count("?")
    depth, index, children = [0] * n, [0] * n, [0] * n
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
        index[i] = children[parent[i]]
        children[parent[i]] += 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        size[p] += size[i]
        linked[p] += linked[i]
        blocks[p] += blocks[i]
        words[p] += words[i]
        stops[p] += stops[i]
        elements[p] += elements[i]
    own, above = [0] * n, [0] * n
    marks = {"article": 1, "main": 1, "nav": 2, "header": 4, "footer": 8, "aside": 16, "form": 128}
    for i in range(n):
        bits = marks.get(tree.tag[i], 0)
        for w in tree.tokens[i]:
            g = _GROUP.get(w)
            if g is not None:
                bits |= 1 << g
        own[i] = bits
        if i:
            above[i] = above[parent[i]] | own[parent[i]]
    total = max(size[0], 1)
    rows = np.zeros((n, N_FEATURES))
    for i in range(n):
        p = max(parent[i], 0)
        s = max(size[i], 1)
        before = size[i - 1] if i and parent[i - 1] == parent[i] else 0
        rows[i, :10] = (
            _TAG.get(tree.tag[i], len(TAGS)), _TAG.get(tree.tag[p], len(TAGS)), depth[i], index[i], children[p],
            np.log1p(size[i]), linked[i] / s, words[i] / max(blocks[i], 1), stops[i] / max(words[i], 1), size[i] / total,
        )
        rows[i, 10:17] = (size[i] / max(size[p], 1), linked[p] / max(size[p], 1), np.log1p(before), elements[i], index[i] / max(children[p], 1), size[i] / elements[i], blocks[i])
        rows[i, 17] = tree.tag[i] in ("form", "button", "label", "select", "option") or tree.tag[p] in ("form", "button", "label", "select", "option")
    bits = np.array([own, above])
    for g in range(len(TOKENS)):
        rows[:, 18 + g] = (bits[0] >> g & 1) + 2 * (bits[1] >> g & 1)
    rows[:, 28] = [len(tree.tokens[i]) > 0 for i in range(n)]
    rows[:, 29] = [min(depth[i] - depth[0], 3) if above[i] & 1 else -1 for i in range(n)]
    return rows


class Boosted:
    """Boosted trees of fixed depth as arrays: feature, border and leaf values per tree."""

    def __init__(self, start: float, features: np.ndarray, borders: np.ndarray, leaves: np.ndarray):
        self.start, self.features, self.borders, self.leaves = start, features, borders, leaves

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, b, v in zip(self.features, self.borders, self.leaves, strict=True):
            at = np.zeros(len(x), "int64")
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > b[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, penalty: float = 1.0) -> Boosted:
    n, k = x.shape
    borders = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(borders[j], x[:, j], "left") for j in range(k)], axis=1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(n, start)
    inner, ends = 2**DEPTH - 1, 2**DEPTH
    all_f, all_b, all_v = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        f, b, v, at = np.zeros(inner, "int64"), np.full(inner, np.inf), np.zeros(ends), np.zeros(n, "int64")
        for node in range(inner):
            own = np.flatnonzero(at == node)
            best = (1e-6, 0, np.inf)
            if len(own) > 20:
                gs, hs = g[own], h[own]
                whole = gs.sum() ** 2 / (hs.sum() + penalty)
                for j in range(k):
                    if not len(borders[j]):
                        continue
                    size = len(borders[j]) + 1
                    gl = np.cumsum(np.bincount(binned[own, j], gs, size))[:-1]
                    hl = np.cumsum(np.bincount(binned[own, j], hs, size))[:-1]
                    gain = gl**2 / (hl + penalty) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + penalty) - whole
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], j, borders[j][i])
            f[node], b[node] = best[1], best[2]
            at[own] = 2 * node + 1 + (x[own, f[node]] > b[node])
        for leaf in range(ends):
            own = at == inner + leaf
            if own.any():
                v[leaf] = rate * g[own].sum() / (h[own].sum() + penalty)
        raw += v[at - inner]
        all_f.append(f)
        all_b.append(b)
        all_v.append(v)
    return Boosted(start, np.array(all_f), np.array(all_b), np.array(all_v))


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """The most likely choice in which every chosen node's parent is chosen.

    With a node chosen, each child's subtree adds what it can; rejecting a node rejects its subtree. So a
    subtree is worth ``max(0, odds + worth of its children)`` over rejecting all of it.
    """
    worth = odds.astype("float64").copy()
    for i in range(len(parent) - 1, 0, -1):
        if worth[i] > 0:
            worth[parent[i]] += worth[i]
    chosen = np.zeros(len(parent), bool)
    chosen[0] = worth[0] > 0
    for i in range(1, len(parent)):
        chosen[i] = chosen[parent[i]] and worth[i] > 0
    return chosen


# --- training pages -------------------------------------------------------------------------------


def training_page(rng: np.random.Generator) -> str:
    """An invented page; the words of its main blocks begin with "m", all others with "b"."""
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]

    def words(mark: str, low: int, high: int) -> str:
        out = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(1, 11)))) for _ in range(int(rng.integers(low, high + 1)))]
        ends = pick(0, 0, 1)
        return " ".join(mark + w + ("." if rng.random() < 0.12 * (1 + ends) else "," if rng.random() < 0.08 else pick("***", "&amp;&amp;", "!!") if noisy and rng.random() < 0.5 else "") for w in out)

    noisy = rng.random() < 0.15
    named = rng.random() < 0.75  # whether attributes tell what a container is
    semantic = rng.random() < 0.65  # whether tags do

    def box(kind: str, inner: str, tags: tuple[str, ...], names: tuple[str, ...]) -> str:
        tag = pick(*tags) if semantic else "div"
        name = pick(*names) if named and names else pick("", "", "x1", "wrap", "col", "row", "c" + str(int(rng.integers(99))))
        attribute = pick(f' class="{name}"', f' id="{name}"', f" class='{name} clearfix'", f' class="{name}-{pick("box", "wrap", "inner", "area")}"') if name else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def links(low: int, high: int) -> str:
        items = [f'<a href="/{words("b", 1, 1)}">{words("b", 1, pick(1, 3, 6))}</a>' for _ in range(int(rng.integers(low, high + 1)))]
        form = pick(0, 0, 1, 2)
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if form == 0 else " | ".join(items) if form == 1 else "".join(f"<div>{x}</div>" for x in items)

    def paragraphs(mark: str, low: int, high: int, longest: int) -> str:
        return "".join(f"<p>{words(mark, 3, longest)}</p>" for _ in range(int(rng.integers(low, high + 1))))

    def nav() -> str:
        return box("nav", links(3, 9), ("nav", "div", "ul"), ("nav", "navbar", "main-menu", "menu", "breadcrumb", "navigation"))

    def header() -> str:
        return box("header", pick(f"<h2>{words('b', 1, 4)}</h2>", f"<div>{words('b', 1, 5)}</div>", f"<p>{words('b', 2, 12)}</p>", words("b", 1, 6), f"<h1>{words('b', 1, 4)}</h1>") + pick("", links(2, 6), f"<p>{words('b', 3, 10)}</p>"), ("header", "div"), ("header", "site-header", "masthead", "banner", "topbar"))

    def footer() -> str:
        return box("footer", pick(f"&copy; {words('b', 1, 3)} &middot; {words('b', 2, 40)}", f"<p>{words('b', 3, 40)}</p>", links(2, 8) + f"<p>{words('b', 2, 20)}</p>"), ("footer", "div"), ("footer", "site-footer", "copyright", "legal"))

    def aside() -> str:
        return box("aside", pick("", f"<h3>{words('b', 1, 4)}</h3>") + pick(links(3, 8), paragraphs("b", 1, 3, 30), paragraphs("b", 1, 1, 15) + links(2, 5)), ("aside", "div", "section"), ("sidebar", "widget", "related", "right-rail", "trending"))

    def advert() -> str:
        return box("ad", pick(words("b", 3, 40), f"<p>{words('b', 3, 40)}</p>", f'<a href="/x">{words("b", 2, 12)}</a>'), ("div", "div", "aside", "section"), ("ad", "ads", "advert", "sponsored", "promo", "ad-slot", "advertisement"))

    def notice() -> str:
        return box("notice", pick(f"<p>{words('b', 5, 40)}</p>", words("b", 5, 40)) + pick("", f"<button>{words('b', 1, 2)}</button>"), ("div", "section", "div", "aside"), ("cookie-notice", "cookie-banner", "consent", "newsletter", "notice", "popup", "subscribe", "alert"))

    def form() -> str:
        inner = "".join(f"<label>{words('b', 1, 4)}</label><input name=x>" for _ in range(int(rng.integers(0, 4)))) + pick("", f"<p>{words('b', 3, 20)}</p>") + f"<button>{words('b', 1, 2)}</button>"
        return box("form", f"<form action=/x>{inner}</form>", ("div", "section"), ("search", "login", "contact-form", "signup", "form")) if rng.random() < 0.4 else f"<form>{inner}</form>"

    def comments() -> str:
        one = lambda: box("comment", pick("", f"<h4>{words('b', 1, 2)}</h4>", f"<span>{words('b', 1, 3)}</span>") + pick(paragraphs("b", 1, 2, 60), words("b", 4, 60)), ("div", "li", "article"), ("comment", "comment-body", "reply"))
        inner = pick("", f"<h3>{words('b', 1, 3)}</h3>", f"<h2>{words('b', 1, 2)}</h2>") + "".join(one() for _ in range(int(rng.integers(1, 6))))
        # comments look like text: only names tell them, so these are nearly always there
        tag = pick("section", "div", "aside", "ol")
        name = pick("comments", "comment-list", "discussion", "reader-comments", "replies", "user-comments")
        return f'<{tag} {pick("id", "class")}="{name}">{inner}</{tag}>'

    def share() -> str:
        return box("share", links(2, 4), ("div", "section"), ("share", "social", "share-buttons", "meta"))

    junk_inside = [advert, notice, share, aside, form, comments, nav]
    parts = [f"<h1>{words('m', 2, 12)}</h1>"] if rng.random() < 0.85 else []
    for _ in range(int(rng.integers(0, 2) if rng.random() < 0.2 else rng.integers(1, 14))):
        kind = rng.random()
        if kind < 0.62:
            text = words("m", 1, pick(4, 30, 90, 160))
            if rng.random() < 0.2:
                text += f' <a href="/m">{words("m", 1, 4)}</a> {words("m", 1, 12)}'
            text = pick(text, text, f"<b>{text}", f"<em>{text}</em>", f"{text}<br>{words('m', 1, 20)}", text + "<br>")
            parts.append(f"<p>{text}" + pick("</p>", "</p>", "</p>", ""))
        elif kind < 0.72:
            level = pick(2, 3)
            parts.append(f"<h{level}>{words('m', 1, 8)}</h{level}>")
        elif kind < 0.79:
            parts.append("<ul>" + "".join(f"<li>{words('m', 1, 25)}</li>" for _ in range(int(rng.integers(1, 6)))) + "</ul>")
        elif kind < 0.84:
            parts.append(f"<blockquote>{pick('<p>', '')}{words('m', 3, 50)}</blockquote>")
        elif kind < 0.88:
            parts.append("<table>" + "".join(f"<tr><td>{words('m', 1, 6)}</td><td>{words('m', 1, 6)}</td></tr>" for _ in range(int(rng.integers(1, 5)))) + "</table>")
        elif kind < 0.91:
            parts.append(f"<pre>{words('m', 3, 40)}</pre>")
        elif kind < 0.95:
            parts.append(f"<div>{words('m', 3, 80)}</div>")
        else:
            parts.append(pick(*junk_inside)())
    if not parts or rng.random() < 0.1:
        parts.append(f"<p>{words('m', 1, 40)}</p>")
    if rng.random() < 0.12:
        parts.append(comments())
    inner = "".join(parts)
    article = pick(
        f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f'<main><article class="post">{inner}</article></main>',
        f'<div class="{pick("content", "article-body", "post", "entry-content", "story")}">{inner}</div>', f'<div id="main"><div class="post-content">{inner}</div></div>', f"<div>{inner}</div>", f"<section>{inner}</section>", inner,
    )
    before = [p() for p in (header, nav, advert, notice, aside, form, share) if rng.random() < (0.6 if p in (header, nav) else 0.3)]
    after = [p() for p in (comments, aside, share, form, advert, notice, nav) if rng.random() < (0.45 if p is comments else 0.3)] + ([footer()] if rng.random() < 0.85 else [])
    body = "".join(before) + article + "".join(after)
    if rng.random() < 0.06:  # a fragment that is nothing but text
        body = article
    if rng.random() < 0.3:
        body = f'<div class="{pick("page", "wrapper", "container", "site")}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{words('b', 1, 8)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def training_rows(pages: int = TRAINING_PAGES, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        tree = parse(training_page(rng))
        texts = [block_text(tree, i) for i in range(len(tree.tag))]
        label = np.array([t.startswith("m") for t in texts])
        for i in range(len(texts) - 1, 0, -1):
            label[tree.parent[i]] |= label[i]
        xs.append(node_features(tree, texts))
        ys.append(label)
    return np.concatenate(xs), np.concatenate(ys).astype("float64")


_models: dict[int, Boosted] = {}


def model(pages: int = TRAINING_PAGES) -> Boosted:
    """The trees, trained once per driver."""
    if pages not in _models:
        _models[pages] = boost(*training_rows(pages))
    return _models[pages]


def main_blocks(pages: list[str], trees: Boosted) -> list[list[str]]:
    """The chosen blocks of every page, in page order; the nodes of all pages are scored together."""
    parsed = [parse(p) for p in pages]
    texts = [[block_text(t, i) if t.text[i] else "" for i in range(len(t.tag))] for t in parsed]
    odds = trees.predict(np.concatenate([node_features(t, x) for t, x in zip(parsed, texts, strict=True)]))
    out, at = [], 0
    for t, x in zip(parsed, texts, strict=True):
        chosen = decode(t.parent, odds[at : at + len(x)])
        at += len(x)
        out.append([s for s, c in zip(x, chosen, strict=True) if c and s])
    return out


def extract(pages: DataFrame, trees: Boosted | None = None, batch: int = 200) -> DataFrame:
    """page_id, url, text of every row."""
    require(pages, "page_id", "url", "html")
    trees = trees or model()
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # small groups of pages bound what a worker holds beside the batch
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                blocks = main_blocks(part["html"].tolist(), trees)
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": ["\n\n".join(b) for b in blocks]})

    # the id travels as text: NULL ids would turn whole numbers into floating point
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInPandas(run, "page_id string, url string, text string").withColumn("page_id", F.col("page_id").cast(kind))
