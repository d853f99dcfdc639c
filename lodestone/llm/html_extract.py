"""Main-text extraction by gradient-boosted trees over DOM nodes, decoded over the hierarchy.

A page becomes a tree of block elements; inline markup belongs to the block around it. Every node has
features of its subtree (text, link and tag density, paragraphs, punctuation), its attribute tokens and
its ancestors', its depth and place, and its siblings. Boosted trees give the probability that a node holds main
text. Decoding picks the most likely labelling in which a kept node's ancestors are all kept: by dynamic
programming, a node keeps its best children or drops its whole subtree, so no choice contradicts one above it.

Names on a page's frame say little: a theme puts sidebar-right or comments-open on body, a server one form around
everything. So html and body have no tokens, and an element that holds most of the page and the article in it is a
plain wrapper, whatever its name or kind.

No page here is labelled, so the trees are fitted on generated pages whose main nodes are known: page
skeletons of many shapes with menus, headers, footers, sidebars, notices, adverts, forms and comments.
Their number is the bound of the training set. Elements that never hold text for a reader (scripts,
styles, form controls and the like) are dropped by the parser.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import _to_arrow

# fixed values: HTML's void elements, raw-text elements, inline elements, and those never shown as text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("script style noscript template svg math iframe object embed canvas audio video map head title textarea select option optgroup button input datalist meter progress dialog".split())
# fixed values: start tags that may stand in a head; any other ends it
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
# fixed values: start tags that end an open paragraph, and the open elements that others of a kind end
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("article aside body div footer header main nav section table td th ul ol dl form button".split())
# fixed values: attribute tokens that speak for and against main text
FOR = frozenset("article articles body content entry hentry main page post story text blog prose copy".split())
AGAINST = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disqus footer foot form gdpr header head hidden links login masthead menu meta modal nav navbar navigation newsletter notice overlay pager pagination popup promo related replies reply respond search share sharing sidebar side signup skip social sponsor sponsored subscribe tags toc toolbar widget".split()
)
AGAINST_NAMES = sorted(AGAINST)  # in an order that does not change from run to run
KINDS = {t: k for k, group in enumerate(("article main", "nav menu", "header", "footer", "aside", "form fieldset", "h1 h2 h3 h4 h5 h6", "p blockquote pre", "li ul ol dl dt dd", "table tr td th tbody thead", "section", "div", "body html"), 1) for t in group.split()}

# an attribute as HTML reads it: quotes count only where a value starts; one left open there ends with the tag
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++)"""
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?+)?+)*+)>", re.S)
_PAIR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^\s>]++))?+)?+""")
_NAMES = frozenset("class id role itemprop aria-label data-role".split())
_MAY_HIDE = re.compile("hidden|style", re.I)
_CLIPS = re.compile(r"\b(?:overflow(?:-[xy])?|backface)-hidden\b", re.I)  # class names that hide no text
_NOTE = re.compile(r"/\*.*?\*/", re.S)
_TOKEN = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "children", "hidden", "links", "parent", "pieces", "tag", "tags", "top")

    def __init__(self, tag: str, parent: Node | None, attrs: str = "", hidden: bool = False):
        self.tag, self.parent, self.attrs, self.hidden = tag, parent, attrs, hidden
        self.children: list[Node] = []
        self.pieces: list = []  # texts and child nodes in page order
        self.links = self.tags = 0  # characters in links, inline tags
        self.top = -1


def hides(attrs: str) -> bool:
    """Whether an element is not shown by its own attributes: hidden, aria-hidden=true, or a style that says so.

    Classes say nothing here; they are tokens for the trees."""
    if not _MAY_HIDE.search(attrs):
        return False
    said: dict[str, str] = {}
    for name, *values in _PAIR.findall(attrs):
        said.setdefault(name.lower(), entities.unescape("".join(values)).strip().lower())
    style = {}
    for declared in _NOTE.sub("", said.get("style", "")).split(";"):
        name, _, value = declared.partition(":")
        style[name.strip()] = value.replace("!important", "").strip()
    return "hidden" in said or said.get("aria-hidden") == "true" or style.get("display") == "none" or style.get("visibility") == "hidden"


def parse(source: str) -> Node:
    """The tree of block elements; damaged markup never fails, tags that close nothing are skipped."""
    root = Node("html", None)
    stack: list[tuple[str, Node]] = [("html", root)]  # open elements, inline ones with the block they are in
    at, links = 0, 0

    def leave_head() -> None:
        nonlocal links
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == "head":
                links -= sum(t == "a" for t, _ in stack[k:])
                del stack[k:]

    def text(raw: str) -> None:
        if stack[-1][0] == "head" and raw.strip(" \t\n\r\f"):
            leave_head()
        if raw and not (here := stack[-1][1]).hidden:
            made = entities.unescape(raw) if "&" in raw else raw
            here.pieces.append(made)
            if links:
                here.links += len(made.strip())

    while True:
        m = _TAG.search(source, at)
        if m is None:
            text(source[at:])
            return root
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    links -= sum(t == "a" for t, _ in stack[k:])
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] in SCOPE:
                    break
            continue
        if stack[-1][0] == "head":
            if tag not in IN_HEAD:
                leave_head()
        elif tag == "body" and not any(t == "template" for t, _ in stack):
            leave_head()
        if tag in ENDS_P or tag in ENDS:
            inner, stop = ({"p"}, SCOPE) if tag in ENDS_P else ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in inner:
                    links -= sum(t == "a" for t, _ in stack[k:])
                    del stack[k:]
                    break
                if stack[k][0] in stop:
                    break
        here = stack[-1][1]
        if tag in INLINE:
            here.tags += 1
            if tag == "br":
                here.pieces.append(" ")
            elif tag not in VOID and not m[3].endswith("/"):
                stack.append((tag, here))
                links += tag == "a"
            continue
        if tag in VOID:
            continue
        if tag in ("html", "body") and any(t == tag for t, _ in stack[1:]):
            continue
        node = Node(tag, here, m[3], here.hidden or tag in HIDDEN or bool(m[3]) and hides(m[3]))
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if not node.hidden:
            here.children.append(node)
            here.pieces.append(node)
        stack.append((tag, node))


FEATURES = 38
FRAME = frozenset(("html", "body"))


def wrappers(nodes: list[Node], parents: list[int], x: np.ndarray, chars: np.ndarray) -> list[int]:
    """The nodes, named or of a kind that speaks against main text, that hold most of the page and its article, and the
    headers in an article that hold its h1.

    The article is an h1's parent, or an article, main or well named element with no token against it, with half of the
    node's text: a list of comments has none of these, each comment being a small part of it."""
    n = len(nodes)
    good = ((x[:, 0] == KINDS["article"]) | (x[:, 1] > 0)) & (x[:, 2] == 0)
    most = np.zeros(n)  # the text of the largest article below each node
    title = np.zeros(n, bool)
    for i in range(n - 1, 0, -1):
        p = parents[i]
        most[p] = max(most[p], most[i], chars[i] if good[i] else 0)
        title[p] |= title[i] or nodes[i].tag == "h1"
    inside = np.zeros(n, bool)
    for i in range(1, n):
        inside[i] = inside[parents[i]] or x[parents[i], 0] == KINDS["article"]
    against = (x[:, 2] > 0) | ((x[:, 0] >= 2) & (x[:, 0] <= 6))
    frame = (chars >= 0.5 * chars[0]) & (title | (most >= 0.5 * chars))
    return np.flatnonzero(against & (frame | (inside & title & (x[:, 0] != KINDS["aside"])))).tolist()


def features(root: Node) -> tuple[list[Node], np.ndarray, list[int]]:
    """(nodes in page order, their features, the place of each one's parent)."""
    nodes, parents, todo = [], [], [(root, -1, 0)]
    depth = []
    while todo:
        node, parent, d = todo.pop()
        node.top = len(nodes)
        nodes.append(node)
        parents.append(parent)
        depth.append(d)
        todo += [(c, node.top, d + 1) for c in reversed(node.children)]
    n = len(nodes)
    own = np.zeros((n, 9))  # characters, words, links, inline tags, sentence marks, paragraphs, items, blocks with text, long blocks
    x = np.zeros((n, FEATURES))
    names: list[list[str]] = []
    for i, node in enumerate(nodes):
        t = " ".join([p for p in node.pieces if isinstance(p, str)]).strip()
        if t:
            words = t.count(" ") + 1
            own[i] = (len(t), words, node.links, node.tags, t.count(".") + t.count(",") + t.count("!") + t.count("?"), node.tag == "p", node.tag == "li", 1, words > 20)
        else:
            own[i, 3], own[i, 6] = node.tags, node.tag == "li"
        read = node.attrs and node.tag not in FRAME
        names.append([w.lower() for name, *a in _PAIR.findall(node.attrs) if name.lower() in _NAMES for w in _TOKEN.findall(_CLIPS.sub("", "".join(a)))] if read else [])
    sub = own.copy()
    size = np.ones(n)
    for i in range(n - 1, 0, -1):
        sub[parents[i]] += sub[i]
        size[parents[i]] += size[i]
    x[:, 0] = [KINDS.get(node.tag, 0) for node in nodes]
    x[:, 1] = [sum(w in FOR for w in tokens) for tokens in names]
    x[:, 2] = [sum(w in AGAINST for w in tokens) for tokens in names]
    for i in wrappers(nodes, parents, x, sub[:, 0]):
        x[i, 0], x[i, 1], x[i, 2] = KINDS["div"], 0, 0
    for i in range(n):
        p, kind = parents[i], x[i, 0]
        x[i, 3] = x[i, 1] + (x[p, 3] if p >= 0 else 0)
        x[i, 4] = x[i, 2] + (x[p, 4] if p >= 0 else 0)
        x[i, 5] = (kind == 1) or (p >= 0 and x[p, 5])  # inside article or main
        x[i, 6] = (2 <= kind <= 6) or (p >= 0 and x[p, 6])  # inside nav, header, footer, aside or form
    parent = np.array(parents)
    up = np.where(parent >= 0, parent, 0)
    total = np.maximum(sub[0], 1)
    chars = np.maximum(sub[:, 0], 1)
    before = np.concatenate([[0], np.cumsum(own[:-1, 0])]) / total[0]
    x[:, 7] = np.log1p(sub[:, 0])
    x[:, 8] = np.log1p(own[:, 0])
    x[:, 9] = sub[:, 2] / chars  # link density
    x[:, 10] = own[:, 2] / np.maximum(own[:, 0], 1)
    x[:, 11] = (size + sub[:, 3]) / np.maximum(sub[:, 1], 1)  # tag density
    x[:, 12] = sub[:, 1] / np.maximum(sub[:, 7], 1)  # words a text block
    x[:, 13] = sub[:, 4] / np.maximum(sub[:, 1], 1)  # sentence marks a word
    x[:, 14], x[:, 15], x[:, 16] = np.log1p(sub[:, 5]), np.log1p(sub[:, 6]), np.log1p(sub[:, 8])
    x[:, 17] = sub[:, 0] / total[0]
    x[:, 18] = sub[:, 0] / np.maximum(sub[up, 0], 1)
    x[:, 19] = depth
    x[:, 20] = before
    x[:, 21] = before + sub[:, 0] / total[0]
    x[:, 22] = np.log1p(size)
    siblings = np.bincount(up[1:], minlength=n)
    x[:, 23] = siblings[up]
    for node in nodes:
        kids = [c.top for c in node.children]
        for j, c in enumerate(kids):
            x[c, 24] = j
            x[c, 25] = len(kids) - 1 - j
            if j:
                x[c, 26], x[c, 27] = x[kids[j - 1], 7], x[kids[j - 1], 9]
            if j + 1 < len(kids):
                x[c, 28], x[c, 29] = x[kids[j + 1], 7], x[kids[j + 1], 9]
    x[:, 30] = x[up, 9]
    x[:, 31] = x[up, 12]
    x[:, 32] = x[up, 0]
    x[:, 33] = x[up, 14]
    x[:, 34] = own[:, 1]
    x[:, 35] = own[:, 4] / np.maximum(own[:, 1], 1)
    x[:, 36] = [node.tag == "h1" for node in nodes]
    x[:, 37] = [node.tag in ("h2", "h3", "h4", "h5", "h6") for node in nodes]
    for i in range(n - 1, 0, -1):  # headings of a subtree
        x[parents[i], 36:38] += x[i, 36:38]
    return nodes, x, parents


class Boosted:
    """Gradient-boosted complete trees for a logistic loss, on binned features."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        inner = 2**self.depth - 1
        self.feature = np.zeros((self.trees, inner), np.int32)
        self.cut = np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, inner + 1))
        self.start = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
        score = np.full(len(y), self.start)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                best, pick, where = np.full(count, 1e-6), np.zeros(count, int), np.full(count, np.inf)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = len(e) + 1
                    cell = (at - first) * b + binned[:, f]
                    gs = np.bincount(cell, g, count * b).reshape(count, b).cumsum(1)
                    hs = np.bincount(cell, h, count * b).reshape(count, b).cumsum(1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
                    k = gain.argmax(1)
                    got = gain[np.arange(count), k]
                    better = got > best
                    best[better], pick[better], where[better] = got[better], f, e[k[better]]
                self.feature[t, first : first + count], self.cut[t, first : first + count] = pick, where
                at = 2 * at + 1 + (x[np.arange(len(y)), self.feature[t, at]] > self.cut[t, at])
            leaf = at - inner
            self.leaf[t] = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.l2)
            score += self.leaf[t, leaf]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for t in range(self.trees):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.cut[t, at])
            total += self.leaf[t, at - (2**self.depth - 1)]
        return total


def decode(log_odds: np.ndarray, parents: list[int]) -> np.ndarray:
    """The most likely labels in which no kept node has a dropped ancestor; the root is kept."""
    keep = -np.logaddexp(0, -log_odds)
    drop = -np.logaddexp(0, log_odds)
    n = len(parents)
    for i in range(n - 1, 0, -1):  # children come after their parents
        keep[parents[i]] += max(keep[i], drop[i])
        drop[parents[i]] += drop[i]
    label = np.zeros(n, bool)
    if n:
        label[0] = True
    for i in range(1, n):
        label[i] = label[parents[i]] and keep[i] >= drop[i]
    return label


def blocks(nodes: list[Node], label: np.ndarray) -> list[str]:
    """The texts of kept nodes in page order; a block child cuts the text around it in two."""
    out: list[str] = []

    def close(run: list[str]) -> None:
        made = _SPACE.sub(" ", "".join(run)).strip()
        if made:
            out.append(made)

    todo: list = [iter(nodes[0].pieces)] if nodes else []
    runs: list[list[str]] = [[]]
    while todo:
        for piece in todo[-1]:
            if isinstance(piece, str):
                runs[-1].append(piece)
                continue
            close(runs[-1])
            runs[-1] = []
            if label[piece.top]:
                todo.append(iter(piece.pieces))
                runs.append([])
                break
        else:
            close(runs.pop())
            todo.pop()
    return out


def generated(rng: random.Random) -> tuple[str, str]:
    """A page and the marker that its main blocks carry: training data with known labels."""
    word = lambda: "".join(rng.choice("aeioutnsrlhdcmpg") for _ in range(rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(3, 18).capitalize() + rng.choice([",", "."]) + " " + words(2, 14) + rng.choice(".!?.")
    prose = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'
    some = lambda p, x: x() if rng.random() < p else ""
    inline = lambda t: t if rng.random() < 0.6 else t.replace(" ", f" <{(i := rng.choice(['b', 'em', 'a href=/x', 'span']))}>", 1) + f"</{i.split()[0]}>"

    def attrs(*tokens: str, bare: float = 0.25) -> str:
        if rng.random() < bare:
            return ""
        t = rng.choice(tokens)
        t = rng.choice([t, t, f"{t}-{word()}", f"{word()}-{t}", f"{t} {word()}"])
        return f' {rng.choice(["class", "class", "id"])}="{t}"'

    wrap = lambda tags, tokens, body: f"<{(t := rng.choice(tags))}{attrs(*tokens)}>{body}</{t}>"
    menu = lambda: wrap(["nav", "div", "ul", "nav"], ["nav", "menu", "navbar", "links"], "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 12))) + "</ul>")
    header = lambda: wrap(["header", "div", "header"], ["header", "masthead", "banner", "top"], rng.choice([f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 8)}</p>", f"<div>{words(1, 3)}</div>"]) + some(0.5, menu))
    footer = lambda: wrap(["footer", "div", "footer"], ["footer", "foot", "copyright"], rng.choice([f"&copy; {words(1, 3)} &middot; {rng.choice([words(2, 9), prose(1, 3)])}", f"&copy; {words(1, 3)}", f"<p>{prose(1, 2)}</p>", "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(4)) + "</ul>"]))
    advert = lambda: wrap(["div", "aside", "section", "div"], ["ad", "ads", "advert", "sponsored", "promo", "banner"], rng.choice([prose(1, 4), f"<p>{prose(1, 3)}</p>", link(), f"<a href=/b>{prose(1, 1)}</a>"]))
    side = lambda: wrap(["aside", "div", "aside"], ["sidebar", "side", "widget", "related"], f"<h3>{words(1, 3)}</h3>" + rng.choice(["<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9))) + "</ul>", f"<p>{prose(1, 3)}</p>"]))
    notice = lambda: wrap(["div", "section", "p"], ["cookie", "notice", "consent", "gdpr", "newsletter", "popup"], rng.choice([prose(1, 3), f"<p>{prose(1, 2)}</p>{link()}", f"<p>{prose(1, 2)}</p>"]))
    form = lambda: f"<form{attrs('search', 'login', 'signup', 'form')}><p>{words(1, 8)}</p><label>{words(1, 3)}</label><input name=q>{some(0.5, lambda: f'<p>{prose(1, 2)}</p>')}</form>"
    comment = lambda: wrap(["li", "div", "article"], ["comment", "reply"], f"<p>{words(1, 2)}</p><p>{prose(1, 4)}</p>")
    # a section of comments says what it is, or nothing would tell it from a section of the article
    comments = lambda: f"<{(t := rng.choice(['section', 'div', 'ol']))}{attrs('comments', 'respond', 'replies', 'disqus', bare=0)}><h3>{words(1, 3)}</h3>{''.join(comment() for _ in range(rng.randint(1, 5)))}</{t}>"
    # and links to share a page by say so, or nothing would tell them from a list in the article
    named_share = lambda: f"<{(t := rng.choice(['div', 'ul']))}{attrs('share', 'social', 'tags', 'related', bare=0)}>{''.join(f'<li>{link()}</li>' for _ in range(rng.randint(2, 5)))}</{t}>"

    main = "\x02"

    def part() -> str:
        k = rng.random()
        if k < 0.68:
            return f"<p>{main}{inline(prose(1, 7))}</p>" if rng.random() < 0.75 else f"<p>{main}{words(1, 4).capitalize()}.</p>"
        if k < 0.74:
            return f"<p>{main}<b>{prose(1, 3)}<br><p>{main}{prose(1, 4)}</p>"
        if k < 0.8:
            return f"<h2>{main}{words(1, 6)}</h2>"
        if k < 0.85:
            return "<ul>" + "".join(f"<li>{main}{words(2, 12)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        if k < 0.88:
            return f"<blockquote>{rng.choice(['', '<p>'])}{main}{prose(1, 2)}</blockquote>"
        if k < 0.9:
            return f"<table><tr><td>{main}{words(1, 4)}</td><td>{main}{words(1, 4)}</td></tr></table>"
        if k < 0.93:
            inner = "".join(f"<p>{main}{prose(1, 4)}</p>" for _ in range(rng.randint(1, 3)))
            inner = some(0.5, lambda: f"<h3>{main}{words(1, 5)}</h3>") + inner
            own = lambda: f"<{(t := rng.choice(['section', 'article', 'div', 'figure']))}>{inner}</{t}>"
            return own() if rng.random() < 0.6 else wrap(["section", "div"], ["section", "part", "chapter", "block", word(), word()], rng.choice([inner, own()]))
        if k < 0.95 and rng.random() < 0.6:  # what an article links to is part of it
            entry = lambda: f'<li>{main}{some(0.3, lambda: words(1, 4) + " ")}{link()}{some(0.4, lambda: ", " + words(1, 9))}</li>'
            kind = rng.choice(["ul", "ol", "ul"])
            return some(0.6, lambda: f"<p>{main}{prose(1, 1)}</p>") + f"<{kind}>" + "".join(entry() for _ in range(rng.randint(2, 9))) + f"</{kind}>"
        if k < 0.95:
            return " | ".join(words(1, 1) for _ in range(rng.randint(6, 30))).join([f"<p>{main}", "</p>"])
        return rng.choice([advert, named_share, notice])()

    title = f"<h1>{main}{words(2, 9)}</h1>" if rng.random() < 0.85 else ""
    if title and rng.random() < 0.4:
        title = f"<{(t := rng.choice(['header', 'header', 'div', 'hgroup']))}{attrs('entry-header', 'post-header', 'title', bare=0.4)}>{title}</{t}>"
    body = "".join(part() for _ in range(rng.randint(1, 16)))
    if rng.random() < 0.1:
        body = f"{main}{prose(2, 8)}"
    article = wrap(["article", "main", "div", "section", "article", "td"], ["article", "content", "post", "entry-content", "main", "story", word()], title + body)
    if article.startswith("<td"):
        article = f"<table><tr>{article}<td>{some(0.7, side)}</td></tr></table>"
    if rng.random() < 0.4:
        article = wrap(["div", "main", "section"], ["main", "page", "container", "wrapper", "content"], article + some(0.3, side))
    parts = [some(0.5, header), some(0.75, menu), some(0.35, advert), some(0.2, notice), some(0.2, form), article, some(0.25, comments), some(0.3, side), some(0.2, advert), some(0.8, footer), some(0.12, notice)]
    page = "".join(parts)
    frame = [*AGAINST_NAMES, "single", "logged", "page", "theme"]
    for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):  # frames with names of any kind, and forms around everything
        tokens = " ".join("-".join(rng.sample(frame, rng.randint(1, 2))) for _ in range(rng.randint(1, 4)))
        page = f"<{(t := rng.choice(['div', 'div', 'form', 'section']))}{rng.choice(['', f' class=%s' % repr(tokens)])}>{page}</{t}>"
    tokens = " ".join("-".join(rng.sample(frame, 2)) for _ in range(rng.randint(0, 5)))
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body class='{tokens}'>{page}</body></html>", main


@lru_cache(maxsize=2)
def trained(pages: int = 700, seed: int = 3) -> Boosted:
    """The model, fitted on `pages` generated pages."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        source, mark = generated(rng)
        nodes, _, parents = features(parse(source))
        y = np.array([any(isinstance(p, str) and mark in p for p in node.pieces) for node in nodes])
        for i in range(len(nodes) - 1, 0, -1):
            y[parents[i]] |= y[i]
        nodes, x, _ = features(parse(source.replace(mark, "")))
        xs.append(x)
        ys.append(y)
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def extract(sources: list[str | None], model: Boosted) -> list[str]:
    """The main text of each page: blocks joined by newlines; a null or empty page has an empty text."""
    made = [features(parse(s)) if s else None for s in sources]
    found = [m for m in made if m is not None]
    odds = model.score(np.concatenate([x for _, x, _ in found])) if found else np.zeros(0)
    out, at = [], 0
    for m in made:
        if m is None:
            out.append("")
            continue
        nodes, _, parents = m
        out.append("\n".join(blocks(nodes, decode(odds[at : at + len(nodes)], parents))))
        at += len(nodes)
    return out


def main_text(pages: DataFrame, group: int = 64) -> DataFrame:
    """(page_id, url, text, n_chars), one row a row of pages.

    A null or empty html has an empty text; a very long page is one tree, read whole. Repeated rows give equal
    texts; null ids and urls stay null; nodes whose log-odds tie are kept. An empty table gives no rows. Other
    columns, whatever their names, are not read."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _to_arrow("page_id long, url string, text string, n_chars long")
        for b in batches:
            for i in range(0, b.num_rows, group):  # trees of a few pages at a time
                part = b.slice(i, group)
                texts = extract([None if s is None else s.decode("utf-8", "replace") for s in part.column("html").cast(pa.binary()).to_pylist()], model)
                texts = [t.encode("utf-8", "replace").decode() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=out)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
