"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded from the root down.

Pages are parsed to trees of block elements.  Trees boosted in numpy on pages spun here give each node
the probability that it holds main text, given that its parent does.  Decoding multiplies these along the
path from the root, so a node is kept only if all its ancestors are: choices can't contradict each other.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of the HTML standard by how they are treated.
BLOCK = set("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset details summary address hr dialog menu search hgroup center".split())
SILENT = set("script style head template noscript svg iframe object canvas select button textarea option audio video title".split())
VOID = set("br hr img input meta link area base col embed source track wbr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: A quoted value ends where an attribute may end; where a quote is left open, the tag ends at the next >.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<[a-zA-Z/][^<>]*\Z"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*|[^>]*)>", re.S,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TAGS = ["p", "div", "section", "article", "main", "h1", "h2", "h3", "ul", "li", "table", "td", "blockquote", "pre", "figure", "figcaption", "nav", "header", "footer", "aside", "form", "body", "dl", "details"]
#: Parts of class, id and role names that pages give their regions.
HINTS = {
    "menu": "nav menu breadcrumb toolbar tabs pagination pager toc", "head": "header masthead banner logo branding topbar", "foot": "footer copyright colophon legal bottom",
    "side": "sidebar aside widget related recommend popular trending complementary", "note": "cookie notice consent alert popup modal gdpr newsletter subscribe promo overlay",
    "ad": "ad ads advert advertisement sponsor sponsored banner-ad adsbygoogle dfp", "form": "form login signup search contact", "talk": "comment comments discussion respond disqus replies reply thread",
    "share": "share social follow byline meta tags author", "good": "article content post entry story main body text prose",
}
HINT_SETS = [set(v.split()) for v in HINTS.values()]
AD = re.compile(r"(?:^|[-_ ])ads?(?:$|[-_ ])")


class Node:
    __slots__ = ("tag", "names", "parent", "kids", "parts", "links", "depth", "order", "place")

    def __init__(self, tag: str, names: str, parent: Node | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.kids: list[Node] = []
        self.parts: list[tuple[int, str]] = []  # (kids so far, text)
        self.links = 0
        self.depth = parent.depth + 1 if parent else 0
        self.place = len(parent.kids) if parent else 0


def parse(page: str) -> Node:
    """Tree of block elements; inline mark-up is dropped and its text belongs to the block around it."""
    root = Node("html", "", None)
    node, at, silent, linked = root, 0, "", 0
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            _text(node, page[at : m.start()], linked)
        at = m.end()
        if not m[2]:
            continue
        close, tag = m[1], m[2].lower()
        if tag in SILENT:
            if not close and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else (len(page) if tag in ("script", "style") else at)
            continue
        if tag == "a":
            linked = 0 if close else 1
            continue
        if tag == "br":
            _text(node, " ", 0)
            continue
        if tag not in BLOCK:
            continue
        if close:
            up = node
            while up.parent and up.tag != tag:
                up = up.parent
            if up.parent:
                node, linked = up.parent, 0
            continue
        if tag == "html" or tag == "hr":
            continue
        if node.tag == "p" or node.tag in CLOSED_BY.get(tag, ()):
            node = node.parent or root
            if node.tag in CLOSED_BY.get(tag, ()) and tag == "tr":
                node = node.parent or root
        linked = 0
        names = " ".join(x or y or z for x, y, z in ATTRIBUTE.findall(m[3])).lower() if m[3] else ""
        child = Node(tag, names, node)
        node.kids.append(child)
        if tag not in VOID:
            node = child
    _text(node, page[at:], linked)
    return root


def _text(node: Node, raw: str, linked: int) -> None:
    if raw:
        shown = html.unescape(raw)
        node.parts.append((len(node.kids), shown))
        node.links += len(shown) if linked else 0


FEATURES = len(TAGS) + 2 * len(HINT_SETS) + 17


def features(root: Node) -> tuple[list[Node], np.ndarray]:
    """Nodes in page order and their features: tag, attribute tokens, density of the subtree, depth and siblings."""
    nodes: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        node.order = len(nodes)
        nodes.append(node)
        stack.extend(reversed(node.kids))
    n = len(nodes)
    own = np.array([sum(len(t.strip()) for _, t in x.parts) for x in nodes], "f4")
    link = np.array([x.links for x in nodes], "f4")
    stops = np.array([sum(t.count(". ") + t.count(", ") + t.rstrip().endswith(".") for _, t in x.parts) for x in nodes], "f4")
    whole, links, marks, size, paras = own.copy(), link.copy(), stops.copy(), np.ones(n, "f4"), np.array([x.tag == "p" for x in nodes], "f4")
    for i in range(n - 1, 0, -1):
        up = nodes[i].parent.order
        for a in (whole, links, marks, size, paras):
            a[up] += a[i]
    x = np.zeros((n, FEATURES), "f4")
    t = len(TAGS)
    for i, node in enumerate(nodes):
        if node.tag in TAGS:
            x[i, TAGS.index(node.tag)] = 1
        if node.names:
            tokens = set(re.split(r"[^a-z0-9]+", node.names))
            for k, hints in enumerate(HINT_SETS):
                x[i, t + k] = bool(tokens & hints)
        if node.parent:
            up = node.parent.order
            x[i, t + len(HINT_SETS) : t + 2 * len(HINT_SETS)] = np.maximum(x[up, t + len(HINT_SETS) : t + 2 * len(HINT_SETS)], x[up, t : t + len(HINT_SETS)])
    base = t + 2 * len(HINT_SETS)
    parent = np.array([x.parent.order if x.parent else 0 for x in nodes])
    place = np.array([x.place for x in nodes], "f4")
    brothers = np.array([len(x.parent.kids) if x.parent else 1 for x in nodes], "f4")
    before = np.concatenate(([0], np.cumsum(own)))[:-1]
    cols = [
        np.log1p(own), np.log1p(whole), links / (whole + 1), marks / (whole / 60 + 1), np.log1p(size), whole / (size * 80 + whole + 1), np.array([x.depth for x in nodes], "f4"),
        place / brothers, np.log1p(brothers), whole / (whole[parent] + 1), whole / (whole[0] + 1), before / (own.sum() + 1), np.log1p(paras), links[parent] / (whole[parent] + 1),
        np.array([any(k.tag in ("h1", "h2") for k in x.kids) for x in nodes], "f4"), (before + whole) / (own.sum() + 1), link / (own + 1),
    ]
    x[:, base:] = np.stack(cols, 1)
    return nodes, x


class Boosted:
    """Binary gradient-boosted trees with quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 24):
        self.depth, self.trees = depth, []
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], 1)
        score = np.full(len(y), 0.0)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at = np.zeros(len(y), "i4")
            split: list[tuple[np.ndarray, np.ndarray]] = []
            for level in range(depth):
                cells = 1 << level
                feature, cut, best = np.zeros(cells, "i4"), np.full(cells, np.inf, "f4"), np.full(cells, 1e-6)
                for f, edge in enumerate(self.edges):
                    if not len(edge):
                        continue
                    key = at * (len(edge) + 1) + code[:, f]
                    gs = np.bincount(key, g, cells * (len(edge) + 1)).reshape(cells, -1).cumsum(1)
                    hs = np.bincount(key, h, cells * (len(edge) + 1)).reshape(cells, -1).cumsum(1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + 2) + (gt - gl) ** 2 / (ht - hl + 2) - gt**2 / (ht + 2)
                    j = gain.argmax(1)
                    top = gain[np.arange(cells), j]
                    better = top > best
                    best[better], feature[better], cut[better] = top[better], f, edge[j[better]]
                split.append((feature, cut))
                at = at * 2 + (x[np.arange(len(y)), feature[at]] >= cut[at])
            value = rate * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + 2)
            score += value[at]
            self.trees.append((split, value))

    def probability(self, x: np.ndarray) -> np.ndarray:
        score, row = np.zeros(len(x)), np.arange(len(x))
        for split, value in self.trees:
            at = np.zeros(len(x), "i4")
            for feature, cut in split:
                at = at * 2 + (x[row, feature[at]] >= cut[at])
            score += value[at]
        return 1 / (1 + np.exp(-score))


def spun_page(rng: np.random.Generator) -> str:
    """A made-up page; main-text elements carry the attribute data-main, which is no feature."""
    pick = lambda *a: a[int(rng.integers(len(a)))]
    word = lambda: "".join(pick("ta", "re", "no", "sil", "ver", "o", "an", "de", "mi", "ku") for _ in range(int(rng.integers(1, 4))))
    words = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))
    sentence = lambda: words(3, 14).capitalize() + pick(".", ".", ", " + words(2, 6) + ".", "!")
    prose = lambda a=1, b=7: " ".join(sentence() for _ in range(int(rng.integers(a, b))))
    link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'
    name = lambda *a: f' {pick("class", "id", "class")}="{pick(*a)}"' if rng.random() < 0.85 else ""
    bare = lambda: pick("", "", f' class="{pick("wrap", "row", "col", "box", "inner", "c1", "block")}"')
    M = " data-main"

    def para() -> str:
        kind = rng.random()
        body = prose() if rng.random() < 0.8 else words(1, 12)
        if rng.random() < 0.2:
            body = f"<b>{body}" + pick("</b>", "<br>", "")
        if rng.random() < 0.15:
            body += " " + link() + " " + prose(1, 3)
        if kind < 0.7:
            return f"<p{M}>{body}" + pick("</p>", "</p>", "")
        if kind < 0.78:
            return f"<h2{M}>{words(1, 7)}</h2><p{M}>{body}</p>"
        if kind < 0.84:
            return f"<ul{M}>" + "".join(f"<li{M}>{prose(1, 3)}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>"
        if kind < 0.88:
            return f"<blockquote{M}><p{M}>{body}</p></blockquote>"
        if kind < 0.91:
            return f"<pre{M}>{words(3, 20)}</pre>"
        if kind < 0.94:
            return f"<table{M}><tr{M}><td{M}>{words(1, 5)}</td><td{M}>{words(1, 5)}</td></tr></table>"
        return f"<div{M}{bare()}><p{M}>{body}</p></div>"

    def junk() -> str:
        return pick(
            lambda: f'<{(t := pick("nav", "div", "ul"))}{name("nav", "menu", "main-menu", "breadcrumb", "pagination")}><ul>' + "".join(f"<li>{link()}</li>" for _ in range(int(rng.integers(2, 9)))) + f"</ul></{t}>",
            lambda: f'<div class="{pick("ad", "ads", "ad-slot", "advert", "sponsored", "ad banner", "advertisement")}">' + pick(prose(1, 4), f"<p>{prose(1, 3)}</p>", link()) + "</div>",
            lambda: f'<aside{name("sidebar", "related", "widget")}><h3>{words(1, 4)}</h3>' + pick(f"<p>{prose()}</p>", "<ul>" + f"<li>{link()}</li>" * 3 + "</ul>") + "</aside>",
            lambda: f'<div class="{pick("cookie-notice", "consent", "newsletter", "alert notice", "popup", "promo")}"><p>{prose(1, 4)}</p></div>',
            lambda: f'<form{name("search", "login", "subscribe-form")}><p>{words(1, 8)}</p><label>{words(1, 3)}</label><input></form>',
            lambda: f'<div class="{pick("sidebar", "side", "related-posts", "share", "social", "widget")}"><h3>{words(1, 3)}</h3><p>{prose(1, 5)}</p></div>',
        )()

    def comments() -> str:
        each = "".join(f'<{(t := pick("div", "li", "article"))}{name("comment", "comment-body", "reply")}><h4>{words(1, 3)}</h4><p>{prose()}</p></{t}>' for _ in range(int(rng.integers(1, 7))))
        return f'<{(t := pick("section", "div", "ol"))} {pick("class", "id")}="{pick("comments", "discussion", "comment-list", "respond", "disqus_thread")}"><h3>{words(1, 3)}</h3>{each}</{t}>'

    body = [para() for _ in range(int(rng.integers(1, 12)))]
    if rng.random() < 0.3:
        body.insert(int(rng.integers(len(body) + 1)), junk())
    title = f"<h1{M}>{words(1, 12)}</h1>"
    if rng.random() < 0.2:
        title = f"<header{M}>{title}</header>"
    tag = pick("article", "article", "article", "main", "div", "section")
    names = name("content", "post", "article-body", "entry-content", "story", "text") if tag != "article" else pick("", name("post", "story", "article"))
    core = f"<{tag}{M}{names}>{title}{''.join(body)}</{tag}>"
    for _ in range(int(rng.integers(0, 3))):
        extra = "".join(junk() for _ in range(int(rng.integers(0, 2))))
        t = pick("div", "main", "section")
        core = f"<{t}{M}{bare()}>{core}{extra}</{t}>"
    head = pick("", f'<header{name("header", "masthead", "site-header")}><p>{words(1, 5)}</p>{junk() if rng.random() < 0.5 else ""}</header>', f'<div class="{pick("header", "masthead", "topbar")}">{words(1, 6)}</div>')
    foot = pick("", f"<footer>&copy; {words(1, 3)} &middot; {prose(1, 4)}</footer>", f'<div class="{pick("footer", "site-footer", "copyright")}"><p>{prose(1, 3)}</p></div>', f"<footer><p>{prose(1, 3)}</p><ul><li>{link()}</li></ul></footer>")
    parts = [head, *[junk() for _ in range(int(rng.integers(0, 4)))], core, comments() if rng.random() < 0.35 else "", *[junk() for _ in range(int(rng.integers(0, 2)))], foot]
    return f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><script>var a='<p>';</script></head><body{M}>{''.join(parts)}" + pick("</body></html>", "")


def _is_main(page: str) -> list[bool]:
    """data-main of each node in page order, read with the same parser through a class token."""
    marked = parse(page.replace(" data-main", ' role="datamain"'))
    return ["datamain" in x.names or x.parent is None for x in features(marked)[0]]


@lru_cache(maxsize=1)
def trained(pages: int = 1500, seed: int = 9) -> Boosted:
    """Trees learned on spun pages, from the nodes whose parent holds main text."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = spun_page(rng)
        want = _is_main(page)
        nodes, x = features(parse(page.replace(" data-main", "")))
        use = [i for i, node in enumerate(nodes) if node.parent and want[node.parent.order]]
        xs.append(x[use])
        ys.append(np.array([want[i] for i in use], "f4"))
    return Boosted(np.concatenate(xs), np.concatenate(ys))


def main_text(page: str | None, model: Boosted, threshold: float = 0.5) -> str:
    """Blocks of main text in page order, one a line; empty for a null page or one without any."""
    if not page:
        return ""
    root = parse(page)
    nodes, x = features(root)
    p = model.probability(x)
    p[0] = 1.0
    for i in range(1, len(nodes)):
        p[i] *= p[nodes[i].parent.order]
    blocks: list[str] = []
    pending: list[str] = []

    def flush() -> None:
        if pending and (said := " ".join("".join(pending).split())):
            blocks.append(said)
        pending.clear()

    def walk() -> None:
        todo: list = [root]
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                pending.append(item)
                continue
            if item is None:
                flush()
                continue
            if p[item.order] < threshold:
                continue
            seq: list = [None]
            texts = iter(item.parts)
            now = next(texts, None)
            for k in range(len(item.kids) + 1):
                while now and now[0] == k:
                    seq.append(now[1])
                    now = next(texts, None)
                if k < len(item.kids):
                    seq += [None, item.kids[k], None]
            seq.append(None)
            todo.extend(reversed(seq))
        flush()

    walk()
    return "\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages, from its whole html.

    Null html counts as empty; text is empty where nothing is found.  Text that stands right in html, in no
    other block, is main text.  Repeated rows and null ids stay; an empty table gives an empty one.
    """
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x.as_py(), model) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
