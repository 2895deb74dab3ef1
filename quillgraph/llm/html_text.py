"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every block element is a node with a binary label: its own text is content or not. A node's potential
comes from its tag, names, text and links; an edge's from the labels of parent and child. Sum-product
messages go up from the leaves and down from the root once, which gives exact marginals in time linear
in the page. Training maximises the likelihood of labelled pages (made here from templates with a
fixed seed: articles amid menus, banners, notices, adverts, forms, side columns and comments).
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES, TRAIN_STEPS, SEED = 200, 90, 5

#: Elements by their role in HTML.
BLOCKS = frozenset("html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption legend".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title iframe svg math canvas object audio video select option textarea button datalist".split())
RAW = frozenset("script style title textarea iframe noscript".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("thead",), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = frozenset("table ul ol dl html body article section div td th".split())
#: Words in class, id and role that tell what a part of a page is for.
ROLES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc skip", "head": "head header banner masthead logo topbar brand", "foot": "foot footer copyright legal colophon",
    "side": "side sidebar aside related recommend recommended popular widget rail trending more", "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense adbox", "notice": "cookie cookies consent notice gdpr alert modal popup overlay newsletter subscribe signup warning paywall",
    "comment": "comment comments disqus reply replies respond discussion", "share": "share social sharing follow like tags meta byline", "form": "form search login contact feedback",
    "content": "article content main post entry story body text page",
}
ROLE_OF = {w: r for r, ws in ROLES.items() for w in ws.split()}

#: A tag with its quotes in pairs, and one that ends at the next sign whatever its quotes.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
OTHER = re.compile(r"<([!?/])([^>]*+)()>")
COMMENT_END = re.compile(r"--!?>")
#: Tags of a page whose quotes have no end; after these all its tags end at the next sign, so that parsing stays linear.
MOST_UNPAIRED = 16
NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
PLAIN = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "names", "chars", "linked", "children", "runs", "marks", "label")

    def __init__(self, tag: str, parent: int, names: str):
        self.tag, self.parent, self.names = tag, parent, names
        self.chars = self.linked = self.children = self.runs = 0
        self.marks = 0
        self.label = -1


class Markup:
    """The tags, comments and declarations of a page, found in one pass."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.unpaired, self.comments_end = 0, True

    def next(self, at: int) -> tuple[int, int, re.Match | None]:
        """(begin, end, match if it is a tag) of the next piece of markup from `at` on; begin < 0 if there is none."""
        at = self.page.find("<", at)
        while 0 <= at < self.last:
            if self.page.startswith("<!--", at) and self.comments_end:
                end = COMMENT_END.search(self.page, at + 4)
                if end:
                    return at, end.end(), None
                self.comments_end = False
            m = TAG.match(self.page, at) if self.unpaired < MOST_UNPAIRED else None
            if m is None:
                m = LOOSE_TAG.match(self.page, at)
                self.unpaired += m is not None
            if m:
                return at, m.end(), m
            other = OTHER.match(self.page, at)
            if other:
                return at, other.end(), None
            at = self.page.find("<", at + 1)
        return -1, len(self.page), None


def parse(page: str, labelled: bool = False) -> tuple[list[Node], list[tuple[int, str]]]:
    """(block nodes, parents first; text blocks in page order as (node, text with white space folded)).

    `labelled` pages, made for training, say in an attribute data-y what is content."""
    nodes = [Node("#root", -1, "")]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements with the block node that their text goes to
    out: list[tuple[int, str]] = []
    run: list[str] = []
    silent = links = 0
    at, size = 0, len(page)
    markup, opened = Markup(page), Counter()  # how many elements of each tag are open

    def flush() -> None:
        nonlocal run
        if run:
            text = " ".join("".join(run).split())
            if text:
                node = nodes[stack[-1][1]]
                out.append((stack[-1][1], text))
                node.chars += len(text)
                node.runs += 1
                node.marks += text.count(". ") + text.endswith((".", "!", "?"))
            run = []

    def close(k: int) -> None:
        """Close the open elements from k on."""
        nonlocal silent, links
        if any(t in BLOCKS for t, _ in stack[k:]):
            flush()
        for t, _ in stack[k:]:
            opened[t] -= 1
            silent -= t in SILENT
            links -= t == "a"
        del stack[k:]

    while at < size:
        begin, end, m = markup.next(at)
        said = page[at : begin if begin >= 0 else size]
        if said and not silent:
            if "&" in said:
                said = html.unescape(said)
            run.append(said)
            if links:
                nodes[stack[-1][1]].linked += len(said)
        if begin < 0:
            break
        at = end
        if m is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in CLOSES_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        for k in range(len(stack) - 1, 0, -1) if any(opened[t] for t in CLOSED_BY.get(tag, ())) else ():
            if stack[k][0] in CLOSED_BY[tag]:
                close(k)
                break
            if stack[k][0] in SCOPE:
                break
        if tag == "body" and silent and opened["head"]:
            close(next(k for k, (t, _) in enumerate(stack) if t == "head"))
        if tag == "br":
            run.append(" ")
        if tag in BLOCKS:
            flush()
            names = ""
            if m.group(3):
                names = " ".join(x or y or z for x, y, z in NAMED.findall(m.group(3)))
            parent = stack[-1][1]
            nodes[parent].children += 1
            nodes.append(Node(tag, parent, names))
            if labelled and "data-y" in m.group(3):
                nodes[-1].label = int("data-y=1" in m.group(3))
        if tag in VOID or m.group(3).endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        silent += tag in SILENT
        links += tag == "a"
        opened[tag] += 1
        stack.append((tag, len(nodes) - 1 if tag in BLOCKS else stack[-1][1]))
    flush()
    return nodes, out


@lru_cache(maxsize=4096)
def _roles(names: str) -> tuple[str, ...]:
    words = PLAIN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower())
    return tuple(sorted({f"role:{ROLE_OF[w]}" for w in words if w in ROLE_OF}))


def features(n: Node) -> list[str]:
    roles = _roles(n.names)
    out = ["bias", f"tag:{n.tag}:{'+'.join(roles) or 'bare'}", *roles]
    if n.chars:
        out.append(f"chars:{min(n.chars.bit_length(), 10)}")
        dense = n.linked / n.chars
        out.append("links:most" if dense > 0.5 else "links:some" if dense > 0.1 else "links:none")
        out.append("ends:yes" if n.marks else "ends:no")
    else:
        out.append("empty")
    return out


SMALL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th tr blockquote pre figcaption".split())
#: The frame of a page says nothing about its parts.
FRAME = frozenset(("#root", "html", "body"))


def edge(parent: Node, child: Node) -> tuple[str, str] | None:
    """Names of an edge's weights: both nodes content, both not."""
    if parent.tag in FRAME:
        return None
    return ("edge:small:11", "edge:small:00") if child.tag in SMALL else ("edge:part:11", "edge:part:00")


def beliefs(nodes: list[Node], w: dict[str, float], known: list[list[str]] | None = None) -> tuple[list[float], list[float], list[float]]:
    """Log-odds of content of each node: (final, from below, of the parent without this child)."""
    exp, log = math.exp, math.log
    get = w.get
    up = [sum([get(f, 0.0) for f in fs]) for fs in (known or map(features, nodes))]
    sent = [0.0] * len(nodes)
    both = [(get(e[0], 0.0), get(e[1], 0.0)) if (e := edge(nodes[n.parent], n)) else (0.0, 0.0) for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        b, (one, zero) = max(-30.0, min(30.0, up[i])), both[i]
        sent[i] = log((1 + exp(one + b)) / (exp(zero) + exp(b)))
        up[nodes[i].parent] += sent[i]
    full, rest = up[:], [0.0] * len(nodes)
    for i in range(1, len(nodes)):
        rest[i] = max(-30.0, min(30.0, full[nodes[i].parent] - sent[i]))
        one, zero = both[i]
        full[i] += log((1 + exp(one + rest[i])) / (exp(zero) + exp(rest[i])))
    return full, up, rest


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


@lru_cache(maxsize=1)
def weights() -> tuple[tuple[str, float], ...]:
    rnd = random.Random(SEED)
    pages = [(nodes, [*map(features, nodes)]) for nodes in (parse(_page(rnd), labelled=True)[0] for _ in range(TRAIN_PAGES))]
    w: dict[str, float] = {}
    seen: dict[str, float] = {}
    for _ in range(TRAIN_STEPS):
        g: dict[str, float] = {}
        for nodes, known in pages:
            full, up, rest = beliefs(nodes, w, known)
            for i, n in enumerate(nodes):
                y = max(n.label, 0)
                e = y - _sigmoid(full[i])
                for f in known[i]:
                    g[f] = g.get(f, 0.0) + e
                if i and (e := edge(nodes[n.parent], n)):
                    one, zero = e
                    b, t = max(-30.0, min(30.0, up[i])), rest[i]
                    z = [math.exp(w.get(zero, 0.0)), math.exp(b), math.exp(t), math.exp(w.get(one, 0.0) + b + t)]
                    s, yp = sum(z), max(nodes[n.parent].label, 0)
                    g[one] = g.get(one, 0.0) + (y and yp) - z[3] / s
                    g[zero] = g.get(zero, 0.0) + (not y and not yp) - z[0] / s
        for f, v in g.items():
            v -= 0.02 * w.get(f, 0.0)
            seen[f] = seen.get(f, 1e-6) + v * v
            w[f] = w.get(f, 0.0) + 2.0 * v / math.sqrt(seen[f])
    return tuple(sorted(w.items()))


def _page(rnd: random.Random) -> str:
    """A labelled page: block elements carry data-y=1 where their own text is the article's."""
    word = lambda: "".join(rnd.choice(("an", "er", "in", "th", "on", "re", "la", "de", "ch", "ou", "st", "al")) for _ in range(rnd.randint(1, 4)))
    line = lambda a, b: " ".join(word() for _ in range(rnd.randint(a, b)))
    text = lambda: " ".join(f"{line(3, 14).capitalize()}." for _ in range(rnd.randint(1, 6)))
    pick = rnd.choice

    def el(tag: str, inner: str, y: int, names: str = "") -> str:
        return f"<{tag}{f' class="{names}"' if names else ''} data-y={y}>{inner}</{tag}>"

    def links(n: int) -> str:
        return el("ul", "".join(el("li", f'<a href="/{k}">{line(1, 3)}</a>', 0) for k in range(n)), 0)

    def menu() -> str:
        return pick((el("nav", links(rnd.randint(3, 9)), 0), el("div", links(rnd.randint(3, 9)), 0, pick(("nav", "menu", "navbar", "breadcrumbs", "main-menu"))), el("div", " | ".join(f'<a href="#">{word()}</a>' for _ in range(6)), 0, "navigation")))

    def head() -> str:
        return pick((el("header", el("h1", line(1, 3), 0) + menu(), 0), el("div", el("p", line(2, 5), 0), 0, "masthead"), el("header", f'<a href="/">{word()}</a>', 0, "site-header"), ""))

    def foot() -> str:
        return pick((el("footer", f"&copy; {word()} &middot; {text()}", 0), el("div", el("p", f"&copy; {line(2, 6)}.", 0) + links(3), 0, "footer"), el("footer", el("p", text(), 0), 0), ""))

    def side() -> str:
        return pick((el("aside", el("h3", line(1, 3), 0) + links(5), 0), el("div", el("h4", line(1, 3), 0) + el("p", text(), 0), 0, pick(("sidebar", "widget", "related-posts"))), el("aside", el("p", text(), 0) * 2, 0), ""))

    def advert() -> str:
        return el(pick(("div", "div", "section", "aside")), pick((text(), el("p", text(), 0), f'<a href="x">{line(3, 8)}</a>', el("h3", line(2, 4), 0) + el("p", text(), 0))), 0, pick(("ad", "ads", "advert", "sponsored", "ad-box", "promo", "banner-ad")))

    def notice() -> str:
        return pick((el("div", text(), 0, pick(("cookie-notice", "consent", "alert", "newsletter", "gdpr", "notice"))), el("div", el("p", text(), 0), 0, "popup"), el("dialog", el("p", text(), 0), 0), el("section", el("p", text(), 0), 0, "newsletter-signup")))

    def form() -> str:
        return el("form", el("p", line(2, 8), 0) + "<label>" + line(1, 2) + "</label><input type=text><button>" + word() + "</button>", 0, pick(("", "search", "login")))

    def comments() -> str:
        one = lambda: pick((el("div", el("p", text(), 0), 0, "comment"), el("li", el("p", text(), 0), 0, "comment-item"), el("article", el("p", text(), 0), 0, "comment")))
        return el(pick(("section", "div")), el("h3", line(1, 2), 0) + "".join(one() for _ in range(rnd.randint(1, 4))), 0, pick(("comments", "comment-list", "discussion", "replies")))

    def share() -> str:
        return el("div", f'<a href="#">{word()}</a> <a href="#">{word()}</a>', 0, pick(("share", "social")))

    def body() -> str:
        parts = [el(pick(("h1", "h1", "h2")), line(2, 9), 1)]
        for _ in range(rnd.randint(1, 9)):
            parts.append(pick((lambda: el("p", text(), 1), lambda: el("p", text(), 1), lambda: el("p", text(), 1), lambda: el("p", f"<b>{line(1, 5)}.", 1), lambda: el("p", line(1, 2), 1), lambda: el("p", line(40, 200), 1), lambda: el("p", text() * 4, 1), lambda: el("p", f"<b>{line(20, 90)}", 1), lambda: el("h2", line(1, 6), 1), lambda: el("ul", "".join(el("li", line(2, 12), 1) for _ in range(3)), 1), lambda: el("ol", "".join(el("li", text(), 1) for _ in range(3)), 1), lambda: el("blockquote", pick((text(), el("p", text(), 1))), 1), lambda: el("pre", text(), 1), lambda: el("figure", el("figcaption", line(2, 8), 1), 1), lambda: el("table", el("tr", el("td", word(), 1) + el("td", word(), 1), 1), 1), lambda: el("section", el("h3", line(1, 4), 1) + el("p", text(), 1), 1), lambda: el("div", text(), 1)))())
            if rnd.random() < 0.12:
                parts.append(pick((advert, share, notice, form))())
        if rnd.random() < 0.35:
            parts += [el("p", line(1, 4), 1) for _ in range(rnd.randint(5, 40))]
        return "".join(parts)

    main = pick((lambda b: el("article", b, 1), lambda b: el("article", b, 1, "post"), lambda b: el("main", el("article", b, 1), 1), lambda b: el("div", b, 1, pick(("content", "post-body", "entry-content", "article", "story", "main-text"))), lambda b: el("main", b, 1), lambda b: el("div", el("div", b, 1, "article-body"), 1, "main"), lambda b: el("section", b, 1, "content")))(body())
    before = [p() for p in rnd.sample([head, menu, advert, notice, share, side, form], rnd.randint(1, 4))]
    after = [p() for p in rnd.sample([side, advert, comments, share, form, notice, menu], rnd.randint(0, 4))] + [foot()]
    inner = "".join([*before, main, *after])
    if rnd.random() < 0.3:
        inner = el("div", inner, 0, pick(("", "wrapper", "page", "container")))
    return f"<html data-y=0><head><title>{word()}</title></head><body data-y=0>{inner}</body></html>"


def main_text(page: str, w: dict[str, float]) -> str:
    nodes, blocks = parse(page)
    full = beliefs(nodes, w)[0]
    return " ".join(text for k, text in blocks if full[k] > 0)


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page: the marginally likely content, in page order.

    A null or empty page, or one without likely content, has the empty text. Null ids, repeated rows
    and further columns do no harm: each row gives one. An empty table gives an empty result."""
    shared = pages.sparkSession.sparkContext.broadcast(dict(weights()))  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [main_text(p, shared.value) if p else "" for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
