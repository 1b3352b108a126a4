"""HTML extraction by a tree-structured graphical model.

Block elements of a page are the nodes of a tree, and so is text that stands beside block elements; each is content, holds none, or holds
content and more. A node's potential comes from what can be seen of it: its tag, the words of its class, id and role, and, in any language, its
amount of text, also next to its siblings and the page, the length of its blocks, where on the page it stands, its share of link text, sentence
marks and form fields. An edge's potential comes from the kind of the child. Sum-product messages go up and down once, as logarithms, and give every
node's exact marginal; text that stands directly in a node with a content marginal over one half belongs to the main text.

Potentials are counted, with add-one smoothing, over labelled pages: a page and its content text; a node counts as content if at
least ``LABEL_SHARE`` of its text stands in content blocks, and as neutral if less but some does. Amounts say much the same of a node, so
each of their potentials counts to the power ``AMOUNTS``. ``fit`` counts on Spark. The query trains on ``TRAINING_PAGES``
made-up pages (``labelled_pages``: articles in several layouts among menus, headers, footers, sidebars, notices, adverts,
forms and comments, half of them without names that say what they are); this number bounds what is sent to the driver.

Text: character references are decoded, white space inside a block (line break elements too) becomes one space, blocks are trimmed and
joined by line ends in page order; formulas are text like any other. A page of text without block elements is its text. Buttons, selections and text fields have no text. Cases: null or empty html gives an empty text; text without
markup is one block of the root; unclosed, misnested and cut-off markup is read as far as it goes: a tag without an end ends the page, an attribute value without its closing
quote ends at the next ``>``, a script, style, title or frame without an end takes the rest of the page, and other skipped elements without an end are read; repeated rows are
extracted one by one; an empty table gives an empty table. Nothing is dropped for its length, and reading is linear in it, whatever the markup. Only the id, URL and html columns are read.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import exp, log, log1p

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slate.llm.batches import sliced

TRAINING_PAGES = 1500
LABEL_SHARE = 0.8
AMOUNTS = 0.3
#: A word of names counts if so many nodes of the training pages have it.
NAMED = 4

#: Element kinds of HTML.
RAW = frozenset("script style noscript template iframe svg object textarea title head button select".split())
TO_THE_END = frozenset("script style title textarea iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "math semantics mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mstyle mover munder munderover mspace mpadded mphantom mtable mtr mtd "
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter nobr output picture progress q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br source link meta".split()
)
CLOSED_BY = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
SCOPE = ("ul", "ol", "dl", "table")
PLAIN = ("html", "body", "#text")
FIELDS = frozenset("input select textarea button option".split())

_MARKUP = re.compile("<(/?)([a-zA-Z][^\\s/>]*)|<!--|<[!?/]")
_PLACE = re.compile("[>=]")
_QUOTE = re.compile("=\\s*([\"']?)")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TEXT_NODE = "#text"


@dataclass(slots=True)
class Node:
    parent: int
    tag: str
    names: str = ""
    #: Characters of the page's text before this node.
    before: int = 0
    chars: int = 0
    blocks: int = 0
    link_chars: int = 0
    marks: int = 0
    fields: int = 0
    signs: int = 0


@dataclass(slots=True)
class Page:
    nodes: list[Node] = field(default_factory=lambda: [Node(-1, "#root")])
    #: (node, text) in page order.
    blocks: list[tuple[int, str]] = field(default_factory=list)
    #: Number of block elements in each node.
    inner: Counter[int] = field(default_factory=Counter)


class _Tags:
    """Where tags end. A place from which no end was found is kept, so none is read twice and the whole is linear."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.dead: set[int] = set()
        self.unended: set[str] = set()

    def end(self, at: int) -> int:
        """The ``>`` that ends a tag whose name ends at ``at``; -1 if there is none."""
        html, place, passed = self.html, at, []
        while place not in self.dead:
            passed.append(place)
            if (m := _PLACE.search(html, place)) is None:
                break
            if m[0] == ">":
                return m.start()
            quote = _QUOTE.match(html, m.start())
            place = html.find(quote[1], quote.end()) + 1 if quote[1] else quote.end()
            if not place:
                break
        self.dead.update(passed)
        return html.find(">", at)

    def past(self, tag: str, at: int) -> int:
        """Where an element that is skipped ends."""
        if tag not in self.unended:
            m = _closing(tag).search(self.html, at)
            if m and m[0] == "<body":
                return m.start()
            if m and (end := self.html.find(">", m.end())) >= 0:
                return end + 1
            self.unended.add(tag)
        return len(self.html) if tag in TO_THE_END else at


_ENDS: dict[str, re.Pattern[str]] = {}


def _closing(tag: str) -> re.Pattern[str]:
    if tag not in _ENDS:
        _ENDS[tag] = re.compile(rf"</{tag}(?![^\s/>])" + (r"|<body(?![^\s/>])" if tag == "head" else ""), re.I)
    return _ENDS[tag]


def parse(html: str) -> Page:
    """Block elements and their own texts."""
    page = Page()
    nodes, blocks = page.nodes, page.blocks
    stack = [0]
    #: Places in the stack of the open elements of each tag.
    opened: dict[str, list[int]] = defaultdict(list)
    pending: list[str] = []
    links = read = linked = 0
    tags = _Tags(html)

    def flush() -> None:
        nonlocal read, linked
        if pending:
            text = " ".join(unescape("".join(pending)).split())
            pending.clear()
            if text:
                blocks.append((stack[-1], text))
                read += len(text)
                node = nodes[stack[-1]]
                node.chars += len(text)
                node.blocks += 1
                node.link_chars += min(linked, len(text))
                node.marks += sum(map(text.count, ".,?!"))
                node.signs += "\u00a9" in text
            linked = 0

    def back_to(k: int) -> None:
        """Closes the open elements from place ``k`` of the stack on."""
        flush()
        while len(stack) > k:
            opened[nodes[stack.pop()].tag].pop()

    at, size = 0, len(html)
    while at < size:
        m = _MARKUP.search(html, at)
        upto = m.start() if m else size
        if upto > at:
            pending.append(html[at:upto])
            if links:
                linked += upto - at
        if not m:
            break
        if not m[2]:
            end = html.find("-->", m.end()) + 3 if m[0] == "<!--" else html.find(">", m.end()) + 1
            at = end if end > m.end() else size
            continue
        closing, tag = m[1], m[2].lower()
        end = tags.end(m.end())
        if end < 0:
            break
        rest, at = html[m.end() : end], end + 1
        if tag in RAW:
            if not closing:
                nodes[stack[-1]].fields += tag in FIELDS
                if not rest.endswith("/"):
                    at = tags.past(tag, at)
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                pending.append(" ")
            if tag in FIELDS and not closing:
                nodes[stack[-1]].fields += 1
            continue
        links = 0
        if closing:
            if opened[tag]:
                back_to(opened[tag][-1])
            else:
                flush()
            continue
        flush()
        if nodes[stack[-1]].tag == "p":
            back_to(len(stack) - 1)
        if tag in CLOSED_BY:
            nearest = max((opened[t][-1] for t in CLOSED_BY[tag] if opened[t]), default=0)
            if nearest > max((opened[t][-1] for t in SCOPE if opened[t]), default=0):
                back_to(nearest)
        page.inner[stack[-1]] += 1
        nodes.append(Node(stack[-1], tag, " ".join(x or y or z for x, y, z in _NAMES.findall(rest)) if "=" in rest else "", read))
        if tag not in VOID:
            opened[tag].append(len(stack))
            stack.append(len(nodes) - 1)
    flush()
    _part_texts(page)
    return page


def _part_texts(page: Page) -> None:
    """Text beside block elements becomes a node of its own."""
    before = 0
    for k, (i, text) in enumerate(page.blocks):
        if page.inner[i]:
            signs, marks = "\u00a9" in text, sum(map(text.count, ".,?!"))
            above = page.nodes[i]
            share = above.link_chars * len(text) // max(above.chars, 1)
            page.nodes.append(Node(i, TEXT_NODE, "", before, len(text), 1, share, marks, 0, signs))
            page.blocks[k] = (len(page.nodes) - 1, text)
        before += len(text)
    for i in {page.nodes[i].parent for i, _ in page.blocks if page.nodes[i].tag == TEXT_NODE}:
        above = page.nodes[i]
        above.chars = above.blocks = above.link_chars = above.marks = above.signs = 0


def _bucket(x: float, edges: tuple[float, ...]) -> int:
    return sum(x > e for e in edges)


def features(page: Page) -> list[list[str]]:
    """What is seen of every node: first its kind, then its amounts, then the words of its names. Amounts are those of the whole subtree."""
    nodes = page.nodes
    # texts beside elements come last, so their amounts are added first
    for i in range(len(nodes) - 1, 0, -1):
        node, up = nodes[i], nodes[nodes[i].parent]
        up.chars += node.chars
        up.blocks += node.blocks
        up.link_chars += node.link_chars
        up.marks += node.marks
        up.fields += node.fields
        up.signs += node.signs
    largest = [0] * len(nodes)
    for node in nodes[1:]:
        largest[node.parent] = max(largest[node.parent], node.chars)
    whole = max(nodes[0].chars, 1)
    out = []
    for node in nodes:
        chars = max(node.chars, 1)
        own = [
            f"tag {node.tag}",
            f"chars {_bucket(node.chars, (0, 15, 60, 250, 1000))} {node.tag}",
            f"links {(linked := _bucket(node.link_chars / chars, (0.05, 0.3, 0.7)))}",
            f"linked {linked} {node.tag}",
            f"marks {_bucket(100 * node.marks / chars, (0.3, 1, 4))}",
            f"length {_bucket(node.chars / max(node.blocks, 1), (12, 30, 70, 160))}",
            f"beside {_bucket(node.chars / max(largest[node.parent], 1), (0.03, 0.15, 0.4, 0.99)) if node.parent >= 0 else 4}",
            f"share {_bucket(node.chars / whole, (0.02, 0.1, 0.4, 0.8))}",
            f"start {_bucket(node.before / whole, (0, 0.05, 0.25, 0.75, 0.93))}",
            f"fields {_bucket(node.fields, (0, 2))}",
            f"signs {_bucket(node.signs, (0,))}{_bucket(node.chars, (250,))}",
        ]
        if node.names:
            own += {f"name {part.lower()}" for part in _PART.findall(node.names)}
        out.append(own)
    return out


#: States of a node: it holds content and more (neutral), is content, or holds none.
NEUTRAL, CONTENT, NOISE = STATES = (0, 1, 2)


def _sum(x: float, y: float, z: float) -> float:
    """The logarithm of a sum, from the logarithms of its parts."""
    top = x if x > y else y
    top = z if z > top else top
    return top + log(exp(x - top) + exp(y - top) + exp(z - top))


def _normal(x: list[float]) -> list[float]:
    """Logarithms of shares of one."""
    total = _sum(*x)
    return [v - total for v in x]


@dataclass
class Model:
    """Log probabilities of node features by state, and of child given parent by the child's kind."""

    root: list[float]
    feature: dict[str, list[float]]
    edge: dict[str, list[list[float]]]

    def _potential(self, names: list[str]) -> list[float]:
        x = y = z = 0.0
        for name in names:
            if (w := self.feature.get(name)) is not None:
                x, y, z = x + w[0], y + w[1], z + w[2]
        return [x, y, z]

    def marginals(self, page: Page) -> list[float]:
        """The content probability of every node, by sum-product messages up and down the tree."""
        nodes, seen = page.nodes, features(page)
        edges = [self.edge.get(own[0], self.edge["tag"]) for own in seen]
        # what a node's own potential and the messages from its children say
        below = [self._potential(names) for names in seen]
        up = [[0.0, 0.0, 0.0]] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            x, y, z = below[i]
            up[i] = message = _normal([_sum(row[0] + x, row[1] + y, row[2] + z) for row in edges[i]])
            into = below[nodes[i].parent]
            for s in STATES:
                into[s] += message[s]
        belief = below
        belief[0] = _normal([a + b for a, b in zip(belief[0], self.root, strict=True)])
        for i in range(1, len(nodes)):
            # what the parent believes without this child's message
            x, y, z = (a - b for a, b in zip(belief[nodes[i].parent], up[i], strict=True))
            first, second, third = edges[i]
            own = below[i]
            belief[i] = _normal([own[s] + _sum(x + first[s], y + second[s], z + third[s]) for s in STATES])
        return [exp(b[CONTENT]) for b in belief]

    def text(self, html: str | None) -> str:
        page = parse(html or "")
        if not page.blocks:
            return ""
        if all(node.tag in PLAIN for node in page.nodes[1:]):
            return "\n".join(text for _, text in page.blocks)  # nothing but text: all of it is the page's
        chance = self.marginals(page)
        return "\n".join(text for node, text in page.blocks if chance[node] > 0.5)


def labels(page: Page, content: str) -> list[int]:
    """States of the nodes of a page whose main text is known."""
    known = set(content.split("\n"))
    total, inside = [0] * len(page.nodes), [0] * len(page.nodes)
    for node, text in page.blocks:
        total[node] += len(text)
        inside[node] += len(text) * (text in known)
    for i in range(len(page.nodes) - 1, 0, -1):
        total[page.nodes[i].parent] += total[i]
        inside[page.nodes[i].parent] += inside[i]
    return [NOISE if not x else CONTENT if x >= LABEL_SHARE * t else NEUTRAL for t, x in zip(total, inside, strict=True)]


def counts(html: str, content: str) -> Counter[tuple[str, str]]:
    """(what, state or states) counts of one labelled page."""
    page = parse(html)
    own, seen = labels(page, content), features(page)
    out: Counter[tuple[str, str]] = Counter()
    for i, names in enumerate(seen):
        y = own[i]
        out["nodes", f"{y}"] += 1
        out.update((name, f"{y}") for name in names)
        if i:
            pair = f"{own[page.nodes[i].parent]}{y}"
            out[names[0], pair] += 1
            out["tag", pair] += 1
        else:
            out["root", f"{y}"] += 1
    return out


def model_from(totals: dict[tuple[str, str], int]) -> Model:
    get = defaultdict(int, totals)
    nodes = [get["nodes", f"{s}"] for s in STATES]
    feature = {}
    for name in {what for what, label in totals if len(label) == 1} - {"nodes", "root"}:
        seen = [get[name, f"{s}"] for s in STATES]
        if name.startswith("name ") and sum(seen) < NAMED:
            continue
        power = 1.0 if name.startswith(("tag ", "name ", "linked ")) else AMOUNTS
        feature[name] = [power * log((n + 1) / (total + 2)) for n, total in zip(seen, nodes, strict=True)]
    edge = {}
    for kind in {what for what, label in totals if len(label) == 2} | {"tag"}:
        rows = []
        for parent in STATES:
            # a kind's own counts, filled up with those of all kinds
            all_kinds = _normal([log(get["tag", f"{parent}{s}"] + 0.01) for s in STATES])
            rows.append(_normal([log(get[kind, f"{parent}{s}"] + 2 * exp(all_kinds[s])) for s in STATES]))
        edge[kind] = rows
    return Model(_normal([log1p(get["root", f"{s}"]) for s in STATES]), feature, edge)


def fit(labelled: DataFrame, html_col: str = "html", content_col: str = "content") -> Model:
    """Counts over a bounded set of labelled pages; only the sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for html, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.update(counts(html or "", content or ""))
        yield pa.RecordBatch.from_pylist([{"what": w, "label": y, "n": n} for (w, y), n in total.items()], schema=pa.schema([("what", pa.string()), ("label", pa.string()), ("n", pa.int64())]))

    rows = labelled.select(html_col, content_col).mapInArrow(run, "what string, label string, n long").groupBy("what", "label").agg(F.sum("n").alias("n")).collect()
    return model_from({(r.what, r.label): r.n for r in rows})


class _Maker:
    """One made-up page with its content text."""

    #: Words that sites use in class and id names, by what the element is.
    NAMES = {
        "menu": ("nav", "menu", "navbar", "main-menu", "site-nav", "breadcrumb", "breadcrumbs", "topnav", "pagination", "toc"),
        "header": ("header", "site-header", "masthead", "top", "branding", "topbar", "logo"),
        "footer": ("footer", "site-footer", "bottom", "copyright", "colophon", "credits", "legal"),
        "side": ("sidebar", "side", "widget", "aside", "related", "related-posts", "widget-area", "recommended", "trending", "popular", "share", "social", "tags"),
        "notice": ("notice", "cookie", "cookie-banner", "consent", "alert", "banner", "message", "popup", "gdpr", "modal", "overlay"),
        "advert": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "ad-slot", "promotion", "adsbox"),
        "form": ("form", "search", "newsletter", "subscribe", "login", "signup", "contact-form", "search-form"),
        "comments": ("comments", "comment", "comment-list", "responses", "discussion", "replies", "reply", "disqus", "comment-body", "user-comments"),
        "content": ("content", "article", "post", "entry", "entry-content", "post-body", "story", "article-body", "main", "text", "body-text", "main-content"),
        "wrap": ("wrapper", "container", "page", "site", "row", "col", "layout", "inner", "grid"),
    }

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.content: list[str] = []
        self.n = 0
        #: Names say what they are, are missing, or are words that no other page has.
        self.naming = self.r.choice(("known", "known", "none", "own"))
        self.own_names = {kind: "".join(self.r.choice("abcdefghijklmnoprstuvwxyz") for _ in range(self.r.randint(4, 10))) for kind in self.NAMES}

    def words(self, a: int, b: int, end: str = ".") -> str:
        r = self.r
        out = ["".join(r.choice("aeiouystrnlmdkpgbc") for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b))]
        for i in range(6, len(out) - 3, r.randint(7, 14)):
            out[i] += r.choice((",", ".", ",", ";"))
        self.n += 1
        out.append(f"q{self.n}")  # makes every block's text one of its own
        return " ".join(out).capitalize() + end

    def named(self, kind: str, often: float = 0.85) -> str:
        if self.naming == "none" or self.r.random() > often:
            return ""
        return f' {self.r.choice(("class", "class", "id"))}="{self.own_names[kind] if self.naming == "own" else self.r.choice(self.NAMES[kind])}"'

    def keep(self, text: str) -> str:
        self.content.append(text)
        return text

    def links(self, n: int) -> str:
        items = "".join(f'<li><a href="/{i}">{self.words(1, 3, "")}</a></li>' for i in range(n))
        return f"<ul{self.named('wrap', 0.1)}>{items}</ul>"

    def noise(self, kind: str) -> str:
        r = self.r
        if kind == "menu" and r.random() < 0.25:
            bar = r.choice((" | ", " ", " &middot; ", "<br>")).join(f'<a href="/{i}">{self.words(1, 2, "")}</a>' for i in range(r.randint(3, 12)))
            return f"<div{self.named('menu', 1)}>{bar}</div>"
        if kind == "menu":
            tag = r.choice(("nav", "nav", "div", "ul"))
            inner = self.links(r.randint(3, 9))
            return inner.replace("<ul", f"<ul{self.named('menu', 1)}", 1) if tag == "ul" else f"<{tag}{self.named('menu', 0.5 if tag == 'nav' else 1)}>{inner}</{tag}>"
        if kind == "header":
            tag = r.choice(("header", "div"))
            title = r.choice((f"<h1>{self.words(1, 3, '')}</h1>", f"<p>{self.words(3, 9)}</p>", f"<div>{self.words(2, 5, '')}</div>"))
            return f"<{tag}{self.named('header', 0.5 if tag == 'header' else 1)}>{title}{self.noise('menu') if r.random() < 0.5 else ''}</{tag}>"
        if kind == "footer":
            tag = r.choice(("footer", "footer", "div"))
            inner = r.choice((f"&copy; {self.words(2, 8)}", f"<p>&copy; {self.words(4, 20)}</p>", f"<p>{self.words(3, 10)}</p>{self.links(r.randint(2, 6))}"))
            return f"<{tag}{self.named('footer', 0.4 if tag == 'footer' else 1)}>{inner}</{tag}>"
        if kind == "side":
            tag = r.choice(("aside", "aside", "div", "section"))
            inner = r.choice((f"<h3>{self.words(1, 4, '')}</h3>{self.links(r.randint(2, 8))}", f"<h3>{self.words(1, 3, '')}</h3><p>{self.words(8, 40)}</p>", f"<p>{self.words(5, 30)}</p>"))
            return f"<{tag}{self.named('side', 0.5 if tag == 'aside' else 1)}>{inner}</{tag}>"
        if kind in ("notice", "advert"):
            tag = r.choice(("div", "div", "section", "aside", "p" if self.naming == "known" else "div"))
            inner = self.words(3, 30) if tag == "p" or r.random() < 0.5 else f"<p>{self.words(4, 30)}</p>"
            return f"<{tag}{self.named(kind, 1)}>{inner}{'<button>' + self.words(1, 2, '') + '</button>' if r.random() < 0.3 else ''}</{tag}>"
        if kind == "form":
            return f'<form action="/s"{self.named("form", 0.6)}><p>{self.words(2, 14)}</p><label>{self.words(1, 3, "")}</label><input name="q"><button>{self.words(1, 2, "")}</button></form>'
        one = lambda: f"<{t}{self.named('comments', 0.7)}><p>{self.words(1, 3, '')}</p><p>{self.words(5, 70)}</p></{t}>"
        t = r.choice(("div", "li", "article"))
        inner = "".join(one() for _ in range(r.randint(1, 6)))
        tag = r.choice(("section", "div"))
        return f"<{tag}{self.named('comments', 1)}><h2>{self.words(1, 3, '')}</h2>{'<ol>' + inner + '</ol>' if t == 'li' else inner}</{tag}>"

    def paragraph(self) -> str:
        r = self.r
        text = self.keep(self.words(*r.choice(((0, 2), (1, 6), (2, 12), (12, 60), (30, 160), (80, 300)) if r.random() < 0.99 else ((1500, 4000),))))
        cut = text.split(" ")
        k = r.randrange(len(cut))
        cut[k] = r.choice((cut[k], cut[k], f"<b>{cut[k]}</b>", f'<a href="/x">{cut[k]}</a>', f"<em>{cut[k]}</em>", f"<code>{cut[k]}</code>"))
        return " ".join(cut)

    def block(self) -> str:
        r, kind = self.r, self.r.random()
        if kind < 0.68:
            return f"<p>{self.paragraph()}" + ("</p>" if r.random() < 0.9 else "")
        if kind < 0.78:
            return f"<{(h := r.choice(('h2', 'h2', 'h3', 'h4')))}>{self.keep(self.words(2, 9, ''))}</{h}>"
        if kind < 0.85:
            tag = r.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{self.keep(self.words(*r.choice(((1, 4), (3, 25)))))}</li>" for _ in range(r.randint(2, 8))) + f"</{tag}>"
        if kind < 0.88:
            return f"<blockquote>{self.keep(self.words(10, 60))}</blockquote>"
        if kind < 0.91:
            return f"<figure><img src='/i.png'><figcaption>{self.keep(self.words(4, 20))}</figcaption></figure>"
        if kind < 0.95:
            code = self.keep(" ".join(r.choice(("x = 1", "for i in y:", "foo(a, b)", "{", "}", "return z", "if (a > b) {", "import os")).replace("<", "") + f" # q{self.n}" for _ in range(r.randint(1, 12))))
            self.n += 1
            return r.choice(("<pre>{}</pre>", "<pre><code>{}</code></pre>", "<div class=highlight><pre>{}</pre></div>")).format(code.replace(">", "&gt;").replace(" ", "\n  "))
        if kind < 0.97:
            return "<dl>" + "".join(f"<dt>{self.keep(self.words(1, 3, ''))}</dt><dd>{self.keep(self.words(4, 30))}</dd>" for _ in range(r.randint(1, 4))) + "</dl>"
        cells = lambda: "".join(f"<td>{self.keep(self.words(1, 5, ''))}</td>" for _ in range(3))
        top = f"<tr>{cells().replace('td>', 'th>')}</tr>" if r.random() < 0.4 else ""
        return f"<table>{top}" + "".join(f"<tr>{cells()}</tr>" for _ in range(r.randint(1, 5))) + "</table>"

    def article(self) -> str:
        r = self.r
        inner = [f"<h1>{self.keep(self.words(2, 12, r.choice(('', '.'))))}</h1>"]
        bare = r.random() < 0.12  # text between line breaks and no paragraphs
        section = r.random() < 0.15
        for _ in range(r.choice((1, 2, 4, 8, 15, 40))):
            inner.append(self.run() if bare else f"<section>{self.block()}{self.block()}</section>" if section else self.block())
            if r.random() < 0.05:
                inner.append(self.noise(r.choice(("advert", "side", "form", "notice"))))
        if r.random() < 0.15:
            inner.append(self.noise("comments"))
        tag = r.choice(("article", "main", "div", "div", "section"))
        body = f"<{tag}{self.named('content', 0.35 if tag in ('article', 'main') else 1)}>{''.join(inner)}</{tag}>"
        return f"<main{self.named('content', 0.3)}>{body}</main>" if tag == "article" and r.random() < 0.3 else body

    def run(self) -> str:
        """Text that stands in the article's own element; a rule behind it keeps it from the next."""
        return self.keep(self.words(20, 120)) + "<hr>"

    def page(self) -> tuple[str, str]:
        r = self.r
        before = [k for k in ("notice", "header", "menu", "advert", "form", "side") if r.random() < 0.5]
        after = [k for k in ("comments", "side", "advert", "form", "menu", "footer", "notice") if r.random() < 0.45]
        first, own, last = [self.noise(k) for k in before], self.article(), [self.noise(k) for k in after]
        if r.random() < 0.12:  # a table holds the columns
            column = lambda kinds: f"<td{self.named('side', 0.5)}>{''.join(kinds)}</td>" if kinds else ""
            line = lambda: f"<a href='/'>{self.words(1, 3, '')}</a>{r.choice((' | ', '<br>'))}" * r.randint(2, 8)
            row = lambda inner: f"<tr><td{self.named('header', 0.3)}>{inner}</td></tr>" if r.random() < 0.6 else ""
            aside = f"<td>{line()}</td>" if r.random() < 0.4 else column(first)
            body = f"<table>{row(line())}<tr>{aside}<td{self.named('content', 0.5)}>{own}</td>{column(last)}</tr>{row(self.noise('footer'))}</table>"
        else:
            body = "".join([*first, own, *last])
        for _ in range(r.choice((0, 0, 1, 2))):
            body = f"<div{self.named('wrap')}>{body}</div>"
        head = f"<head><title>{self.words(2, 8, '')}</title><script>var t='<p>';</script><style>p{{}}</style></head>"
        close = "</body></html>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html>{head}<body>{body}{close}", "\n".join(self.content)


def labelled_pages(spark: SparkSession, n: int = TRAINING_PAGES, seed: int = 1) -> DataFrame:
    """Made-up pages with columns html and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_Maker(seed * 1_000_003 + i).page() for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in made], pa.string()), pa.array([c for _, c in made], pa.string())], names=["html", "content"])

    return spark.range(0, n, 1, 4).mapInArrow(run, "html string, content string")


def extracted(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url and main text of every row."""
    held = pages.sparkSession.sparkContext.broadcast(model)
    schema = pages.select(F.col(id_col), F.col(url_col), F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in sliced(batches, 2):
            texts = [own.text(html) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=schema.names)

    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)


def query(pages: DataFrame) -> DataFrame:
    """op9: the main text of every page, by a model trained on made-up labelled pages."""
    model = fit(labelled_pages(pages.sparkSession))
    return extracted(pages, model).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
