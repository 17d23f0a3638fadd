"""HTML main text by a tree-structured graphical model.

A page is parsed into its element tree. Each element is a variable with two states, content or boilerplate. Its
observed features (tag, words in class and id, length, link share, sentence marks, whether it is hidden) give node
potentials; parent and child are tied by pair potentials that depend on the child's kind. Messages go up the tree from
the leaves and down again from the root (sum-product), which gives every element's exact marginal probability of being
content. All potentials are counts with smoothing from labelled pages.

The labelled pages are made by a small generator of page layouts in this module (menus, headers, adverts, notices,
forms, comments, hidden elements and the like, in random nesting); which elements are content is known from how they
were made. Words of names are known to the model by a fixed table of groups; the generator uses every second word of
each group in one plain spelling, so that the others, in other spellings and layouts, are left for tests. Training takes
some hundred pages and runs once in each worker process, always with the same seed.

A block is a run of text between block-level tags. Blocks whose element's marginal is one half or more are joined in page
order. Texts of any length are kept whole; the memory is one page.

Defined results: a null or empty page gives an empty text. Bytes that are no UTF-8 become U+FFFD. Unclosed and misnested
tags are closed where their parent closes. Attributes are read by the rules of HTML; a quote that nothing closes is part
of its value. Scripts, styles, frames, form fields, drawings and templates are no text: a script or style without an
end takes the rest of the page, any other such element ends at the first tag that can't stand in it. Formulas, and what
stands in for objects and scripts, are text like any other. A page cut off in mid tag keeps what is whole. Text without any tag is one
block. Repeated rows are judged row by row; an empty table gives no rows; further columns of pages stay out.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: tags by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol option p pre section summary table tbody td tfoot th thead tr ul xmp button label".split()
)
#: Their content is text that ends only at their own closing tag; all but the last are no text of the page.
RAW = frozenset("script style textarea iframe title noembed noframes xmp".split())
#: Their content is markup, but no text of the page.
DROPPED = frozenset("svg template select datalist annotation annotation-xml".split())
#: An opening tag that closes an open element of these names.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {t: {"p"} for t in BLOCK - {"p", "li", "dt", "dd", "tr", "td", "th", "option", "button", "label"}}
#: Elements at which the search for what to close stops.
FENCE = frozenset("table ul ol dl div section article aside nav main body html header footer form blockquote td th".split())

#: A value is quoted only behind an equals sign; quotes elsewhere are part of names and values.
VALUE = r"""(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+))"""
ATTRIBUTE = re.compile(rf"=?([^\s/>=]++)(?:\s*+=\s*+{VALUE})?+")
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+{VALUE.replace('([', '(?:[')})?+|=)*+)(>|\Z)", re.S)
#: Groups of words in class, id and role names.
NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs pagination pager toolbar skip toc",
    "edge": "header footer masthead topbar bottom copyright legal colophon banner contentinfo",
    "side": "sidebar aside side rail widget related recommended recommendations trending popular tags categories archive complementary more",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted adsense dfp outbrain taboola partner",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog paywall newsletter subscribe subscription signup warning message",
    "form": "form search login register contact input",
    "talk": "comment comments commentlist respond reply replies disqus discussion feedback reviews review",
    "share": "share sharing social follow facebook twitter print byline author meta date tools",
    "text": "article content post entry story body text main page prose markdown maincontent articlebody",
}
MARK = re.compile(r"[.!?…。](?=\s|$)")
WORD_GROUP = {w: g for g, words in NAMES.items() for w in words.split()}
TAG_GROUP = {t: t for t in "nav header footer aside form article main section p h1 h2 h3 div ul ol li table blockquote pre button label body html figure".split()} | {"h4": "h3", "h5": "h3", "h6": "h3", "td": "table", "th": "table", "tr": "table", "tbody": "table", "dl": "ul", "dd": "li", "dt": "li", "menu": "ul", "dialog": "aside", "fieldset": "form", "figcaption": "figure", "details": "section"}


@lru_cache(1 << 14)
def groups_of(word: str) -> frozenset[str]:
    """The groups of a word of a name; a longer word's groups are those of what it begins or ends with."""
    if word in WORD_GROUP:
        return frozenset([WORD_GROUP[word]])
    return frozenset(g for w, g in WORD_GROUP.items() if len(w) > 4 and (word.startswith(w) or word.endswith(w)))


class Node:
    """An element: with what its features are made from."""

    __slots__ = ("tag", "names", "parent", "children", "chars", "linked", "marks", "legal", "hidden", "label", "blocks")

    def __init__(self, tag: str, names: frozenset[str], parent: Node | None, hidden: bool = False, label: bool | None = None):
        self.tag, self.names, self.parent, self.hidden, self.label = tag, names, parent, hidden, label
        self.children: list[Node] = []
        self.chars = self.linked = self.marks = self.legal = self.blocks = 0


def name_groups(attributes: str, truth: str | None) -> tuple[frozenset[str], bool, bool | None]:
    """Groups of the names in class, id and role; whether the element is hidden; the label in the attribute that truth names."""
    groups, hidden, label = set(), False, None
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            for word in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", html.unescape(value)).lower()):
                groups |= groups_of(word)
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
        elif key == truth:
            label = value == "1"
    return frozenset(groups), hidden, label


def parse(page: str, truth: str | None = None) -> tuple[Node, list[tuple[Node, str]]]:
    """The element tree of block-level elements, and the blocks of text in page order with the element each stands in. truth: an attribute with labels, on pages made for training."""
    root = node = Node("html", frozenset(), None)
    blocks: list[tuple[Node, str]] = []
    run: list[str] = []
    skipped: list[str] = []  # open elements from the outermost dropped one on
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            blocks.append((node, text))
            node.chars += len(text)
            node.linked += min(linked, len(text))
            node.marks += len(MARK.findall(text))
            node.legal += text.startswith(("©", "(c)"))
            node.blocks += 1
        linked = 0

    def opened(tag: str) -> bool:
        up = node
        while up is not root and up.tag != tag:
            up = up.parent
        return up is not root

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        # A last "<" that no token completes is a page cut off in mid tag.
        stop = m.start() if m else end
        if stop > at and not skipped:
            text = html.unescape(page[at:stop])
            run.append(text)
            if links:
                linked += len(text.strip())
        if m is None:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[4]:
            continue
        if skipped:
            if m[1]:
                if tag in skipped:
                    while skipped.pop() != tag:
                        pass
                    continue
                if tag not in BLOCK or not opened(tag):
                    continue
            elif tag in ("script", "style"):
                pass
            elif tag in BLOCK and skipped[0] != "template" and "foreignobject" not in skipped and tag not in ("option", "hr"):
                pass
            else:
                if tag not in VOID and not m[3].endswith("/"):
                    skipped.append(tag)
                continue
            if tag not in ("script", "style"):
                skipped.clear()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK and (tag == "html" or opened(tag)):
                flush()
                while node is not root and node.tag != tag:
                    node = node.parent
                node, links = node.parent or root, 0
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if tag == "xmp" and close:
                flush()
                run.append(page[at : close.start()])
                flush()
            if close or tag in ("script", "style"):
                at = close.end() if close else end
        elif tag in DROPPED:
            if not m[3].endswith("/"):
                skipped.append(tag)
        elif tag == "a":
            links += 1
        elif tag == "br":
            run.append(" ")
        elif tag in BLOCK:
            flush()
            links = 0
            up = node
            while up is not root and up.tag not in FENCE:
                if up.tag in CLOSES.get(tag, ()):
                    node = up.parent
                    break
                up = up.parent
            else:
                if up is not root and up.tag in CLOSES.get(tag, ()):
                    node = up.parent
            if tag in VOID:
                continue
            names, hidden, label = name_groups(m[3], truth) if m[3] else (frozenset(), False, None)
            node.children.append(child := Node(tag, names, node, hidden, label))
            node = child
    flush()
    return root, blocks


def post_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(n.children)
    return out[::-1]


def features(n: Node) -> list[tuple[str, ...]]:
    """Each feature with coarser ones to fall back on. Tag and text make one feature, as they hang together."""
    kind = TAG_GROUP.get(n.tag, "other")
    own = (f"tag={kind}",)
    if n.blocks:
        size = "tiny" if n.chars < 20 else "short" if n.chars < 80 else "some" if n.chars < 300 else "long"
        share = n.linked / n.chars
        links = "none" if share == 0 else "few" if share < 0.3 else "many" if share < 0.8 else "all"
        own = (f"text={kind} {size} {links} {min(n.marks, 2)}", f"text={kind} {links}", *own)
    return [own, *((f"name={g}",) for g in sorted(n.names) or ["none"]), *([("hidden",)] if n.hidden else []), *([("legal",)] if n.legal else [])]


def edge_kind(n: Node) -> str:
    """What the pair potential of an element and its parent depends on: whether the child starts something of its own."""
    if n.hidden:
        return "hidden"
    if n.names:
        return "named text" if n.names == {"text"} else "named"
    if n.parent.names - {"text"}:
        return "inside named"
    return f"edge {n.tag}" if n.tag in ("nav", "aside", "footer", "header", "form", "dialog") else "section" if n.tag in ("article", "main", "section", "div") else "plain"


class TreeModel:
    """Potentials by counting, and marginals by messages over the tree."""

    def __init__(self, pages: list[tuple[Node, list[Node]]], smoothing: float = 0.5):
        seen: dict[str, list[float]] = {}
        totals, edges = [smoothing, smoothing], {}
        for _, nodes in pages:
            for n in nodes:
                y = int(bool(n.label))
                totals[y] += 1
                for f in features(n):
                    for level in f:
                        seen.setdefault(level, [smoothing, smoothing])[y] += 1
                if n.parent is not None:
                    edges.setdefault(edge_kind(n), [[smoothing, smoothing], [smoothing, smoothing]])[int(bool(n.parent.label))][y] += 1
        self.prior = log(totals[1] / totals[0])
        # Log odds of features seen often enough; others leave it to the coarser ones, and at last say nothing.
        self.odds = {f: log(c[1] / totals[1]) - log(c[0] / totals[0]) for f, c in seen.items() if sum(c) >= 5}
        # Transition probabilities over the child's own prior, so that the prior isn't counted twice.
        share = [t / sum(totals) for t in totals]
        self.pair = {k: [[row[y] / sum(row) / share[y] for y in (0, 1)] for row in t] for k, t in edges.items()}
        self.neutral = [[1.0, 1.0], [1.0, 1.0]]

    def evidence(self, n: Node) -> float:
        return sum(next((self.odds[level] for level in f if level in self.odds), 0.0) for f in features(n))

    def marginals(self, root: Node) -> dict[int, float]:
        """Probability of content of each element, by id()."""
        order = post_order(root)
        local: dict[int, tuple[float, float]] = {}
        up: dict[int, tuple[float, float]] = {}
        for n in order:
            # The root stands for the page and says nothing itself.
            z = self.prior + self.evidence(n) if n is not root else 0.0
            p = 1 / (1 + exp(-max(-30.0, min(30.0, z))))
            a, b = 1 - p, p
            for c in n.children:
                m = up[id(c)]
                a, b = a * m[0], b * m[1]
                s = a + b
                a, b = a / s, b / s
            local[id(n)] = (a, b)
            if n is root:
                break
            t = self.pair.get(edge_kind(n), self.neutral)
            m0, m1 = t[0][0] * a + t[0][1] * b, t[1][0] * a + t[1][1] * b
            s = m0 + m1
            up[id(n)] = (m0 / s, m1 / s)
        down: dict[int, tuple[float, float]] = {id(root): (0.5, 0.5)}
        out: dict[int, float] = {}
        for n in reversed(order):
            a, b = local[id(n)]
            d = down[id(n)]
            a, b = a * d[0], b * d[1]
            s = a + b
            a, b = a / s, b / s
            out[id(n)] = b
            for c in n.children:
                # What the parent believes without this child's own message.
                m = up[id(c)]
                x, y = a / max(m[0], 1e-12), b / max(m[1], 1e-12)
                t = self.pair.get(edge_kind(c), self.neutral)
                d0, d1 = x * t[0][0] + y * t[1][0], x * t[0][1] + y * t[1][1]
                s = d0 + d1
                down[id(c)] = (d0 / s, d1 / s)
        return out


#: The attribute that says on the generator's pages whether an element is content.
TRUTH = "data-truth"


def labelled_page(rng: random.Random, held_out: bool = False) -> str:
    """A page whose elements say by the attribute TRUTH what they are. held_out: with the words that training leaves out, in other spellings, and often in plain div elements."""
    word = lambda: "".join(rng.choice("aeioulnrstdmkp") for _ in range(rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(2, 18).capitalize() + rng.choice(".....!?" if rng.random() < 0.85 else (" |", "", ":"))
    prose = lambda: " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 3, 5, 9))))
    link = lambda: f'<a href="#">{words(1, 4)}</a>'

    def el(tag: str, inner: str, content: bool, names: str = "") -> str:
        if held_out and names and tag in ("nav", "header", "footer", "aside", "section", "article", "main") and rng.random() < 0.5:
            tag = "div"
        gone = rng.choice((" hidden", ' style="display: none"', ' aria-hidden="true"')) if not content and rng.random() < 0.05 else ""
        return f'<{tag} {rng.choice(("class", "id"))}="{names}" {TRUTH}="{content:d}"{gone}>{inner}</{tag}>'

    def name(group: str, chance: float = 0.8) -> str:
        if rng.random() >= chance:
            return ""
        found = rng.choice(NAMES[group].split()[held_out::2])
        return rng.choice((found, f"site-{found}", f"{found}__inner", f"js{found.capitalize()}2", f"wrap {found}")) if held_out else found

    def links(n: int) -> str:
        return el(rng.choice(("ul", "ol")), "".join(el("li", link(), False) for _ in range(n)), False) if rng.random() < 0.7 else " ".join(link() for _ in range(n))

    def paragraph(content: bool) -> str:
        text = prose()
        if rng.random() < 0.3:
            text = text.replace(" ", f" {link()} ", 1)
        return el("p", f"<b>{text}</b>" if rng.random() < 0.1 else text, content)

    def noise(kind: str) -> str:
        tag = lambda *t: rng.choice(t)
        if kind == "menu":
            t = tag("nav", "nav", "div", "ul")
            return el(t, "".join(el("li", link(), False) for _ in range(rng.randint(3, 9))) if t == "ul" else links(rng.randint(3, 9)), False, name("menu", 0.4 if t == "nav" else 1))
        if kind == "head":
            return el("header", el(tag("div", "p", "h2"), words(1, 5), False) + (noise("menu") if rng.random() < 0.5 else ""), False, name("edge", 0.5))
        if kind == "foot":
            t = tag("footer", "footer", "div")
            return el(t, (el("p", f"&copy; {words(1, 4)} &middot; {prose()}", False) if rng.random() < 0.5 else f"&copy; {words(1, 4)} {prose()}") + (links(3) if rng.random() < 0.4 else ""), False, name("edge", 0.4 if t == "footer" else 1))
        if kind == "side":
            t = tag("aside", "aside", "div", "section")
            return el(t, el("h3", words(1, 4), False) + (links(rng.randint(2, 7)) if rng.random() < 0.6 else "".join(paragraph(False) for _ in range(rng.randint(1, 3)))), False, name("side", 0.4 if t == "aside" else 1))
        if kind == "advert":
            return el(tag("div", "div", "aside", "section"), prose() if rng.random() < 0.6 else paragraph(False), False, name("advert", 1))
        if kind == "notice":
            return el(tag("div", "section", "dialog", "p"), (prose() + f"<button>{words(1, 2)}</button>") if rng.random() < 0.5 else prose(), False, name("notice", 1))
        if kind == "form":
            return el("form", f"<label>{words(1, 3)}</label><input><button>{words(1, 2)}</button>" + (paragraph(False) if rng.random() < 0.3 else ""), False, name("form", 0.3))
        if kind == "share":
            return el(tag("div", "ul", "p"), words(1, 4) if rng.random() < 0.4 else links(3), False, name("share", 1))
        talk = "".join(el(tag("div", "li", "article", "section"), el("p", prose(), False) + (el("p", words(1, 3), False) if rng.random() < 0.3 else ""), False, name("talk", 0.7)) for _ in range(rng.randint(1, 5)))
        return el(tag("section", "div", "ol", "ul"), el("h3", words(1, 3), False) * (rng.random() < 0.6) + talk, False, name("talk", 1))

    def body() -> str:
        out = [el(rng.choice(("h1", "h1", "h2")), words(2, 9).capitalize(), True)] if rng.random() < 0.9 else []
        if out and rng.random() < 0.2:
            out = [el("header", out[0] + (noise("share") if rng.random() < 0.5 else ""), True)]
        for _ in range(rng.choice((1, 2, 4, 8, 14))):
            roll = rng.random()
            if roll < 0.72:
                out.append(paragraph(True))
            elif roll < 0.80:
                out.append(el(rng.choice(("h2", "h3")), words(1, 7).capitalize(), True))
            elif roll < 0.85:
                out.append(el(rng.choice(("ul", "ol")), "".join(el("li", prose(), True) for _ in range(rng.randint(2, 5))), True))
            elif roll < 0.88:
                out.append(el("blockquote", paragraph(True) if rng.random() < 0.5 else prose(), True))
            elif roll < 0.90:
                out.append(el("table", el("tr", "".join(el("td", words(1, 4), True) for _ in range(3)), True), True))
            elif roll < 0.92:
                out.append(el("pre", words(4, 30), True))
            elif roll < 0.93:
                out.append(el("figure", el("figcaption", prose(), True), True))
            elif roll < 0.94:
                out.append(el("dl", el("dt", words(1, 4), True) + el("dd", prose(), True), True))
            elif roll < 0.95:
                out.append(el(rng.choice(("div", "section")), paragraph(True) + paragraph(True), True))
            elif roll < 0.96:
                hidden = el(rng.choice(("p", "div", "section")), prose() if rng.random() < 0.5 else paragraph(False), False)
                out.append(hidden.replace(" ", rng.choice((" hidden ", ' style="display:none" ', ' aria-hidden="true" ')), 1))
            else:
                out.append(noise(rng.choice(("advert", "share", "side", "notice", "form"))))
        return "".join(out)

    tag = rng.choice(("article", "article", "main", "div", "section"))
    main = el(tag, body(), True, name("text", 0.4 if tag in ("article", "main") else 1))
    if rng.random() < 0.15:
        main = el("main", main, True, name("text", 0.4))
    before = "".join(noise(k) for k in ("head", "menu", "notice", "advert", "form") if rng.random() < 0.5)
    after = "".join(noise(k) for k in ("side", "share", "talk", "advert", "foot", "notice") if rng.random() < 0.5)
    if rng.random() < 0.25:
        # No container at all: the body, or a fragment's root, holds the text itself.
        inner = before + body() + after
        return inner if rng.random() < 0.4 else f'<html {TRUTH}="1"><body {TRUTH}="1">{inner}</body></html>'
    middle = before + main + after
    if rng.random() < 0.3:
        middle = f'<div {TRUTH}="0">{middle}</div>'
    return f'<html {TRUTH}="0"><body {TRUTH}="0">{middle}</body></html>'


def labelled(page: str) -> tuple[Node, list[Node], list[tuple[Node, str]]]:
    """Tree, elements from the leaves up, and blocks of a page of the generator's, with every element labelled."""
    root, blocks = parse(page, TRUTH)
    nodes = post_order(root)
    root.label = any(c.label and edge_kind(c) == "plain" for c in root.children)
    # Elements without a label of their own (buttons, labels) are their parents'.
    for n in reversed(nodes):
        if n.label is None:
            n.label = bool(n.parent and n.parent.label)
    return root, nodes, blocks


@lru_cache(2)
def trained(pages: int = 600, seed: int = 7) -> TreeModel:
    rng = random.Random(seed)
    return TreeModel([labelled(labelled_page(rng))[:2] for _ in range(pages)])


def content_blocks(page: str, model: TreeModel) -> list[str]:
    root, blocks = parse(page)
    marginal = model.marginals(root)
    return [text for node, text in blocks if marginal[id(node)] >= 0.5]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_blocks: a row for each row of pages (page_id, url, html)."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [content_blocks((h.as_py() or b"").decode("utf-8", "replace"), model) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(["\n\n".join(b) for b in found], pa.string()), pa.array([len(b) for b in found], pa.int64())], names=["page_id", "url", "text", "n_blocks"])

    return pages.select("page_id", "url", F.col("html").cast("binary").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_blocks long")
