"""HTML extraction: gradient-boosted trees over DOM nodes, decoded over the tree.

A tolerant parser builds the element tree; each block element gets features of its
subtree (text, tags, links, punctuation), its attribute tokens, its depth and its
siblings. Boosted trees, trained on pages made by rule in many layouts, give each node a
probability of belonging to the main text. Decoding picks the best set that is closed
upwards: a node is kept only with its parent, and dropping a node drops its subtree, so
an ancestor and a descendant never contradict each other.

Null and empty html, and pages without main text, give an empty string. White space is
any Unicode white space. Whole pages are parsed in time linear in their length; nothing in
the main text is dropped or capped. A quotation mark in a tag that is never closed ends the
reading of quotes on that page: from there on a tag ends at its first ">". A link is text
of a link however deep it is nested. Nodes of equal odds are dropped (ties). Repeated rows
give equal results, an empty table an empty result; other columns play no part, whatever
their names.
"""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from plumbline.llm import boost
from plumbline.llm.common import map_rows

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks int"

# Fixed classes of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math select xmp noembed noframes".split())
FOREIGN = frozenset("svg math".split())  # of RAW, those that nest and may be closed by their start tag
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li".split()
)
NEVER = frozenset("head form button select textarea dialog".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
GROUPS = ["p", "h1 h2 h3 h4 h5 h6", "ul ol li dl dt dd menu", "nav", "header hgroup", "footer", "aside", "article main", "section div", "table tbody thead tr td th", "blockquote pre figure figcaption", "body html"]
GROUP = {tag: k for k, tags in enumerate(GROUPS) for tag in tags.split()}
GOOD = frozenset("article body content entry main post story text hentry articlebody maincontent".split())
BAD = frozenset(
    "ad ads adv advert advertisement banner breadcrumb breadcrumbs combx comment comments cookie consent copyright disqus footer foot header "
    "login masthead menu modal nav navbar navigation newsletter notice outbrain pager pagination popup promo related reply respond share sharing sidebar signup social "
    "sponsor sponsored subscribe tags toolbar widget".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|</[^>A-Za-z][^>]*+>|<[A-Za-z/!?][^>]*+\Z",
    re.S,
)
#: The same without quotes: a tag ends at its first ">".
PLAIN_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]+)>|</[^>A-Za-z][^>]*+>|<[A-Za-z/!?][^>]*+\Z", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PIECES = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
PUNCTUATION = re.compile(r"[.,;:!?]")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    good: int = 0
    bad: int = 0
    index: int = 0
    children: int = 0
    chars: int = 0
    linked: int = 0
    words: int = 0
    marks: int = 0
    tags: int = 1
    blocks: int = 0
    items: int = 0


@dataclass
class Page:
    nodes: list[Node]
    runs: list[tuple[int, str]]  # (block node, text) in page order


def attribute_tokens(raw: str) -> tuple[int, int]:
    """How many tokens of class, id and role speak for and against main text."""
    tokens: set[str] = set()
    for m in ATTRIBUTE.finditer(raw):
        value = html.unescape(m[2] or m[3] or m[4] or "")
        tokens.update(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower().replace("-", " ").replace("_", " ").split())
    return len(tokens & GOOD), len(tokens & BAD)


def foreign_ends(source: str, at: int) -> dict[int, int]:
    """Where each foreign element ends, by the end of its start tag; one that is never closed has no entry."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in FOREIGN}
    for m in TOKEN.finditer(source, at):
        tag = (m[2] or m[5] or "").lower()
        if tag not in FOREIGN:
            continue
        if not (m[1] or m[4]):
            if not (m[3] or m[6] or "").endswith("/"):
                opened[tag].append(m.end())
        elif opened[tag]:
            ends[opened[tag].pop()] = m.end()
    return ends


class Open:
    """The open elements, with the places of each tag and of the elements that aren't inline."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []  # tag and block node
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node))

    def last(self, *tags: str) -> int:
        """Place of the innermost open element with one of these tags, -1 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def cut(self, k: int) -> bool:
        """Close everything from place k on; was there a block among it?"""
        for tag, _ in self.stack[k:]:
            self.places[tag].pop()
        del self.stack[k:]
        had = len(self.blocks)
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()
        return len(self.blocks) < had


def parse(source: str) -> Page:
    """Element tree of block elements, and the text runs between block boundaries."""
    nodes = [Node("html", -1, 0)]
    opened = Open()
    opened.push("html", 0)
    runs: list[tuple[int, str]] = []
    pieces: list[str] = []
    owner, linked = 0, 0
    ends: dict[int, int] | None = None  # of foreign elements, found at the first
    token = TOKEN

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                runs.append((owner, text))
                own = nodes[owner]
                own.chars += len(text)
                own.linked += min(linked, len(text))
                own.words += text.count(" ") + 1
                own.marks += len(PUNCTUATION.findall(text))
                own.blocks += 1
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal owner
        if opened.cut(k):
            flush()
        owner = opened.stack[-1][1]

    def add(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if opened.places.get("a"):
            linked += len(text)

    at, n = 0, len(source)
    while at < n:
        m = token.search(source, at)
        if not m:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        if m[5]:
            token = PLAIN_TOKEN
        tag, raw = name.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            k = opened.last(tag)
            if k > (opened.blocks[-1] if tag in INLINE else 0):
                pop_to(k)
            continue
        nodes[owner].tags += 1
        if tag in VOID:
            if tag in CLOSES_P:
                flush()
            else:
                pieces.append(" " if tag == "br" else "")
            continue
        if tag in FOREIGN:
            if not raw.endswith("/"):
                ends = foreign_ends(source, m.start()) if ends is None else ends
                at = ends.get(at, at)
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(source, at)
            close = source.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else n
            continue
        if tag in INLINE:
            if tag == "a" and (k := opened.last("a")) > opened.blocks[-1]:
                pop_to(k)  # links don't nest
            opened.push(tag, owner)
            continue
        if tag in SAME:
            while (k := opened.last(*SAME[tag])) > max(0, opened.last(*SCOPE.get(tag, ()))):
                pop_to(k)
                if tag != "tr":
                    break
        if tag in CLOSES_P and (k := opened.last("p")) >= 0 and k == opened.blocks[-1]:
            pop_to(k)
        if tag in ("html", "body") and opened.last(tag) >= 0:
            continue
        if tag == "body" and opened.stack[-1][0] == "head":
            pop_to(len(opened.stack) - 1)
        flush()
        good, bad = attribute_tokens(raw) if "=" in raw else (0, 0)
        parent = nodes[owner]
        node = Node(tag, owner, parent.depth + 1, good, bad, parent.children)
        parent.children += 1
        owner = len(nodes)
        nodes.append(node)
        opened.push(tag, owner)
    flush()
    return Page(nodes, runs)


def node_features(page: Page) -> np.ndarray:
    """One row per node; sums over subtrees run from the last node up, children come after parents."""
    nodes = page.nodes
    total = [[v.chars, v.linked, v.words, v.marks, v.tags, v.blocks, 1] for v in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        up = total[nodes[k].parent]
        for j, v in enumerate(total[k]):
            up[j] += v
    whole = max(1, total[0][0])
    inherited = [(0, 0)] * len(nodes)
    out = np.zeros((len(nodes), 22))
    for k, v in enumerate(nodes):
        chars, linked, words, marks, tags, blocks, below = total[k]
        parent = nodes[v.parent] if k else v
        above = inherited[v.parent] if k else (0, 0)
        inherited[k] = (above[0] + v.good + (v.tag in ("article", "main")), above[1] + v.bad + (v.tag in ("nav", "footer", "aside", "header")))
        siblings = parent.children if k else 1
        around = total[v.parent][0] if k else chars
        out[k] = (
            GROUP.get(v.tag, -1), v.depth, chars, chars / whole, linked / max(1, chars), chars / max(1, tags), words / max(1, blocks),
            marks / max(1, words), below, v.good, v.bad, inherited[k][0], inherited[k][1], siblings, v.index / max(1, siblings),
            chars / max(1, around), GROUP.get(parent.tag, -1), float(v.tag in NEVER), blocks, above[0], above[1], chars / max(1, below),
        )
    return out


def decode(page: Page, p: np.ndarray) -> list[bool]:
    """Which nodes are kept: the likeliest set in which every kept node's parent is kept."""
    nodes = page.nodes
    p = np.clip(p, 1e-4, 1 - 1e-4)
    drop, keep = np.log(1 - p), np.log(p)
    below, best = drop.tolist(), keep.tolist()
    for k in range(len(nodes) - 1, 0, -1):  # children before parents
        if nodes[k].tag in NEVER:
            best[k] = -np.inf
        parent = nodes[k].parent
        best[parent] += max(best[k], below[k])
        below[parent] += below[k]
    kept = [False] * len(nodes)
    kept[0] = True
    for k in range(1, len(nodes)):
        kept[k] = kept[nodes[k].parent] and best[k] > below[k]
    return kept


def main_text(page: Page, p: np.ndarray) -> list[str]:
    kept = decode(page, p)
    return [text for owner, text in page.runs if kept[owner]]


# --- training pages -------------------------------------------------------------------


class Maker:
    """Labelled pages: text of the main article is wrapped in marks that no other text has."""

    KEEP, DROP = "\x01", "\x02"

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def pick(self, xs: list) -> object:
        return xs[int(self.rng.integers(len(xs)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, low: int, high: int, mark: str) -> str:
        parts = "an ther in on re th st ed er ing nd tion ha es ly ou wh le ch auf und que de".split()
        text = " ".join("".join(self.pick(parts) for _ in range(int(self.rng.integers(1, 4)))) for _ in range(int(self.rng.integers(low, high))))
        return mark + text + ("." if self.chance(0.7) else "")

    def links(self, n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/x">{self.words(1, 4, self.DROP)}</a></{tag}>' for _ in range(n))

    def boiler(self, kind: str) -> str:
        w, n = self.words, int(self.rng.integers(2, 9))
        return {
            "nav": lambda: self.pick(["<nav>{}</nav>", '<div class="navbar">{}</div>', '<div id="menu">{}</div>', '<ul class="nav">{}</ul>']).format(f"<ul>{self.links(n)}</ul>"),
            "header": lambda: self.pick(["<header>{}</header>", '<div id="header">{}</div>', '<div class="masthead">{}</div>']).format(f"<p>{w(1, 6, self.DROP)}</p>"),
            "footer": lambda: self.pick(["<footer>{}</footer>", '<div class="footer">{}</div>', "<footer><p>{}</p></footer>"]).format("&copy; " + w(3, 25, self.DROP)),
            "aside": lambda: self.pick(["<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div class="widget">{}</div>']).format(f"<h3>{w(1, 4, self.DROP)}</h3><ul>{self.links(n)}</ul><p>{w(4, 30, self.DROP)}</p>"),
            "ad": lambda: self.pick(['<div class="ad">{}</div>', '<div class="ad-banner"><p>{}</p></div>', '<section class="promo">{}</section>', '<div class="sponsored">{}</div>']).format(w(3, 40, self.DROP)),
            "notice": lambda: self.pick(['<div class="cookie-notice"><p>{}</p></div>', '<div id="consent">{}</div>', '<div class="notice">{}</div>']).format(w(8, 40, self.DROP)),
            "share": lambda: f'<ul class="share">{self.links(3)}</ul>',
            "related": lambda: self.pick(['<div class="related">{}</div>', '<section class="related-posts">{}</section>']).format(f"<h4>{w(1, 3, self.DROP)}</h4><ul>{self.links(n)}</ul>"),
            "comments": lambda: self.pick(['<div class="comments">{}</div>', '<section id="comments">{}</section>', '<ol class="comment-list">{}</ol>']).format("".join(self.pick(['<div class="comment"><p>{}</p></div>', '<li class="comment"><p>{}</p></li>']).format(w(5, 60, self.DROP)) for _ in range(int(self.rng.integers(1, 8))))),
            "form": lambda: f'<form class="newsletter"><label>{w(2, 8, self.DROP)}</label><input name="q"><button>{w(1, 2, self.DROP)}</button></form>',
        }[kind]()

    def article(self) -> str:
        w, out = self.words, []
        if self.chance(0.8):
            out.append(f"<h1>{w(2, 12, self.KEEP)}</h1>")
        for _ in range(int(self.rng.integers(1, 14))):
            r = self.rng.random()
            if r < 0.70:
                text = w(1, 120, self.KEEP)
                if self.chance(0.2):
                    text += f' <a href="/y">{w(1, 4, self.KEEP)}</a> {w(1, 30, self.KEEP)}'
                out.append(self.pick([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>"]))
            elif r < 0.78:
                out.append(f"<h2>{w(1, 7, self.KEEP)}</h2>")
            elif r < 0.86:
                out.append("<ul>" + "".join(f"<li>{w(1, 20, self.KEEP)}</li>" for _ in range(3)) + "</ul>")
            elif r < 0.90:
                out.append(f"<blockquote><p>{w(5, 40, self.KEEP)}</p></blockquote>")
            elif r < 0.93:
                out.append("<table><tr>" + "".join(f"<td>{w(1, 5, self.KEEP)}</td>" for _ in range(3)) + "</tr></table>")
            elif r < 0.97:
                out.append(self.boiler(self.pick(["ad", "related", "share", "form"])))
            else:
                out.append(f"<figure><figcaption>{w(2, 12, self.KEEP)}</figcaption></figure>")
        if self.chance(0.2):
            out.append(self.boiler(self.pick(["share", "related", "comments"])))
        shell = self.pick(["<article>{}</article>"] * 3 + ["<main>{}</main>", '<div class="post-content">{}</div>', '<div id="content">{}</div>', '<div class="entry">{}</div>', '<main><article class="post">{}</article></main>', "<div>{}</div>"])
        return shell.format("".join(out))

    def page(self) -> str:
        some = lambda kinds, p: [self.boiler(k) for k in kinds if self.chance(p)]
        body = some(["notice"], 0.25) + some(["header"], 0.4) + some(["nav"], 0.8) + some(["ad"], 0.5) + [self.article()] + some(["ad", "aside", "related", "comments", "form"], 0.3) + some(["footer"], 0.85)
        inner = "".join(body)
        if self.chance(0.3):
            inner = self.pick(['<div id="wrap">{}</div>', '<div class="container"><div class="row">{}</div></div>']).format(inner)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8, self.DROP)}</title></head><body>{inner}</body></html>"


def labelled_page(source: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels: a node belongs to the main text if some of its text does."""
    page = parse(source)
    label = np.zeros(len(page.nodes))
    for owner, text in page.runs:
        k = owner if Maker.KEEP in text else -1
        while k >= 0:
            label[k] = 1
            k = page.nodes[k].parent
    return node_features(page), label


@functools.cache
def default_model(pages: int = 500, seed: int = 5) -> boost.Boosted:
    maker = Maker(seed)
    made = [labelled_page(maker.page()) for _ in range(pages)]
    return boost.train(np.concatenate([x for x, _ in made]), np.concatenate([y for _, y in made]), rounds=40, depth=4)


def extract_many(sources: list[str | None], model: boost.Boosted) -> list[list[str]]:
    """Main-text blocks of each page; nodes of several pages are scored at once."""
    pages = [parse(s or "") for s in sources]
    found = [node_features(p) for p in pages]
    if not pages:
        return []
    p = model.proba(np.concatenate(found))
    ends = np.cumsum([len(f) for f in found])
    return [main_text(page, p[end - len(f) : end]) for page, f, end in zip(pages, found, ends, strict=True)]


def extract(pages: DataFrame, model: boost.Boosted | None = None) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): blocks joined by two line feeds."""
    model = model or default_model()

    def run(batch: dict[str, list]) -> dict[str, list]:
        blocks = [b for k in range(0, len(batch["html"]), 64) for b in extract_many(batch["html"][k : k + 64], model)]
        texts = ["\n\n".join(b) for b in blocks]
        return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts], "n_blocks": [len(b) for b in blocks]}

    return map_rows(pages.select("page_id", "url", "html"), run, SCHEMA)
