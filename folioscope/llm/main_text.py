"""Main text of web pages: gradient-boosted trees over the nodes of the document tree, decoded so that no part is kept outside what is kept."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import hash_below, tidied
from folioscope.llm.warc import SILENT, _plain, tags

# Elements of HTML by how they take part in a page.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol "
    "optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
NO_TEXT = {*SILENT, "title", "textarea", "object", "canvas", "audio", "video", "math"}
CONTROLS = set("input button select textarea".split())
#: What a new one of these ends, and what keeps it from being ended from within.
ENDED = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
ENDED |= {x: (("tbody", "thead", "tfoot"), ("table",)) for x in ("tbody", "thead", "tfoot")}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BARRIERS = ("td", "th", "caption", "button")

#: Groups of elements that a feature tells apart, and of the words in attributes (class, id, role).
KINDS = {
    "text": "#text", "p": "p", "title": "h1", "heading": "h2 h3 h4 h5 h6 hgroup", "item": "li dt dd option", "list": "ul ol dl menu dir select", "div": "div center", "section": "section details", "article": "article", "main": "main",
    "nav": "nav", "header": "header", "footer": "footer address", "aside": "aside", "form": "form fieldset search button legend dialog", "table": "table tbody thead tfoot tr td th caption", "quote": "blockquote pre", "figure": "figure figcaption",
}
KIND = {tag: k for k, names in enumerate(KINDS.values()) for tag in names.split()}
WORDS = {
    "main": "article|articles|articlebody|content|contents|maincontent|post|entry|story|main|body|text|prose|markdown",
    "title": "title|headline|heading|subtitle",
    "nav": r"nav\w*|menus?|breadcrumbs?|pag(?:er|ination)|toc|tabs?|skip",
    "head": "header|masthead|topbar|logo|branding|brand|top|banner",
    "foot": "footer|foot|copyright|colophon|legal|bottom|contentinfo|imprint",
    "side": r"side\w*|aside|widgets?|related|recommend\w*|more|popular|trending|rail|complementary|teasers?",
    "ad": r"ads?|adv|advert\w*|adsense|adslot|sponsor\w*|promo\w*|dfp|commercial|affiliate|partner|partners",
    "notice": r"cookies?|consent|gdpr|ccpa|privacy|notice|notices|notification|alert\w*|popup|modal|overlay|toast|warning|disclaimer|dialog|paywall|announcement",
    "comment": r"comment\w*|disqus|repl(?:y|ies)|respond|responses|discussion|feedback|reviews?|threads?",
    "share": "share|sharing|social|follow|likes?|tweet|buttons?|toolbar|actions",
    "form": r"form\w*|search|login|signin|signup|register|contact|fields?|newsletter|subscri\w*|poll",
    "byline": "byline|author|date|meta|tags?|category|categories|time|published",
}
_WORDS = [re.compile(x) for x in WORDS.values()]
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_ENDS = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.I) for x in NO_TEXT}
#: Stands in front of the texts of made pages that are main text; a character for private use.
MARK = "\ue000"


@lru_cache(maxsize=1 << 14)
def words_in(names: str) -> int:
    """Bits of the groups that the words of an attribute's value belong to."""
    own = {w.lower() for w in _WORD.findall(names)}
    return sum(1 << k for k, x in enumerate(_WORDS) if any(map(x.fullmatch, own)))


@dataclass
class Page:
    """A page's nodes in page order: blocks, and runs of text between their edges (kind 0).

    ``end`` is the place after a node's last descendant; ``above`` has the bits of the kinds and of the attributes' words of the nodes that it stands in.
    """

    parent: list[int] = field(default_factory=lambda: [-1])
    end: list[int] = field(default_factory=lambda: [0])
    kind: list[int] = field(default_factory=lambda: [KIND["div"]])
    words: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    above: list[tuple[int, int]] = field(default_factory=lambda: [(0, 0)])
    texts: dict[int, str] = field(default_factory=dict)
    linked: dict[int, int] = field(default_factory=dict)
    links: list[int] = field(default_factory=lambda: [0])
    controls: list[int] = field(default_factory=lambda: [0])

    def add(self, parent: int, kind: int, words: int) -> int:
        self.parent.append(parent)
        self.end.append(0)
        self.kind.append(kind)
        self.words.append(words)
        self.depth.append(self.depth[parent] + 1)
        kinds, names = self.above[parent]
        self.above.append((kinds | 1 << self.kind[parent], names | max(0, self.words[parent])))
        self.links.append(0)
        self.controls.append(0)
        return len(self.parent) - 1


def parse(text: str | None) -> Page:
    """The tree of a page's blocks, however badly formed, in one pass. Scripts, styles, comments, titles and hidden parts leave nothing. White space within a run of text is one blank."""
    page, text = Page(), text or ""
    stack, names, barriers, at = [0], ["body"], [0], 0
    places: dict[str, list[int]] = {}
    run, anchors, in_links, n_links = [], 0, 0, 0

    def flush() -> None:
        nonlocal in_links, n_links
        if run:
            own = " ".join("".join(run).split())
            if own:
                k = page.add(stack[-1], 0, 0)
                page.end[k] = k + 1
                page.texts[k], page.linked[k], page.links[k] = own, min(in_links, len(own)), n_links
            run.clear()
        in_links = n_links = 0

    def place(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else 0

    def down_to(depth: int) -> None:
        flush()
        while len(stack) > depth:
            page.end[stack.pop()] = len(page.parent)
            places[names.pop()].pop()
        while barriers[-1] >= depth > 0:
            barriers.pop()

    found, go_on = tags(text), None
    while True:
        try:
            start, stop, name, closing, rest = found.send(go_on)
        except StopIteration:
            break
        go_on = None
        if start > at:
            own = _plain(text[at:start])
            run.append(own)
            if anchors:
                in_links += len(own)
        at = stop
        if not name:
            continue
        if name == "a":
            anchors = not closing
            n_links += not closing
        elif name == "br":
            run.append(" ")
        elif name in CONTROLS and not closing:
            page.controls[stack[-1]] += 1
        silent = name in NO_TEXT or (name in BLOCKS and not closing and rest and name != "body" and _HIDDEN.search(rest) is not None and name not in VOID)
        if silent and not closing and not rest.endswith("/"):
            if name in _ENDS:
                over = _ENDS[name].search(text, at)
                at = go_on = over.end() if over else len(text)
                continue
            words = -1
        else:
            words = 0
        if name not in BLOCKS and "-" not in name:
            continue
        if closing:
            if name in HEADINGS and names[-1] in HEADINGS:  # any of them ends another
                name = names[-1]
            depth = place(name)
            if name == "body" or not depth:
                flush()
            elif depth > barriers[-1] or name in ENDED or name in ("table", *BARRIERS):
                down_to(depth)
                anchors = 0
            continue
        if name == "body":
            flush()
            continue
        if names[-1] == "p" or (name in HEADINGS and names[-1] in HEADINGS):
            down_to(len(stack) - 1)
        if name in ENDED:
            ends, limits = ENDED[name]
            if (depth := max(map(place, ends))) > max(map(place, limits)):
                down_to(depth)
        flush()
        if name in VOID:
            continue
        if rest and words == 0:
            for value in _NAMES.findall(rest):
                words |= words_in(value.strip("\"'"))
        k = page.add(stack[-1], KIND.get(name, KIND["div"]), words)
        places.setdefault(name, []).append(len(stack))
        if name in BARRIERS:
            barriers.append(len(stack))
        stack.append(k)
        names.append(name)
    if at < len(text):
        run.append(_plain(text[at:]))
    down_to(1)
    page.end[0] = len(page.parent)
    return page


def features(pages: list[Page]) -> np.ndarray:
    """A row of numbers for each node of the pages: its subtree's text, links and punctuation, their density, its depth and place, its siblings, its element and attributes and those above it."""
    joined = lambda x: np.fromiter((y for p in pages for y in getattr(p, x)), np.int64)
    sizes = np.array([len(p.parent) for p in pages])
    starts = np.cumsum(sizes) - sizes
    start = np.repeat(starts, sizes)
    n = len(start)
    at = np.arange(n)
    up = np.maximum(joined("parent"), 0) + start  # a page's first node is its own parent
    end, kind, depth, words = joined("end") + start, joined("kind"), joined("depth"), np.maximum(joined("words"), 0)
    above = np.array([y for p in pages for y in p.above], np.int64).reshape(-1, 2)
    sums = np.zeros((14, n))
    leaf = np.array([k + s for p, s in zip(pages, starts.tolist(), strict=True) for k in p.texts], np.int64)
    texts = [x for p in pages for x in p.texts.values()]
    count = lambda c: np.fromiter((x.count(c) for x in texts), np.float64, len(texts))
    sums[0, leaf] = np.fromiter(map(len, texts), np.float64, len(texts))
    sums[1, leaf] = count(" ") + 1
    sums[2, leaf] = [y for p in pages for y in p.linked.values()]
    sums[3, leaf] = count(".") + count("!") + count("?") + count("。")
    sums[4, leaf] = count(",") + count(";")
    sums[5, leaf] = [x[-1] in ".!?:;\"'”»…。)" for x in texts]
    sums[6, leaf] = 1
    sums[7, leaf] = sums[0, leaf] * (kind[up[leaf]] == KIND["p"])
    sums[8], sums[9] = joined("controls"), joined("links")
    for row, tag in ((10, "h1"), (11, "h2"), (12, "li")):
        sums[row] = kind == KIND[tag]
    sums[13] = kind != 0
    run = np.concatenate((np.zeros((len(sums), 1)), np.cumsum(sums, axis=1)), axis=1)
    chars, n_words, linked, stops, commas, ended, leaves, in_p, controls, n_links, titles, headings, items, blocks = run[:, end] - run[:, at]
    # siblings: children in page order, one after the other; a page's first node is a group of its own
    group_of = np.where(at == start, -1 - start, up)
    order = np.argsort(group_of, kind="stable")
    first = np.r_[True, group_of[order][1:] != group_of[order][:-1]]
    group = np.cumsum(first) - 1
    many = np.bincount(group)
    index, siblings, mean = np.empty(n), np.empty(n), np.empty(n)
    log, dense = np.log1p(chars), linked / np.maximum(chars, 1)
    index[order] = at - np.flatnonzero(first)[group]
    siblings[order] = many[group]
    mean[order] = (np.bincount(group, log[order]) / many)[group]
    same = group[1:] == group[:-1]

    def beside(x: np.ndarray, step: int) -> np.ndarray:
        out, y = np.full(n, -1.0), x[order]
        if step < 0:
            out[order[1:]] = np.where(same, y[:-1], -1)
        else:
            out[order[:-1]] = np.where(same, y[1:], -1)
        return out

    _, alike, times = np.unique((group_of << 20) | (kind << 14) | words, return_inverse=True, return_counts=True)
    one = np.maximum(chars[start], 1)
    before = run[:, at] - run[:, start]
    out = np.empty((n, WIDTH), np.float32)
    numbers = (
        log, np.log1p(n_words), dense, np.log1p(chars / (blocks + 1)), np.log1p(leaves), np.log1p(chars / np.maximum(leaves, 1)), stops / np.maximum(n_words, 1), commas / np.maximum(n_words, 1), ended / np.maximum(leaves, 1),
        in_p / np.maximum(chars, 1), n_links / np.maximum(leaves, 1), np.log1p(controls), np.log1p(titles), np.log1p(headings), np.log1p(items), depth, index, siblings - index, np.log1p(siblings), chars / np.maximum(chars[up], 1), chars / one,
        before[0] / one, 1 - (before[0] + chars) / one, beside(log, -1), beside(log, 1), beside(dense, -1), beside(dense, 1), beside(kind, -1) == KIND["h1"], mean, np.log1p(times[alike.ravel()]), log[up], dense[up], before[10], n_words <= 3,
    )
    for k, x in enumerate(numbers):
        out[:, k] = x
    bits = np.arange(max(len(KINDS), len(WORDS)))
    k = NUMBERS
    for value, width in ((np.left_shift(1, kind), len(KINDS)), (above[:, 0], len(KINDS)), (words, len(WORDS)), (above[:, 1], len(WORDS))):
        out[:, k : k + width] = (value[:, None] >> bits[:width]) & 1
        k += width
    return out


NUMBERS = 34
WIDTH = NUMBERS + 2 * len(KINDS) + 2 * len(WORDS)
BINS = 32


@dataclass
class Trees:
    """Boosted trees of one depth: at each inner node a feature and a threshold (to the right if greater), at each leaf a value; log odds are their sum."""

    at: np.ndarray
    than: np.ndarray
    value: np.ndarray
    bias: float

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        flat, begin = np.ascontiguousarray(rows).ravel(), np.arange(len(rows)) * rows.shape[1]
        inner = self.at.shape[1]
        for at, than, value in zip(self.at, self.than, self.value, strict=True):
            node = np.zeros(len(rows), np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (flat.take(begin + at.take(node)) > than.take(node))
            out += value[node - inner]
        return out


def boost(rows: np.ndarray, labels: np.ndarray, n_numbers: int, n_trees: int = 50, depth: int = 5, rate: float = 0.3, ridge: float = 2.0) -> Trees:
    """Second-order gradient boosting of the logistic loss, in numpy. The first ``n_numbers`` features are cut into BINS quantile bins, the others are 0 or 1."""
    n, width = rows.shape
    cuts = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(n_numbers)]
    binned = [np.searchsorted(c, rows[:, j], "left") for j, c in enumerate(cuts)]
    bits = np.ascontiguousarray(rows[:, n_numbers:].T)
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3) if n else 0.5
    z = np.full(n, bias := float(np.log(share / (1 - share))))
    at, than, value = [], [], []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-z))
        g, h = labels - p, p * (1 - p)
        own_at, own_than = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf, np.float32)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            k = 1 << level
            best, where, cut = np.full(k, 1e-6), np.zeros(k, np.int64), np.full(k, np.inf, np.float32)
            gs, hs = np.bincount(node, g, k), np.bincount(node, h, k)

            def gain(gl, hl, gs=gs[:, None], hs=hs[:, None]):
                return gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)

            for j in range(n_numbers):
                if len(cuts[j]):
                    slot = node * BINS + binned[j]
                    much = gain(*(np.bincount(slot, x, k * BINS).reshape(k, BINS).cumsum(axis=1)[:, : len(cuts[j])] for x in (g, h)))
                    top = much.argmax(axis=1)
                    much = much[np.arange(k), top]
                    better = much > best + 1e-9
                    best, where, cut = np.where(better, much, best), np.where(better, j, where), np.where(better, cuts[j][top], cut)
            spread = np.zeros((n, 2 * k), np.float32)
            spread[np.arange(n), node], spread[np.arange(n), k + node] = g, h
            ones = (bits @ spread).astype(np.float64)
            much = gain(gs[:, None] - ones[:, :k].T, hs[:, None] - ones[:, k:].T)
            top = much.argmax(axis=1)
            much = much[np.arange(k), top]
            better = much > best + 1e-3
            where, cut = np.where(better, n_numbers + top, where), np.where(better, np.float32(0.5), cut)
            own_at[k - 1 : 2 * k - 1], own_than[k - 1 : 2 * k - 1] = where, cut
            node = 2 * node + (rows[np.arange(n), where[node]] > cut[node])
        leaf = rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + ridge)
        z += leaf[node]
        at.append(own_at)
        than.append(own_than)
        value.append(leaf)
    return Trees(np.array(at), np.array(than), np.array(value), bias)


def decode(page: Page, odds: np.ndarray) -> list[int]:
    """The runs of text to keep: the set of nodes of largest summed log odds in which every node's parent is as well.

    So a part of something dropped is never kept, and what is kept has all that it stands in. Hidden parts are out.
    """
    n = len(page.parent)
    best = odds.tolist()
    best[0] = float("inf")
    for k in range(n - 1, 0, -1):
        if page.words[k] < 0:
            best[k] = -1.0
        elif not page.kind[k] and k not in page.texts:
            best[k] = 0.0
        if best[k] > 0:
            best[page.parent[k]] += best[k]
    kept = [False] * n
    kept[0] = True
    for k in range(1, n):
        kept[k] = kept[page.parent[k]] and best[k] > 0
    return [k for k in page.texts if kept[k]]


def main_texts(model: Trees, html: list[str | None]) -> list[str]:
    """The kept runs of text of each page, in page order, a line each."""
    pages = [parse(x) for x in html]
    sizes = np.cumsum([len(p.parent) for p in pages])
    odds = np.split(model.log_odds(features(pages)), sizes[:-1]) if pages else []
    return ["\n".join(p.texts[k] for k in decode(p, own)) if p.texts else "" for p, own in zip(pages, odds, strict=True)]


# Names that made pages give to their parts.
NAMES = {
    "main": "content main-content article-body post entry-content post-content story article story-body page-content body-text prose",
    "plain": "wrapper container row col inner layout page box block section-1 grid c1 x7 wrap holder outer",
    "nav": "nav menu navbar main-menu topnav navigation breadcrumb breadcrumbs pagination toc nav-links",
    "head": "header masthead site-header top topbar page-header logo branding",
    "foot": "footer site-footer colophon page-footer copyright bottom legal",
    "side": "sidebar side aside widget related related-posts recommended more-stories right-rail popular trending",
    "ad": "ad ads advert advertisement sponsored banner promo ad-slot ad-container sponsor-box",
    "notice": "cookie-notice cookie-banner consent gdpr notice alert site-notice popup modal announcement disclaimer privacy-notice",
    "comment": "comments comment-list discussion replies respond user-comments disqus-thread responses reader-comments",
    "share": "share social share-bar social-links follow-us sharing",
    "form": "newsletter signup search login subscribe contact-form search-form poll",
}


class Made:
    """Pages of made layouts round given texts: every part's place, elements and names are drawn anew, and each run of main text begins with MARK."""

    def __init__(self, seed: int, texts: list[str]):
        self.r = random.Random(seed)
        self.texts = texts
        self.words = [w for t in texts for w in t.split()][:20_000] or ["word"]

    def some(self, least: int, most: int) -> str:
        a = self.r.randrange(len(self.words))
        return " ".join(self.words[(a + i) % len(self.words)] for i in range(self.r.randint(least, most))).replace("<", "")

    def prose(self, least: int = 8, most: int = 120) -> str:
        n, x = self.r.randint(least, most), self.r.choice(self.texts).replace("<", "").split() if self.texts else []
        a = self.r.randrange(max(1, len(x) - n))
        return " ".join(x[a : a + n]) if len(x) >= least else self.some(least, most).capitalize() + "."

    def open(self, tag: str, names: str | None, chance: float = 0.95) -> str:
        if names is None or self.r.random() > chance:
            return f"<{tag}>"
        own = self.r.choice(NAMES[names].split())
        if self.r.random() < 0.2:
            own = f"{self.r.choice(NAMES['plain'].split())} {own}"
        return f'<{tag} {self.r.choice(["class", "class", "id"])}="{own}">'

    def link(self, least: int = 1, most: int = 3) -> str:
        return f'<a href="/{self.r.randrange(999)}">{self.some(least, most)}</a>'

    def links(self, least: int = 3, most: int = 10) -> str:
        n = self.r.randint(least, most)
        if self.r.random() < 0.7:
            return f"<ul>{''.join(f'<li>{self.link()}</li>' for _ in range(n))}</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(self.link() for _ in range(n))

    def within(self, tag: str, names: str | None, *parts: str, chance: float = 0.95) -> str:
        body = "".join(parts)
        if self.r.random() < 0.15:
            body = f"{self.open('div', 'plain', 0.5)}{body}</div>"
        return f"{self.open(tag, names, chance)}{body}</{tag}>"

    def nav(self) -> str:
        return self.within("nav", "nav", self.links(), chance=0.5) if self.r.random() < 0.6 else self.within("div", "nav", self.links())

    def header(self) -> str:
        r = self.r
        name = r.choice([f"<h1>{self.some(1, 4)}</h1>", f"<div>{self.link(1, 3)}</div>", f"<p>{self.some(1, 4)}</p>", f"<h2>{self.link(1, 4)}</h2>"])
        rest = f"<p>{self.prose(3, 14)}</p>" * (r.random() < 0.5) + (self.nav() if r.random() < 0.4 else "")
        return self.within("header", "head", name, rest, chance=0.5) if r.random() < 0.6 else self.within("div", "head", name, rest)

    def footer(self) -> str:
        r = self.r
        parts = [f"&copy; {self.some(1, 3)} &middot; {self.prose(2, 12)}", f"<p>{self.prose(4, 40)}</p>", self.links(2, 6), f"<p>&copy; 20{r.randrange(10, 30)} {self.some(1, 5)}</p>"]
        r.shuffle(parts)
        parts = parts[: r.randint(1, 3)]
        return self.within("footer", "foot", *parts, chance=0.4) if r.random() < 0.65 else self.within("div", "foot", *parts)

    def sidebar(self) -> str:
        r = self.r
        parts = [f"<h{r.randint(2, 4)}>{self.some(1, 3)}</h3>"] + [r.choice([self.links(3, 8), f"<p>{self.prose(5, 40)}</p>", f"<div>{self.link(3, 8)}<p>{self.prose(5, 25)}</p></div>"]) for _ in range(r.randint(1, 4))]
        return self.within("aside", "side", *parts, chance=0.6) if r.random() < 0.55 else self.within(r.choice(["div", "section", "div"]), "side", *parts, chance=0.97)

    def advert(self) -> str:
        body = self.r.choice([self.prose(3, 30), f"<p>{self.prose(3, 30)}</p>", self.link(2, 8), f"<p>{self.prose(4, 20)} {self.link(1, 3)}</p>", f"<h4>{self.some(2, 5)}</h4><p>{self.prose(4, 30)}</p>"])
        return self.within(self.r.choice(["div", "div", "section", "aside", "p" if "<" not in body else "div"]), "ad", body, chance=1)

    def notice(self) -> str:
        body = self.r.choice([self.prose(4, 40), f"<p>{self.prose(4, 40)}</p>", f"<p>{self.prose(4, 30)} {self.link(1, 3)}</p>"]) + f"<button>{self.some(1, 2)}</button>" * (self.r.random() < 0.6)
        if self.r.random() < 0.15:
            return f'<div role="{self.r.choice(["alert", "dialog", "alertdialog"])}">{body}</div>'
        return self.within(self.r.choice(["div", "div", "section", "aside"]), "notice", body, chance=1)

    def form(self) -> str:
        r = self.r
        body = f"<p>{self.prose(3, 25)}</p>" * (r.random() < 0.6) + "".join(f"<label>{self.some(1, 3)}</label><input name=x>" for _ in range(r.randint(1, 4))) + f"<textarea>{self.some(0, 3)}</textarea>" * (r.random() < 0.3) + f"<button>{self.some(1, 2)}</button>"
        own = self.within("form", "form", body, chance=0.4)
        return self.within("div", "form", f"<h3>{self.some(1, 4)}</h3>" * (r.random() < 0.5), own) if r.random() < 0.4 else own

    def comments(self) -> str:
        r = self.r
        tag, inner = r.choice([("div", "div"), ("section", "div"), ("section", "article"), ("ol", "li"), ("ul", "li"), ("div", "p")])
        own, by = r.random() < 0.7, r.choice(["b", "strong", "span", "p", "h4", "cite"])
        items = []
        for _ in range(r.randint(1, 9)):
            who = f"<{by}>{self.some(1, 2)}</{by}> " if inner != "p" or by not in ("p", "h4") else f"<b>{self.some(1, 2)}</b>: "
            text = self.prose(3, 90)
            text = f"<p>{text}</p>" if inner != "p" and r.random() < 0.75 else text
            items.append(f'<{inner}{" class=" + r.choice(["comment", "reply", "comment-body"]) if own else ""}>{who}{text}</{inner}>')
        body = f"<h{(k := r.randint(2, 4))}>{self.some(1, 3)}</h{k}>" * (r.random() < 0.7) + "".join(items)
        return self.within(tag, "comment", body, self.form() if r.random() < 0.3 else "", chance=0.9 if not own else 0.95)

    def share(self) -> str:
        return self.within("div", "share", self.links(2, 5))

    def own(self, text: str) -> str:
        return MARK + text

    def paragraph(self) -> str:
        r = self.r
        text = self.prose(1, 6) if r.random() < 0.2 else self.prose(8, 130)
        if r.random() < 0.2:
            cut = text.split(" ")
            k = r.randrange(len(cut))
            cut[k] = f'<a href="/x">{cut[k]}</a>' if r.random() < 0.6 else f"<em>{cut[k]}</em>"
            text = " ".join(cut)
        if r.random() < 0.12:
            return f"<p><b>{self.own(text)}<br>"
        return f"<p>{self.own(text)}</p>"

    def block(self) -> str:
        r, x = self.r, self.r.random()
        if x < 0.72:
            return self.paragraph()
        if x < 0.82:
            return f"<h{(k := r.randint(2, 4))}>{self.own(self.prose(1, 8))}</h{k}>"
        if x < 0.9:
            return f"<{(t := r.choice(['ul', 'ol']))}>{''.join(f'<li>{self.own(self.prose(2, 25))}</li>' for _ in range(r.randint(2, 7)))}</{t}>"
        if x < 0.94:
            return f"<blockquote>{r.choice(['{}', '<p>{}</p>']).format(self.own(self.prose(5, 50)))}</blockquote>"
        if x < 0.96:
            return f"<pre>{self.own(self.prose(5, 40))}</pre>"
        if x < 0.98:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.own(self.some(1, 4))}</td>" for _ in range(r.randint(2, 4))) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>"
        return f"<figure><img src=x><figcaption>{self.own(self.prose(3, 15))}</figcaption></figure>"

    def article(self) -> str:
        r = self.r
        title = f"<h{(k := r.choice([1, 1, 1, 2]))}>{self.own(self.some(1, 12))}</h{k}>"
        n, style = r.choice([0, 1, 1, 2, 3, 4, 6, 9, 14, 20]), r.random()
        if style < 0.1:  # paragraphs as divs
            blocks = [f"<div>{self.own(self.prose(8, 120))}</div>" for _ in range(n)]
        elif style < 0.15:  # one run of text
            blocks = [self.own(self.prose(20, 200))] * min(n, 1)
        else:
            blocks = [self.block() for _ in range(n)]
        for part, chance in ((self.advert, 0.2), (self.share, 0.15), (self.sidebar, 0.12), (self.form, 0.08), (self.notice, 0.06)):
            if r.random() < chance:
                blocks.insert(r.randint(0, len(blocks)), part())
        if r.random() < 0.9 or not n:
            blocks.insert(0, f"<header>{title}</header>" if r.random() < 0.08 else title)
        if r.random() < 0.08:
            blocks.append(self.comments())
        if r.random() < 0.12:
            by = r.choice(["p", "div", "div", "span"])
            blocks.insert(min(1, len(blocks)), f'<{by} class="{r.choice(["byline", "meta", "post-meta", "author", "date"])}">{self.own(self.some(2, 7))}</{by}>')
        body = "".join(blocks)
        kind = r.random()
        if kind > 0.95:  # nothing round it
            return body
        body = self.within("article", "main", body, chance=0.3) if kind < 0.5 else self.within("main", "main", body, chance=0.3) if kind < 0.6 else self.within(r.choice(["div", "div", "section", "td"]), "main", body, chance=0.7)
        if body.startswith("<td"):
            body = f"<table><tr>{body}</tr></table>"
        for _ in range(r.choice([0, 0, 0, 1, 1, 2, 3])):
            body = self.within(r.choice(["div", "div", "div", "main", "section"]), "plain", body, chance=0.6)
        return body

    def page(self) -> str:
        r = self.r
        much = r.choice([0, 0.5, 1, 1, 1, 1])  # of what stands round an article
        before = [f() for f, chance in ((self.notice, 0.3), (self.header, 0.5), (self.nav, 0.6), (self.advert, 0.4), (self.form, 0.12)) if r.random() < chance * much]
        beside = [self.sidebar()] if r.random() < 0.35 * much else []
        after = [f() for f, chance in ((self.share, 0.15), (self.comments, 0.4), (self.sidebar, 0.2), (self.advert, 0.2), (self.form, 0.15), (self.notice, 0.15), (self.nav, 0.1), (self.footer, 0.75)) if r.random() < chance * much]
        if r.random() < 0.3:
            r.shuffle(before)
        middle = [*beside, self.article()] if r.random() < 0.5 else [self.article(), *beside]
        if after and r.random() < 0.5:  # what belongs to the article stands beside it
            middle.append(after.pop(0))
        inner = "".join(middle)
        if r.random() < 0.35:
            inner = self.within("div", "plain", inner)
        out = "".join([*before, inner, *after])
        if r.random() < 0.15:
            out = self.within("div", "plain", out)
        return f"<!DOCTYPE html><html><head><title>{self.some(1, 6)}</title><style>p{{margin:0}}</style><script>var t=1;</script></head><body>{out}" + "</body></html>" * (r.random() < 0.8)


#: Attribute groups and elements inside which a sampled page's text is no main text, and the elements that it has to stand in.
_OUT = sum(1 << list(KINDS).index(k) for k in ("nav", "header", "footer", "aside", "form"))
_IN = sum(1 << list(KINDS).index(k) for k in ("article", "main"))
_OUT_WORDS = sum(1 << list(WORDS).index(k) for k in ("nav", "side", "ad", "notice", "comment", "share", "form"))


def said(page: Page) -> dict[int, bool]:
    """What a page's own markup says of its runs of text: inside an article or main element, and not inside a menu, advert and the like. Empty where it says nothing of the kind, or holds several articles."""
    if sum(k in (KIND["article"], KIND["main"]) for k in page.kind) != 1:
        return {}
    return {k: bool(page.above[k][0] & _IN) and not page.above[k][0] & _OUT and not page.above[k][1] & _OUT_WORDS for k in page.texts}


def _examples(pages: list[tuple[Page, dict[int, bool]]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all nodes; a block is main if it holds main text."""
    labels = []
    for page, own in pages:
        main = np.zeros(len(page.parent))
        for k, yes in own.items():
            while yes and k >= 0 and not main[k]:
                main[k], k = 1, page.parent[k]
        labels.append(main)
    return features([p for p, _ in pages]), np.concatenate(labels)


def marked(html: str) -> tuple[Page, dict[int, bool]]:
    """A made page's tree without its marks, and which runs had one."""
    page = parse(html)
    own = {k: MARK in x for k, x in page.texts.items()}
    page.texts = {k: x.replace(MARK, "") for k, x in page.texts.items()}
    return page, own


def train(sample: list[str], n_made: int = 700, seed: int = 5) -> Trees:
    """Trees from sampled pages whose own markup tells the main text, and from made pages round the sample's texts, where it is known however they are marked up."""
    known = [(p, own) for p in map(parse, sample) if (own := said(p))]
    texts = [x.replace(MARK, "") for p, own in known for k, x in p.texts.items() if own[k] and len(x) > 80][:3000]
    made = Made(seed, texts)
    return boost(*_examples([*known[: n_made // 2], *(marked(made.page()) for _ in range(n_made))]), NUMBERS)


def learn(pages: DataFrame, max_pages: int = 300, max_bytes: int = 1 << 15, key: str = "page_id") -> Trees:
    """Trees from about ``max_pages`` of ``pages`` (html), chosen by a hash of ``key`` among those of at most ``max_bytes``, which bounds what reaches the driver. Without any, from made pages alone."""
    short = pages.where(F.octet_length(F.col("html").cast("string")) <= max_bytes)
    n = short.count()
    sample = short.where(hash_below(key, max_pages / n)).select(key, F.col("html").cast("string").alias("html")).collect() if n else []
    return train([r["html"] for r in sorted(sample, key=lambda r: (r[key] is None, r[key] or 0, r["html"]))])


def extract(pages: DataFrame, model: Trees, key: str = "page_id", window_chars: int = 1 << 20) -> DataFrame:
    """(key, url, text, n_chars) for every row of ``pages`` (html, url): the main text, its blocks in page order, a line each.

    White space within a block is one blank, character references are decoded, nothing else is changed or left out. Null and
    empty pages, and those without main text, give an empty text. Whole pages; repeated rows and null keys stay; other columns are ignored.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, window, size = [], [], 0
            for x in batch.column(2):
                window.append(x.as_py())
                size += len(window[-1] or "")
                if size >= window_chars:
                    texts += main_texts(model, window)
                    window, size = [], 0
            texts += main_texts(model, window)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[key, "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("long").alias(key), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(tidied(over), f"{key} long, url string, text string, n_chars long")
