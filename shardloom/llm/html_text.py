"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed to block nodes and text segments (runs of inline text inside a block).  Each has
features of its subtree (text, link and tag density, paragraphs, inputs), its attribute tokens and
tags and those of its ancestors, its depth, its siblings and its place in the page.  Boosted trees
give each node the probability that it holds main text, and a decoder picks the most likely
labelling in which nothing is kept under a dropped node, so that an ancestor's and a descendant's
choices never contradict each other.

No page of the input is labelled, so the trees are trained here, on pages written by a seeded
generator of common layouts whose main text is known.

Defined results: a null or empty page has empty text; unclosed tags end with their parents, and
an unclosed script or style runs to the end; repeated rows are extracted each; an empty table
gives no rows.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>", re.S)
_NAME = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACES = re.compile(r"[ \t\n\r\f\v]+")
# Fixed names of the markup language.
RAW = {"script", "style", "template", "iframe", "noembed", "noframes", "svg", "math", "object", "canvas"}
TEXT_RAW = {"title", "textarea"}
VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
BLOCK = set(
    "html body head article section nav aside header footer main div p ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset legend "
    "h1 h2 h3 h4 h5 h6 hgroup pre blockquote figure figcaption address details summary dialog menu noscript select option button label textarea title search center".split()
)
_ENDS_P = BLOCK - {"button", "label", "option"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
_STOP = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "option": {"select"}}


@dataclass
class Page:
    """Nodes in page order.  A segment is a node named ``#text``; ``parent`` of the root is -1."""

    tag: list[str] = field(default_factory=list)
    attrs: list[tuple[str, ...]] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    tags: list[int] = field(default_factory=list)
    inputs: list[int] = field(default_factory=list)

    def add(self, tag: str, attrs: tuple[str, ...], parent: int) -> int:
        for column, value in ((self.tag, tag), (self.attrs, attrs), (self.parent, parent), (self.text, ""), (self.linked, 0), (self.tags, 0), (self.inputs, 0)):
            column.append(value)
        return len(self.tag) - 1


def attribute_tokens(attributes: str) -> tuple[str, ...]:
    if not attributes or "=" not in attributes:
        return ()
    return tuple(t.lower() for m in _NAME.finditer(attributes) for t in _TOKEN.findall(m[1] or m[2] or m[3] or ""))


def parse(source: str) -> Page:
    page = Page()
    stack = [(page.add("#root", (), -1), "#root")]  # open blocks
    inline: list[tuple[str, int]] = []  # open inline elements and the depth of their block
    parts: list[str] = []
    linked = anchors = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACES.sub(" ", html.unescape("".join(parts))).strip(" ")
            if text:
                node = page.add("#text", (), stack[-1][0])
                page.text[node], page.linked[node] = text, min(linked, len(text))
            parts.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal anchors
        flush()
        del stack[upto:]
        while inline and inline[-1][1] > len(stack):
            anchors -= inline.pop()[0] == "a"

    at, size = 0, len(source)
    while at < size:
        m = _TAG.search(source, at)
        piece = source[at : m.start() if m else size]
        if piece:
            parts.append(piece)
            if anchors > 0:
                linked += len(piece)
        if not m:
            break
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        page.tags[stack[-1][0]] += 1
        if m[1]:
            if name in BLOCK:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][1] == name:
                        close(k)
                        break
            else:
                for k in range(len(inline) - 1, -1, -1):
                    if inline[k][0] == name:
                        anchors -= name == "a"
                        del inline[k]
                        break
            continue
        if name in RAW or name in TEXT_RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            flush() if name in TEXT_RAW else None
            if name in TEXT_RAW:
                node = page.add(name, attribute_tokens(m[3]), stack[-1][0])
                inner = _SPACES.sub(" ", html.unescape(source[at : end.start() if end else size])).strip(" ")
                if inner:
                    page.text[page.add("#text", (), node)] = inner
            at = end.end() if end else size
            continue
        if name in VOID:
            parts.append(" ") if name in ("br", "hr", "wbr") and name != "wbr" else None
            page.inputs[stack[-1][0]] += name == "input"
            continue
        if name in BLOCK:
            same, stop = _SAME.get(name, ()), _STOP.get(name, ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] in same:
                    close(k)
                elif stack[k][1] in stop or (same and stack[k][1] not in ("p",)):
                    break
            if name in _ENDS_P and stack[-1][1] == "p":
                close(len(stack) - 1)
            flush()
            node = page.add(name, attribute_tokens(m[3]), stack[-1][0])
            page.inputs[node] += name in ("select", "button", "textarea")
            stack.append((node, name))
        elif not m[3].endswith("/"):
            inline.append((name, len(stack)))
            anchors += name == "a"
    flush()
    return page


# --- features --------------------------------------------------------------------------------------

FEATURES = 25


@dataclass
class Evidence:
    """Log odds of main text by tag and by attribute token, from the training pages."""

    tags: dict[str, float] = field(default_factory=dict)
    tokens: dict[str, float] = field(default_factory=dict)

    def of_tokens(self, tokens: tuple[str, ...]) -> float:
        known = [self.tokens[t] for t in tokens if t in self.tokens]
        return max(-6.0, min(6.0, sum(known))) if known else 0.0


def features(page: Page, evidence: Evidence) -> np.ndarray:
    n = len(page.tag)
    parent = page.parent
    chars = [len(t) for t in page.text]
    stops = [sum(map(t.count, ".,!?;")) if t else 0 for t in page.text]
    links, tags, inputs = list(page.linked), list(page.tags), list(page.inputs)
    in_p = [c if parent[i] >= 0 and page.tag[parent[i]] == "p" else 0 for i, c in enumerate(chars)]
    children: list[int] = [0] * n
    size = [1] * n
    same: Counter = Counter()
    place = [0] * n
    for i in range(1, n):
        place[i] = children[parent[i]]
        children[parent[i]] += 1
        same[parent[i], page.tag[i]] += 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for column in (chars, stops, links, tags, inputs, in_p, size):
            column[p] += column[i]
    out = np.zeros((n, FEATURES))
    depth, low_t, high_t, low_a, high_a, named, up_t = ([0.0] * n for _ in range(7))
    total = chars[0] or 1
    before = 0
    for i in range(n):
        p = parent[i]
        own_t = evidence.tags.get(page.tag[i], 0.0)
        own_a = evidence.of_tokens(page.attrs[i])
        if p >= 0:
            depth[i] = depth[p] + 1
            low_t[i], high_t[i] = min(low_t[p], own_t), max(high_t[p], own_t)
            low_a[i], high_a[i] = min(low_a[p], own_a), max(high_a[p], own_a)
        # The nearest ancestor that says anything by its attributes, and the parent's tag.
        named[i] = own_a or (named[p] if p >= 0 else 0.0)
        up_t[i] = evidence.tags.get(page.tag[p], 0.0) if p >= 0 else 0.0
        c, siblings = chars[i], children[p] if p >= 0 else 1
        around = (chars[p] - c) / max(1, siblings - 1) if p >= 0 else 0
        out[i] = (
            depth[i], math.log1p(c), links[i] / max(1, c), math.log1p(100 * tags[i] / (1 + c)), children[i], place[i], siblings,
            same[p, page.tag[i]] / siblings if p >= 0 else 1, c / max(1, chars[p]) if p >= 0 else 1, c / total, own_a, low_a[i], own_t, low_t[i],
            stops[i] / max(1, c), math.log1p(around), page.tag[i] == "#text", before / total, inputs[i], high_t[i], in_p[i] / max(1, c), high_a[i],
            named[i], up_t[i], up_t[p] if p >= 0 else 0.0,
        )
        if page.tag[i] == "#text":
            before += len(page.text[i])
    return out


# --- boosted trees -----------------------------------------------------------------------------------


@dataclass
class Trees:
    """Gradient-boosted trees of one depth, split at quantile bins; scores are log odds."""

    edges: list[np.ndarray]
    feature: np.ndarray  # (tree, inner node)
    bound: np.ndarray
    leaf: np.ndarray  # (tree, leaf)
    start: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 5.0) -> Trees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)])
        start = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
        score = np.full(len(y), start)
        inner, leaves = (1 << depth) - 1, 1 << depth
        feature, bound, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p) + 1e-6
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                width = 1 << level
                local = node - (width - 1)
                best = np.full(width, 1e-6)
                pick = np.full((width, 2), -1, np.int64)
                all_g, all_h = np.bincount(local, g, width), np.bincount(local, h, width)
                for j, e in enumerate(edges):
                    k = len(e) + 1
                    code = local * k + binned[:, j]
                    left_g = np.bincount(code, g, width * k).reshape(width, k).cumsum(1)[:, :-1]
                    left_h = np.bincount(code, h, width * k).reshape(width, k).cumsum(1)[:, :-1]
                    if not left_g.size:
                        continue
                    right_g, right_h = all_g[:, None] - left_g, all_h[:, None] - left_h
                    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - (all_g**2 / (all_h + 1))[:, None]
                    gain[(left_h < least * 0.1) | (right_h < least * 0.1)] = -1
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best[better] = top[better]
                    pick[better] = np.column_stack([np.full(width, j), at])[better]
                for q in np.flatnonzero(pick[:, 0] >= 0):
                    feature[t, width - 1 + q] = pick[q, 0]
                    bound[t, width - 1 + q] = edges[pick[q, 0]][pick[q, 1]]
                j = feature[t, node]
                node = 2 * node + 1 + (x[np.arange(len(y)), j] > bound[t, node])
            where = node - inner
            leaf[t] = rate * np.bincount(where, g, leaves) / (np.bincount(where, h, leaves) + 1)
            score += leaf[t, where]
        return cls(edges, feature, bound, leaf, start)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out, row = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for t in range(len(self.leaf)):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[row, self.feature[t, node]] > self.bound[t, node])
            out += self.leaf[t, node - inner]
        return out


def decode(page: Page, score: np.ndarray) -> np.ndarray:
    """The likeliest labels in which no node is kept under a dropped one; the root is always kept."""
    n = len(page.tag)
    keep, drop = -np.logaddexp(0, -score), -np.logaddexp(0, score)  # log probabilities
    all_dropped, best = drop.copy(), keep.copy()
    for i in range(n - 1, 0, -1):
        best[i] = max(best[i], all_dropped[i])  # its children have been added
        p = page.parent[i]
        all_dropped[p] += all_dropped[i]
        best[p] += best[i]
    out = np.zeros(n, bool)
    out[0] = True
    for i in range(1, n):
        out[i] = out[page.parent[i]] and best[i] > all_dropped[i]
    return out


# --- training pages ------------------------------------------------------------------------------------

_MAIN_NAMES = "content main article post entry story body text page maincontent articleBody single hentry prose blog news container wrapper".split()
_OTHER = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav pagination pager toc".split(),
    "header": "header masthead banner top logo branding site title".split(),
    "footer": "footer bottom copyright legal colophon site imprint".split(),
    "aside": "sidebar aside widget related recommended popular trending archive tags secondary rail more".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner adsense adbox taboola outbrain dfp billboard".split(),
    "notice": "notice cookie consent gdpr alert warning popup modal overlay message paywall disclaimer newsletter subscribe signup".split(),
    "form": "form search login contact subscribe signup newsletter comment respond".split(),
    "comments": "comments comment reply discussion disqus thread responses replies reader commentlist".split(),
    "share": "share social sharing follow like buttons tools actions meta byline".split(),
}
_TAGS = {
    "nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "ad": ["div", "aside", "section", "p"],
    "notice": ["div", "section", "p", "dialog"], "form": ["form", "form", "div"], "comments": ["section", "div", "ol", "ul"], "share": ["div", "ul", "p"],
}


class Generator:
    """Pages of common layouts with their main text's segments known."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        parts = "ka lo mi ren tas vor el un dis per gra sul ten qui bar ost fen ol zu wem ich der ous ment ía été ön".split()
        self.words = ["".join(self.r.choices(parts, k=self.r.randint(1, 4))) for _ in range(3000)]
        self.main: list[str] = []
        self.count = 0

    def prose(self, low: int, high: int) -> str:
        words = self.r.choices(self.words, k=self.r.randint(low, high))
        out = []
        for w in words:
            out.append(w + self.r.choice(["", "", "", "", "", ",", "."]) if self.r.random() < 0.9 else f"<b>{w}</b>")
        text = " ".join(out).capitalize()
        return text + (". " if self.r.random() < 0.8 else " ")

    def mark(self, main: bool) -> str:
        """A word that tells the trainer whether its segment is main text; cut out before features."""
        self.count += 1
        return f"\x01{int(main)}\x02"

    def names(self, words: list[str]) -> str:
        kind = self.r.choice(["class", "class", "id", "both", "none"])
        pick = lambda: self.r.choice(["", "", "c-", "site-", "js-", "l_"]) + self.r.choice(words) + self.r.choice(["", "", "", "-box", "-1", "_inner", "Wrap"])
        return {"class": f' class="{pick()}"', "id": f' id="{pick()}"', "both": f' id="{pick()}" class="{pick()} {pick()}"', "none": ""}[kind]

    def links(self, n: int) -> str:
        items = [f'<a href="/{i}">{self.mark(False)}{self.prose(1, 3)}</a>' for i in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.7 else " | ".join(items)

    def other(self, kind: str) -> str:
        tag = self.r.choice(_TAGS[kind])
        names = self.names(_OTHER[kind])
        if not names and tag in ("div", "p", "ul", "section", "ol"):
            names = f' class="{self.r.choice(_OTHER[kind])}"'
        if kind == "nav" or kind == "share":
            inner = self.links(self.r.randint(2, 9))
        elif kind == "form":
            inner = f'<label>{self.mark(False)}{self.prose(1, 3)}</label><input name="q"><button>{self.mark(False)}{self.prose(1, 1)}</button>' + self.r.choice(["", f"<p>{self.mark(False)}{self.prose(4, 20)}</p>"])
        elif kind == "comments":
            each = lambda: f'<{t}{self.names(["comment", "reply", "author"])}><p>{self.mark(False)}{self.prose(3, 50)}</p></{t}>' if (t := self.r.choice(["div", "li", "article"])) else ""
            inner = f"<h3>{self.mark(False)}{self.prose(1, 3)}</h3>" + "".join(each() for _ in range(self.r.randint(1, 7)))
        elif kind == "aside":
            inner = f"<h3>{self.mark(False)}{self.prose(1, 4)}</h3>" + self.r.choice([self.links(self.r.randint(2, 8)), f"<p>{self.mark(False)}{self.prose(5, 60)}</p>"])
        elif kind in ("header", "footer"):
            inner = f"{self.mark(False)}{self.r.choice(['&copy; ', ''])}{self.prose(2, 40 if kind == 'footer' else 9)}" + self.r.choice(["", self.links(3)])
        else:
            inner = self.r.choice([f"{self.mark(False)}{self.prose(2, 40)}", f"<p>{self.mark(False)}{self.prose(3, 60)}</p>", f'<a href="/x">{self.mark(False)}{self.prose(2, 9)}</a>'])
        if tag == "p":  # a paragraph can't hold blocks
            inner = f"{self.mark(False)}{self.prose(2, 40)}"
        if tag == "ul":
            inner = f"<li>{inner}</li>"
        return f"<{tag}{names}>{inner}</{tag}>"

    def body(self) -> str:
        out = [f"<h1>{self.mark(True)}{self.prose(2, 9)}</h1>"] if self.r.random() < 0.8 else []
        for _ in range(self.r.choice([1, 2, 3, 5, 8, 14])):
            kind = self.r.random()
            if kind < 0.72:
                end = self.r.choice(["</p>", "</p>", ""])
                out.append(f"<p>{self.r.choice(['', '', '<b>', '<br>'])}{self.mark(True)}{self.prose(*self.r.choice([(1, 4), (5, 30), (30, 120)]))}{end}")
            elif kind < 0.8:
                out.append(f"<h2>{self.mark(True)}{self.prose(1, 7)}</h2>")
            elif kind < 0.87:
                out.append("<ul>" + "".join(f"<li>{self.mark(True)}{self.prose(2, 25)}</li>" for _ in range(self.r.randint(1, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote><p>{self.mark(True)}{self.prose(5, 40)}</p></blockquote>")
            elif kind < 0.95:
                out.append(f"<table><tr><td>{self.mark(True)}{self.prose(1, 6)}<td>{self.mark(True)}{self.prose(1, 6)}</table>")
            else:
                out.append(self.other(self.r.choice(["ad", "share", "notice", "aside", "form"])))
        return "".join(out)

    def page(self) -> str:
        tag = self.r.choice(["article", "article", "main", "div", "section"])
        names = self.names(_MAIN_NAMES) or (f' class="{self.r.choice(_MAIN_NAMES)}"' if tag in ("div", "section") else "")
        main = f"<{tag}{names}>{self.body()}"
        if self.r.random() < 0.25:
            main += self.other(self.r.choice(["comments", "share", "ad"]))
        main += f"</{tag}>"
        if self.r.random() < 0.35:
            main = f"<div{self.names(_MAIN_NAMES)}>{main}{self.other('aside') if self.r.random() < 0.4 else ''}</div>"
        before = [self.other(k) for k in ("header", "nav", "ad", "notice", "form") if self.r.random() < 0.5]
        after = [self.other(k) for k in ("aside", "comments", "form", "ad", "footer", "notice", "nav") if self.r.random() < 0.45]
        self.r.shuffle(before)
        title = f"<title>{self.mark(False)}{self.prose(2, 8)}</title>"
        return f"<!DOCTYPE html><html><head>{title}<style>p{{}}</style></head><body>{''.join(before)}{main}{''.join(after)}" + self.r.choice(["</body></html>", ""])


_MARK = re.compile("\x01([01])\x02")


def labelled(source: str) -> tuple[Page, np.ndarray]:
    """A generated page without its marks, and whether each node holds main text."""
    page = parse(source)
    y = np.zeros(len(page.tag))
    for i, text in enumerate(page.text):
        if text:
            y[i] = "\x011\x02" in text
            page.text[i] = _MARK.sub("", text)
            page.linked[i] = min(page.linked[i], len(page.text[i]))
    for i in range(len(y) - 1, 0, -1):
        y[page.parent[i]] = max(y[page.parent[i]], y[i])
    return page, y


@dataclass
class TextModel:
    evidence: Evidence
    trees: Trees

    def extract(self, sources: list[str]) -> list[str]:
        pages = [parse(s) for s in sources]
        tables = [features(p, self.evidence) for p in pages]
        scores = self.trees.scores(np.concatenate(tables)) if tables else np.empty(0)
        out, at = [], 0
        for page in pages:
            kept = decode(page, scores[at : at + len(page.tag)])
            at += len(page.tag)
            out.append("\n".join(t for t, k in zip(page.text, kept) if k and t))
        return out


@lru_cache(maxsize=2)
def train_text_model(pages: int = 1500, seed: int = 11, trees: int = 60, depth: int = 4) -> TextModel:
    """Trained on generated pages; the evidence tables and the trees see separate halves."""
    generator = Generator(seed)
    made = [labelled(generator.page()) for _ in range(pages)]
    tags: dict[str, np.ndarray] = {}
    tokens: dict[str, np.ndarray] = {}
    for page, y in made[: pages // 2]:
        for i in range(1, len(y)):
            tags.setdefault(page.tag[i], np.zeros(2))[int(y[i])] += 1
            for t in set(page.attrs[i]):
                tokens.setdefault(t, np.zeros(2))[int(y[i])] += 1
    odds = lambda c: float(np.log((c[1] + 0.5) / (c[0] + 0.5)))
    evidence = Evidence({k: odds(c) for k, c in tags.items()}, {k: odds(c) for k, c in tokens.items() if c.sum() >= 5})
    x = np.concatenate([features(p, evidence) for p, _ in made[pages // 2 :]])
    return TextModel(evidence, Trees.fit(x, np.concatenate([y for _, y in made[pages // 2 :]]), trees=trees, depth=depth))


def extract_text(pages: DataFrame, model: TextModel | None = None) -> DataFrame:
    """(page_id, url, text) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train_text_model())
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts = shared.value.extract([h or "" for h in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    source = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op9(pages: DataFrame) -> DataFrame:
    return extract_text(pages).withColumn("n_chars", F.length("text").cast("long"))
