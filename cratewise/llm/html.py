"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks, runs of text between block-level tags. A block's features are its ancestors' tags,
the words of their class, id and role, and its text (length, share of links, ending). The field has two states, main
text and the rest, with weights for features in the main state and for transitions; it is trained by maximum
likelihood on labelled pages and decoded by Viterbi.

The given pages carry no labels, so the labelled pages are composed here from wrappers with a known part: each page
has one main wrapper and several others before, inside and after it.

Null and empty pages, and pages without main blocks, give an empty text. Scripts, styles and other elements without
reading text are no blocks. Broken markup is read as far as it goes: an open paragraph ends where the next block
starts, unmatched end tags are passed over, an unfinished tag ends the page. Blocks are never cut or dropped for size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cratewise.llm.common import keyed, slices, texts

# Names of HTML elements.
BLOCK_TAGS = frozenset(
    "html body header footer nav main article section aside div p h1 h2 h3 h4 h5 h6 hgroup ul ol menu li dl dt dd table caption thead tbody tfoot tr td th form fieldset legend "
    "blockquote pre figure figcaption address details summary dialog hr center head search".split()
)
SILENT_TAGS = frozenset("script style template textarea select button title".split())
ENDED_BY_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SIBLING_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[a-zA-Z/])[^>]*>?|[^<]+|<", re.S)
_NAMES = re.compile(r"""(?<![-\w])(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_WORDS = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Paths that a task remembers.
_PATHS = 50_000


class Paths:
    """Ancestor paths by number; the features of each."""

    def __init__(self) -> None:
        self.features: list[frozenset[str]] = [frozenset()]
        self.known: dict[tuple[int, str, str], int] = {}

    def child(self, parent: int, tag: str, attributes: str) -> int:
        names = ""
        if attributes and "=" in attributes:
            names = " ".join(_CAMEL.sub(" ", a or b or c) for a, b, c in _NAMES.findall(attributes)).lower()
        key = (parent, tag, names)
        if key not in self.known:
            words = _NAME_WORDS.findall(names)
            own = {f"in {tag}"} | {f"word {w.rstrip('s')}" for w in words} | {f"stem {w[:4]}" for w in words if len(w) > 4}
            parents = {f for f in self.features[parent] if not f.startswith("is ")}
            self.known[key] = len(self.features)
            self.features.append(frozenset(parents | own | {f"is {tag}"}))
        return self.known[key]


@dataclass
class Block:
    path: int
    text: str
    linked: int  # characters inside links


def blocks(html: str, paths: Paths) -> list[Block]:
    """The leaf blocks of a page that have text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = [("", 0)]
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(stack[-1][1], text, linked))
            parts.clear()
        linked = 0

    def close(to: int) -> None:
        flush()
        del stack[to:]

    match = _TOKEN.match
    lower, endless = "", set()
    while at < len(html):
        m = match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            raw = m[0]
            if raw[0] != "<" or raw == "<":
                text = unescape(raw) if "&" in raw else raw
                parts.append(text)
                if in_link:
                    linked += len(text)
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            in_link = False
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                else:
                    flush()
                continue
            flush()
            for k in range(len(stack) - 1, 0, -1):  # an open paragraph ends
                if stack[k][0] == "p":
                    close(k)
                    break
            if tag in ENDED_BY_SIBLING:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in SIBLING_SCOPE[tag]:
                        break
                    if stack[k][0] in ENDED_BY_SIBLING[tag]:
                        close(k)
                        break
            if tag != "hr":
                stack.append((tag, paths.child(stack[-1][1], tag, m[3])))
        elif tag == "a":
            in_link = not m[1]
        elif tag in ("br", "img", "input", "wbr"):
            if tag != "wbr":
                parts.append(" ")
        elif tag in SILENT_TAGS and tag not in endless and not m[1] and not m[3].endswith("/"):
            lower = lower or html.lower()
            end = lower.find(f"</{tag}", at) if len(lower) == len(html) else -1
            if end < 0 and len(lower) != len(html):  # lower case changes the length of some letters
                found = re.compile(f"</{tag}", re.I).search(html, at)
                end = found.start() if found else -1
            if end >= 0:
                at = end
            else:
                endless.add(tag)  # no later one ends either
            if end < 0 and tag in ("script", "style", "title", "textarea"):
                at = len(html)
    flush()
    return out


def text_features(block: Block) -> list[str]:
    words = block.text.count(" ") + 1
    share = block.linked / len(block.text)
    return [
        f"words {min(words.bit_length(), 7)}", "links all" if share > 0.7 else "links some" if share > 0.2 else "links few",
        "ends a sentence" if block.text[-1] in ".!?…\"'”»" else "ends otherwise", "copyright" if "©" in block.text else "no copyright",
    ]


@dataclass
class Model:
    """Two states, 0 the rest and 1 main. weights: of a feature in state 1; transitions[a][b]; start: of state 1."""

    weights: dict[str, float]
    transitions: list[list[float]]
    start: float
    paths: Paths = field(default_factory=Paths)
    path_scores: list[float] = field(default_factory=list)

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi: whether each block is main text."""
        (t00, t01), (t10, t11) = self.transitions
        rest, main, back = 0.0, self.start, []
        get = self.weights.get
        for k in range(len(self.path_scores), len(self.paths.features)):
            self.path_scores.append(sum(get(f, 0.0) for f in self.paths.features[k]))
        for k, block in enumerate(page):
            score = self.path_scores[block.path] + sum([get(f, 0.0) for f in text_features(block)])
            if k:
                a, b, c, d = rest + t00, main + t10, rest + t01, main + t11
                back.append((b > a, d >= c))
                rest, main = max(a, b), max(c, d)
            main += score
        state = main >= rest
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return out[::-1] if page else []

    def text(self, html: str) -> str:
        if len(self.paths.features) > _PATHS:
            self.paths, self.path_scores = Paths(), []
        page = blocks(html, self.paths)
        return "\n".join(b.text for b, main in zip(page, self.decode(page)) if main)


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = 300, rate: float = 0.1, decay: float = 0.0002) -> Model:
    """Maximum likelihood with an L2 penalty, Adam. pages: features and labels of the blocks of each page."""
    names = sorted({f for page, _ in pages for block in page for f in block})
    place = {f: k for k, f in enumerate(names)}
    n, longest = len(pages), max(len(labels) for _, labels in pages)
    real = np.zeros((n, longest), bool)
    gold = np.zeros((n, longest), int)
    owner, feature = [], []
    for p, (page, labels) in enumerate(pages):
        real[p, : len(labels)] = True
        gold[p, : len(labels)] = labels
        for b, block in enumerate(page):
            owner += [p * longest + b] * len(block)
            feature += [place[f] for f in block]
    owner_a, feature_a = np.array(owner), np.array(feature)
    total = real.sum()
    theta = np.zeros(len(names) + 5)  # feature weights, transitions, start
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    both = real[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    for step in range(1, steps + 1):
        score = np.bincount(owner_a, weights=theta[feature_a], minlength=n * longest).reshape(n, longest)
        emit = np.stack([np.zeros_like(score), score], axis=2)
        move = theta[-5:-1].reshape(2, 2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = emit[:, 0] + np.array([0, theta[-1]])
        for t in range(1, longest):
            came = np.logaddexp.reduce(forward[:, t - 1, :, None] + move, axis=1) + emit[:, t]
            forward[:, t] = np.where(real[:, t, None], came, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            goes = np.logaddexp.reduce(move + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(real[:, t + 1, None], goes, 0)
        z = np.logaddexp.reduce(forward[:, -1], axis=1)
        main = np.where(real, np.exp(forward[:, :, 1] + backward[:, :, 1] - z[:, None]), 0)
        pair = np.exp(forward[:, :-1, :, None] + move + (emit + backward)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        gradient = np.zeros_like(theta)
        gradient[: len(names)] = np.bincount(feature_a, weights=(main - gold * real).ravel()[owner_a], minlength=len(names))
        gradient[-5:-1] = (pair.sum(axis=(0, 1)) - seen).ravel()
        gradient[-1] = (main[:, 0] - gold[:, 0]).sum()
        gradient = gradient / total + decay * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(dict(zip(names, theta[: len(names)].tolist())), theta[-5:-1].reshape(2, 2).tolist(), float(theta[-1]))


# Wrappers of the labelled pages. Those of main text, and the others by where they stand.
MAIN_WRAPPERS = [
    "article", "main", "main><article", "div class='article-body'", "div class='post-content'", "div id='content'", "div class='entry-content'", "section class='story'", "div class='main-text'",
    "div itemprop='articleBody'", "div role='main'", "article class='post'", "body", "div class='text'", "section id='article'", "div class='page'><article", "article><section", "div class='container'><main",
]
BEFORE_WRAPPERS = [
    "nav", "header", "div class='ad'", "div class='menu'", "div id='nav'", "div class='navbar'", "div class='top-bar header'", "div class='cookie-notice'", "div class='cookie-banner consent'", "div class='breadcrumbs'",
    "form", "form class='search'", "div class='search-box'", "div class='notice'", "div role='banner'", "div role='navigation'", "ul class='menu'", "div class='alert warning'", "div class='popup modal'", "div class='gdpr'",
    "div class='skip-link'", "header class='masthead'", "div class='login'", "div role='alert'", "div class='announcement'", "header><nav",
]
INSIDE_WRAPPERS = [
    "div class='ad'", "div class='advert'", "div class='advertisement'", "aside", "aside class='related'", "div class='share'", "div class='social-links'", "div class='newsletter'", "form", "div class='promo'", "div class='sponsored'",
    "div class='subscribe'", "div class='ads banner'", "nav", "div class='notice'", "div class='recommended'", "div class='paywall'", "footer", "div class='widget'", "nav class='toc'", "div class='sponsor'", "div class='ad-slot'",
]
AFTER_WRAPPERS = [
    "footer", "div class='footer'", "div id='footer'", "aside", "aside class='sidebar'", "div class='sidebar'", "div id='sidebar-right'", "section class='comments'", "div id='comments'", "div class='comment-list'", "div class='reader-comments'",
    "section class='comments'><article class='comment'", "ol class='commentlist'", "div class='related-posts'", "div class='copyright'", "div class='pagination'", "div class='tags'", "div class='disqus thread'", "div class='replies'",
    "form class='comment-form'", "div role='contentinfo'", "div role='complementary'", "div class='ad'", "div class='promotion'", "nav class='pager'", "section class='responses'", "div class='recommendations'", "div class='signup'",
]
BARE_WRAPPERS = ["aside", "form", "nav", "footer", "aside"]
PLAIN_WRAPPERS = ["div", "div class='wrapper'", "section", "div class='row'", "div id='page'", "div class='container'"]


def labelled_pages(count: int = 500, seed: int = 0) -> list[tuple[str, list[int]]]:
    """Pages of random words, and for each of their blocks whether it is main text."""
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefghilmnoprstuv"), rng.integers(2, 9))) for _ in range(300)]
    labels: list[int] = []

    def words(low: int, high: int) -> str:
        return " ".join(rng.choice(vocabulary, rng.integers(low, high + 1)))

    def sentence(high: int) -> str:
        return words(1, high).capitalize() + rng.choice([".", ".", ".", "?", ""])

    def wrap(wrapper: str, inner: str) -> str:
        tags = wrapper.split("><")
        return "".join(f"<{t}>" for t in tags) + inner + "".join(f"</{t.split()[0]}>" for t in reversed(tags))

    def other(wrapper: str) -> str:
        kind, n = rng.integers(5), rng.integers(1, 5)
        if kind == 0 or "menu" in wrapper and kind < 3:
            inner = "<ul>" + "".join(f"<li><a href='/x'>{words(1, 3)}</a></li>" for _ in range(n)) + "</ul>"
        elif kind == 1:
            n, inner = 1, sentence(25)
        elif kind == 2:
            n, inner = 1, f"&copy; {words(1, 2)} &middot; {sentence(12)}" if "foot" in wrapper or "copy" in wrapper else f"{sentence(8)} <a href='/y'>{words(1, 2)}</a>"
        else:
            inner = "".join(f"<p>{sentence(60)}</p>" for _ in range(n))
        labels.extend([0] * n)
        return wrap(wrapper, inner)

    def paragraph() -> str:
        labels.append(1)
        kind = rng.integers(12)
        text = sentence(90 if rng.integers(3) else 6)
        if kind == 0:
            return f"<h2>{words(1, 8)}</h2>"
        if kind == 1:
            return f"<blockquote>{text}</blockquote>"
        if kind == 2:
            return f"<ul><li>{text}</li></ul>"
        if kind == 3:
            return f"<p>{text} <a href='/z'>{words(1, 2)}</a> {words(3, 9)}.</p>"
        if kind == 4:
            return f"<div>{text}</div>"
        if kind == 5:
            return f"<table><tr><td>{text}</td></tr></table>"
        return f"<p>{text}</p>"

    out = []
    for k in range(count):
        labels = []
        html = "".join(other(BEFORE_WRAPPERS[(k * 3 + j) % len(BEFORE_WRAPPERS)]) for j in range(rng.integers(0, 4)))
        labels.append(1)
        body = f"<h1>{words(2, 12)}</h1>"
        for j in range(rng.integers(1, 9)):
            body += paragraph()
            if rng.integers(3) == 0:
                inside = INSIDE_WRAPPERS + AFTER_WRAPPERS if k % 2 else BARE_WRAPPERS
                body += other(inside[(k + 7 * j) % len(inside)])
        wrapper = MAIN_WRAPPERS[k % len(MAIN_WRAPPERS)]
        html += body if wrapper == "body" else wrap(wrapper, body)
        html += "".join(other(AFTER_WRAPPERS[(k * 3 + j) % len(AFTER_WRAPPERS)]) for j in range(rng.integers(0, 4)))
        if rng.integers(2):
            html = wrap(PLAIN_WRAPPERS[k % len(PLAIN_WRAPPERS)], html)
        out.append((f"<html><body>{html}</body></html>", labels))
    return out


def fit(pages: list[tuple[str, list[int]]]) -> Model:
    """``pages``: html and the labels of its blocks in order."""
    paths, rows = Paths(), []
    for html, labels in pages:
        page = blocks(html, paths)
        if len(page) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(page)} blocks")
        rows.append(([sorted(paths.features[b.path]) + text_features(b) for b in page], labels))
    return train(rows)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, url, text) of each page."""
    sent = pages.sparkSession.sparkContext.broadcast((model.weights, model.transitions, model.start))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in slices(batches, "html"):
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([own.text(t) for t in texts(batch, "html")], pa.string())], ["page_id", "url", "text"])

    return keyed(pages, "page_id", url="string", html="string").mapInArrow(task, "page_id long, url string, text string")
