"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of elements; text that stands loose in the body becomes elements of its own, one for each
stretch between blocks. Each element gets features: its kind of tag, what its class, id and role tokens say, what
its first line and the heading before it say, whether it begins as a reader's voice does (a name, and that or when it was said)
and how many of its children do, its depth, how dense its subtree is in text, links and punctuation, and
how it compares with its siblings and its parent. Boosted regression trees, trained here in numpy, give the log odds that an element is
part of the article. Decoding then chooses for the whole tree at once: an element left out takes its whole
subtree along, one kept may leave out children, and the choice with the largest sum of log odds wins. So no
descendant contradicts an ancestor.

The trees are fitted on page templates with known parts that ``templates`` generates, and, where given, on a
bounded sample of real pages whose own semantic tags (article, nav, footer, aside, ...) label their elements:
the first ``max_pages`` different ones by a hash, of ``max_chars`` characters at most. These bound what is learnt from only.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed,
empty ones left out, and the rest joined by one newline in page order. Nothing is capped.

Defined results: a null or empty page has empty text; unclosed and crossing tags are closed as their
parents end; a page without elements is one block of text; declarations such as ``<![if ...]>`` are comments, an
unclosed comment or tag takes the rest of the page; repeated pages give equal texts. Time is linear in a page's
length, however deep or broken its tags are.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGES = 300
MAX_CHARS = 200_000
TREES = 120
REAL = 0.5
DEPTH = 4
_SILENT = {"script", "style", "head", "title", "template", "svg", "iframe", "textarea", "select", "button"}
_FRAME = ("#page", "html", "body")
_LOOSE = "#loose"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
_SPLIT = _BLOCKS | {"#loose"}
_GROUPS = (
    {"article", "main"}, {"nav", "menu"}, {"footer"}, {"header"}, {"aside"}, {"form", "fieldset", "label", "input", "dialog"}, {"p", "blockquote", "pre", "figcaption", "dd"},
    {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "li", "dt"}, {"table", "tbody", "tr", "td", "th"}, {"div", "section", "body", "html", "center"}, {"a"}, {"#loose"},
)
_TOKENS = (
    re.compile(r"^(article|content|main|post|entry|story|text|body|prose|page)"),
    re.compile(r"^(ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|banner|outbrain|taboola)$"),
    re.compile(r"^(nav|navbar|navigation|menu|breadcrumb|breadcrumbs|topbar|tabs|pagination|pager)"),
    re.compile(r"^(footer|foot|copyright|legal|bottom)"),
    re.compile(r"^(header|masthead|head|logo|brand)"),
    re.compile(r"^(sidebar|side|widget|related|recommended|rail|aside|share|social|tags|newsletter|subscribe|signup|author-box)"),
    re.compile(r"^(cookie|cookies|notice|consent|gdpr|alert|popup|modal|overlay|toast|disclaimer)"),
    re.compile(r"^(comment|comments|disqus|reply|replies|respond|discussion)"),
)
# What a first line or a heading says when it says nothing else.
_LINES = re.compile(
    r"\W*(?:(?:(?P<advert>advert\w*|sponsored(?: content)?|anzeige|werbung|publicidad|publicité)|(?P<menu>menu|navigation|home)|(?P<more>related(?: \w+)?|recommended(?: \w+)?|see also|more from.{0,30}|you may also like|share(?: this)?(?: \w+)?|follow us|tags|subscribe|newsletter|sign up.{0,30})"
    r"|(?P<comments>(?:reader |\d+ )?(?:comments?|repl(?:y|ies)|responses?|kommentare?|comentarios?|commentaires?)(?: ?\(?\d+\)?)?|leave a (?:reply|comment)|what do you think))\W*$|(?P<legal>copyright \d|\(c\) ?\d|©)|(?P<cookies>(?:we|this (?:web)?site) uses? cookies|cookies?\b))",
    re.I,
)
_SAYS = {name: 1 << n for n, name in enumerate(("advert", "menu", "more", "comments", "legal", "cookies", "voice"))}
# How the words of somebody other than the author begin: a name, and that or when it was said.
_VOICE = re.compile(
    r"\W*[^\W\d_][^.!?:;]{0,40}?(?:\b(?:says?|said|wrote|writes|repli(?:ed|es)|commented|posted|schrieb|sagte?|schreibt|dice|dijo|escribió|dit|écrit)\b[^.!?:;]{0,40}(?::|$|\d)|\b\d+ (?:minutes?|hours?|days?|weeks?|months?|years?) ago\b"
    r"|,? \(?(?:on )?(?:\d{1,2}\.? [A-Z]\w{2,8}\.?|[A-Z]\w{2,8}\.? \d{1,2})(?:,? \d{4})?\b|,? \d{1,4}[-./]\d{1,2}[-./]\d{1,4}\b)"
)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PARTS = re.compile(r"[^a-z0-9]+")
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}}
_CONTAINERS = {"article", "main", "section", "div", "nav", "footer", "header", "aside", "form", "ul", "ol", "dl", "table", "td", "body", "blockquote", "figure", "details"}
_SEMANTIC = {"article": 1, "main": 1, "nav": 0, "footer": 0, "aside": 0, "form": 0, "header": 0}


@dataclass
class Node:
    """An element; ``items`` are its texts and child numbers in page order."""

    tag: str
    words: str
    parent: int
    depth: int
    items: list = field(default_factory=list)


class _Builder(HTMLParser):
    """Builds the nodes. ``open`` is the stack; ``at`` holds the stack's places by tag, so no tag is searched for."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#page", "", -1, 0)]
        self.open = [0]
        self.at: dict[str, list[int]] = {"#page": [0]}
        self.containers: list[int] = []

    def _push(self, tag, words):
        parent = self.open[-1]
        self.nodes.append(Node(tag, words, parent, len(self.open)))
        self.nodes[parent].items.append(len(self.nodes) - 1)
        if tag not in _VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            if tag in _CONTAINERS:
                self.containers.append(len(self.open))
            self.open.append(len(self.nodes) - 1)

    def _close(self, at):
        """Close everything from the place ``at`` of the stack on."""
        while len(self.open) > at:
            tag = self.nodes[self.open.pop()].tag
            self.at[tag].pop()
            if tag in _CONTAINERS:
                self.containers.pop()

    def _last(self, tags):
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def _top(self):
        return self.nodes[self.open[-1]].tag

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            if self._top() == _LOOSE:
                self._close(len(self.open) - 1)
        elif self._top() in _FRAME and tag not in _SILENT and tag not in _VOID:
            self._push(_LOOSE, "")
        closes = _CLOSES.get(tag) or ({"p"} if tag in _BLOCKS else None)
        if closes and (at := self._last(closes)) >= 0:
            stop = self._last(_STOPS[tag]) if tag in _STOPS else self.containers[-1] if self.containers else -1
            if at > stop:
                self._close(at)
        self._push(tag, " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop", "aria-label")).lower())

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self._top() == tag and tag in ("svg", "path", "iframe"):
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        at = self._last((tag,))
        if at > 0 and (tag in _CONTAINERS or not self.containers or at > self.containers[-1]):
            self._close(at)

    def handle_data(self, data):
        if self._top() in _FRAME and data.strip():
            self._push(_LOOSE, "")
        self.nodes[self.open[-1]].items.append(data)

    # What the base class leaves open at the end of a page it would read again as text, tag by tag.
    def _or_rest(self, end, i):
        if end < 0:
            end = self.rawdata.find(">", i + 1) + 1
        return end or len(self.rawdata)

    def parse_starttag(self, i):
        return self._or_rest(super().parse_starttag(i), i)

    def parse_endtag(self, i):
        return self._or_rest(super().parse_endtag(i), i)

    def parse_pi(self, i):
        return self._or_rest(self.rawdata.find(">", i) + 1 or -1, i)

    def parse_html_declaration(self, i):
        return self._or_rest(self.rawdata.find(">", i) + 1 or -1, i)

    def parse_comment(self, i, report=1):
        for empty in ("<!-->", "<!--->"):
            if self.rawdata.startswith(empty, i):
                return i + len(empty)
        ends = [at + len(end) for end in ("-->", "--!>") if (at := self.rawdata.find(end, i + 4)) >= 0]
        return min(ends, default=len(self.rawdata))


def parse(html: str) -> list[Node]:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.nodes


_GROUP_OF = {name: g for g, names in enumerate(_GROUPS) for name in names}


@lru_cache(4096)
def _says(tokens: str) -> int:
    """Bits of the token patterns that a class, id or role text meets."""
    found = 0
    for word in _PARTS.split(tokens):
        for t, pattern in enumerate(_TOKENS):
            if pattern.match(word):
                found |= 1 << t
    return found


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each element."""
    n = len(nodes)
    chars, link, marks, tags, below = [0] * n, [0] * n, [0] * n, [1] * n, [0] * n
    place, among, most = [0.0] * n, [1] * n, [0] * n
    first, said, headed = [""] * n, [0] * n, [0] * n  # first line; what it says; what the heading before an element says
    lead, voices = [""] * n, [0.0] * n  # the first characters of all texts of an element; the share of its children that are voices
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        up = node.parent
        if node.tag in _SILENT:
            chars[i] = link[i] = marks[i] = 0
        else:
            children = 0
            for item in node.items:
                if isinstance(item, str):
                    text = item.strip()
                    chars[i] += len(text)
                    marks[i] += text.count(".") + text.count(",")
                    first[i] = first[i] or text
                    if len(lead[i]) < 80:
                        lead[i] += item[:160]
                else:
                    children += 1
                    first[i] = first[i] or first[item]
                    voices[i] += said[item] >> len(_SAYS) - 1 & 1
                    if len(lead[i]) < 80:
                        lead[i] += lead[item] + " " * (nodes[item].tag in _BLOCKS)
            lead[i] = lead[i][:160]
            voices[i] /= max(children, 1)
            if _VOICE.match(lead[i].strip()):
                said[i] = _SAYS["voice"]
            if first[i] and (line := _LINES.match(first[i][:80])):
                said[i] |= _SAYS[line.lastgroup]
            if children:
                seen = heading = 0
                for item in node.items:
                    if not isinstance(item, str):
                        place[item], among[item], headed[item] = seen / children, children, heading
                        seen += 1
                        if nodes[item].tag in _HEADINGS:
                            heading = said[item]
            if node.tag == "a":
                link[i] = chars[i]
            if up >= 0:
                chars[up] += chars[i]
                link[up] += link[i]
                marks[up] += marks[i]
                tags[up] += tags[i]
                below[up] = max(below[up], below[i] + 1)
                most[up] = max(most[up], chars[i])
    group, token = [0] * n, [0] * n  # bits of the element, and above them those of what stands over it
    for i, node in enumerate(nodes):
        g = _GROUP_OF.get(node.tag)
        group[i] = 0 if g is None else 1 << g
        token[i] = _says(node.words) if node.words else 0
        if node.parent >= 0:
            over_g, over_t = group[node.parent], token[node.parent]
            group[i] |= (over_g | over_g >> len(_GROUPS)) << len(_GROUPS) & (1 << 2 * len(_GROUPS)) - 1
            token[i] |= (over_t | over_t >> len(_TOKENS)) << len(_TOKENS) & (1 << 2 * len(_TOKENS)) - 1
            over = said[node.parent]
            said[i] |= (over | over >> len(_SAYS) | headed[i]) << len(_SAYS) & (1 << 2 * len(_SAYS)) - 1
    c, t = np.array(chars, float), np.array(tags, float)
    parent = np.maximum(np.array([node.parent for node in nodes]), 0)
    largest = np.array(most, float)[parent]
    own = np.column_stack([
        np.minimum([node.depth for node in nodes], 20), np.log1p(c), np.array(link) / np.maximum(c, 1), np.log1p(t), np.log1p(c / t), np.array(marks) / np.maximum(c, 1) * 50,
        below, place, np.log1p(among), c / np.maximum(largest, 1), c / np.maximum(c[parent], 1), c / max(c[0], 1), voices, np.array(voices)[parent],
        np.array(group)[:, None] >> np.arange(2 * len(_GROUPS)) & 1, np.array(token)[:, None] >> np.arange(2 * len(_TOKENS)) & 1,
        np.array(said)[:, None] >> np.arange(2 * len(_SAYS)) & 1,
    ])
    return own.astype(np.float32)


@dataclass
class Trees:
    """Boosted trees of depth ``DEPTH``: a feature and a cut for each inner node, a value for each leaf."""

    start: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, rate: float = 0.3, ridge: float = 1.0, bins: int = 32) -> Trees:
    """Second-order boosting of the log loss. Whether each value is beyond each cut is a matrix, so sums of gradients are products."""
    mean = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
    start = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(np.unique(x[:100, j])) > 2 else np.array([0.5]) for j in range(x.shape[1])]
    owner, values = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts]), np.concatenate(cuts)
    beyond = (x[:, owner] > values).astype(np.float32)
    score = np.full(len(x), start)
    inner, ends = 2**DEPTH - 1, 2**DEPTH
    out_f, out_c, out_l = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, ends))
    worth = lambda g, h: g**2 / (h + ridge)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        slopes = np.column_stack([weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)]).astype(np.float32)
        at = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            first, n = 2**level - 1, 2**level
            spread = np.zeros((len(x), 2 * n), np.float32)
            rows = np.arange(len(x))
            spread[rows, at - first], spread[rows, n + at - first] = slopes[:, 0], slopes[:, 1]
            right, whole = (beyond.T @ spread).astype(float), spread.sum(axis=0, dtype=float)
            gr, hr, gs, hs = right[:, :n], right[:, n:], whole[:n], whole[n:]
            gain = worth(gr, hr) + worth(gs - gr, np.maximum(hs - hr, 0)) - worth(gs, hs)
            best = np.argmax(gain, axis=0)
            useful = gain[best, np.arange(n)] > 1e-6
            out_f[t, first : first + n] = np.where(useful, owner[best], 0)
            out_c[t, first : first + n] = np.where(useful, values[best], np.inf)
            at = 2 * at + 1 + (x[rows, out_f[t, at]] > out_c[t, at])
        sums = [np.bincount(at - inner, slopes[:, k], ends) for k in (0, 1)]
        out_l[t] = -rate * sums[0] / (sums[1] + ridge)
        score += out_l[t][at - inner]
    return Trees(start, out_f, out_c, out_l)


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Which elements are kept: the consistent choice of the largest sum of log odds."""
    n = len(nodes)
    gain, odds = [0.0] * n, odds.tolist()
    for i in range(n - 1, -1, -1):
        if nodes[i].tag in _SILENT:
            gain[i] = 0.0
            continue
        own = 0.0 if nodes[i].tag in _FRAME else odds[i]
        gain[i] = own + sum(max(gain[c], 0.0) for c in nodes[i].items if not isinstance(c, str))
    kept = [True] + [False] * (n - 1)
    for i in range(1, n):
        kept[i] = kept[nodes[i].parent] and nodes[i].tag not in _SILENT and (gain[i] > 0 or nodes[i].tag in _FRAME)
    return kept


def text_of(nodes: list[Node], kept: list[bool]) -> str:
    """Blocks of the kept elements, in page order."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if whole := " ".join("".join(line).split()):
            blocks.append(whole)
        line.clear()

    stack: list[tuple[int, int]] = [(0, 0)]
    while stack:
        i, at = stack.pop()
        node = nodes[i]
        if at == 0 and node.tag in _SPLIT:
            flush()
        while at < len(node.items):
            item = node.items[at]
            at += 1
            if isinstance(item, str):
                line.append(item)
            elif nodes[item].tag in _VOID:
                line.append(" " if nodes[item].tag == "br" else "")
                if nodes[item].tag in _SPLIT:
                    flush()
            elif kept[item]:
                stack += [(i, at), (item, 0)]
                break
            elif nodes[item].tag in _SPLIT:
                flush()
        else:
            if node.tag in _SPLIT:
                flush()
    flush()
    return "\n".join(blocks)


def extract(pages: list[str], trees: Trees) -> list[str]:
    """The main text of each page; the trees are walked for all of them together."""
    parsed = [parse(page) for page in pages]
    ends = np.cumsum([0, *map(len, parsed)])
    odds = trees.log_odds(np.concatenate([features(nodes) for nodes in parsed])) if pages else np.zeros(0)
    return [text_of(nodes, decode(nodes, odds[a:b])) for nodes, a, b in zip(parsed, ends[:-1], ends[1:], strict=True)]


def labels_of(nodes: list[Node]) -> np.ndarray:
    """1 article, 0 not, -1 unknown: what the nearest semantic tag above or at an element says, or a template's mark of its part."""
    out = np.full(len(nodes), -1)
    for i, node in enumerate(nodes):
        above = out[node.parent] if node.parent >= 0 else -1
        own = _SEMANTIC.get(node.tag, -1)
        if "part-main" in node.words or _MAIN in node.items:
            own = 1
        elif "part-rest" in node.words or _REST in node.items:
            own = 0
        out[i] = 0 if above == 0 or node.tag in _SILENT else own if own >= 0 else above
    return out


_PART_WORD = re.compile(r"\bpart-(main|rest)\b")
_MAIN, _REST = "\x01", "\x02"  # marks of loose text in templates


def templates(count: int = 640, seed: int = 5) -> Iterator[str]:
    """Pages with known parts, in the ways that real ones are marked up: semantic tags, classes, or bare structure."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeilmnorstu", k=rng.randrange(2, 9))) for _ in range(400)]

    def prose(lo: int, hi: int) -> str:
        sentence = lambda: " ".join(rng.choices(words, k=rng.randrange(lo, hi))).capitalize() + pick(".", ", and.", "!", "?")
        return " ".join(sentence() for _ in range(rng.randrange(1, 5)))

    def heading(most: int) -> str:
        """One word up to ``most``, at times with a full stop: real headings and paragraphs can be as short as that."""
        return " ".join(rng.choices(words, k=rng.randrange(1, most + 1))).capitalize() + pick("", "", ".")

    def links(n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{w}">{w}</a></{tag}>' for w in rng.choices(words, k=n))

    pick = lambda *options: rng.choice(options)
    often = lambda p: rng.random() < p
    many = lambda lo, hi, make: "".join(make() for _ in range(rng.randrange(lo, hi)))

    def block() -> str:
        kind = rng.randrange(18)
        if kind < 5:
            return f"<p>{prose(3, 30)}</p>"
        return (
            f"<p><b>{prose(4, 12)}<br><p>{prose(5, 25)}</p>", f"<h2>{heading(5)}</h2><p>{prose(5, 20)}</p>", f"<p>{pick(heading(3), heading(3), 'All rights reserved.', 'Share this.', 'No comments so far.', 'Copyright law, it says.')}</p>",
            f"<{pick('ul', 'ol')}>{many(2, 6, lambda: f'<li>{prose(1, 9)}</li>')}</ul>".replace("</ul>", "</ul></ol>"),
            f'<p>{prose(6, 20)} <a href="/x">{pick(*words)}</a> {prose(4, 9)}</p>', f"<blockquote>{prose(4, 15)}</blockquote>", table(), table(),
            f"<dl>{many(1, 5, lambda: f'<dt>{heading(3)}</dt><dd>{prose(2, 10)}</dd>')}</dl>", f"<pre><code>{heading(6)} = {heading(4)}\n{heading(5)}</code></pre>",
            f'<figure><img src="/{pick(*words)}.png"><figcaption>{heading(8)}</figcaption></figure>', linked(), f"<p>{name()} {pick('says', 'said', 'wrote')}: {prose(4, 20)}</p>",
        )[kind - 5]

    def name() -> str:
        return " ".join(rng.choices(words, k=rng.randrange(1, 3))).title()

    def linked() -> str:
        """A list of links that is part of the article: their texts are phrases, as often with a word of comment."""
        item = lambda: f'<a href="/{pick(*words)}">{" ".join(rng.choices(words, k=rng.randrange(3, 9))).capitalize()}</a>{pick("", "", ": " + prose(2, 6))}'
        return pick(f"<ul>{many(2, 9, lambda: f'<li>{item()}</li>')}</ul>", many(2, 6, lambda: f"<p>{item()}</p>"), f"<ol>{many(2, 7, lambda: f'<li>{item()}</li>')}</ol>")

    def when() -> str:
        month = pick("January", "May", "Jun", "Oct", "Mai", "August")
        return pick(f"on {month} {rng.randrange(1, 29)}", f"{rng.randrange(1, 29)} {month} {rng.randrange(2005, 2026)}", f"{rng.randrange(2, 30)} {pick('minutes', 'hours', 'days', 'months')} ago", f"{rng.randrange(2005, 2026)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}")

    def voice() -> str:
        """What one reader wrote, with a name and that or when it was said."""
        verb, text = pick("says", "wrote", "said", "replied", "commented"), prose(2, 14)
        return pick(
            f"<div><b>{name()}</b> {verb}: {text}</div>", f"<div><div>{name()} {verb} {when()}:</div><div>{text}</div></div>", f"<p><b>{name()}</b>, {when()}<br>{text}</p>", f"<div><p>{name()} {verb}:</p><p>{text}</p></div>",
            f"<li><cite>{name()}</cite> <small>{when()}</small> {text}</li>", f"<div><span>{name()}</span> <span>{when()}</span><p>{text}</p></div>", f"<dl><dt>{name()} {verb} {when()}</dt><dd>{text}</dd></dl>",
        )

    def table() -> str:
        columns, text = rng.randrange(1, 5), rng.randrange(2, 9)
        row = lambda tag: "<tr>" + many(columns, columns + 1, lambda: f"<{tag}>{heading(text)}</{tag}>") + "</tr>"
        return f"<table>{f'<caption>{heading(5)}</caption>' if often(0.3) else ''}{row('th') if often(0.5) else ''}{many(1, 6, lambda: row('td'))}</table>"

    def loose(mark: str, part: str) -> str:
        return f"{mark}<!-- -->{part}"

    def remarks() -> str:
        """What readers wrote, in markup of any kind; under a heading or with names where no class says so."""
        if often(0.5):
            title = pick(f"{rng.randrange(1, 40)} thoughts on \u201c{heading(5)}\u201d", f"{rng.randrange(1, 40)} Comments", "What readers say", "Join the conversation", "Your thoughts", "Discussion", heading(3))
            top = f"<h{(level := pick(2, 3, 4))}>{title}</h{level}>" if often(0.7) else ""
            return f'<{(tag := pick("div", "div", "section"))} class="part-rest">{top}{many(1 if top else 2, 6, voice)}</{tag}>'
        name = pick("comments", "comment-list", "replies", "discussion", "") if often(0.6) else ""
        said = pick("Comments", "Comments ({})", "{} comments", "Reader comments", "Replies", "{} responses", "Leave a comment", "Kommentare").format(rng.randrange(1, 40))
        one = pick(lambda: f"<p>{prose(2, 14)}</p>", lambda: f"<div>{heading(2)}</div><div>{prose(2, 14)}</div>", lambda: f"<div><b>{heading(2)}</b> {prose(2, 14)}</div>", lambda: f"<li>{prose(2, 12)}</li>")
        title = f"<h{pick(2, 3, 4)}>{said}</hx>" if not name or often(0.5) else ""
        title = title.replace("</hx>", f"</{title[1:3]}>")
        if not name and often(0.3):
            return title.replace(">", ' class="part-rest">', 1) + many(1, 5, lambda: f'<div class="part-rest">{one()}</div>')
        tag = pick("section", "div", "div", "ul")
        return f'<{tag} class="part-rest {name}">{title}{many(1, 5, one)}</{tag}>'

    for number in range(count):
        style = rng.randrange(4)
        if number % 12 == 0:  # a bare page: a few words, a paragraph or two, a table
            yield pick(loose(_MAIN, heading(4)), f'<p class="part-main">{prose(2, 9)}</p>', f'<div class="part-main">{many(1, 3, table)}</div>', f'<body><div class="part-main">{table()}</div></body>', f'<p class="part-main">{heading(1)}</p>{loose(_MAIN, heading(2))}', f'<div class="part-main">{many(1, 3, block)}</div>')
            continue

        def wrap(tags: list, classes: list, inner: str, part: str, style: int = style) -> str:
            tag = pick(*tags) if style == 0 else "div"
            return f'<{tag} class="part-{part} {pick(*classes) if style == 1 else ""}">{inner}</{tag}>'

        body: list[str] = []
        rows = links(rng.randrange(3, 9))
        if often(0.2):
            pass
        elif style == 3 and often(0.5):
            body.append(loose(_REST, " | ".join(f'<a href="/{w}">{w}</a>' for w in rng.choices(words, k=5))) + "<hr>")
        else:
            body.append(wrap(["nav", "header"], ["nav", "menu top", "navbar", "site-header"], f"<ul>{rows}</ul>", "rest"))
        if often(0.6):
            body.append(f'<div class="part-rest {pick("ad", "advert box", "banner", "sponsored", "promo")}">{prose(4, 10)}</div>' if often(0.8) else f'<div class="part-rest"><h4>{pick("Advertisement", "Sponsored", "Anzeige")}</h4>{prose(3, 9)}</div>')
        if often(0.4):
            body.append(f'<div class="part-rest {pick("cookie-notice", "notice", "consent-banner", "alert")}" role="dialog"><p>{prose(5, 12)}</p></div>' if often(0.7) else f'<div class="part-rest">We use cookies {prose(3, 9)}</div>')
        blocks = ([f"<h1>{heading(7)}</h1>"] if often(0.9) else []) + [block() for _ in range(rng.randrange(1, pick(3, 9)))]
        if often(0.12):  # an article that is mostly a list
            blocks = [blocks[0], linked(), *([f"<p>{prose(3, 15)}</p>"] if often(0.7) else [])]
        if often(0.08):
            blocks.insert(rng.randrange(len(blocks) + 1), f"<noscript>{pick(prose(3, 12), f'<p>{prose(3, 12)}</p>')}</noscript>")
        if often(0.25) and len(blocks) > 2:
            extra = f'<div class="part-rest {pick("ad", "related", "share social")}">{pick(prose(3, 8), "<ul>" + links(3) + "</ul>")}</div>'
            blocks.insert(rng.randrange(1, len(blocks)), extra)
        if style == 3:  # an article without an element around it: loose text and blocks in the body
            part = lambda: loose(_MAIN, prose(3, 25) + pick("", "<br>" + prose(2, 20), f" <b>{heading(3)}</b> {prose(2, 9)}", f' <a href="/y">{heading(2)}</a> {prose(3, 9)}'))
            for piece in blocks:
                own = piece if 'class="part-rest' in piece else f'<div class="part-main">{piece}</div>' if often(0.5) else re.sub(r"^<(\w+)>", r'<\1 class="part-main">', piece, count=1)
                body += [part(), own] if often(0.6) else [own]
        else:
            if often(0.3):
                blocks = [f"<div>{''.join(blocks)}</div>"]
            body.append(wrap(["article", "main"], ["article", "content", "post entry", "story-body"], "".join(blocks), "main"))
        if often(0.5):
            body.append(wrap(["aside"], ["sidebar", "widget", "related"], f"<h3>{pick('Related', 'See also', 'Share this', *words[:6])}</h3><ul>{links(5)}</ul><p>{prose(3, 8)}</p>", "rest"))
        if often(0.45):
            body.append(remarks())
        if often(0.3):
            body.append(f'<form class="part-rest {pick("search", "newsletter", "subscribe")}"><label>{pick(*words)}</label><input type="text"><p>{prose(2, 6)}</p></form>')
        if often(0.1):
            body.append(f'<noscript class="part-rest">{pick("Please enable JavaScript", "You need to enable JavaScript to run this app.", "JavaScript is off")} {prose(2, 5)}</noscript>')
        if often(0.2):
            body.append("")
        legal = "" if not body[-1] else f"{pick('&copy;', '&copy; 2024', 'Copyright')} {pick(*words)}.example {prose(3, 9)}"
        body.append("" if not legal else "<hr>" + loose(_REST, legal) if style == 3 and often(0.5) else wrap(["footer"], ["footer", "site-footer legal", "copyright"], legal, "rest"))
        if often(0.3):
            body = ['<div class="wrapper">', *body, "</div>"]
        yield f"<html><head><title>{pick(*words)}</title><script>var a='<p>';</script></head><body>{''.join(body)}</body></html>"


def _training(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for html in pages:
        nodes = parse(html)
        y = labels_of(nodes)
        for node in nodes:
            node.words = _PART_WORD.sub(" ", node.words)
            node.items = [x for x in node.items if x != _MAIN and x != _REST]
        x = features(nodes)
        xs.append(x[y >= 0])
        ys.append(y[y >= 0])
    return np.concatenate(xs), np.concatenate(ys)


def _drawn(pages: DataFrame, html: str, max_pages: int, max_chars: int) -> list[str]:
    """Different pages that have semantic tags, the first by a hash: copies count once."""
    named = pages.filter(F.col(html).rlike("(?i)<(article|main)[ >]") & (F.length(html) <= max_chars)).select(F.col(html).alias("html"), F.xxhash64(html).alias("by"))
    first = named.select("by").distinct().orderBy("by").limit(max_pages)  # so few that they may be broadcast
    once = named.join(F.broadcast(first), "by").groupBy("by").agg(F.min("html").alias("html"))
    return [r["html"] for r in once.orderBy("by").toLocalIterator()]


def fit(pages: DataFrame | None = None, html: str = "html", max_pages: int = MAX_PAGES, max_chars: int = MAX_CHARS) -> Trees:
    """Trees fitted on templates and on ``max_pages`` real pages at most, of ``max_chars`` characters at most.

    Real pages weigh ``REAL`` times what the templates do at most: they show what a site's markup is like, not that nothing else occurs.
    """
    x, y = _training(list(templates()))
    weight = np.ones(len(y))
    if pages is not None and (drawn := _drawn(pages, html, max_pages, max_chars)):
        more, says = _training(drawn)
        x, y = np.concatenate([x, more]), np.concatenate([y, says])
        weight = np.concatenate([weight, np.full(len(says), min(1.0, REAL * len(weight) / max(len(says), 1)))])
    share = max(float(np.average(y, weights=weight)), 1e-3)
    return boost(x, y.astype(float), weight * np.where(y == 1, 0.7 / share, 0.3 / max(1 - share, 1e-3)))  # a line lost is worse than one too many


def main_text(pages: DataFrame, trees: Trees, html: str = "html", into: str = "text") -> DataFrame:
    """Every row with its main text. One pass, no shuffle; the trees are broadcast."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for batch in batches:
            pages = batch.tolist()
            yield pd.Series([text for lo in range(0, len(pages), 64) for text in extract(pages[lo : lo + 64], known)], dtype=object)

    return pages.withColumn(into, read(F.coalesce(F.col(html), F.lit(""))))
