"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

blocks() reads a page in one pass: it keeps the stack of open elements (end tags that HTML lets authors leave out are
implied), decodes character references and returns the text blocks in page order, each with what its ancestors say (tag names and
the words of class, id, role and similar attributes). Scripts, styles, templates, titles and comments hold no text.
A block is text without a block-level tag inside; white space, line breaks included, becomes one space.

The field has the two labels boilerplate and main. Emissions are sums over binary features of ancestors and text, transitions
are between neighbouring blocks; decode() is Viterbi. train() maximises the penalised likelihood over labelled
pages by limited-memory BFGS, forward-backward running over all pages at once. The labelled pages are made by
labelled_pages(): layouts of all common kinds whose blocks are known to be main text or not, from a fixed seed. The model
is a few hundred numbers, whatever the input, and travels with the task.

Null and empty pages, and pages without main text, give an empty text. Very long or deeply nested pages are read whole in linear
time. Repeated rows, null or equal page_ids are pages of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_right
from collections.abc import Collection
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, tidy

# Fixed values of HTML: elements that flow inside a line of text; whose content is no text; without content; and which end tags a start tag implies.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark meta link nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
SILENT = frozenset("script style template noscript title iframe object svg math canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK_STARTS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}} | {t: {"p"} for t in _BLOCK_STARTS}
_SCOPES = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "dt": {"dl"}, "dd": {"dl"}}
_SCOPE = ("article", "section", "div", "td", "body")

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_LONG_NUMBER = re.compile("&#[0-9]{4000,};?")  # beyond what int() takes, and beyond Unicode
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_CUES = re.compile(r"©|\b(copyright|rights|cookies?|privacy|subscribe|newsletter|comments?|reply|replies|shares?|login|log in|sign (?:in|up)|advert\w*|sponsored|related|menu|search|home|contact|next|previous|read more)\b", re.I)


@dataclass
class Block:
    ancestors: frozenset[str]
    text: str
    link_chars: int


def _names(attributes: str) -> set[str]:
    """Words of the telling attributes, in the singular."""
    found = set()
    for m in _ATTRIBUTE.finditer(attributes):
        for w in _WORD.findall(next(filter(None, m.groups()), "")):
            w = w.lower()
            found.add("c:" + (w[:-1] if len(w) > 2 and w[-1] == "s" and w[-2] != "s" else w))
    return found


class _Tokens:
    """Finds tags and comments. Each quote is followed once: one from which no tag's end was reached is remembered."""

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.lost: set[int] = set()

    def _end(self, at: int) -> int:
        """The ">" that ends the attributes from at, not counting those in quotes; by a first ">" where quotes do not close."""
        page, j, passed = self.page, at, []
        while True:
            m = _STOP.search(page, j)
            if m is None:
                break
            k = m.start()
            if page[k] == ">":
                return k
            if k in self.lost:
                break
            passed.append(k)
            close = page.find(page[k], k + 1)
            if close < 0:
                break
            j = close + 1
        self.lost.update(passed)
        return page.find(">", at)

    def after(self, at: int) -> tuple[int, int, bool, str, int, int] | None:
        """The next one from at: (start, end, is it an end tag, name, start and end of the attributes); a comment has no name."""
        page, p = self.page, at
        while True:
            p = page.find("<", p)
            if p < 0:
                return None
            lead = page[p + 1 : p + 2]
            if lead == "!" and page.startswith("--", p + 2):
                if page.startswith((">", "->"), p + 4):
                    return p, page.index(">", p + 4) + 1, False, "", 0, 0
                ends = [(k, k + n) for text, n in (("-->", 3), ("--!>", 4)) if (k := page.find(text, p + 4)) >= 0]
                return p, min(ends)[1] if ends else len(page), False, "", 0, 0
            if lead in ("!", "?") and lead:
                return p, (page.find(">", p) + 1) or len(page), False, "", 0, 0
            closing = lead == "/"
            m = _NAME.match(page, p + 1 + closing) if p < self.last else None
            if m is not None:
                end = self._end(m.end())
                if end >= 0:
                    return p, end + 1, closing, m[0].lower(), m.end(), end
            p += 1


def _silent_end(page: str, name: str, at: int) -> int:
    """Where the content of an element without text is over: behind its end tag, or at the page's end."""
    m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at) if name.isalnum() else None
    return (page.find(">", m.end()) + 1 if m else 0) or len(page)


def blocks(page: str, known: Collection[str] | None = None) -> list[Block]:
    """known: ancestor features to keep; None keeps all, which for deep nesting under ever new names takes a set of all of them for each level."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = [("", frozenset())]
    where: dict[str, list[int]] = {}  # places of each open element in the stack
    text: list[str] = []
    linked = 0
    link = False
    at, n = 0, len(page)
    tokens = _Tokens(page)

    def flush():
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(Block(stack[-1][1] | {"own:" + stack[-1][0]}, joined, linked))
            text.clear()
        linked = 0

    def pop(k):
        for name, _ in stack[k:]:
            where[name].pop()
        del stack[k:]

    def put(piece):
        nonlocal linked
        if piece:
            piece = entities.unescape(_LONG_NUMBER.sub("\ufffd", piece)) if "&" in piece else piece
            text.append(piece)
            if link:
                linked += len(piece.strip())

    while at < n:
        found = tokens.after(at)
        if found is None:
            put(page[at:])
            break
        start, end, closing, name, a, b = found
        put(page[at:start])
        at = end
        if not name:
            continue
        if name in SILENT:
            if not closing and not page.endswith("/", a, b):
                at = _silent_end(page, name, at)
        elif name == "br":
            text.append(" ")
        elif name in INLINE:
            if name == "a":
                link = not closing
        elif closing:
            flush()
            link = False
            if where.get(name):
                pop(where[name][-1])
        else:
            flush()
            link = False
            ends = IMPLIED.get(name)
            if ends and any(where.get(x) for x in ends):
                scope = max((where[x][-1] for x in _SCOPES.get(name, _SCOPE) if where.get(x)), default=0)
                lowest = [own[k] for x in ends if (own := where.get(x)) and (k := bisect_right(own, scope)) < len(own)]
                if lowest:
                    pop(min(lowest))
            if name not in VOID:
                above = stack[-1][1]
                own = {"t:" + name} | (_names(page[a:b]) if a < b else set())
                if known is not None:
                    own = {x for x in own if x in known or x in _TOLD}
                where.setdefault(name, []).append(len(stack))
                stack.append((name, above if own <= above else above | own))
    flush()
    return out


#: Tags that mean one thing in an article and another around it, and the tags that are an article.
_TWOFOLD, _ARTICLE = ("t:header", "t:footer", "t:aside", "t:form"), ("t:article", "t:main")
_TOLD = frozenset(_TWOFOLD + _ARTICLE)


def block_features(b: Block, place: int, count: int) -> list[str]:
    """All features of a block, in a fixed order."""
    return [*sorted(b.ancestors), *_both(b.ancestors), *text_features(b, place, count)]


def _both(ancestors: frozenset[str]) -> list[str]:
    where = "in" if any(x in ancestors for x in _ARTICLE) else "out"
    found = [f"{x}/{where}" for x in _TWOFOLD if x in ancestors]
    return found + ([f"own/{where}"] if len(found) == 0 else [])


def _size(n: int) -> str:
    return "w:" + next((str(k) for k in (1, 3, 7, 15, 30, 60) if n <= k), "more")


def text_features(b: Block, place: int, count: int) -> list[str]:
    words = b.text.count(" ") + 1
    share = min(1.0, b.link_chars / len(b.text))
    found = [_size(words), "l:" + ("none" if share == 0 else "some" if share < 0.5 else "most"), "e:" + ("stop" if b.text[-1] in ".!?:;\"'”»)" else "open")]
    if words <= 40:
        found += {"q:" + m[0].lower().rstrip("s") for m in _CUES.finditer(b.text)}
    if place == 0:
        found.append("p:first")
    if place == count - 1:
        found.append("p:last")
    return found


@dataclass
class Model:
    weights: dict[str, float]  # of label main over boilerplate
    moves: np.ndarray  # 2 x 2, from and to; row 2: from the page's start

    def __post_init__(self):
        self.known: dict[frozenset[str], float] = {}

    def emission(self, b: Block, place: int, count: int) -> float:
        base = self.known.get(b.ancestors)
        if base is None:
            if len(self.known) > 20000:
                self.known.clear()
            base = self.known[b.ancestors] = sum(self.weights.get(x, 0.0) for x in [*sorted(b.ancestors), *_both(b.ancestors)]) + self.weights["bias"]
        return base + sum(self.weights.get(x, 0.0) for x in text_features(b, place, count))

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi: the likeliest labels."""
        if not page:
            return []
        (m00, m01), (m10, m11), (s0, s1) = self.moves.tolist()
        a, b = s0, s1 + self.emission(page[0], 0, len(page))
        back = []
        for i in range(1, len(page)):
            x, y = a + m00, b + m10
            u, v = a + m01, b + m11
            back.append((int(y > x), int(v > u)))
            a, b = max(x, y), max(u, v) + self.emission(page[i], i, len(page))
        labels = [int(b > a)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def extract(self, html: str | None) -> str:
        page = blocks(html or "", self.weights)
        return "\n".join(b.text for b, y in zip(page, self.decode(page), strict=True) if y)


def _log_sum(a, b):
    return np.logaddexp(a, b)


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 300, penalty: float = 0.05) -> Model:
    """pages: blocks and their labels (1: main)."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {"bias": 0}
    rows = []
    for page, _ in pages:
        for i, b in enumerate(page):
            rows.append([0] + [names.setdefault(f, len(names)) for f in block_features(b, i, len(page))])
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, r] = 1
    size = np.array([len(p[0]) for p in pages])
    longest = int(size.max())
    of = np.repeat(np.arange(len(pages)), size)
    pos = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
    gold = np.concatenate([np.array(p[1]) for p in pages])
    grid = np.zeros((len(pages), longest), int)
    grid[of, pos] = gold
    live = np.arange(longest)[None] < size[:, None]
    seen = np.zeros((3, 2))
    np.add.at(seen, (2, grid[:, 0]), 1)
    both = live[:, 1:]
    np.add.at(seen, (grid[:, :-1][both], grid[:, 1:][both]), 1)
    held = x.T @ gold

    def gradient(w, moves):
        e = np.zeros((len(pages), longest))
        e[of, pos] = x @ w
        f = np.zeros((longest, len(pages), 2))
        f[0] = moves[2] + np.stack([np.zeros(len(pages)), e[:, 0]], 1)
        for t in range(1, longest):
            for y in (0, 1):
                f[t, :, y] = _log_sum(f[t - 1, :, 0] + moves[0, y], f[t - 1, :, 1] + moves[1, y]) + (e[:, t] if y else 0)
        g = np.zeros((longest, len(pages), 2))
        for t in range(longest - 2, -1, -1):
            for y in (0, 1):
                new = _log_sum(moves[y, 0] + g[t + 1, :, 0], moves[y, 1] + e[:, t + 1] + g[t + 1, :, 1])
                g[t, :, y] = np.where(live[:, t + 1], new, 0)
        last = f[size - 1, np.arange(len(pages))]
        z = _log_sum(last[:, 0], last[:, 1])
        p1 = np.exp(f[:, :, 1] + g[:, :, 1] - z).T
        want = np.zeros((3, 2))
        want[2] = [(1 - p1[:, 0]).sum(), p1[:, 0].sum()]
        for a in (0, 1):
            for b in (0, 1):
                pair = f[:-1, :, a] + moves[a, b] + (e.T[1:] if b else 0) + g[1:, :, b] - z
                want[a, b] = np.exp(pair.T[both]).sum()
        likelihood = held @ w + (seen * moves).sum() - z.sum() - penalty / 2 * ((w**2).sum() + (moves**2).sum())
        return likelihood, held - x.T @ p1[of, pos] - penalty * w, seen - want - penalty * moves

    k = len(names)

    def loss(v):
        value, gw, gm = gradient(v[:k], v[k:].reshape(3, 2))
        return -value, -np.concatenate([gw, gm.ravel()])

    best = _minimise(loss, np.zeros(k + 6), rounds)
    return Model({n: float(best[i]) for n, i in names.items()}, best[k:].reshape(3, 2))


def _minimise(loss, v: np.ndarray, rounds: int, memory: int = 12) -> np.ndarray:
    """Limited-memory BFGS with step halving."""
    value, g = loss(v)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, kept = g.copy(), []
        for s, y, rho in reversed(steps):
            kept.append(rho * (s @ d))
            d -= kept[-1] * y
        d *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, float(np.sqrt(g @ g)))
        for (s, y, rho), a in zip(steps, reversed(kept), strict=True):
            d += (a - rho * (y @ d)) * s
        slope, size = g @ d, 1.0
        while size > 1e-10:
            new = v - size * d
            lower, ng = loss(new)
            if lower <= value - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = new - v, ng - g
        if s @ y > 1e-12:
            steps = [*steps[-memory + 1 :], (s, y, 1 / (s @ y))]
        done = value - lower < 1e-7 * abs(lower)
        v, value, g = new, lower, ng
        if done:
            break
    return v


#: Marks main text in made pages; removed before training.
_MAIN = "\ue000"
_MAIN_NAMES = "content article post entry story main body text page".split()
_OTHER = {
    "nav": "nav menu navbar navigation breadcrumb topbar toolbar pagination pager tab link skip".split(),
    "header": "header masthead banner logo top brand".split(),
    "footer": "footer copyright legal bottom imprint colophon".split(),
    "aside": "sidebar side aside widget related recommended popular trending more tag archive rail".split(),
    "notice": "cookie consent gdpr notice alert popup modal overlay disclaimer message warning paywall".split(),
    "ad": "ad advert advertisement sponsor sponsored promo promotion adsense teaser".split(),
    "form": "form search login signup subscribe newsletter contact poll".split(),
    "comments": "comment reply discussion respond disqus review thread feedback".split(),
    "share": "share social follow sharing".split(),
}
_SAID = {
    "nav": "Home|About|Contact|News|Menu|Next|Previous|Search".split("|"),
    "header": "Welcome|Log in|Sign up|Home".split("|"),
    "footer": "© 2024|Copyright 2023, all rights reserved|Privacy policy|Terms of use".split("|"),
    "aside": "Related|Read more|Popular|Tags|Archive".split("|"),
    "notice": "We use cookies.|This site uses cookies to improve your visit.|Accept|Please disable your ad blocker.".split("|"),
    "ad": "Advertisement|Sponsored|Buy now|Special offer".split("|"),
    "form": "Search|Subscribe|Your email|Sign up for our newsletter|Send".split("|"),
    "comments": "Comments|Reply|3 comments|Leave a reply".split("|"),
    "share": "Share|Follow us|Tweet".split("|"),
}


def labelled_pages(count: int = 600, seed: int = 7) -> list[tuple[list[Block], list[int]]]:
    """Made pages with the label of each block."""
    r = random.Random(seed)
    syllables = "an er in on re th st en at ou le de la es ti ai so ra mo ku pe".split()

    def sentence(lo, hi):
        w = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        return (" ".join(w)).capitalize() + r.choice([".", ".", ".", "", "!", "?"])

    def paragraph():
        return " ".join(sentence(1, 14) for _ in range(r.choice([1, 1, 1, 2, 4, 8])))

    def main_block(first=False):
        kind = r.choice(["p"] * 8 + ["h2", "h3", "ul", "blockquote", "pre", "ol", "table", "div"])
        if first and r.random() < 0.8:
            kind = "h1"
        inner = lambda: _MAIN + (r.choice(r.choice(list(_SAID.values()))) if r.random() < 0.06 else paragraph() if kind not in ("h1", "h2", "h3") else sentence(1, 9))
        if r.random() < 0.06:
            return f'<p>{_MAIN}<a href="/x">{paragraph()}</a></p>'
        if r.random() < 0.15:
            words = inner().split(" ")
            k = r.randrange(len(words))
            words[k] = f'<a href="/x">{words[k]}</a>' if not words[k].startswith(_MAIN) else words[k]
            return f"<{kind if kind not in ('ul', 'ol', 'table') else 'p'}>{' '.join(words)}</{kind if kind not in ('ul', 'ol', 'table') else 'p'}>"
        if kind in ("ul", "ol"):
            return f"<{kind}>" + "".join(f"<li>{inner()}</li>" for _ in range(r.randint(1, 5))) + f"</{kind}>"
        if kind == "table":
            return "<table>" + "".join(f"<tr><td>{inner()}</td><td>{inner()}</td></tr>" for _ in range(2)) + "</table>"
        if kind == "p" and r.random() < 0.2:
            return f"<p><b>{inner()}<br>"
        return f"<{kind}>{inner()}</{kind}>"

    def named(names, tags):
        tag = r.choice(tags)
        name = r.choice(names)
        name = r.choice([name, name, name + "s", name + "-" + r.choice("box area wrapper inner list section block item".split()), "site-" + name, "x" + str(r.randint(1, 9)) + "_" + name])
        attr = r.choice(["class", "class", "id"])
        return tag, f'<{tag} {attr}="{name}">'

    def other(kind):
        tags = {"nav": ["nav", "nav", "div", "ul", "td"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "aside", "div", "section", "td"], "form": ["form", "form", "div", "section"], "comments": ["section", "div", "ol", "article"]}.get(kind, ["div", "div", "section", "p", "aside"])
        tag, start = named(_OTHER[kind], tags)
        if tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6:
            start = f"<{tag}>"
        n = r.randint(1, 6) if kind in ("nav", "aside", "comments") else r.randint(1, 2)
        parts = []
        for _ in range(n):
            said = r.choice(_SAID[kind]) if r.random() < 0.35 else paragraph() if kind in ("ad", "notice", "footer", "comments") or r.random() < 0.2 else sentence(1, 4)
            if kind in ("nav",) or (kind in ("aside", "share", "header") and r.random() < 0.7) or r.random() < 0.15:
                said = f'<a href="/{r.randint(1, 99)}">{said}</a>'
            if kind == "form" and r.random() < 0.7:
                said = r.choice(["<label>{}</label><input name=q>", "<button>{}</button>", "<select><option>{}<option>{}</select>", "<textarea>{}</textarea>"]).replace("{}", said)
            if kind == "comments" and r.random() < 0.6:
                said = f'<div class="{r.choice(["comment", "reply", "comment-body"])}"><p>{said}</p></div>'
            parts.append(said)
        inside = "li" if tag in ("ul", "ol") else r.choice(["li", "p", "div", "span", "h3", "", *(["h1", "h1", "h2"] if kind == "header" else [])])
        if tag == "p":
            inside = ""
        body = "".join(f"<{inside}>{x}</{inside}>" if inside else x + " " for x in parts)
        if inside == "li" and tag not in ("ul", "ol"):
            body = f"<ul>{body}</ul>"
        whole = f"{start}{body}</{tag}>"
        return f"<table><tr>{whole}</tr></table>" if tag == "td" else whole

    out = []
    for _ in range(count):
        layout = r.random()
        body = [main_block(i == 0) for i in range(r.choice([1, 2, 4, 8, 16]))]
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            body.insert(r.randint(0, len(body)), other(r.choice(["ad", "aside", "share", "form", "notice"])))
        if r.random() < 0.25:
            body.append(other("comments"))
        if layout < 0.65 and r.random() < 0.2:
            body[0] = f"<header>{body[0]}</header>"
        if layout < 0.5:
            tag, start = "article", r.choice(["<article>", "<article>", '<article class="post">', '<article itemprop="articleBody">'])
        elif layout < 0.65:
            tag, start = "main", r.choice(["<main>", '<main role="main">', '<main id="content">'])
        elif layout < 0.95:
            tag, start = named(_MAIN_NAMES, ["div", "div", "section", "td"])
        else:
            tag, start = "div", "<div>"
        core = f"{start}{''.join(body)}</{tag}>"
        if tag == "td":
            core = f"<table><tr>{core}</tr></table>"
        before = [other(k) for k in r.sample(["header", "nav", "ad", "notice", "form", "share", "nav", "aside"], r.randint(0, 4))]
        after = [other(k) for k in r.sample(["footer", "comments", "aside", "ad", "notice", "share", "nav", "form"], r.choice([0, 0, 1, 2, 3, 4]))]
        if r.random() < 0.5:
            after.append(other("footer"))
        page = "".join([*before, core, *after])
        if r.random() < 0.3:
            page = f'<div class="{r.choice(["wrapper", "container", "page", "site", "layout"])}">{page}</div>'
        found = blocks(f"<!DOCTYPE html><html><head><title>{sentence(2, 6)}</title><style>p{{}}</style></head><body>{page}</body></html>")
        labels = [int(_MAIN in b.text) for b in found]
        for b in found:
            b.text = b.text.replace(_MAIN, "")
        out.append(([b for b in found if b.text], [y for b, y in zip(found, labels, strict=True) if b.text]))
    return out


@cache
def default_model() -> Model:
    return train(labelled_pages())


def _extract(model: Model, batches):
    for batch in batches:
        for piece in pieces(batch, "html"):
            found = [model.extract(x) for x in piece.column(2).to_pylist()]
            yield pa.record_batch([piece.column(0), piece.column(1), pa.array(found, pa.string())], names=["page_id", "url", "text"])


def extract_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(tidy(partial(_extract, model or default_model())), "page_id long, url string, text string")


def op10_html_extract(pages: DataFrame) -> DataFrame:
    return extract_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))
