"""Main text of HTML pages by a recurrent block labeller.

A page becomes a sequence of blocks, the texts between block-level tags.  Each
block is described by a vector of its tag path (tags, classes, ids and roles
of its ancestors, hashed), of its words (hashed) and of a few measures.  A
bidirectional LSTM, in numpy, reads the whole sequence in both directions and
labels every block as main text or not, so a block is judged by the whole
page around it.

The network is trained here, on pages that ``made_pages`` composes from
templates of articles and of everything that surrounds them; it needs no
labelled data and its training takes some seconds on the driver.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Widths of the hashed path, the hashed words and the hidden state; pages made for training, and rounds over them.
PATH, WORDS, HIDDEN, MADE, ROUNDS = 64, 32, 20, 900, 7
#: Pages labelled together, and steps times pages that are held at once: longer sequences pass in pieces, with the state carried on.
BATCH, HELD = 64, 1 << 15
#: Characters of pages that are parsed before they are labelled.
CHARS = 4_000_000

BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose content is not markup; the text of all but title and textarea is no text of the page.
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT_TAGS = frozenset("script style textarea xmp iframe noembed noframes template svg math object canvas audio video".split())
#: Open elements that a start tag closes, if no other boundary lies between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = frozenset("ul ol dl table html body select".split())

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_NAME = re.compile(r"[a-z]+")


class Open:
    """An open element: its key and the element around it, which blocks inside it share; ``vector`` describes the path down to it."""

    __slots__ = ("key", "outer", "vector")

    def __init__(self, key: str, outer: Open | None):
        self.key, self.outer, self.vector = key, outer, None


@dataclass
class Block:
    """A block's text, its innermost open element, and its characters inside links."""

    text: str
    inner: Open | None
    linked: int


def blocks(page: str | None) -> list[Block]:
    """The page's blocks with text, in order; references decoded, white space folded."""
    out: list[Block] = []
    names: list[str] = []
    opened: list[Open] = []
    count: Counter = Counter()
    held: list[str] = []
    links = silent = linked = 0

    def end() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append(Block(text, opened[-1] if opened else None, linked))
            held.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal links, silent
        for name in names[to:]:
            links -= name == "a"
            silent -= name in SILENT_TAGS
            count[name] -= 1
        del names[to:], opened[to:]

    def said(part: str) -> None:
        nonlocal linked
        if part and not silent:
            held.append(part)
            if links:
                linked += len(part)

    s, at = page or "", 0
    while at < len(s):
        m = _TOKEN.search(s, at)
        if not m:
            said(s[at:])
            break
        said(s[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            said(" ")
            continue
        block = name in BLOCK_TAGS
        if block:
            end()
        if m[1]:
            if not count[name]:
                continue
            for i in range(len(names) - 1, -1, -1):
                if names[i] == name:
                    pop(i)
                    break
            continue
        if block and any(count[n] for n in ("p", *CLOSES.get(name, ()))):
            for i in range(len(names) - 1, -1, -1):
                if names[i] == "p" or names[i] in CLOSES.get(name, ()):
                    pop(i)
                    break
                if names[i] in BOUNDS or names[i] in BLOCK_TAGS and name not in CLOSES:
                    break
        if name in VOID_TAGS or m[3].endswith("/") and not block:
            continue
        names.append(name)
        count[name] += 1
        key = name + "".join(f" {k.lower()}={(a or b or c).lower()}" for k, a, b, c in _ATTRIBUTE.findall(m[3])) if m[3] else name
        opened.append(Open(key, opened[-1] if opened else None))
        links += name == "a"
        silent += name in SILENT_TAGS
        if name in RAW_TAGS:
            close = re.compile(rf"</{name}\s*[^>]*>|\Z", re.I).search(s, at)
            said(s[at : close.start()])
            if name in BLOCK_TAGS:
                end()
            at = close.end()
            pop(len(names) - 1)
    end()
    return out


# --- features ---------------------------------------------------------------------------------

_keys: dict[str, np.ndarray] = {}
_buckets: dict[str, int] = {}
N_FEATURES = PATH + WORDS + 12


def _spot(word: str, width: int) -> tuple[int, float]:
    h = crc32(word.encode())
    return h % width, 1.0 if h & 0x80000000 else -1.0


def _key_vector(key: str) -> np.ndarray:
    """Tag and name parts of one element, hashed twice; then its tag as the innermost one."""
    found = _keys.get(key)
    if found is None:
        found = np.zeros((2, PATH))
        tag, *attributes = key.split(" ", 1)
        for p in [tag, *(f".{w}" for a in attributes for w in _NAME.findall(a) if w not in ("class", "id", "role"))]:
            for salt in "01":
                i, sign = _spot(salt + p, PATH)
                found[0, i] += sign
        i, sign = _spot(f"leaf {tag}", PATH)
        found[1, i] = sign
        if tag in ("html", "body"):
            found[:] = 0
        if len(_keys) > 50_000:
            _keys.clear()
        _keys[key] = found
    return found


def _path_vector(inner: Open | None) -> np.ndarray:
    """The open elements' vectors, each weaker than the one inside it; elements keep their sum, so shared paths are summed once."""
    if inner is None:
        return np.zeros(PATH)
    chain, at = [], inner
    while at is not None and at.vector is None:
        chain.append(at)
        at = at.outer
    total = at.vector if at is not None else np.zeros(PATH)
    for e in reversed(chain):
        total = e.vector = _key_vector(e.key)[0] + 0.85 * total
    return total + _key_vector(inner.key)[1]


def features(page: list[Block], start: int = 0, stop: int | None = None) -> np.ndarray:
    """A row for each block, or for the blocks from ``start`` to ``stop``."""
    stop = len(page) if stop is None else min(stop, len(page))
    out = np.zeros((max(0, stop - start), N_FEATURES), np.float32)
    for row, n in enumerate(range(start, stop)):
        b = page[n]
        words = b.text.lower().split()
        if len(_buckets) > 200_000:
            _buckets.clear()
        spots = []
        for w in words:
            s = _buckets.get(w)
            if s is None:
                i, sign = _spot(w.strip(".,:;!?()\"'"), WORDS)
                s = _buckets[w] = i if sign > 0 else i + WORDS
            spots.append(s)
        counts = np.bincount(spots, minlength=2 * WORDS)
        chars = len(b.text)
        out[row, :PATH] = _path_vector(b.inner)
        # bounded, for texts that repeat a word
        out[row, PATH : PATH + WORDS] = np.tanh((counts[:WORDS] - counts[WORDS:]) / max(1, len(words)) ** 0.5)
        inner = b.inner.key.split(" ", 1)[0] if b.inner else ""
        out[row, PATH + WORDS :] = (
            np.log1p(chars) / 4, np.log1p(len(words)) / 3, b.linked / max(1, chars), float(b.linked == 0), chars / max(1, len(words)) / 8,
            sum(b.text.count(c) for c in ".,;:") / max(1, len(words)), float(b.text[-1] in ".!?\"»”"), float(inner in ("h1", "h2", "h3", "h4")),
            float(inner in ("p", "blockquote", "pre")), float(n == 0), n / max(1, len(page) - 1), np.log1p(len(page)) / 5,
        )
    return out


# --- network ----------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(x: np.ndarray, mask: np.ndarray, p: dict, d: str, keep: bool, state: list | None = None):
    """One direction over (time, pages, features); masked steps leave the state at rest.  ``state``, if given, is carried on from and to."""
    h_size = HIDDEN
    steps, n = mask.shape
    xw = x @ p[f"x{d}"] + p[f"b{d}"]
    h, c = state or (np.zeros((n, h_size), np.float32), np.zeros((n, h_size), np.float32))
    hs, saved = np.zeros((steps, n, h_size), np.float32), []
    for t in range(steps):
        z = xw[t] + h @ p[f"h{d}"]
        gates, g = _sigmoid(z[:, : 3 * h_size]), np.tanh(z[:, 3 * h_size :])
        i, f, o = gates[:, :h_size], gates[:, h_size : 2 * h_size], gates[:, 2 * h_size :]
        m = mask[t][:, None]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        h_new = o * tc
        if keep:
            saved.append((h, c, i, f, o, g, tc, m))
        h, c = m * h_new + (1 - m) * h, m * c_new + (1 - m) * c
        hs[t] = h
    if state is not None:
        state[:] = h, c
    return hs, saved


def _backward(x: np.ndarray, dhs: np.ndarray, saved: list, p: dict, d: str, grad: dict) -> None:
    dh, dc = np.zeros_like(dhs[0]), np.zeros_like(dhs[0])
    dz_all = np.zeros((len(saved), dhs.shape[1], 4 * HIDDEN), np.float32)
    wh, gh = p[f"h{d}"], np.zeros_like(p[f"h{d}"])
    for t in range(len(saved) - 1, -1, -1):
        h, c, i, f, o, g, tc, m = saved[t]
        dh = dh + dhs[t]
        dh_new, dc_new = m * dh, m * dc + m * dh * o * (1 - tc * tc)
        dz = np.concatenate([dc_new * g * i * (1 - i), dc_new * c * f * (1 - f), dh_new * tc * o * (1 - o), dc_new * i * (1 - g * g)], axis=1)
        dz_all[t] = dz
        gh += h.T @ dz
        dh, dc = (1 - m) * dh + dz @ wh.T, (1 - m) * dc + dc_new * f
    grad[f"h{d}"] = gh
    grad[f"x{d}"] = np.tensordot(x, dz_all, axes=([0, 1], [0, 1]))
    grad[f"b{d}"] = dz_all.sum(axis=(0, 1))


def _stacked(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), N_FEATURES), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, f in enumerate(pages):
        x[: len(f), k], mask[: len(f), k] = f, 1
    return x, mask


def _both(x: np.ndarray, mask: np.ndarray, p: dict, keep: bool = False):
    right, sr = _forward(x, mask, p, "r", keep)
    left, sl = _forward(x[::-1], mask[::-1], p, "l", keep)
    joined = np.concatenate([right, left[::-1], x], axis=2)
    return joined, joined @ p["w"] + p["c"], sr, sl


def train(pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, seed: int = 11) -> dict:
    """The network's parameters, by Adam on (features, labels) of whole pages."""
    rng = np.random.default_rng(seed)
    p = {}
    for d in "rl":
        p[f"x{d}"] = rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, 4 * HIDDEN))
        p[f"h{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        p[f"b{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
    p["w"], p["c"] = rng.normal(0, 0.1, 2 * HIDDEN + N_FEATURES), np.zeros(1)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    mean, var, step = {k: 0 * v for k, v in p.items()}, {k: 0 * v for k, v in p.items()}, 0
    total = rounds * -(-len(pages) // 16)
    for _ in range(rounds):
        # pages of like length share a batch; batches come in random order
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]) + rng.random())
        batches = [order[i : i + 16] for i in range(0, len(order), 16)]
        for b in rng.permutation(len(batches)):
            own = [pages[i] for i in batches[b]]
            x, mask = _stacked([f for f, _ in own])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, labels) in enumerate(own):
                y[: len(labels), k] = labels
            joined, z, sr, sl = _both(x, mask, p, True)
            dz = (_sigmoid(z) - y) * mask / mask.sum()
            grad = {"w": np.tensordot(dz, joined, axes=([0, 1], [0, 1])), "c": dz.sum(keepdims=True)[0]}
            dj = dz[:, :, None] * p["w"]
            _backward(x, dj[:, :, :HIDDEN], sr, p, "r", grad)
            _backward(x[::-1], dj[::-1, :, HIDDEN : 2 * HIDDEN], sl, p, "l", grad)
            step += 1
            rate = 0.02 * (1 - 0.9 * step / total)
            for k in p:
                g = np.clip(grad[k], -1, 1)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                var[k] = 0.99 * var[k] + 0.01 * g * g
                p[k] = (p[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-6) - rate * 1e-3 * p[k]).astype(np.float32)
    return p


def _piece(pages: list[list[Block]], start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    x, mask = np.zeros((stop - start, len(pages), N_FEATURES), np.float32), np.zeros((stop - start, len(pages)), np.float32)
    for k, page in enumerate(pages):
        if start < len(page):
            f = features(page, start, stop)
            x[: len(f), k], mask[: len(f), k] = f, 1
    return x, mask


def _label_together(pages: list[list[Block]], p: dict) -> np.ndarray:
    """Logits (steps, pages).  Both directions go through the sequences in pieces; what stays of a piece is its hidden state."""
    steps = max(map(len, pages))
    size = max(1, HELD // len(pages))
    spans = [(i, min(steps, i + size)) for i in range(0, steps, size)]
    w, logit, state = p["w"], np.zeros((steps, len(pages)), np.float32), []
    held = [_piece(pages, *spans[0])] if len(spans) == 1 else None
    for start, stop in spans:
        x, mask = held[0] if held else _piece(pages, start, stop)
        right, _ = _forward(x, mask, p, "r", False, state)
        logit[start:stop] = right @ w[:HIDDEN] + x @ w[2 * HIDDEN :] + p["c"]
    state = []
    for start, stop in reversed(spans):
        x, mask = held[0] if held else _piece(pages, start, stop)
        left, _ = _forward(x[::-1], mask[::-1], p, "l", False, state)
        logit[start:stop] += left[::-1] @ w[HIDDEN : 2 * HIDDEN]
    return logit


def label(pages: list[list[Block]], p: dict) -> list[np.ndarray]:
    """Probability of main text, for each block of each page.  Pages of like length go together, fewer the longer they are."""
    out: list = [np.zeros(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    while order:
        n = 1
        while n < min(BATCH, len(order)) and (n + 1) * len(pages[order[n]]) <= HELD:
            n += 1
        own, order = order[:n], order[n:]
        z = _sigmoid(_label_together([pages[i] for i in own], p))
        for k, i in enumerate(own):
            out[i] = z[: len(pages[i]), k]
    return out


def main_text(page: str | None, p: dict) -> str:
    found = blocks(page)
    return " ".join(b.text for b, y in zip(found, label([found], p)[0], strict=True) if y >= 0.5)


# --- pages for training -----------------------------------------------------------------------

_SYLLABLES = "an ar au ba be bo ci de do el en er es fa ga ha he in is ja ka le lo ma mi na ne no or pa qu re ri ro sa se st ta te ti to un ur va ve vo wa zu".split()
_COMMON = "the of and to in is that it for on with as are this der die und das les des est que los las una por".split()
_OUTER = {
    "menu": "Home About Contact News Products Blog Login Register Archive Sitemap Impressum Kontakt Accueil Inicio".split(),
    "notice": "We use cookies. Accept all cookies Privacy settings Subscribe to our newsletter Your browser is out of date Sign in to continue".split(),
    "advert": "Buy now Sale Free shipping Advertisement Sponsored Special offer discount Click here".split(),
    "footer": "© 2024 All rights reserved Terms Privacy policy Imprint Contact Follow us · |".split(),
    "comment": "Thanks great post I agree said Reply Report wrote ago Posted by Anonymous comment".split(),
}


class _Maker:
    """Composes one page and its labels; each text carries a unique last word that tells its block."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.kept: set[str] = set()
        self.n = 0
        #: How the page's words look: plain, shouted or with signs behind each word.
        self.style = self.r.choices(("plain", "caps", "signs"), (6, 1, 1))[0]

    def words(self, n: int, kind: str | None = None) -> str:
        r, out = self.r, []
        for _ in range(n):
            if kind and r.random() < 0.5:
                w = r.choice(_OUTER[kind])
            elif r.random() < 0.35:
                w = r.choice(_COMMON)
            else:
                w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 5)))
            if not kind and self.style == "caps":
                w = w.upper() + "!!"
            elif not kind and self.style == "signs":
                w += r.choice(("%%%", "***", "&amp;&amp;&amp;", "###", "$$$"))
            elif r.random() < 0.12:
                w += r.choice(".,.,;!?")
            out.append(w)
        text = " ".join(out)
        return text[0].upper() + text[1:] + r.choice(("", ".", ".", ".") if n > 6 else ("", "", "."))

    def text(self, n: int, main: bool = False, kind: str | None = None) -> str:
        self.n += 1
        tag = f"q{self.n}q"
        if main:
            self.kept.add(tag)
        return f"{self.words(max(1, n), kind)} {tag}"

    def pick(self, *options: str) -> str:
        return self.r.choice(options)

    def links(self, n: int, kind: str = "menu", wrap: str = "li") -> str:
        items = [f'<a href="/{i}">{self.text(self.r.randint(1, 3), kind=kind if self.r.random() < 0.4 else None)}</a>' for i in range(n)]
        return "".join(f"<li>{x}</li>" for x in items) if wrap == "li" else " ".join(f"<{wrap}>{x}</{wrap}>" for x in items)

    def named(self, tag: str, *names: str) -> str:
        key = self.pick("class", "class", "id")
        return f'<{tag} {key}="{self.pick(*names)}">'

    def advert(self) -> str:
        r = self.r
        body = self.text(r.randint(2, 22), kind="advert" if r.random() < 0.5 else None)
        tag = self.pick("div", "div", "div", "section", "aside")
        return f"{self.named(tag, 'ad', 'ads', 'advert', 'advertisement', 'ad-slot', 'sponsored', 'promo', 'banner-ad')}{body}</{tag}>"

    def notice(self) -> str:
        r = self.r
        tag = self.pick("div", "section", "div", "p")
        return f"{self.named(tag, 'cookie-banner', 'notice', 'cookie-consent', 'alert', 'banner', 'newsletter', 'consent', 'gdpr', 'popup', 'message')}{self.text(r.randint(4, 30), kind='notice' if r.random() < 0.7 else None)}<button>{self.text(1, kind='notice')}</button></{tag}>"

    def form(self) -> str:
        r = self.r
        fields = "".join(f'<label>{self.text(r.randint(1, 3))}</label><input name="f{i}">' for i in range(r.randint(1, 3)))
        return f"<form action='/s'>{fields}<select><option>{self.text(1)}</option></select><button>{self.text(1, kind='notice')}</button></form>"

    def side(self) -> str:
        r, tag = self.r, self.pick("aside", "aside", "div")
        head = self.named(tag, "sidebar", "related", "widget", "side", "recommended", "popular") if tag == "div" or r.random() < 0.4 else "<aside>"
        inner = f"<h3>{self.text(r.randint(1, 4))}</h3>" + (f"<ul>{self.links(r.randint(2, 6))}</ul>" if r.random() < 0.7 else f"<p>{self.text(r.randint(5, 40))}</p>")
        return f"{head}{inner}</{tag}>"

    def comments(self) -> str:
        r, tag, item = self.r, self.pick("section", "div", "div", "ol"), self.pick("div", "li", "article")
        body = "".join(f'<{item} class="{self.pick("comment", "reply", "comment-body")}"><p>{self.text(r.randint(3, 60), kind="comment" if r.random() < 0.5 else None)}</p></{item}>' for _ in range(r.randint(1, 5)))
        title = f"<h3>{self.text(r.randint(1, 3), kind='comment')}</h3>" if r.random() < 0.6 and tag != "ol" else ""
        return f"{self.named(tag, 'comments', 'comment-list', 'discussion', 'responses', 'replies', 'user-comments')}{title}{body}</{tag}>"

    def nav(self) -> str:
        r, tag = self.r, self.pick("nav", "nav", "nav", "div", "ul")
        inner = self.links(r.randint(3, 9), wrap="li" if tag == "ul" else self.pick("li", "li", "span"))
        inner = f"<ul>{inner}</ul>" if "<li>" in inner and tag != "ul" else inner
        return f"{self.named(tag, 'menu', 'navbar', 'nav', 'navigation', 'breadcrumbs', 'topnav', 'pagination') if tag != 'nav' else '<nav>'}{inner}</{tag}>"

    def paragraph(self) -> str:
        r = self.r
        n = r.choices((r.randint(1, 4), r.randint(5, 40), r.randint(40, 220)), (2, 6, 3))[0]
        body = self.text(n, main=True)
        if r.random() < 0.25:
            body = f"<{(t := self.pick('b', 'i', 'em', 'strong', 'span'))}>{body}" + f"</{t}>" * (r.random() < 0.8)
        if r.random() < 0.2:
            at = body.find(" ")
            body = f'<a href="/x">{body[:at]}</a>{body[at:]}' if at > 0 and "<" not in body[:at] else body
        if r.random() < 0.2:
            body += "<br>"
        return f"<p>{body}" + "</p>" * (r.random() < 0.85)

    def article(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.85:
            parts.append(f"<h1>{self.text(r.randint(1, 12), main=True)}</h1>")
        for _ in range(r.choices((1, r.randint(1, 4), r.randint(4, 18)), (2, 4, 5))[0]):
            kind = r.random()
            if kind < 0.78:
                parts.append(self.paragraph())
            elif kind < 0.84:
                parts.append(f"<h2>{self.text(r.randint(1, 8), main=True)}</h2>")
            elif kind < 0.89:
                parts.append("<ul>" + "".join(f"<li>{self.text(r.randint(2, 25), main=True)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                parts.append(f"<blockquote>{self.text(r.randint(5, 50), main=True)}</blockquote>")
            elif kind < 0.94:
                parts.append(f"<pre>{self.text(r.randint(5, 50), main=True)}</pre>")
            elif kind < 0.96:
                parts.append("<table>" + "".join(f"<tr><td>{self.text(2, main=True)}</td><td>{self.text(2, main=True)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            else:
                parts.append(self.pick(self.advert(), f"{self.named('div', 'share', 'social', 'share-buttons')}{self.links(3, wrap='span')}</div>", self.side()))
        body = "".join(parts)
        form = r.random()
        if form < 0.5:
            return f"<article>{body}</article>"
        if form < 0.65:
            return f"<main>{body}</main>"
        if form < 0.75:
            return f"<main><article>{body}</article></main>"
        tag = self.pick("div", "div", "section")
        return f"{self.named(tag, 'content', 'post', 'entry-content', 'article-body', 'story', 'main', 'post-content', 'article')}{body}</{tag}>"

    def page(self) -> str:
        r, top, end = self.r, [], []
        if r.random() < 0.35:
            top.append(f"<header>{self.text(r.randint(1, 6))}{self.nav() if r.random() < 0.5 else ''}</header>")
        if r.random() < 0.85:
            top.append(self.nav())
        for make, before, after in ((self.advert, 0.5, 0.25), (self.notice, 0.25, 0.12), (self.form, 0.12, 0.15), (self.side, 0.15, 0.3)):
            if r.random() < before:
                top.append(make())
            if r.random() < after:
                end.append(make())
        if r.random() < 0.3:
            end.append(self.comments())
        if r.random() < 0.2:
            end.append(self.nav())
        r.shuffle(end)
        if r.random() < 0.85:
            tag = self.pick("footer", "footer", "footer", "div")
            inner = self.text(r.randint(1, 25), kind="footer" if r.random() < 0.6 else None)
            end.append(f"{'<footer>' if tag == 'footer' else self.named('div', 'footer', 'site-footer', 'bottom', 'copyright')}{'&copy; ' if r.random() < 0.5 else ''}{inner if r.random() < 0.6 else f'<p>{inner}</p>'}</{tag}>")
        head = f'<head><meta charset="utf-8"><title>{self.text(r.randint(1, 10))}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        middle = self.article()
        if r.random() < 0.3:
            middle = f"{self.named('div', 'wrapper', 'container', 'page', 'layout', 'root')}{middle}{self.side() if r.random() < 0.4 else ''}</div>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(top)}<!-- x -->{middle}{''.join(end)}</body></html>"


def made_pages(n: int, seed: int = 0) -> Iterator[tuple[list[Block], np.ndarray]]:
    """Blocks and labels of n made pages."""
    mark = re.compile(r" ?q\d+q")
    for i in range(n):
        maker = _Maker(seed * 1_000_003 + i)
        found = blocks(maker.page())
        y = np.array([any(t.strip() in maker.kept for t in mark.findall(b.text)) for b in found], np.float32)
        for b in found:
            b.linked = max(0, b.linked - sum(map(len, mark.findall(b.text)))) if b.linked else 0
            b.text = mark.sub("", b.text)
        pairs = [(b, t) for b, t in zip(found, y, strict=True) if b.text]
        yield [b for b, _ in pairs], np.array([t for _, t in pairs], np.float32)


@lru_cache(maxsize=4)
def trained(n: int = MADE, seed: int = 0) -> dict:
    """The network's parameters, trained once in a process."""
    return train([(features(page), y) for page, y in made_pages(n, seed)])


# --- operator ---------------------------------------------------------------------------------


def _extractor(p: dict):
    def texts(held: list[list[Block]]) -> list[str]:
        return [" ".join(b.text for b, y in zip(page, ys, strict=True) if y >= 0.5) for page, ys in zip(held, label(held, p), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, chars, held = 0, 0, []
            for i, html in enumerate(batch.column(2)):
                page = html.as_py()
                held.append(blocks(page))
                chars += len(page or "")
                if chars >= CHARS or len(held) == 512 or i + 1 == batch.num_rows:
                    found, part = texts(held), batch.slice(start, len(held))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=["page_id", "url", "text", "n_chars"])
                    start, chars, held = i + 1, 0, []

    return run


def extract(pages: DataFrame, *, model: dict | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages``: one narrow pass.

    A page of any length or depth is read whole: its blocks pass through the
    network in pieces, and blocks share the elements around them.  A null or empty html, and one without main text, give an empty text; null
    ids and URLs stay null, repeated rows repeat, other columns are not read,
    an empty table gives an empty result.
    """
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").alias("html"))
    return narrow.mapInArrow(_extractor(model or trained()), "page_id long, url string, text string, n_chars long")
