"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks (text between block-level tags). Each block is a vector: its hashed tag path
with class and id words, its hashed words, and a few figures. A bidirectional LSTM in numpy reads the blocks
of a page in order and labels each as main text or not, so every label depends on the whole page. The model
is trained by this module on pages made from templates with a fixed seed, and its weights (some 50 KB) are kept
beside it. The templates have pages with telling element and class names and pages without any.

Nulls: a null html is an empty page with empty text. Repeated rows keep a row each; empty tables give empty
results; broken markup never fails: unknown ends are passed over and open elements end with the page.
"""

from __future__ import annotations

import functools
import html as entities
import os
import random
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PATH, WORDS, FIGURES, HIDDEN = 64, 24, 6, 24
WIDTH = PATH + WORDS + FIGURES
UNSURE = 0.05

# HTML's element kinds.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
DROPPED = frozenset("script style template textarea title iframe noembed noframes xmp".split())  # their content is no text of the page's
TO_THE_END = frozenset("script style".split())  # without an end tag these hold the rest of the page; the others are passed over
ENDS_P = BLOCK - {"body", "html", "option", "noscript"}
CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "option": ("select",)}
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[!?][^>]*(?:>|\Z)|/[^>]*(?:>|\Z))", re.S)
NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
PART = re.compile(r"[a-z]+")


class Block(NamedTuple):
    """A leaf block: the sum of its path's hashed names, its element, depth, text and characters in links."""

    path: np.ndarray
    tag: str
    depth: int
    text: str
    linked: int


class _Path:
    """The open elements. The vector of their distinct names is kept up to date, so a block costs the same at any depth."""

    def __init__(self) -> None:
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.times: dict[str, int] = {}
        self.vector = np.zeros(PATH, np.float32)

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, names))
        for x in (tag, *names):
            self.times[x] = self.times.get(x, 0) + 1
            if self.times[x] == 1:
                k, sign = _slot(x, PATH)
                self.vector[k] += sign

    def cut(self, size: int) -> None:
        while len(self.open) > size:
            tag, names = self.open.pop()
            self.places[tag].pop()
            for x in (tag, *names):
                self.times[x] -= 1
                if not self.times[x]:
                    del self.times[x]
                    k, sign = _slot(x, PATH)
                    self.vector[k] -= sign

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)


def blocks(page: str) -> list[Block]:
    """The leaf blocks with text, in page order.

    The head ends where its end tag, or anything that can't be in a head, comes. Foreign elements (svg, math)
    and fallback content (object, canvas) are read like any inline element.
    """
    out: list[Block] = []
    path = _Path()
    held: list[str] = []
    linked, in_link, head = 0, False, False
    at = 0

    def flush() -> None:
        nonlocal held, linked
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            out.append(Block(path.vector.copy(), path.open[-1][0] if path.open else "", len(path.open), text, linked))
        held, linked = [], 0

    def add(s: str) -> None:
        nonlocal linked, head
        if head:
            if not s.strip():
                return
            head = False
        held.append(s)
        if in_link:
            linked += len(s.strip())

    while m := TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, end = m[2].lower(), bool(m[1])
        if tag == "head":
            head = not end
            continue
        if head and not end and tag not in HEAD:
            head = False
        if tag in DROPPED:
            if not end and not (m[3] or "").endswith("/"):
                close = _closing(tag).search(page, at)
                at = close.end() if close else len(page) if tag in TO_THE_END else at
        elif tag == "br":
            add(" " if not head else "")
        elif tag == "a":
            in_link = not end
        elif tag in BLOCK:
            if head:
                continue
            flush()
            in_link = False
            if end:
                if (k := path.last(tag)) >= 0:
                    path.cut(k)
                continue
            if tag in ENDS_P and path.open and path.open[-1][0] == "p":
                path.cut(len(path.open) - 1)
            if tag in CLOSES and (k := path.last(tag)) > path.last(*CLOSES[tag]):
                path.cut(k)
            if tag not in VOID:
                names = [x for g in NAME.findall(m[3] or "") for x in PART.findall("".join(g).lower())]
                path.push(tag, tuple("." + x for x in names[:8]))
    add(page[at:])
    flush()
    return out


@functools.lru_cache(None)  # as many entries as DROPPED
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}[\s/]*>", re.I)


@functools.lru_cache(1 << 16)
def _slot(word: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "replace"))
    return h % size, 1.0 if h >> 31 else -1.0


def vectors(found: list[Block]) -> np.ndarray:
    out = np.zeros((len(found), WIDTH), np.float32)
    for i, b in enumerate(found):
        out[i, :PATH] = b.path
        words = b.text.lower().split()
        slots = [_slot(w, WORDS) for w in words]
        out[i, PATH : PATH + WORDS] = np.bincount([k for k, _ in slots], [s for _, s in slots], WORDS)
        scale = max(1.0, float(np.sqrt(len(words))))
        out[i, PATH : PATH + WORDS] = np.clip(out[i, PATH : PATH + WORDS] / scale, -2, 2)
        marks = sum(b.text.count(c) for c in ".,;:!?")
        out[i, PATH + WORDS :] = (np.log1p(len(words)) / 4, b.linked / max(1, len(b.text)), marks / max(1, len(words)), i / len(found), b.tag == "p", min(b.depth, 50) / 10)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(x: np.ndarray, w: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """One direction over (steps, pages, width); ``w`` maps input, state and 1 to the four gates."""
    t, b, _ = x.shape
    inp = x @ w[:WIDTH] + w[-1]
    h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
    hs, memory = np.zeros((t, b, HIDDEN), np.float32), []
    for i in range(t):
        z = inp[i] + h @ w[WIDTH:-1]
        gi, gf, go = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[i][:, None]
        c2 = gf * c + gi * g
        tc = np.tanh(c2)
        h2 = go * tc
        if keep:
            memory.append((h, c, gi, gf, go, g, tc, m))
        c = m * c2 + (1 - m) * c
        h = m * h2 + (1 - m) * h
        hs[i] = h
    return hs, memory


def _backward(x: np.ndarray, w: np.ndarray, memory: list, dhs: np.ndarray) -> np.ndarray:
    """Gradient of ``w`` from that of every state."""
    grad = np.zeros_like(w)
    dh, dc = np.zeros_like(dhs[0]), np.zeros_like(dhs[0])
    for i in range(len(memory) - 1, -1, -1):
        h, c, gi, gf, go, g, tc, m = memory[i]
        dh = dh + dhs[i]
        new, dc_new = dh * m, dc * m
        dc_new = dc_new + new * go * (1 - tc * tc)
        dz = np.concatenate([dc_new * g * gi * (1 - gi), dc_new * c * gf * (1 - gf), new * tc * go * (1 - go), dc_new * gi * (1 - g * g)], axis=1)
        grad[:WIDTH] += x[i].T @ dz
        grad[WIDTH:-1] += h.T @ dz
        grad[-1] += dz.sum(axis=0)
        dh = dh * (1 - m) + dz @ w[WIDTH:-1].T
        dc = dc * (1 - m) + dc_new * gf
    return grad


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, pages, width) and which steps are real."""
    t = max(map(len, pages))
    x, mask = np.zeros((t, len(pages), WIDTH), np.float32), np.zeros((t, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def scores(model: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Probability of main text for each step. The reverse pass skips the padding, which then comes first."""
    ahead, _ = _forward(x, model["ahead"], mask)
    back, _ = _forward(x[::-1], model["back"], mask[::-1])
    return _sigmoid(np.concatenate([ahead, back[::-1]], axis=2) @ model["out"][:-1] + model["out"][-1])


class _Templates:
    """Pages with known main text, from templates."""

    SYLLABLES = "an ba che do er fi gu ha in jo ka lo mi ne on pa qui ro sa the un vi wa xe yo zu tion ing ment".split()
    MENU = "nav menu navbar navigation topnav breadcrumb breadcrumbs links".split()
    HEADER = "header masthead banner top branding logo".split()
    FOOTER = "footer foot bottom copyright colophon legal".split()
    SIDE = "sidebar side aside related widget recommended trending popular rail".split()
    AD = "ad ads advert advertisement sponsor sponsored promo promotion adbox banner".split()
    NOTICE = "cookie cookies consent notice alert gdpr popup modal newsletter subscribe disclaimer".split()
    COMMENT = "comments comment discussion replies reply respond disqus thread".split()
    MAIN = "content main article post entry story text body".split()
    SAY_COMMENT = "Comments;Leave a comment;Responses;Discussion;Reader comments;What do you think?;Join the conversation".split(";")
    SAY_SIDE = "Related;Related articles;Popular posts;Most read;You may also like;Recommended for you;Archive;Tags".split(";")
    SAY_AD = "Advertisement;Sponsored;Promoted content;Buy now;Special offer".split(";")
    SAY_NOTICE = "This site uses cookies;We use cookies to improve;Accept all cookies;Subscribe to our newsletter;Please enable JavaScript;Sign up for updates".split(";")
    SAY_FOOTER = "All rights reserved;Privacy policy;Terms of use;Contact us;Powered by".split(";")

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, a: int, b: int) -> str:
        r = self.r
        ws = ["".join(r.choices(self.SYLLABLES, k=r.randint(1, 3))) for _ in range(r.randint(a, b))]
        if r.random() < 0.03:
            ws = ws[:1] * r.randint(1, 90)  # junk is text too
        out = " ".join(w + (r.choice(".,;?") if r.random() < 0.15 else "") for w in ws)
        return out[:1].upper() + out[1:] + ("." if r.random() < 0.7 else "")

    def name(self, names: list[str]) -> str:
        r = self.r
        if r.random() < 0.15:
            return ""
        return f' {r.choice(("class", "class", "id"))}="{r.choice(names)}{r.choice(("", "", "-" + r.choice(("box", "wrap", "list", "item", "area"))))}"'

    def lines(self, a: int, b: int, low: int = 1, high: int = 30) -> list[str]:
        return [self.words(low, high) for _ in range(self.r.randint(a, b))]

    def menu(self) -> str:
        r = self.r
        items = [f'<a href="/x">{self.words(1, 2)}</a>' for _ in range(r.randint(2, 9))]
        body = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.7 else "".join(f"<div>{x}</div>" for x in items) if r.random() < 0.5 else " | ".join(items)
        return f"<nav>{body}</nav>" if r.random() < 0.6 else f'<div class="{r.choice(self.MENU)}">{body}</div>'

    def aside(self, tag: str, names: list[str], hint: str) -> str:
        r = self.r
        own = r.random() < 0.5 and tag != "div"
        name = self.name(names) if own else f' class="{r.choice(names)}"'
        parts = self.lines(1, 4, 1, 45)
        if hint and r.random() < 0.5:
            parts[0] = f"{r.choice(hint.split(';'))} {parts[0]}"
        inner = "".join(r.choice((f"<p>{x}</p>", f"<div>{x}</div>", f'<p><a href="#">{x}</a></p>', f"<h3>{x}</h3>")) for x in parts) if r.random() < 0.6 else parts[0]
        return f"<{tag if own else 'div'}{name}>{inner}</{tag if own else 'div'}>"

    def form(self) -> str:
        return f"<form{self.name(self.NOTICE)}><label>{self.words(1, 4)}</label><input><p>{self.words(1, 12)}</p><button>{self.words(1, 2)}</button></form>"

    def comments(self) -> str:
        r = self.r
        name = r.choice(self.COMMENT)
        each = "".join(f'<{t} class="{r.choice(("comment", "reply", name))}"><p>{self.words(1, 40)}</p></{t}>' for t in r.choices(("div", "li", "article"), k=r.randint(1, 4)))
        tag = r.choice(("div", "section"))
        said = r.choice(self.SAY_COMMENT) if r.random() < 0.7 else self.words(1, 3)
        return f'<{tag} id="{name}"><h3>{said}</h3>{each}</{tag}>'

    def article(self) -> tuple[str, list[str]]:
        r, gold, out = self.r, [], []

        def keep(markup: str, text: str) -> None:
            out.append(markup.format(text))
            gold.append(text)

        if r.random() < 0.7:
            keep(r.choice(("<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>")) if r.random() < 0.9 else "<div>{}</div>", self.words(2, 14))
        usual = r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<dd>{}</dd>", "{}<hr>", "<tr><td>{}</td></tr>"))
        low = r.choice((1, 1, 12))
        for _ in range(r.choice((r.randint(1, 3), r.randint(1, 18)))):
            kind = r.random()
            if kind < 0.55:
                keep(usual, self.words(low, 90))
            elif kind < 0.7:
                keep("<p><b>{}<br>", self.words(1, 120))
            elif kind < 0.78:
                keep(r.choice(("<h2>{}</h2>", "<h3>{}</h3>")), self.words(1, 9))
            elif kind < 0.84:
                items = self.lines(1, 4)
                out.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
                gold.extend(items)
            elif kind < 0.88:
                keep(r.choice(("<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>", "<figure><figcaption>{}</figcaption></figure>", "<table><tr><td>{}</td></tr></table>")), self.words(1, 40))
            elif kind < 0.93:
                keep('<p><a href="/y">{}</a></p>', self.words(1, 25))
            else:
                out.append(r.choice((lambda: self.aside("aside", self.AD, ";".join(self.SAY_AD)), lambda: self.aside("aside", self.SIDE, ";".join(self.SAY_SIDE)), self.form, lambda: self.aside("div", self.NOTICE, ";".join(self.SAY_NOTICE))))())
        wrap = r.choice(("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", f'<div class="{r.choice(self.MAIN)}">{{}}</div>', f'<div id="{r.choice(self.MAIN)}">{{}}</div>', '<article class="post"><div class="entry">{}</div></article>', '{}' if r.random() < 0.3 else '<div>{}</div>'))
        return wrap.replace("{}", "".join(out)), gold

    def plain(self, page: str) -> str:
        """The page without elements that say what they are for; its names go, or become any words."""
        r = self.r
        box = r.choice(("div", "div", "section", "td", "dl", "center", "fieldset"))
        page = re.sub(r"<(/?)(article|main|nav|header|footer|aside|section)\b", lambda m: f"<{m[1]}{box}", page)
        if r.random() < 0.6:
            return re.sub(r' (class|id)="[^"]*"', "", page)
        named: dict[str, str] = {}
        return re.sub(r' (class|id)="([^"]*)"', lambda m: f' {m[1]}="{named.setdefault(m[2], "".join(r.choices(self.SYLLABLES, k=2)))}"', page)

    def page(self) -> tuple[str, list[str]]:
        page, gold = self._page()
        r = self.r
        if r.random() < 0.4:
            page = self.plain(page)
        if r.random() < 0.15:
            page = page.replace("</head>", "")
        if r.random() < 0.15:
            page = page.replace("<body>", "").replace("</body></html>", "")
        return page, gold

    def _page(self) -> tuple[str, list[str]]:
        r = self.r
        body, gold = self.article()
        before, after = [], []
        for chance, make in ((0.5, lambda: self.aside("header", self.HEADER, "")), (0.9, self.menu), (0.5, lambda: self.aside("div", self.AD, ";".join(self.SAY_AD))), (0.3, lambda: self.aside("div", self.NOTICE, ";".join(self.SAY_NOTICE))), (0.2, lambda: self.aside("aside", self.SIDE, ";".join(self.SAY_SIDE)))):
            if r.random() < chance:
                before.append(make())
        for chance, make in ((0.3, self.comments), (0.3, lambda: self.aside("aside", self.SIDE, ";".join(self.SAY_SIDE))), (0.2, self.form), (0.25, lambda: self.aside("div", self.AD, ";".join(self.SAY_AD))), (0.2, self.menu)):
            if r.random() < chance:
                after.append(make())
        r.shuffle(before)
        if r.random() < 0.15:
            return f"<html><head><title>x</title></head><body>{body}</body></html>", gold
        if r.random() < 0.95:
            after.append(f"<footer>{r.choice(('&copy; ', '&copy; ', r.choice(self.SAY_FOOTER) + ' ', ''))}{self.words(1, 40)}</footer>" if r.random() < 0.6 else self.aside("footer", self.FOOTER, "©;" + ";".join(self.SAY_FOOTER)))
        return f"<html><head><title>x</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>", gold


def examples(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Block vectors of n template pages, and which blocks are main text."""
    make, out = _Templates(seed), []
    for _ in range(n):
        page, gold = make.page()
        found = blocks(page)
        left = [" ".join(g.split()) for g in gold]
        label = []
        for b in found:
            hit = bool(left) and b.text == left[0]
            if hit:
                left.pop(0)
            label.append(hit)
        if not left:
            out.append((vectors(found), np.array(label, np.float32)))
    return out


WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "html_weights.npz")


@functools.lru_cache(1)
def model() -> tuple:
    """The weights (name, array) as ``train`` made them; ``python -m glossmill.llm.html`` makes the file anew."""
    with np.load(WEIGHTS) as f:
        return tuple((k, f[k].astype(np.float32)) for k in f.files)


def train(pages: int = 9000, epochs: int = 12, seed: int = 7) -> tuple:
    """Weights (name, array), by Adam over batches of pages of like length."""
    rng = np.random.default_rng(seed)
    data = sorted(examples(pages, seed), key=lambda e: len(e[1]))
    weights = {k: (rng.standard_normal((WIDTH + HIDDEN + 1, 4 * HIDDEN)) * 0.15).astype(np.float32) for k in ("ahead", "back")}
    weights["out"] = (rng.standard_normal(2 * HIDDEN + 1) * 0.1).astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    groups = [data[i : i + 24] for i in range(0, len(data), 24)]
    step = 0
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            x, mask = pad([e[0] for e in groups[g]])
            y = np.zeros_like(mask)
            for k, (_, label) in enumerate(groups[g]):
                y[: len(label), k] = label
            ahead, m1 = _forward(x, weights["ahead"], mask, True)
            back, m2 = _forward(x[::-1], weights["back"], mask[::-1], True)
            both = np.concatenate([ahead, back[::-1]], axis=2)
            d = (_sigmoid(both @ weights["out"][:-1] + weights["out"][-1]) - y) * mask / mask.sum()
            grads = {"out": np.append(np.einsum("tbh,tb->h", both, d), d.sum())}
            dh = d[:, :, None] * weights["out"][:-1]
            grads["ahead"] = _backward(x, weights["ahead"], m1, dh[:, :, :HIDDEN])
            grads["back"] = _backward(x[::-1], weights["back"], m2, dh[::-1, :, HIDDEN:])
            step += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for k, gr in grads.items():
                gr = np.clip(gr, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * gr
                second[k] = 0.99 * second[k] + 0.01 * gr * gr
                weights[k] = (weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return tuple(weights.items())


def extract(pages: list[str | None], weights: dict[str, np.ndarray], cells: int = 40_000) -> list[str]:
    """Main text of each page; pages of like length are read side by side.

    A block is main text above 0.5; where none is, above half of the page's best, if that isn't below UNSURE.
    """
    found = [blocks(p or "") for p in pages]
    out = [""] * len(pages)
    order = [i for i in sorted(range(len(pages)), key=lambda i: len(found[i])) if found[i]]
    while order:
        n = 1
        while n < len(order) and (n + 1) * len(found[order[n]]) <= cells:
            n += 1
        part, order = order[:n], order[n:]
        p = scores(weights, *pad([vectors(found[i]) for i in part]))
        for k, i in enumerate(part):
            most = float(p[: len(found[i]), k].max())
            bar = 0.5 if most > 0.5 else max(most / 2, UNSURE)
            out[i] = "\n\n".join(b.text for j, b in enumerate(found[i]) if p[j, k] > bar)
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages`` (page_id, url, html)."""
    weights = pages.sparkSession.sparkContext.broadcast(dict(model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = extract(part.column(2).to_pylist(), weights.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in train()})
