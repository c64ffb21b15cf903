"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: runs of text between block-level tags. Each block has a vector: signed
hashes of its tag path (names, and the words of class and id), of all its words (their sum over the
root of their number), and a few numbers (length, share of link text, place, the page's number of
blocks, length against its longest). A bidirectional LSTM in numpy reads the whole page's sequence
and a logistic layer on both directions keeps or drops each block, so a block is judged in its page.

No table labels blocks, so the network is trained on pages drawn from a small random grammar of
layouts, whose blocks are labelled by construction: pages with telling names, pages without any or with
random ones, and pages that are little but their text. Training takes about a minute and depends on
nothing but its seed; its weights lie beside this module, and ``python -m tallyspark.llm.page_extract``
makes them. Its test pages are written by hand, in layouts that the grammar does not draw. Pages are
labelled in batches of sequences of like length, whole pages always.

Edge cases: null or empty html, or a page without text, gives the empty text; unclosed, crossed and
stray tags are tolerated (an end tag closes up to its nearest open match, a block-level start closes
an open paragraph); an unterminated script, style or comment runs to the end; equal rows give equal
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

# Element names of the HTML standard.
_BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|iframe|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?:[!?]|/?[a-zA-Z])[^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PART = re.compile(r"[A-Za-z]+")

PATH, WORD, EXTRA = 128, 256, 10
WIDTH, HIDDEN = PATH + WORD + EXTRA, 16
#: Pages, and bytes of their html, that are labelled together.
SLICE_PAGES, SLICE_BYTES = 512, 2 << 20


@lru_cache(maxsize=1 << 16)
def _slot(name: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(name.encode())
    return h % size, 1.0 if h & 0x10000 else -1.0


@lru_cache(maxsize=1 << 14)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    vector = np.zeros(PATH, np.float32)
    for name in path:
        k, sign = _slot(name, PATH)
        vector[k] = sign
    return vector


def blocks(source: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, share of link text) of every block with text, in page order."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    found: list[tuple[tuple[str, ...], str, float]] = []
    text: list[str] = []
    linked = links = at = 0

    def close() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                path = tuple(dict.fromkeys(n for _, names in stack for n in names))
                found.append((path, whole, min(1.0, linked / len(whole))))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if links:
            linked += len(piece.strip())

    for m in _MARKUP.finditer(source):
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        block = name in _BLOCK
        if m[2]:
            if block:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    links -= sum(n == "a" for n, _ in stack[k:])
                    del stack[k:]
                    break
            continue
        if block:
            close()
            if name != "br":
                for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph and what it holds
                    if stack[k][0] == "p":
                        links -= sum(n == "a" for n, _ in stack[k:])
                        del stack[k:]
                        break
                    if stack[k][0] in _BLOCK:
                        break
        if name in _VOID:  # a slash before the end of any other tag means nothing in HTML
            continue
        names = [name]
        if "=" in m[4]:
            for given in _NAMES.findall(m[4]):
                names += ["." + w.lower() for w in _PART.findall("".join(given))]
        stack.append((name, tuple(names)))
        links += name == "a"
    if at < len(source):
        add(source[at:])
    close()
    return [b for b in found if "head" not in b[0]]


def vectors(pages: list[list[tuple[tuple[str, ...], str, float]]]) -> list[np.ndarray]:
    """One row a block, of each page."""
    found = kernels.words([text.encode("utf-8", "replace") for page in pages for _, text, _ in page], lower=True)
    counts = found.counts
    slot, sign = (found.hashes % np.uint64(WORD)).astype(np.int64), np.where(found.hashes >> np.uint64(63), 1.0, -1.0)
    hashed = np.bincount(np.repeat(np.arange(len(counts)), counts) * WORD + slot, sign, minlength=len(counts) * WORD).reshape(-1, WORD)
    hashed = hashed / np.sqrt(np.maximum(counts, 1))[:, None]
    out, at = [], 0
    for page in pages:
        x = np.empty((len(page), WIDTH), np.float32)
        x[:, PATH : PATH + WORD] = hashed[at : at + len(page)]
        longest = max((len(text) for _, text, _ in page), default=1)
        for i, (path, text, linked) in enumerate(page):
            x[i, :PATH] = _path_vector(path)
            x[i, PATH + WORD :] = (
                np.log1p(len(text)) / 6, linked, i / len(page), 1.0 if text[-1] in ".!?…\"" else 0.0,
                min(1.0, text.count(",") / counts[at + i] * 5), 1.0 if "©" in text else 0.0, 1.0 if i == 0 else 0.0, 1.0 if i == len(page) - 1 else 0.0,
                np.log1p(len(page)) / 5, len(text) / longest,
            )
        at += len(page)
        out.append(x)
    return out


# ---- the network

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class BiLstm:
    """One LSTM layer each way and a logistic output; sequences are padded to (time, batch)."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {}
        for way in "fb":
            self.p["x" + way] = rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, 4 * HIDDEN))
            self.p["h" + way] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            bias = np.zeros(4 * HIDDEN)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p["b" + way] = bias
        self.p["o"], self.p["c"] = rng.normal(0, 0.3, 2 * HIDDEN), np.zeros(1)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, taped: bool = True) -> tuple[np.ndarray, list]:
        steps = range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)
        h, c = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
        into = x @ self.p["x" + way] + self.p["b" + way]
        out, tape = np.zeros((len(x), x.shape[1], HIDDEN), np.float32), []
        for t in steps:
            gates = into[t] + h @ self.p["h" + way]
            i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN :])
            new = f * c + i * g
            live = mask[t][:, None]
            squashed = np.tanh(new)
            if taped:
                tape.append((t, h, c, i, f, o, g, squashed))
            c = np.where(live, new, c)
            h = np.where(live, o * squashed, h)
            out[t] = h
        return out, tape

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, way, taped=False)[0] for way in "fb"], axis=2)
        return _sigmoid(both @ self.p["o"] + self.p["c"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {way: self._run(x, mask, way) for way in "fb"}
        both = np.concatenate([runs[w][0] for w in "fb"], axis=2)
        delta = (_sigmoid(both @ self.p["o"] + self.p["c"]) - y) * mask / np.float32(mask.sum())
        grads = {"o": np.einsum("tb,tbh->h", delta, both), "c": np.array([delta.sum()])}
        for k, way in enumerate("fb"):
            above = delta[:, :, None] * self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
            every, before = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros((*x.shape[:2], HIDDEN), np.float32)
            dh, dc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, g, squashed in reversed(runs[way][1]):
                live = mask[t][:, None]
                dh = dh + above[t]
                dnew = np.where(live, dh * o * (1 - squashed**2) + dc, 0)
                gates = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), np.where(live, dh * squashed, 0) * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
                every[t], before[t] = gates, h
                dh = np.where(live, gates @ self.p["h" + way].T, dh)
                dc = np.where(live, dnew * f, dc)
            flat = every.reshape(-1, 4 * HIDDEN)
            grads |= {"x" + way: x.reshape(-1, WIDTH).T @ flat, "h" + way: before.reshape(-1, HIDDEN).T @ flat, "b" + way: flat.sum(0)}
        return grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask = np.zeros((longest, len(pages), WIDTH), np.float32), np.zeros((longest, len(pages)), bool)
    for k, page in enumerate(pages):
        x[: len(page), k] = page
        mask[: len(page), k] = True
    return x, mask


# ---- training pages

# Words by which page authors commonly name the parts of a layout.
_SIDE_NAMES = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs topbar toolbar tabs skip pagination".split(),
    "ad": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion banner".split(),
    "side": "sidebar side widget related recommended popular trending tags rail aside".split(),
    "note": "notice cookie cookies consent alert popup modal newsletter subscribe signup disclaimer gdpr".split(),
    "head": "header masthead site logo branding".split(),
    "foot": "footer copyright legal colophon bottom".split(),
    "talk": "comments comment replies reply discussion disqus respond".split(),
    "share": "share social sharing follow buttons".split(),
}
# Words that such parts often say.
_SIDE_WORDS = {
    "nav": "home about contact news search menu blog login sign in account help products services archive next previous page".split(),
    "ad": "advertisement sponsored offer buy now sale save discount free shipping deal price shop order today limited only get yours".split(),
    "side": "related popular recent latest posts tags categories trending most read more stories you may also like recommended".split(),
    "note": "we use cookies to improve your experience accept reject privacy policy consent settings subscribe to our newsletter sign up close".split(),
    "head": "home welcome the daily online magazine search login subscribe".split(),
    "foot": "copyright all rights reserved terms of service privacy policy contact us imprint cookie powered by".split(),
    "talk": "reply comment comments says wrote posted ago report like thanks great agree leave a log in to".split(),
    "share": "share tweet email print link facebook follow us copy save".split(),
    "form": "name email password submit send your message search enter address subscribe required phone".split(),
}
_MAIN_NAMES = "content main article post entry body text story page".split()


def training_pages(n: int, seed: int = 5) -> Iterator[tuple[str, str]]:
    """(html, main text) drawn from a grammar of layouts."""
    rng = np.random.default_rng(seed)
    syllables = [a + b for a in ("", *"bdfgklmnprstv", "th", "sh", "ch") for b in ("a", "e", "i", "o", "u", "en", "er", "é", "ü")]
    chance = lambda p: rng.random() < p
    pick = lambda xs: xs[rng.integers(len(xs))]
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 5)))
    every = [w for own in _SIDE_WORDS.values() for w in own]
    kind_now = [""]  # the part whose words phrases mix in
    nameless = [False]  # whether the page names its parts at all

    def phrase(low: int, high: int) -> str:
        least = 0.3 if nameless[0] else 0.0  # where names tell nothing, words must
        own, share = (_SIDE_WORDS[kind_now[0]], least + 0.45 * rng.random()) if kind_now[0] else (every, 0.04)
        return " ".join((pick(own) if chance(share) else word()) + ("," if chance(0.08) else "") for _ in range(rng.integers(low, high + 1))).capitalize()

    def attributes(names: list[str], p: float) -> str:
        if nameless[0] or not chance(p):
            return f' {pick(("class", "id"))}="{word()}{rng.integers(10)}"' if chance(0.6 if nameless[0] else 0.3) else ""
        value = pick(names) if chance(0.6) else "-".join((pick(names), word()) if chance(0.5) else (word(), pick(names)))
        return f' {pick(("class", "class", "id"))}="{value}"'

    def links(k: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}">{phrase(1, 3)}</a></{tag}>' for _ in range(k))

    def box(kind: str, inner: str, tags: tuple[str, ...], p: float = 0.9) -> str:
        tag = "div" if nameless[0] and chance(0.8) else pick(tags)
        return f"<{tag}{attributes(_SIDE_NAMES[kind], 1.0 if tag in ('div', 'section', 'p') else p * 0.5)}>{inner}</{tag}>"

    def sentences() -> str:
        return phrase(1, 60 if chance(0.8) else 4) + ("." if chance(0.9) else "")

    def side(kind: str) -> str:
        outer, kind_now[0] = kind_now[0], kind
        drawn = drawn_side(kind)
        kind_now[0] = outer
        return drawn

    def drawn_side(kind: str) -> str:
        if kind == "nav":
            k = rng.integers(2, 9)
            inner = f"<ul>{links(k)}</ul>" if chance(0.6) else links(k, "span") if chance(0.4) else links(k, "td") if chance(0.4) else "<br>".join(f"<a href='/{word()}'>{phrase(1, 3)}</a>" for _ in range(k))
            return box(kind, inner, ("nav", "nav", "div", "td"))
        if kind == "head":
            return box(kind, (f"<h1>{phrase(1, 3)}</h1>" if chance(0.4) else f"<a href='/'>{phrase(1, 3)}</a>") + (f"<p>{phrase(2, 8)}</p>" if chance(0.3) else ""), ("header", "header", "div"))
        if kind == "ad":
            return box(kind, phrase(2, 25) + "." if chance(0.7) else f"<p>{sentences()}</p>", ("div", "div", "aside", "section"))
        if kind == "side":
            return box(kind, f"<h3>{phrase(1, 3)}</h3>" + (f"<ul>{links(rng.integers(2, 7))}</ul>" if chance(0.6) else f"<p>{sentences()}</p>"), ("aside", "aside", "div"))
        if kind == "note":
            return box(kind, f"<p>{sentences()}</p>" + (f"<button>{word()}</button>" if chance(0.5) else ""), ("div", "div", "section", "p"))
        if kind == "form":
            return f"<form><label>{phrase(1, 4)}</label><input type='text'><select><option>{word()}</option><option>{word()}</option></select><button>{word()}</button></form>"
        if kind == "foot":
            return box(kind, (f"&copy; {word()}.example.com &middot; " if chance(0.6) else "") + (sentences() if chance(0.6) else f"<ul>{links(rng.integers(1, 6))}</ul>"), ("footer", "footer", "div"))
        if kind == "share":
            return box(kind, links(rng.integers(2, 5), "span"), ("div", "ul"))
        talk = "".join(f'<div{attributes(["comment", "reply"], 0.8)}><b>{word()}</b><p>{sentences()}</p></div>' for _ in range(rng.integers(1, 6)))
        return box("talk", (f"<h2>{phrase(1, 2)}</h2>" if chance(0.7) else "") + talk, ("div", "section", "section", "ol"))

    for _ in range(n):
        kept: list[str] = []
        layout = rng.random()
        nameless[0] = layout < 0.2
        paragraph = "div" if layout < 0.3 and chance(0.6) else "p"

        def keep(text: str) -> str:
            kept.append(text)
            return text

        def content() -> str:
            out = []
            if chance(0.8):
                title = f"<h1>{keep(phrase(2, 12))}</h1>"
                out.append(f"<header>{title}</header>" if chance(0.1) else title)
            for _ in range(rng.integers(1, 14)):
                r = rng.random()
                if r < 0.64:
                    text = keep(sentences())
                    cut = text.find(" ", len(text) // 2)
                    inline = f"<b>{text}</b>" if chance(0.1) or cut < 0 else f"{text[:cut]} <a href='/x'>{text[cut + 1:]}</a>" if chance(0.1) else f"<em>{text[:cut]}</em> {text[cut + 1:]}" if chance(0.1) else text
                    out.append(f"<{paragraph}{attributes(['lead', 'intro', 'text'], 0.1)}>{inline}" + (f"</{paragraph}>" if paragraph == "div" or chance(0.9) else ""))
                elif r < 0.70:
                    text = keep(sentences())
                    out.append(f"<p><b>{text}<br>")
                elif r < 0.78:
                    out.append(f"<{(h := pick(('h2', 'h3')))}>{keep(phrase(1, 6))}</{h}>")
                elif r < 0.84:
                    out.append("<ul>" + "".join(f"<li>{keep(phrase(1, 20))}</li>" for _ in range(rng.integers(1, 5))) + "</ul>")
                elif r < 0.87:
                    out.append(f"<blockquote>{keep(sentences())}</blockquote>" if chance(0.5) else f"<pre>{keep(phrase(2, 20))}</pre>")
                elif r < 0.90:
                    out.append("<table>" + "".join(f"<tr><td>{keep(phrase(1, 4))}</td><td>{keep(phrase(1, 4))}</td></tr>" for _ in range(rng.integers(1, 4))) + "</table>")
                else:
                    out.append(side(pick(("ad", "share", "side", "note"))))
            return "".join(out)

        def flat() -> str:
            """Little but its text: some blocks of one kind, or none around it, between few other parts."""
            kind = pick(("p", "p", "div", "div", "td", "li", "pre", "section", "br", ""))
            texts = [keep(sentences()) for _ in range(1 if kind in ("", "pre") else rng.integers(1, 7))]
            title = f"<h1>{keep(phrase(1, 8))}</h1>" if chance(0.25) else ""
            if title:
                kept.insert(0, kept.pop())
            return title + ("<br>".join(texts) if kind == "br" else "".join(f"<{kind}>{t}</{kind}>" if kind else t for t in texts))

        if 0.2 <= layout < 0.34:
            nameless[0] = chance(0.5)
            before = "".join(side(k) for k in ("note", "nav", "ad") if chance(0.12))
            inner = flat()
            after = "".join(side(k) for k in ("foot", "note", "talk", "side") if chance(0.12))
            whole = before + inner + after
            yield (f"<html><body>{whole}</body></html>" if chance(0.8) else whole), " ".join(" ".join(t.split()) for t in kept)
            continue

        top = [side(k) for k in ("note", "head", "nav", "ad", "side", "form") if chance(0.5)]
        bottom = [side(k) for k in ("share", "side", "talk", "ad", "form", "nav") if chance(0.35)]
        tag = pick(("article", "article", "main", "div", "div", "section"))
        inner = content()
        middle = f"<{tag}{attributes(_MAIN_NAMES, 1.0 if tag in ('div', 'section') else 0.4)}>{inner}</{tag}>"
        if chance(0.3):
            tag = pick(("main", "div"))
            middle = f"<{tag}{attributes(_MAIN_NAMES + ['wrapper', 'container'], 0.6)}>{middle}{side('talk') if chance(0.3) else ''}</{tag}>"
        head = f"<head><title>{phrase(1, 8)}</title><style>p{{}}</style></head>" if chance(0.8) else ""
        page = "".join(top) + middle + "".join(bottom) + (side("foot") if chance(0.85) else "")
        yield f"<!DOCTYPE html><html>{head}<body>{page}</body></html>", " ".join(" ".join(t.split()) for t in kept)


WEIGHTS = "labeller.npz"


@lru_cache(maxsize=1)
def trained() -> BiLstm:
    """The labeller with the weights that ``python -m tallyspark.llm.page_extract`` makes."""
    net = BiLstm()
    with (files(__package__) / WEIGHTS).open("rb") as file, np.load(file) as held:
        net.p = {k: held[k].astype(np.float32) for k in net.p}
    return net


def train(pages: int = 4000, rounds: int = 10, seed: int = 5) -> BiLstm:
    """The labeller after ``rounds`` passes of Adam over generated pages."""
    drawn = [(blocks(source), main) for source, main in training_pages(pages, seed)]
    data = []
    for (found, main), rows in zip(drawn, vectors([found for found, _ in drawn])):
        labels, at = [], 0
        for _, text, _ in found:
            here = main.startswith(text, at)
            labels.append(float(here))
            at += (len(text) + 1) * here
        data.append((rows, np.array(labels)))
    data.sort(key=lambda d: len(d[1]))
    net, rng, batch, t = BiLstm(), np.random.default_rng(seed), 24, 0
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for _ in range(rounds):
        for b in rng.permutation(range(0, len(data), batch)):
            part = data[b : b + batch]
            x, mask = padded([d[0] for d in part])
            x[:, :, : PATH + WORD] *= rng.random((1, 1, PATH + WORD)) > 0.08  # no single name or word may decide
            y = np.zeros(mask.shape, np.float32)
            for k, d in enumerate(part):
                y[: len(d[1]), k] = d[1]
            t += 1
            rate = 0.012 * (1 - t / (rounds * -(-len(data) // batch) + 1))
            for k, g in net.gradients(x, mask, y).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def label_pages(net: BiLstm, sources: list[str], cells: int = 8_192) -> list[list[tuple[str, bool]]]:
    """(text, kept) of every block of every page; a padded group has at most ``cells`` blocks, or is
    one page."""
    pages = [blocks(s) for s in sources]
    rows = vectors(pages)
    out: list[list[tuple[str, bool]]] = [[] for _ in pages]
    order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    while order:
        group = max(1, min(len(order), cells // len(pages[order[-1]])))
        own, order = order[-group:], order[:-group]
        x, mask = padded([rows[k] for k in own])
        keep = net.probabilities(x, mask) >= 0.5
        for j, k in enumerate(own):
            out[k] = [(b[1], bool(keep[i, j])) for i, b in enumerate(pages[k])]
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """At most SLICE_PAGES pages and SLICE_BYTES of html, or one page."""
    size = np.append(0, np.cumsum([len(s) if s else 0 for s in kernels.binary_list(batch.column(2))]))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(size, size[at] + SLICE_BYTES, "right")) - 1
        end = min(max(end, at + 1), at + SLICE_PAGES, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def extract(pages: DataFrame, net: BiLstm | None = None) -> DataFrame:
    """page_id, url, text of every page."""
    model = net or trained()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                found = label_pages(model, [s or "" for s in part.column(2).to_pylist()])
                texts = [" ".join(t for t, kept in page if kept) for page in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(work, "page_id long, url string, text string")


if __name__ == "__main__":
    from pathlib import Path

    np.savez_compressed(Path(__file__).with_name(WEIGHTS), **{k: v.astype(np.float16) for k, v in train().p.items()})
