"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, the texts between block-level tags, each with its tag path (tags, class and id words).
A bidirectional LSTM in numpy reads the blocks in page order, each as the sum of its path's embeddings, the mean of
its hashed words' embeddings and a few measures, so every block is classified with the whole page as its context.
The network is trained here, from a fixed seed, on pages that page_maker composes from templates with known labels;
``python -m quarryloom.llm.html_text`` trains it anew and writes the weights file beside this module.

Scripts, styles and comments, and templates and SVG graphics that are closed, never become blocks. Formulas stay in their
sentence; what noscript, iframe, object, canvas, audio or video hold is a block of its own. Character references are decoded, white space inside a block
(a <br> too) becomes one space, blocks are trimmed and joined by one line break. Null and empty pages, and pages
without a main block, give an empty text. Unclosed and stray tags, and text without tags, are read as far as they go.
Repeated pages give repeated rows. Empty tables give no rows. Columns other than the three are ignored.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import small_batches
from .text import SPACED, WordScanner, row_chunks, string_bytes

#: Fixed values of HTML: block-level and void elements, elements whose content is no text, and what an opening tag closes.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOIDS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
NO_P = BLOCKS - {"body", "html", "head", "button", "option", "optgroup", "select", "textarea", "title", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "legend"}

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"""
    r"""|<(template|svg)(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?<!/)>(?:(?!<\2[\s/>]).)*?</\2(?=[\s/>])[^>]*>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""",
    re.DOTALL | re.IGNORECASE,
)
MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
FALLBACK = frozenset("noscript iframe object canvas audio video".split())
PARTS = re.compile(r"[a-z]+")

PATH_ROWS, WORD_ROWS, PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN = 2048, 1024, 16, 8, 5, 16


@dataclass(slots=True)
class Block:
    path: tuple[str, ...]
    text: str
    linked: float


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks that have text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # tag, and label: the tag with its class and id words
    pieces: list[str] = []
    links = [0, 0]  # open anchors, characters inside them
    at_path: list[tuple[str, ...]] = []

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(at_path[0], text, min(1.0, links[1] / len(text))))
            pieces.clear()
            at_path.clear()
        links[1] = 0

    def add(text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        if not at_path and not text.isspace():
            at_path.append(tuple(label for _, label in stack))
        if links[0]:
            links[1] += len(text)
        if at_path:
            pieces.append(text)

    def close(tags: set[str], until: frozenset[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                links[0] -= sum(t == "a" for t, _ in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in until:
                return

    page, last = page or "", 0
    for m in TOKEN.finditer(page):
        start = m.start()
        if start > last:
            add(page[last:start])
        last = m.end()
        tag = m.group(4) or m.group(7)
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            if at_path:
                pieces.append(" ")
            continue
        if tag in BLOCKS or tag in FALLBACK:
            flush()
        if m.group(3) or m.group(6):
            close({tag}, frozenset())
            continue
        if tag in NO_P:
            close({"p"}, frozenset({"table", "td", "button", "blockquote"}))
        if tag in CLOSES:
            close(CLOSES[tag], frozenset({"ul", "ol", "table", "dl", "select"} - {tag}))
        attributes = m.group(5) or m.group(8) or ""
        if tag in VOIDS or attributes.endswith("/") and tag not in BLOCKS:
            continue
        label = tag
        if "=" in attributes:
            for kind, a, b, c in MARKS.findall(attributes):
                label += "".join(f" {kind[0].lower()}:{w}" for w in PARTS.findall(html.unescape(a or b or c).lower()))
        stack.append((tag, label))
        links[0] += tag == "a"
    if last < len(page):
        add(page[last:])
    flush()
    return out


def _row(token: str, rows: int) -> int:
    return zlib.crc32(token.encode()) % rows


def path_rows(path: tuple[str, ...]) -> list[int]:
    """Rows of the embedding table: every element's tag and marks, and the innermost tag once more."""
    tokens = [part for label in path for part in label.split(" ")]
    if path:
        tokens.append("leaf:" + path[-1].split(" ", 1)[0])
    return [_row(t, PATH_ROWS) for t in tokens] or [_row("no path", PATH_ROWS)]


class Network:
    """Embeddings, an LSTM in each direction, and a logistic unit on both hidden states."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + MEASURES
        self.p: dict[str, np.ndarray] = {"path": rng.normal(0, 0.1, (PATH_ROWS, PATH_SIZE)), "word": rng.normal(0, 0.05, (WORD_ROWS, WORD_SIZE)), "out": rng.normal(0, 0.3, 2 * HIDDEN + size), "bias": np.zeros(1)}
        for side in "fb":
            self.p["w" + side] = rng.normal(0, (size + HIDDEN) ** -0.5, (size + HIDDEN, 4 * HIDDEN))
            self.p["c" + side] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self._paths: dict[tuple[str, ...], np.ndarray] = {}

    def inputs(self, page_blocks: Sequence[list[Block]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """A row for each block of all pages: path, words, measures; and each block's path rows."""
        flat = [b for page in page_blocks for b in page]
        size = PATH_SIZE + WORD_SIZE + MEASURES
        x = np.zeros((len(flat), size))
        rows = []
        for i, b in enumerate(flat):
            got = self._paths.get(b.path)
            if got is None:
                if len(self._paths) > 100_000:
                    self._paths.clear()
                got = self._paths[b.path] = np.array(path_rows(b.path))
            rows.append(got)
        if flat:
            at = np.cumsum([0, *map(len, rows)])[:-1]
            x[:, :PATH_SIZE] = np.add.reduceat(self.p["path"][np.concatenate(rows)], at, axis=0)
        position = np.concatenate([np.arange(len(page)) / max(1, len(page) - 1) for page in page_blocks]) if flat else np.empty(0)
        lengths = np.array([len(b.text) for b in flat], float)
        x[:, -MEASURES:] = np.stack([np.log1p(lengths) / 6, [b.linked for b in flat], position, [b.text[-1] in ".!?…:\"”»" for b in flat], lengths > 200], axis=1) if flat else 0
        self._words = [(w.first, w.hashes % np.uint64(WORD_ROWS), w.bounds) for w in _SCANNER.scan(pa.array([b.text for b in flat], pa.large_string()))]
        for first, hashes, bounds in self._words:
            total = np.zeros((len(hashes) + 1, WORD_SIZE))
            np.cumsum(self.p["word"][hashes.astype(np.int64)], axis=0, out=total[1:])
            x[first : first + len(bounds) - 1, PATH_SIZE : PATH_SIZE + WORD_SIZE] = (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)[:, None]
        return x, rows

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, pages, HIDDEN) in the order of x; where the mask is 0 the state stays."""
        w, c0 = self.p["w" + side], self.p["c" + side]
        steps, pages, size = x.shape
        h, c, out = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN)), np.empty((steps, pages, HIDDEN))
        ahead = x.reshape(-1, size) @ w[:size] + c0
        ahead = ahead.reshape(steps, pages, -1)
        for t in range(steps):
            z = ahead[t] + h @ w[size:]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            squashed = np.tanh(new)
            if keep is not None:
                keep.append((h, c, i, f, o, g, squashed, m))
            c = m * new + (1 - m) * c
            h = m * (o * squashed) + (1 - m) * h
            out[t] = h
        return out

    @staticmethod
    def _padded(x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(steps, pages, size) from rows, the mask, and each row's place."""
        steps, pages = int(counts.max(initial=1)), len(counts)
        page = np.repeat(np.arange(pages), counts)
        step = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
        out, mask = np.zeros((steps, pages, x.shape[1])), np.zeros((steps, pages))
        out[step, page], mask[step, page] = x, 1
        return out, mask, step * pages + page

    def _logits(self, x: np.ndarray, counts: np.ndarray, keep: dict | None = None) -> np.ndarray:
        xs, mask, place = self._padded(x, counts)
        kept: tuple[list | None, list | None] = ([], []) if keep is not None else (None, None)
        forward = self._run(xs, mask, "f", kept[0])
        backward = self._run(xs[::-1], mask[::-1], "b", kept[1])[::-1]
        both = np.concatenate([forward, backward, xs], axis=2).reshape(-1, 2 * HIDDEN + x.shape[1])[place]
        if keep is not None:
            keep.update(xs=xs, mask=mask, place=place, both=both, kept=kept)
        return both @ self.p["out"] + self.p["bias"]

    def probabilities(self, page_blocks: list[list[Block]]) -> list[np.ndarray]:
        """P(main) of every block; pages of similar length are run together, so padding is little."""
        out: list[np.ndarray] = [np.empty(0)] * len(page_blocks)
        order = sorted((i for i, page in enumerate(page_blocks) if page), key=lambda i: len(page_blocks[i]))
        for at in range(0, len(order), 64):
            these = order[at : at + 64]
            pages = [page_blocks[i] for i in these]
            counts = np.array([len(page) for page in pages])
            logits = self._logits(self.inputs(pages)[0], counts)
            for i, part in zip(these, np.split(logits, np.cumsum(counts)[:-1]), strict=True):
                out[i] = 1 / (1 + np.exp(-np.clip(part, -30, 30)))
        return out

    def gradients(self, pages: list[list[Block]], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        counts = np.array([len(page) for page in pages])
        x, rows = self.inputs(pages)
        keep: dict = {}
        p = 1 / (1 + np.exp(-np.clip(self._logits(x, counts, keep), -30, 30)))
        loss = float(-np.mean(labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9)))
        d = (p - labels) / len(labels)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["out"], grads["bias"] = d @ keep["both"], np.array([d.sum()])
        steps, count, size = keep["xs"].shape
        d_both = np.zeros((steps * count, 2 * HIDDEN + size))
        d_both[keep["place"]] = d[:, None] * self.p["out"]
        d_both = d_both.reshape(steps, count, -1)
        d_x = d_both[:, :, 2 * HIDDEN :].copy()
        for side, part, flip in (("f", slice(0, HIDDEN), 1), ("b", slice(HIDDEN, 2 * HIDDEN), -1)):
            w, xs, d_out, kept = self.p["w" + side], keep["xs"][::flip], d_both[::flip, :, part], keep["kept"][side == "b"]
            d_h, d_c, d_z = np.zeros((count, HIDDEN)), np.zeros((count, HIDDEN)), np.empty((steps, count, 4 * HIDDEN))
            hs = np.empty((steps, count, HIDDEN))
            for t in range(steps - 1, -1, -1):
                h, c, i, f, o, g, squashed, m = kept[t]
                hs[t] = h
                d_h = d_h + d_out[t]
                new_h = m * d_h
                new_c = m * d_c + new_h * o * (1 - squashed**2)
                d_z[t] = np.concatenate([new_c * g * i * (1 - i), new_c * c * f * (1 - f), new_h * squashed * o * (1 - o), new_c * i * (1 - g**2)], axis=1)
                d_h = d_z[t] @ w[size:].T + (1 - m) * d_h
                d_c = new_c * f + (1 - m) * d_c
            flat = d_z.reshape(-1, 4 * HIDDEN)
            grads["w" + side][:size] = xs.reshape(-1, size).T @ flat
            grads["w" + side][size:] = hs.reshape(-1, HIDDEN).T @ flat
            grads["c" + side] = flat.sum(axis=0)
            d_x[::flip] += (flat @ w[:size].T).reshape(steps, count, size)
        d_rows = d_x.reshape(-1, size)[keep["place"]]
        np.add.at(grads["path"], np.concatenate(rows), np.repeat(d_rows[:, :PATH_SIZE], [len(r) for r in rows], axis=0))
        for first, hashes, bounds in self._words:
            n = np.diff(bounds)
            np.add.at(grads["word"], hashes.astype(np.int64), np.repeat(d_rows[first : first + len(n), PATH_SIZE : PATH_SIZE + WORD_SIZE] / np.maximum(n, 1)[:, None], n, axis=0))
        return loss, grads


_SCANNER = WordScanner(SPACED)


# Training pages

#: How templates mark what is main and what is not, and words of furniture.
MAIN_SHELLS = ("<article>", "<main>", '<div class="content">', '<div id="content">', '<div class="post-body">', '<article class="post">', '<div class="entry-content">', '<section class="article-body">', '<main id="main"><article>', '<div class="main"><div class="story">', '<div role="main">', '<div class="wrapper"><article class="article">')
ASIDES = {
    "menu": ("<nav>", '<ul class="menu">', '<div class="navbar">', '<nav class="breadcrumb">', '<div id="navigation">', '<div class="pagination">'),
    "header": ("<header>", '<div id="header">', '<div class="site-header">', '<header class="top">'),
    "footer": ("<footer>", '<div class="footer">', '<div id="footer">', '<footer class="site-footer">', '<div class="copyright">'),
    "sidebar": ("<aside>", '<div class="sidebar">', '<div id="sidebar">', '<aside class="widget">', '<div class="related">', '<div class="recommended-posts">'),
    "notice": ('<div class="cookie-notice">', '<div class="notice">', '<div id="consent">', '<div class="alert">', '<div class="popup modal">', '<div class="newsletter">', '<div class="gdpr banner">'),
    "advert": ('<div class="ad">', '<div class="ads">', '<div class="advert">', '<div id="advertisement">', '<div class="sponsored promo">', '<section class="ad-slot">'),
    "form": ("<form>", '<form class="search">', '<form id="login"><fieldset>', '<div class="subscribe"><form>'),
    "comments": ('<section class="comments">', '<div id="comments">', '<div class="comment">', '<ol class="comment-list">', '<div class="responses"><div class="comment-body">', '<section id="disqus_thread">'),
    "share": ('<div class="share">', '<ul class="social-links">', '<div class="tags">', '<p class="byline meta">'),
}
FURNITURE = "home about contact login search menu subscribe privacy terms cookie cookies accept share reply comment comments copyright rights reserved next previous read more related sign up newsletter advertisement sponsored kontakt impressum datenschutz suche anmelden accueil recherche connexion inicio buscar contacto".split()
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ción mente ado osa lar ich sch ung keit eau tion ment que é ñ ö ü ß".split()


def page_maker(rng: np.random.Generator) -> tuple[str, dict[str, int]]:
    """A page, and for each block's text whether it is main text."""
    labels: dict[str, int] = {}

    def words(n: int) -> list[str]:
        return ["".join(rng.choice(SYLLABLES, rng.integers(1, 5))) for _ in range(n)]

    def said(main: bool, short: bool) -> str:
        while True:
            n = int(rng.integers(1, 9)) if short else int(np.exp(rng.uniform(0, 4.6))) + 1
            w = words(n)
            if not main and rng.random() < 0.4:
                w = list(rng.choice(FURNITURE, min(n, 4)))
            text = " ".join(w).capitalize() + ("." if rng.random() < (0.8 if main else 0.4) else "")
            if text not in labels:
                labels[text] = int(main)
                return text

    def closing(opened: str) -> str:
        return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opened)))

    def shell(opened: str) -> str:
        if rng.random() < 0.25:
            opened = re.sub(r"<(\w+)(?: (?:class|id)=\"([^\"]*)\")?>", lambda m: f'<{m[1]} class="{(m[2] or "") + " " + "".join(rng.choice(SYLLABLES, 3))}">', opened, count=1)
        return opened

    def furniture(kind: str) -> str:
        opened = shell(str(rng.choice(ASIDES[kind])))
        parts = []
        prose = kind in ("advert", "comments", "notice", "sidebar", "footer")
        for _ in range(int(rng.integers(1, 7))):
            text = said(False, not (prose and rng.random() < 0.6))
            form = rng.random()
            if kind in ("menu", "share") or form < 0.3:
                parts.append(f'<li><a href="/{text[:5]}">{text}</a></li>' if form < 0.7 else f'<a href="#">{text}</a><p></p>')
            elif kind == "form" and form < 0.7:
                parts.append(f"<label>{text}</label><input name=q><p></p>" if form < 0.5 else f"<button>{text}</button>")
            elif form < 0.75:
                parts.append(f"<p>{text}</p>")
            elif form < 0.85:
                parts.append(f"<h3>{text}</h3>")
            else:
                parts.append(f"<div>{text}</div>")
        if len(parts) == 1 or rng.random() < 0.3:
            text = said(False, rng.random() < 0.5)
            parts = [text]
        return opened + "".join(parts) + closing(opened)

    def article() -> str:
        opened = shell(str(rng.choice(MAIN_SHELLS)))
        parts = [f"<h1>{said(True, rng.random() < 0.7)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(int(np.exp(rng.uniform(0, 3.2)))):
            text, form = said(True, rng.random() < 0.15), rng.random()
            if form < 0.68:
                parts.append(f"<p>{text}</p>")
            elif form < 0.76:
                parts.append(f"<p><b>{text}<br>")
            elif form < 0.81:
                parts.append(f"<h2>{text}</h2>")
            elif form < 0.86:
                parts.append(f"<ul><li>{text}</li><li>{said(True, True)}</li></ul>")
            elif form < 0.89:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif form < 0.92:
                parts.append(f"<div>{text}</div>")
            elif form < 0.94:
                parts.append(f"<pre>{text}</pre>")
            elif form < 0.96:
                parts.append(f"<table><tr><td>{text}</td><td>{said(True, True)}</td></tr></table>")
            elif form < 0.98:
                parts.append(f'<p><a href="/x">{said(True, True)}</a></p>')
            else:
                parts.append(f"<section><h3>{said(True, True)}</h3><p>{text}</p></section>")
            if rng.random() < 0.08:
                parts.append(furniture(str(rng.choice(["advert", "sidebar", "share", "notice", "comments", "form"]))))
        return opened + "".join(parts) + closing(opened)

    before = [furniture(k) for k in ("notice", "header", "menu", "advert", "form", "share") if rng.random() < 0.45]
    after = [furniture(k) for k in ("share", "comments", "sidebar", "advert", "form", "notice", "footer") if rng.random() < 0.45]
    rng.shuffle(before)
    title = said(False, True)
    body = "".join(before) + (article() if rng.random() < 0.97 else "") + "".join(after)
    if rng.random() < 0.15:
        body = f'<div class="container"><div id="page">{body}</div></div>'
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title></head><body>{body}</body></html>', labels


def trained(pages: int = 4000, epochs: int = 4, seed: int = 11) -> Network:
    """The network, trained with Adam; the same seed gives the same weights."""
    rng, net = np.random.default_rng(seed), Network(seed)
    made = []
    for _ in range(pages):
        page, labels = page_maker(rng)
        found = blocks(page)
        made.append((found, np.array([labels[b.text] for b in found], float)))
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * 0.45**epoch
        order = sorted(rng.permutation(pages).tolist(), key=lambda i: len(made[i][0]) // 8)
        batches = [order[i : i + 32] for i in range(0, pages, 32)]
        for k in rng.permutation(len(batches)).tolist():
            chosen = [made[i] for i in batches[k]]
            _, grads = net.gradients([b for b, _ in chosen], np.concatenate([y for _, y in chosen]))
            step += 1
            for name, g in grads.items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                net.p[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    net._paths.clear()
    return net


WEIGHTS = Path(__file__).with_name("html_weights.npz")


@functools.lru_cache(maxsize=1)
def network() -> Network:
    """The network with the weights of the file."""
    net = Network()
    with np.load(WEIGHTS) as held:
        net.p = {k: held[k].astype(float) for k in held.files}
    return net


def _extracted(batches: Iterator[pa.RecordBatch], weights: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    net = Network()
    net.p = weights
    for batch in batches:
        _, offsets = string_bytes(batch.column(2))
        for low, high in row_chunks(offsets):
            pages = [blocks(x) for x in batch.column(2).slice(low, high - low).to_pylist()]
            texts = ["\n".join(b.text for b, p in zip(page, chances, strict=True) if p >= 0.5) for page, chances in zip(pages, net.probabilities(pages), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low).cast(pa.int64()), batch.column(1).slice(low, high - low), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p) for p in pages], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks"],
            )


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points), n_blocks (all of the page's)."""
    small_batches(pages.sparkSession)
    weights = network().p
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return own.mapInArrow(lambda batches: _extracted(batches, weights), "page_id long, url string, text string, n_chars long, n_blocks long")


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float32) for k, v in trained().p.items()})
