"""Main-text extraction by a recurrent block labeller.

A page is a sequence of leaf blocks (``html_blocks``).  Each block becomes a vector: the mean of
learned vectors of the hashed names on its tag path, the mean of learned vectors of its hashed
words, and a few measures.  A bidirectional LSTM in numpy reads the whole sequence, and a logistic
output on both of its states labels every block.

Nobody has labelled the pages.  The model learns from a bounded sample of them: blocks inside
``article`` or ``main`` but not inside ``nav``, ``aside``, ``header``, ``footer`` or ``form`` are
main text; and from texts of the sample laid out anew in pages of other make-up, whose labels are
known.  Where no page tells its main text, the new layouts are all that it learns from.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from html import escape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import TAG_SLOTS, Block, blocks
from .session import small_batches
from .text import NOT_SPACE, buffers, word_hashes, words

#: Pages in the mean that the model is trained on, and the characters of markup that such a page has at most.
SAMPLE_PAGES, SAMPLE_CHARS = 240, 200_000
#: Characters from which a block of a page that doesn't tell its main text is laid out as main text.
PROSE = 60
#: Blocks, with padding, that are labelled together, unless a single page has more.
LABEL_BLOCKS = 1 << 14
LAYOUTS = 3
_SHARES = 1 << 30
WORD_SLOTS, TAG_SIZE, WORD_SIZE, MEASURES, HIDDEN = 2048, 16, 8, 6, 16
EPOCHS, RATE, GROUP = 10, 0.01, 24
_INPUT = TAG_SIZE + WORD_SIZE + MEASURES


class Inputs:
    """What the network sees of a group of pages, padded to [pages, steps]."""

    def __init__(self, pages: list[list[Block]]):
        self.lengths = np.array([len(p) for p in pages])
        self.steps = int(self.lengths.max(initial=0))
        flat = [b for p in pages for b in p]
        self.row = np.repeat(np.arange(len(pages)), self.lengths)
        self.step = np.concatenate([np.arange(n) for n in self.lengths]) if len(flat) else np.zeros(0, int)
        places: dict[tuple[int, ...], int] = {}
        self.path = np.array([places.setdefault(b.path, len(places)) for b in flat], np.int64)  # many blocks share one
        self.tag_of = np.repeat(np.arange(len(places)), [len(p) for p in places])
        self.tags = np.array([s for p in places for s in p], np.int64)
        self.n_tags = np.maximum(np.bincount(self.tag_of, minlength=len(places)), 1)[:, None]
        raw, offsets = buffers(pa.array([b.text for b in flat], pa.string()))
        start, end, first = words(raw, offsets, NOT_SPACE)
        self.word_of = np.repeat(np.arange(len(flat)), np.diff(first))
        self.words = (word_hashes(raw, start, end) % np.uint64(WORD_SLOTS)).astype(np.int64)
        self.n_words = np.maximum(np.diff(first), 1)[:, None]
        size = np.array([len(b.text) for b in flat], float)
        marks = np.array([sum(map(b.text.count, ".!?,;|:")) for b in flat], float)
        place = self.step / np.maximum(self.lengths[self.row] - 1, 1) if len(flat) else size
        self.measures = np.stack([np.log1p(size) / 5, np.array([b.linked for b in flat]) / np.maximum(size, 1), np.minimum(1, 10 * marks / np.maximum(size, 1)), np.array([b.text[-1:] in ".!?" for b in flat], float), place, np.ones(len(flat))], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """The network: embeddings, an LSTM in either direction and the output."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.p = {"tags": r.normal(0, 0.3, (TAG_SLOTS, TAG_SIZE)), "words": r.normal(0, 0.1, (WORD_SLOTS, WORD_SIZE)), "out": r.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
        for d in "fb":
            self.p[f"x{d}"] = r.normal(0, _INPUT**-0.5, (_INPUT, 4 * HIDDEN))
            self.p[f"h{d}"] = r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            self.p[f"c{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)  # gates: in, forget, out, new

    def _vectors(self, x: Inputs) -> np.ndarray:
        n = len(x.row)
        tags, texts = np.zeros((len(x.n_tags), TAG_SIZE)), np.zeros((n, WORD_SIZE))
        np.add.at(tags, x.tag_of, self.p["tags"][x.tags])
        np.add.at(texts, x.word_of, self.p["words"][x.words])
        out = np.zeros((len(x.lengths), x.steps, _INPUT))
        out[x.row, x.step] = np.concatenate([(tags / x.n_tags)[x.path], texts / x.n_words, x.measures], axis=1)
        return out

    def _run(self, x: Inputs, v: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """States [pages, steps, HIDDEN], and, to ``keep`` for training, what led to them; backward in direction b, where padding keeps the state at 0."""
        n = len(x.lengths)
        h, c, out, kept = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.zeros((n, x.steps, HIDDEN)), []
        pre = v @ self.p[f"x{d}"] + self.p[f"c{d}"]
        for t in range(x.steps) if d == "f" else range(x.steps - 1, -1, -1):
            live = (t < x.lengths)[:, None]
            z = pre[:, t] + h @ self.p[f"h{d}"]
            gates, new = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            c2 = f * c + i * new
            squashed = np.tanh(c2)
            h2 = o * squashed
            if keep:
                kept.append((t, live, h, c, i, f, o, new, squashed))
            h, c = np.where(live, h2, h), np.where(live, c2, c)
            out[:, t] = np.where(live, h2, 0)
        return out, kept

    def chances(self, x: Inputs) -> np.ndarray:
        """P(main text) of each block, flat."""
        if not len(x.row):
            return np.zeros(0)
        v = self._vectors(x)
        states = np.concatenate([self._run(x, v, d)[0] for d in "fb"], axis=2)
        return _sigmoid(states[x.row, x.step] @ self.p["out"] + self.p["bias"])

    def gradients(self, x: Inputs, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, by backpropagation through time."""
        v = self._vectors(x)
        runs = {d: self._run(x, v, d, keep=True) for d in "fb"}
        states = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        flat = states[x.row, x.step]
        error = (_sigmoid(flat @ self.p["out"] + self.p["bias"]) - y) / len(y)
        g = {"out": flat.T @ error, "bias": error.sum(keepdims=True)}
        to_state = np.zeros_like(states)
        to_state[x.row, x.step] = error[:, None] * self.p["out"]
        to_input = np.zeros_like(v)
        for k, d in enumerate("fb"):
            own = to_state[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            dh, dc = np.zeros((len(x.lengths), HIDDEN)), np.zeros((len(x.lengths), HIDDEN))
            dz_all, gh = np.zeros((*v.shape[:2], 4 * HIDDEN)), np.zeros_like(self.p[f"h{d}"])
            for t, live, h, c, i, f, o, new, squashed in reversed(runs[d][1]):
                a = np.where(live, dh + own[:, t], 0)
                b = np.where(live, dc, 0) + a * o * (1 - squashed**2)
                dz = np.concatenate([b * new * i * (1 - i), b * c * f * (1 - f), a * squashed * o * (1 - o), b * i * (1 - new**2)], axis=1)
                gh += h.T @ dz
                dz_all[:, t] = dz
                dh, dc = np.where(live, dz @ self.p[f"h{d}"].T, dh), np.where(live, b * f, dc)
            g[f"h{d}"], g[f"c{d}"] = gh, dz_all.sum(axis=(0, 1))
            g[f"x{d}"] = np.tensordot(v, dz_all, axes=([0, 1], [0, 1]))
            to_input += dz_all @ self.p[f"x{d}"].T
        back = to_input[x.row, x.step]
        g["tags"], g["words"] = np.zeros_like(self.p["tags"]), np.zeros_like(self.p["words"])
        to_path = np.zeros((len(x.n_tags), TAG_SIZE))
        np.add.at(to_path, x.path, back[:, :TAG_SIZE])
        np.add.at(g["tags"], x.tags, (to_path / x.n_tags)[x.tag_of])
        np.add.at(g["words"], x.words, (back[:, TAG_SIZE : TAG_SIZE + WORD_SIZE] / x.n_words)[x.word_of])
        return g


def fit(pages: list[list[Block]]) -> Labeller:
    """Adam over groups of pages whose blocks are marked."""
    model, r = Labeller(), np.random.default_rng(1)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for _ in range(EPOCHS):
        # Pages of like length make a group, so that little is padded; groups come in any order.
        order = np.array(sorted(r.permutation(len(pages)), key=lambda k: len(pages[k])))
        starts = np.arange(0, len(order), GROUP)
        for a in r.permutation(starts):
            group = [pages[k] for k in order[a : a + GROUP]]
            y = np.array([float(b.marked) for p in group for b in p])
            step += 1
            for k, g in model.gradients(Inputs(group), y).items():
                m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g**2
                model.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


#: Names of elements and of classes, and words, that page makers commonly use.
_MAIN = ["article", "main", 'div class="content"', 'div class="post-content"', 'div class="entry-content"', 'div id="content"', 'div class="article-body"', 'section class="story"', 'div class="text"', 'main class="page"']
_TOP = ["header", 'div class="header"', 'div id="header"', 'div class="masthead"', 'header class="site-header"']
_MENU = ["nav", 'div class="menu"', 'ul class="nav"', 'div id="navigation"', 'div class="breadcrumb"', 'nav class="navbar"']
_SIDE = ["aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="related"', 'aside class="widget"', 'section class="recommended"']
_NOTICE = ['div class="cookie-notice"', 'div class="notice"', 'div id="cookie-banner"', 'div class="alert"', 'div class="newsletter"', 'div class="popup"', 'div class="consent"', 'div role="alert"']
_ADVERT = ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="sponsored"', 'div id="ad-top"', 'aside class="promo"', 'div class="banner"', 'div class="advertisement"']
_TALK = ['div class="comments"', 'section id="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'div class="comment"', 'section class="discussion"', 'div class="reader-comments"']
_FORM = ["form", 'form class="search"', 'form class="comment-form"', 'form id="subscribe"', 'div class="login"']
_BOTTOM = ["footer", 'div class="footer"', 'div id="footer"', 'footer class="site-footer"', 'div class="copyright"']
_SHORT = ["Home", "About", "Contact", "Search", "Subscribe", "Share", "Login", "Next", "Previous", "Menu", "Reply", "Read more", "Privacy policy", "Accept"]


def _laid_out(main: list[str], other: list[str], r: random.Random) -> str:
    """A page with the given main texts, and with parts of other kinds, in a common make-up."""

    def part(kinds: list[str], texts: list[str], inner: list[str], linked: float = 0.1) -> str:
        kind, leaf = r.choice(kinds), r.choice(inner)
        tag = kind.split()[0]
        shown = [f'<a href="#">{escape(t)}</a>' if r.random() < linked else escape(t) for t in texts]
        items = "".join(f"<{leaf}>{t}</{leaf}>" if leaf else t for t in shown)
        return f'<{kind} data-main="0">{items}</{tag}>'

    some = lambda a, b: [r.choice(other) for _ in range(r.randint(a, b))]
    short = lambda a, b: [r.choice(_SHORT) if r.random() < 0.5 else " ".join(r.choice(other).split()[:2]) or "Home" for _ in range(r.randint(a, b))]
    long = lambda a, b: [r.choice(main) if r.random() < 0.5 else r.choice(other) for _ in range(r.randint(a, b))]
    maybe = lambda chance, make: make() if r.random() < chance else ""
    kind = r.choice(_MAIN)
    body, at = [], r.sample(range(len(main)), min(len(main), r.randint(0, 2)))
    for k, text in enumerate(main):
        tag = "h1" if k == 0 and r.random() < 0.7 else r.choice(["h2", "h3", "li", "blockquote"]) if r.random() < 0.12 else "p"
        line = f"<{tag}>{escape(text)}" + ("" if tag == "p" and r.random() < 0.2 else f"</{tag}>")
        body.append(f"<ul>{line}</ul>" if tag == "li" else line)
        if k in at:
            body.append(r.choice([lambda: part(_ADVERT, some(1, 2), ["", "p", "span"]), lambda: part(_NOTICE, long(1, 1), ["", "p"]), lambda: part(_SIDE, long(1, 2), ["p", "div"]), lambda: part(_FORM, short(1, 3), ["label", "p", "div"])])())
    content = f'<{kind} data-main="1">{"".join(body)}{maybe(0.2, lambda: part(_TALK, long(1, 4), ["p", "li", "div"]))}</{kind.split()[0]}>'
    parts = [
        maybe(0.5, lambda: part(_NOTICE, long(1, 2), ["", "p", "span"])),
        maybe(0.7, lambda: part(_TOP, short(1, 3) if r.random() < 0.6 else some(1, 1), ["h1", "h1", "p", "div", "span"])),
        maybe(0.8, lambda: part(_MENU, short(3, 9), ["li", "span", "div"], 0.7)),
        maybe(0.6, lambda: part(_ADVERT, some(1, 2), ["", "p"])),
        maybe(0.3, lambda: part(_SIDE, long(1, 5), ["p", "li", "div"])),
        content,
        maybe(0.5, lambda: part(_TALK, long(1, 6), ["p", "li", "div"])),
        maybe(0.4, lambda: part(_FORM, short(1, 4), ["label", "p", "div"])),
        maybe(0.5, lambda: part(_SIDE, long(1, 5), ["p", "li", "div"])),
        maybe(0.8, lambda: part(_BOTTOM, some(1, 2), ["", "p", "div"])),
    ]
    wrap = maybe(0.5, lambda: f'<div class="{r.choice(["container", "wrapper", "page", "layout"])}">')
    if r.random() < 0.3:
        parts[5] = f"<{r.choice(['main', 'article', 'div', 'section'])}>{content}"
    return f"<html><body>{wrap}{''.join(parts)}{'</div>' if wrap else ''}</body></html>"


def _marked(page: str) -> list[Block]:
    """Blocks of a page labelled by the elements above them; none if nothing tells."""
    slot = lambda name: crc32(name.encode()) % TAG_SLOTS
    inside, outside = {slot("article"), slot("main")}, {slot(x) for x in ("nav", "aside", "header", "footer", "form")}
    found = [b._replace(marked=bool(inside & set(b.path)) and not outside & set(b.path)) for b in blocks(page)]
    return found if any(b.marked for b in found) else []


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS) -> Labeller | None:
    """Train on about ``sample_pages`` whole pages of at most ``sample_chars`` characters, drawn by a hash of
    id and markup, and on new layouts of their texts; None if none of them has any text."""
    fit_for = pages.where(F.length(html_col) <= sample_chars).select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    share = F.pmod(F.xxhash64("id", "html"), F.lit(_SHARES)) < -(-sample_pages * _SHARES // max(1, fit_for.count()))
    r, learned = random.Random(0), []
    for page in sorted(row["html"] for row in fit_for.where(share).collect()):
        told = _marked(page)
        found = told or blocks(page)
        main = [b.text for b in found if (b.marked if told else len(b.text) >= PROSE)]
        other = [b.text for b in found if not (b.marked if told else len(b.text) >= PROSE)] or _SHORT
        learned += [told] if told else []
        for _ in range(LAYOUTS if main else 0):
            at = r.randrange(len(main))
            learned.append([b for b in blocks(_laid_out(main[at : at + r.randint(1, 30)], other, r)) if b.marked is not None])
    return fit(learned) if learned else None


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    """The main text of each page, its blocks joined by line ends."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if found[k]), key=lambda k: len(found[k]))
    while order:
        n = 1
        while n < len(order) and (n + 1) * len(found[order[n]]) <= LABEL_BLOCKS:
            n += 1
        group, order = order[:n], order[n:]
        keep = iter((model.chances(Inputs([found[k] for k in group])) > 0.5).tolist())
        for k in group:
            out[k] = "\n".join([b.text for b in found[k] if next(keep)])
    return out


def _extracted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(shared.value, [x or "" for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, model: Labeller | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``; null pages, and all without a model, have empty text.

    Broken markup never fails (see ``html_blocks``), and pages may be of any length.
    """
    small_batches(pages.sparkSession)
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    if model is None:
        out = base.select("page_id", "url", F.lit("").alias("text"))
    else:
        kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
        out = base.mapInArrow(_extracted(pages.sparkSession.sparkContext.broadcast(model)), f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
