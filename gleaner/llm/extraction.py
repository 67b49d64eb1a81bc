"""Main text of web pages by a recurrent labeller of their blocks.

A page is read into its leaf blocks (runs of text between block-level tags) with the path of open tags. Each
block is a vector of hashed path tokens (tags, classes, ids, roles), hashed words and a few measures; a
bidirectional LSTM in numpy reads the sequence of a whole page and says for every block whether it belongs
to the article. Its text is the blocks so chosen, in page order.

The network is trained here, on the blocks of a bounded sample of pages (``SAMPLE_PAGES`` pages of at most
``SAMPLE_CHARS`` characters, by the least hash of their id). Pages that mark their article by a tag are the
teachers; copies of them with other tags and class names and with added notices, sidebars, forms and reader
comments teach the rest. Every page is read and labelled whole.

Defined cases: null or empty html gives an empty text; markup that is never closed runs to the end of the
page; end tags without start are ignored; repeated rows and null ids are labelled like others; extra columns
are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.quality import least_hashed
from gleaner.llm.words import SPACED, find_words, text_slices

SAMPLE_PAGES = 150
SAMPLE_CHARS = 200_000
HIDDEN = 12
PATH_DIM = 256
WORD_DIM = 16
STEPS = 400
BATCH = 24
WINDOW = 48
RATE = 0.02
SEED = 11
#: blocks whose vectors are held at a time
CHUNK = 20_000

_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr object math semantics mi mn mo ms mtext mspace mrow msub msup msubsup mfrac msqrt mroot munder mover munderover".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: what holds no text of the page, whatever stands in it
_RAW = set("script style template iframe noembed noframes title".split())
#: of these, what runs to the end of the page if it is not closed, as in a browser; others end nothing
_OPEN_ENDED = {"script", "style"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>])*+)(?:>|\Z)|(?P<text>[^<]++|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PLAIN_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    """Text with what its vector and the teachers take from the whole path of open tags."""

    slots: bytes  # hashed tokens of the path, each once
    depth: int  # tokens of the path
    text: str
    linked: int = 0
    taught: bool | None = None  # in an article and in none of its surroundings; None outside of articles
    kept: tuple[str, ...] = ()  # tokens of the path that variants keep, each once
    repeated: int = 0  # and how many more there are


@dataclass
class _Open:
    tag: str
    tokens: tuple[str, ...]
    around: int = 0  # tokens of surroundings that count within the outermost article


@lru_cache(maxsize=1 << 16)
def _slot(token: str) -> int:
    return zlib.crc32(token.encode()) % PATH_DIM


def _block(path: tuple[str, ...], text: str, linked: int = 0, repeated: int = 0) -> Block:
    return Block(bytes({_slot(t) for t in path}), len(path) + repeated, text, linked)


class _Path:
    """The open tags, and running counts over their tokens: a block costs the same at any depth."""

    def __init__(self) -> None:
        self.stack: list[_Open] = []
        self.outer: list[int] = []  # places in the stack of tags that are not inline
        self.held: dict[str, int] = {}
        self.slots: dict[int, int] = {}
        self.kept: dict[str, int] = {}
        self.depth = self.around = 0
        self.article: int | None = None  # place of the outermost article

    def push(self, tag: str, tokens: tuple[str, ...]) -> None:
        inner = tokens
        if self.article is None:
            first = next((i for i, t in enumerate(tokens) if t in ARTICLE), None)
            inner = () if first is None else tokens[first:]
            self.article = None if first is None else len(self.stack)
        around = sum(t in _AROUND_TOKENS for t in inner)
        if tag not in _INLINE:
            self.outer.append(len(self.stack))
        self.stack.append(_Open(tag, tokens, around))
        self.held[tag] = self.held.get(tag, 0) + 1
        self.depth += len(tokens)
        self.around += around
        for token in tokens:
            self.slots[_slot(token)] = self.slots.get(_slot(token), 0) + 1
            if token in _KEPT:
                self.kept[token] = self.kept.get(token, 0) + 1

    def pop(self) -> None:
        top = self.stack.pop()
        self.held[top.tag] -= 1
        if top.tag not in _INLINE:
            self.outer.pop()
        self.depth -= len(top.tokens)
        self.around -= top.around
        if self.article == len(self.stack):
            self.article = None
        for token in top.tokens:
            for counts, key in ((self.slots, _slot(token)), (self.kept, token)):
                if key in counts:
                    counts[key] -= 1
                    if not counts[key]:
                        del counts[key]

    def block(self) -> Block:
        taught = None if self.article is None else not self.around
        return Block(bytes(self.slots), self.depth, "", 0, taught, tuple(self.kept), sum(self.kept.values()) - len(self.kept))


def page_blocks(html: str) -> list[Block]:
    """The leaf blocks of a page with text, in order."""
    blocks: list[Block] = []
    path = _Path()
    stack, outer, held, pop = path.stack, path.outer, path.held, path.pop
    parts: list[str] = []
    begun: list[Block] = []  # the block of the open parts
    linked = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                block = begun.pop()
                block.text, block.linked = text, linked
                blocks.append(block)
            parts.clear()
            begun.clear()

    at = 0
    while at < len(html):
        match = _TOKEN.match(html, at)
        at = match.end()
        if match["text"]:
            if not parts:
                if match["text"].isspace():
                    continue
                begun.append(path.block())
                linked = 0
            piece = unescape(match["text"])
            parts.append(piece)
            if held.get("a"):
                linked += len(piece)
            continue
        if not match["tag"]:
            continue
        tag = match["tag"].lower()
        if tag not in _INLINE and tag != "br":
            flush()
        if tag == "br":
            if parts:
                parts.append(" ")
        elif match["end"]:
            if held.get(tag):
                while stack[-1].tag != tag:
                    pop()
                pop()
        elif tag in _RAW:
            if not match["rest"].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?![\w-])[^>]*+(?:>|\Z)", re.I).search(html, at)
                at = close.end() if close else len(html) if tag in _OPEN_ENDED else at
        elif tag not in _VOID:
            closes = _CLOSES.get(tag) or ({"p"} if tag not in _INLINE else ())
            if outer and tag not in _INLINE and stack[outer[-1]].tag in closes:
                below = outer[-1]
                while len(stack) > below:
                    pop()
            tokens = [tag]
            for name, *values in _ATTRIBUTE.findall(match["rest"]):
                tokens += [f"{name.lower()}:{w}" for w in _PLAIN_WORD.findall(" ".join(values).lower())]
            path.push(tag, tuple(tokens))
    flush()
    return blocks


def block_vectors(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), PATH_DIM + WORD_DIM + 6), dtype=np.float32)
    if not blocks:
        return out
    for i, block in enumerate(blocks):
        out[i, np.frombuffer(block.slots, np.uint8)] = 1
        n = len(block.text)
        out[i, -6:] = (np.log1p(n) / 8, block.linked / max(n, 1), block.text[-1] in ".!?:;\"'", block.text[0].isupper(), np.log1p(block.depth) / 2.5, 1)
    words = find_words(pa.array([b.text for b in blocks], pa.large_string()), SPACED)
    slot = words.doc * WORD_DIM + (words.hash % np.uint64(WORD_DIM)).astype(np.int64)
    counts = np.bincount(slot, minlength=len(blocks) * WORD_DIM).reshape(len(blocks), WORD_DIM)
    out[:, PATH_DIM : PATH_DIM + WORD_DIM] = counts / np.maximum(1, words.count)[:, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output for every step."""

    def __init__(self, inputs: int = PATH_DIM + WORD_DIM + 6, hidden: int = HIDDEN, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.hidden, self.seed = hidden, seed
        self.w = {}
        for side in "fb":
            self.w[f"x{side}"] = draw.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * hidden))
            self.w[f"h{side}"] = draw.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            self.w[f"o{side}"] = draw.normal(0, 1 / np.sqrt(hidden), hidden)
        self.w["bias"] = np.zeros(1)

    def _run(self, side: str, drive: np.ndarray, mask: np.ndarray, keep: bool = False):
        """States of one direction over ``drive (time, page, 4 * hidden)``; padding keeps the state."""
        h = self.hidden
        state, cell = np.zeros((drive.shape[1], h)), np.zeros((drive.shape[1], h))
        out, trace = np.zeros((*drive.shape[:2], h)), []
        steps = range(len(drive)) if side == "f" else range(len(drive) - 1, -1, -1)
        for t in steps:
            z = drive[t] + state @ self.w[f"h{side}"]
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            new = f * cell + i * g
            squashed = np.tanh(new)
            m = mask[t][:, None]
            if keep:
                trace.append((t, state, cell, i, f, o, g, squashed))
            cell = np.where(m, new, cell)
            state = np.where(m, o * squashed, state)
            out[t] = state
        return out, trace

    def drives(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {side: (x @ self.w[f"x{side}"]) for side in "fb"}

    def scores(self, drive: dict[str, np.ndarray], mask: np.ndarray) -> np.ndarray:
        return sum(self._run(s, drive[s], mask)[0] @ self.w[f"o{s}"] for s in "fb") + self.w["bias"][0]

    def label(self, lengths: list[int], x_chunks: Iterator[np.ndarray]) -> np.ndarray:
        """Probabilities for all blocks of pages of these lengths, given in order."""
        parts = [self.drives(x) for x in x_chunks]
        if not parts:
            return np.zeros(0)
        drive = {s: np.concatenate([p[s] for p in parts]) for s in "fb"}
        first = np.concatenate(([0], np.cumsum(lengths)))
        out = np.zeros(first[-1])
        order = [p for p in np.argsort(lengths, kind="stable") if lengths[p]]
        while order:
            group = [order.pop()]
            longest = lengths[group[0]]
            while order and lengths[order[-1]] * 2 >= longest and longest * (len(group) + 1) <= CHUNK:
                group.append(order.pop())
            mask = np.arange(longest)[:, None] < np.array([lengths[p] for p in group])[None, :]
            padded = {}
            for s in "fb":
                padded[s] = np.zeros((longest, len(group), 4 * self.hidden))
                for k, p in enumerate(group):
                    padded[s][: lengths[p], k] = drive[s][first[p] : first[p + 1]]
            scores = _sigmoid(self.scores(padded, mask))
            for k, p in enumerate(group):
                out[first[p] : first[p + 1]] = scores[: lengths[p], k]
        return out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS) -> Labeller:
        """Adam on the log loss of whole sequences, or of windows of long ones."""
        draw = np.random.default_rng(self.seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        for n in range(1, steps + 1):
            chosen = [pages[i] for i in draw.integers(0, len(pages), BATCH)]
            cuts = []
            for x, y in chosen:
                s = int(draw.integers(0, len(y) - WINDOW + 1)) if len(y) > WINDOW and draw.random() < 0.6 else 0
                if len(y) > WINDOW and not s and draw.random() < 0.5:
                    s = len(y) - WINDOW
                cuts.append((x[s : s + WINDOW], y[s : s + WINDOW]))
            longest = max(len(y) for _, y in cuts)
            x, y = np.zeros((longest, BATCH, cuts[0][0].shape[1])), np.zeros((longest, BATCH))
            mask = np.zeros((longest, BATCH), dtype=bool)
            for k, (a, b) in enumerate(cuts):
                x[: len(b), k], y[: len(b), k], mask[: len(b), k] = a, b, True
            drop = draw.random((1, BATCH, x.shape[2])) > 0.05  # no single token may decide
            grads = self._slopes(x * drop, y, mask)
            for k, d in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                rate = RATE * (1 - 0.8 * n / steps)
                self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)
        return self

    def _slopes(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        h, drive = self.hidden, self.drives(x)
        runs = {s: self._run(s, drive[s], mask, keep=True) for s in "fb"}
        score = sum(runs[s][0] @ self.w[f"o{s}"] for s in "fb") + self.w["bias"][0]
        dscore = np.where(mask, _sigmoid(score) - y, 0) / mask.sum()
        grads = {"bias": np.array([dscore.sum()])}
        for s in "fb":
            out, trace = runs[s]
            grads[f"o{s}"] = np.einsum("tb,tbh->h", dscore, out)
            grads[f"h{s}"] = np.zeros_like(self.w[f"h{s}"])
            dz_all = np.zeros_like(drive[s])
            dstate, dcell = np.zeros((x.shape[1], h)), np.zeros((x.shape[1], h))
            for t, before, cell, i, f, o, g, squashed in reversed(trace):
                live = mask[t][:, None]
                d = dstate + dscore[t][:, None] * self.w[f"o{s}"]
                dc = dcell + d * o * (1 - squashed**2)
                dz = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), d * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1) * live
                dz_all[t] = dz
                grads[f"h{s}"] += before.T @ dz
                dstate = np.where(live, dz @ self.w[f"h{s}"].T, dstate)
                dcell = np.where(live, dc * f, dcell)
            grads[f"x{s}"] = np.einsum("tbi,tbk->ik", x, dz_all)
        return grads


#: what teachers call the article and its surroundings
ARTICLE = ["article", "main", "role:main"]
ARTICLE_NAMES = [["article"], ["main"], ["div", "class:content"], ["div", "class:post"], ["section", "class:entry"], ["div", "id:content"], ["div", "class:article", "class:body"], ["div", "role:main"], ["main", "article"]]
AROUND = {
    "menu": [["nav"], ["nav", "class:menu"], ["div", "class:menu"], ["ul", "class:navigation"], ["div", "id:nav"], ["div", "class:breadcrumb"]],
    "header": [["header"], ["div", "class:header"], ["div", "id:header"], ["div", "class:masthead"]],
    "footer": [["footer"], ["div", "class:footer"], ["div", "id:footer"], ["footer", "class:site"]],
    "advert": [["div", "class:ad"], ["div", "class:ads"], ["div", "class:advert"], ["aside", "class:sponsored"], ["div", "class:banner"], ["div", "class:promo"]],
    "sidebar": [["aside"], ["div", "class:sidebar"], ["aside", "class:sidebar"], ["div", "class:related"], ["div", "class:widget"]],
    "notice": [["div", "class:cookie"], ["div", "class:notice"], ["div", "class:cookie", "class:notice"], ["div", "id:cookie", "class:banner"], ["div", "class:popup"], ["div", "role:alert"], ["dialog"]],
    "form": [["form"], ["form", "class:search"], ["form", "class:newsletter"], ["form", "id:login"]],
    "comments": [["section", "class:comments"], ["div", "class:comments"], ["div", "id:comments"], ["div", "class:comment"], ["section", "id:comments"], ["ol", "class:comment", "class:list"], ["div", "class:discussion"]],
}
#: tags of an article that its variants keep
_KEPT = {"p", "h1", "h2", "h3", "ul", "li", "b", "blockquote"}
_AROUND_TOKENS = {t for options in AROUND.values() for o in options for t in o} - {"div", "ul", "section", "ol"}


def _taught(blocks: list[Block]) -> list[bool] | None:
    """Labels of a page that marks its article by a tag, else None."""
    if all(b.taught is None for b in blocks):
        return None
    return [bool(b.taught) for b in blocks]


def _varied(blocks: list[Block], labels: list[bool], spare: list[str], draw: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """A copy of a page with other names and with added surroundings, inside the article and around it."""
    pick = lambda options: options[int(draw.integers(0, len(options)))]
    name = tuple(pick(ARTICLE_NAMES))
    around = {k: tuple(pick(v)) for k, v in AROUND.items()}

    def made(kind: str, base: tuple[str, ...]) -> list[tuple[Block, bool]]:
        inner = pick([("p",), ("p",), (), ("div",), ("li",)])
        out = []
        for _ in range(int(draw.integers(1, 6))):
            text = pick(spare)
            if kind in ("menu", "form", "notice") or draw.random() < 0.3:
                text = " ".join(text.split()[: int(draw.integers(1, 8))])
            linked = len(text) if kind == "menu" or draw.random() < 0.15 else 0
            out.append((_block((*base, *around[kind], *inner), text, linked), False))
        return out

    body = ("html", "body")
    heading = pick(["h1", "h1", "h2", "h3"])
    article = [(_block((*body, *name, *(heading if t == "h1" else t for t in b.kept)), b.text, b.linked, b.repeated), True) for b, y in zip(blocks, labels) if y]
    if draw.random() < 0.3:  # further kinds of blocks in the article
        k = int(draw.integers(0, len(article)))
        extra = pick([("ul", "li"), ("h2",), ("blockquote", "p"), ("table", "tr", "td"), ("pre",), ("figure", "figcaption")])
        article[k:k] = [(_block((*body, *name, *extra), pick(spare), 0), True) for _ in range(int(draw.integers(1, 5)))]
    for kind in ("comments", "form", "advert", "sidebar", "notice"):
        if draw.random() < (0.5 if kind == "comments" else 0.35):
            k = len(article) if kind in ("comments", "form") else int(draw.integers(0, len(article) + 1))
            article[k:k] = made(kind, (*body, *name) if draw.random() < 0.6 else body)
    pages: list[tuple[Block, bool]] = []
    for kind in ("notice", "header", "menu", "advert", "form", "sidebar"):
        if draw.random() < 0.5:
            pages += made(kind, body)
    pages += article
    for kind in ("comments", "sidebar", "form", "advert", "footer", "notice"):
        if draw.random() < 0.5:
            pages += made(kind, body)
    return [b for b, _ in pages], [y for _, y in pages]


def train(pages: list[str], variants: int = 4) -> Labeller:
    """A labeller taught by these pages; without a page that marks its article, by invented ones alone."""
    draw = np.random.default_rng(SEED)
    syllables = ["ba", "do", "ke", "li", "mu", "ra", "so", "ti", "ve", "no"]
    word = lambda: "".join(syllables[i] for i in draw.integers(0, 10, int(draw.integers(1, 5))))
    invented = [" ".join(word() for _ in range(int(draw.integers(2, 60)))).capitalize() + "." for _ in range(200)]
    taught = []
    for html in pages:
        blocks = page_blocks(html)
        labels = _taught(blocks)
        if labels is not None and any(labels):
            taught.append((blocks, labels))
    spare = [b.text for blocks, _ in taught for b in blocks] + invented
    for _ in range(30):
        n = int(draw.integers(1, 12))
        taught.append(([_block(("html", "body", "article", "p"), invented[int(draw.integers(0, 200))]) for _ in range(n)], [True] * n))
    examples = [(block_vectors(b), np.array(y, dtype=float)) for b, y in taught]
    for blocks, labels in taught:
        for _ in range(variants):
            b, y = _varied(blocks, labels, spare, draw)
            examples.append((block_vectors(b), np.array(y, dtype=float)))
    return Labeller().fit(examples)


def _extract(model: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            pages = [page_blocks(html) if html else [] for html in batch.column("html").to_pylist()]
            flat = [b for p in pages for b in p]
            lengths = [len(p) for p in pages]
            chosen = model.label(lengths, (block_vectors(flat[i : i + CHUNK]) for i in range(0, len(flat), CHUNK))) >= 0.5
            texts, at = [], 0
            for page in pages:
                texts.append("\n".join(b.text for b, y in zip(page, chosen[at : at + len(page)]) if y))
                at += len(page)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run


def sample_pages(pages: DataFrame, size: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> list[str]:
    """The training sample: chosen by id, then fetched."""
    fit = pages.filter(F.length("html").between(1, chars))
    return [r["html"] for r in least_hashed(fit, size, pages.count(), "page_id", "url").select("html").collect()]


def main_text(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """``page_id, url, text, n_chars``: one row per row of ``pages (page_id, url, html)``."""
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    model = model or train(sample_pages(page))
    return page.mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long")
