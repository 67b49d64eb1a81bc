"""Benchmark decontamination with suffix arrays over the training text.

The documents are the training shards: each slice of texts becomes a suffix array of its words (a sorted
list of the positions at which a test window could start, ordered by the words that follow). Every suffix of
every test item is searched in it by bisection; the range found holds all places of its window, and every
match is then followed to its full length. Only positions whose first words occur in the benchmark are put
into the array, since no other suffix can match a window.

The benchmark goes to the tasks in blocks of bounded size: one pass of the same stage for each block, so
its size is never an assumption. Documents are not shuffled.

Defined cases: a null or empty text has no words; an item without words is ignored; an item shorter than
the window is one window; matches never cross texts; repeated rows get the same result each; extra columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.words import ALNUM, find_words, mix, text_slices

WINDOW = 10
BLOCK_BYTES = 8 << 20
ANCHOR = 3
_BITS = 20

_SPANS = "array<struct<s:long,e:long>>"


class TestItems:
    """The suffixes of a block of test items, as rows of word hashes."""

    __test__ = False

    def __init__(self, ids: list, texts: list[str], window: int):
        words = find_words(pa.array(texts, pa.large_string()), ALNUM)
        count = words.count
        self.ids = [str(i) for i in ids]
        self.window = window
        self.words, self.item = words.hash, words.doc
        self.last = words.first[1:]
        rest = self.last[self.item] - np.arange(len(words.hash))
        need = np.minimum(count, window)[self.item]
        self.at = np.flatnonzero(rest >= need)  # where windows begin
        self.need = need[self.at]
        self.anchor = int(min(ANCHOR, self.need.min())) if len(self.at) else ANCHOR
        self.low = _keys(self.words, self.at, self.need, window, 0)
        self.high = _keys(self.words, self.at, self.need, window, 2**64 - 1)
        self.table = np.zeros(1 << _BITS, dtype=bool)
        if len(self.at):
            self.table[_anchors(self.words, self.anchor)[self.at] >> np.uint64(64 - _BITS)] = True


def _anchors(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` words from each position on."""
    out = np.zeros(len(words), dtype=np.uint64)
    for j in range(k):
        out[: max(0, len(words) - j)] += words[j:] * np.uint64(2 * j + 1)
    return mix(out)


def _keys(words: np.ndarray, at: np.ndarray, need: np.ndarray, window: int, fill: int) -> np.ndarray:
    """The words from each position on, one row each; beyond ``need`` words filled up."""
    rows = np.full((len(at), window), fill, dtype=np.uint64)
    for j in range(window):
        inside = need > j
        rows[inside, j] = words[at[inside] + j]
    return rows


def _search(columns: np.ndarray, key: np.ndarray, right: bool) -> np.ndarray:
    """Bisection of all keys at once in rows sorted by their words."""
    low, high = np.zeros(len(key), np.int64), np.full(len(key), len(columns), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) >> 1
        a, b = columns[mid], key[open_]
        differ = a != b
        first = differ.argmax(axis=1)
        rows = np.arange(len(open_))
        less = (a[rows, first] < b[rows, first]) | ((~differ.any(axis=1)) & right)
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]


def find_matches(words: np.ndarray, first: np.ndarray, tests: TestItems) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All maximal matches of test windows in texts with these words: place, length and test position."""
    n = len(words)
    doc_end = np.repeat(first[1:], np.diff(first))
    left = doc_end - np.arange(n)
    none = np.zeros(0, np.int64)
    if not n or not len(tests.at):
        return none, none, none
    chosen = tests.table[_anchors(words, tests.anchor) >> np.uint64(64 - _BITS)] & (left >= tests.anchor)
    at = np.flatnonzero(chosen)
    columns = _keys(words, at, left[at], tests.window, 0)
    order = np.lexsort(columns.T[::-1])
    suffixes, columns = at[order], columns[order]
    low, high = _search(columns, tests.low, False), _search(columns, tests.high, True)
    size = high - low
    test = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(test)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
    place, position = suffixes[inside], tests.at[test]
    length = tests.need[test].astype(np.int64)
    growing = np.arange(len(place))
    item_end = tests.last[tests.item[position]]
    while len(growing):
        p, t = place[growing] + length[growing], position[growing] + length[growing]
        ok = (p < doc_end[place[growing]]) & (t < item_end[growing])
        ok[ok] = words[p[ok]] == tests.words[t[ok]]
        growing = growing[ok]
        length[growing] += 1
    return place, length, position


def _pass(block, window: int):
    """mapInArrow: add this block's matches to the spans and items that each document has so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = TestItems(*block.value, window)
        for batch in text_slices(batches):
            words = find_words(batch.column("text"), ALNUM)
            place, length, position = find_matches(words.hash, words.first, tests)
            spans, items = batch.column("_spans").to_pylist(), batch.column("_items").to_pylist()
            longest = np.array(batch.column("longest_match").to_pylist(), dtype=np.int64)
            where = np.array(batch.column("match_start").to_pylist(), dtype=np.int64)
            of = batch.column("match_item").to_pylist()
            doc = np.searchsorted(words.first, place, "right") - 1
            order = np.lexsort((place, doc))
            edges = np.searchsorted(doc[order], np.arange(batch.num_rows + 1))
            for d in np.unique(doc):
                own = order[edges[d] : edges[d + 1]]
                s, e = place[own] - words.first[d], place[own] - words.first[d] + length[own]
                reach = np.maximum.accumulate(e)
                new = np.concatenate(([True], s[1:] > reach[:-1]))
                spans[d] = spans[d] + [{"s": int(a), "e": int(b)} for a, b in zip(s[new], np.concatenate((reach[:-1][new[1:]], reach[-1:])))]
                items[d] = items[d] + sorted({tests.ids[i] for i in tests.item[position[own]]})
                best = own[int(np.argmax(length[own]))]
                if length[best] > longest[d]:
                    longest[d], where[d] = length[best], place[best] - words.first[d]
                    of[d] = tests.ids[tests.item[position[best]]]
            out = {
                "doc_id": batch.column("doc_id"), "text": batch.column("text"), "n_words": pa.array(words.count.astype(np.int64)),
                "_spans": pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                "_items": pa.array(items, pa.list_(pa.string())), "longest_match": pa.array(longest),
                "match_start": pa.array(where), "match_item": pa.array(of, pa.string()),
            }
            yield pa.RecordBatch.from_pydict({k: out[k] if k in out else batch.column(k) for k in batch.schema.names})

    return run


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list:
    """The items in broadcast blocks of about ``block_bytes`` of text, read block by block."""
    sc = benchmark.sparkSession.sparkContext
    blocks, ids, texts, size = [], [], [], 0
    for row in benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        if ids and size + len(row["text"]) > block_bytes:
            blocks.append(sc.broadcast((ids, texts)))
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"])
    return [*blocks, sc.broadcast((ids, texts))]


def _covered(spans: list) -> int:
    total, reach = 0, 0
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        total += max(0, e - max(s, reach))
        reach = max(reach, e)
    return total


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit, count, digest = [], [], []
        for spans, items in zip(batch.column("_spans").to_pylist(), batch.column("_items").to_pylist()):
            names = sorted(set(items))
            hit.append(_covered(spans))
            count.append(len(names))
            digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        extra = {"n_hit": pa.array(hit, pa.int64()), "n_items": pa.array(count, pa.int64()), "items_sha256": pa.array(digest, pa.string())}
        kept = [n for n in batch.schema.names if n not in ("_spans", "_items")]
        yield pa.RecordBatch.from_pydict({**{n: batch.column(n) for n in kept}, **extra})


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` with what its texts share with the benchmark.

    Adds ``n_words, longest_match, match_start, match_item, n_hit, n_items, items_sha256, contaminated``;
    ``docs`` has none of these names. The longest match counts words, its start is a word of the text.
    """
    found = docs.withColumns({
        "n_words": F.lit(0).cast("long"), "_spans": F.array().cast(_SPANS), "_items": F.array().cast("array<string>"),
        "longest_match": F.lit(0).cast("long"), "match_start": F.lit(-1).cast("long"), "match_item": F.lit(None).cast("string"),
    })
    for block in benchmark_blocks(benchmark, block_bytes):
        found = found.mapInArrow(_pass(block, window), found.schema)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name not in ("_spans", "_items"))
    found = found.mapInArrow(_summary, f"{schema}, n_hit long, n_items long, items_sha256 string")
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: words, hit words, matching items and the longest verbatim match."""
    return matched(docs.select("doc_id", "text"), benchmark, window, block_bytes).drop("text")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, with their columns."""
    names = {c: c if c in ("doc_id", "text") else f"_own_{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    clean = matched(named, benchmark, window, block_bytes).filter(~F.col("contaminated"))
    return clean.select(*[F.col(n).alias(c) for c, n in names.items()])
