"""Words of whole Arrow text columns as numpy arrays, found on the UTF-8 bytes.

Both word models of this package are classes of bytes: every byte of a multi-byte character is at least
0x80, and all separators are ASCII. A batch is cut into slices of bounded size, never a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
GIANT = 1 << 20

_BYTES = np.arange(256)
#: words between white space: `[^\x20\x09-\x0D]+`
SPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: words of letters and digits: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, GIANT + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), GIANT + 1)


@dataclass
class Words:
    """Words of some texts: ``first[d] .. first[d + 1]`` are those of text ``d``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, mixed with its length."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        base = start[i]
        j = int(np.searchsorted(end, base + GIANT, "right"))
        if j <= i:  # one word of more than a mebibyte
            out[i] = int.from_bytes(blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        span = data[base : end[j - 1]].astype(np.uint64)
        span += _U(1)
        span *= _POW[: len(span)]
        total = np.zeros(len(span) + 1, dtype=np.uint64)
        np.cumsum(span, out=total[1:])
        a, b = start[i:j] - base, end[i:j] - base
        out[i:j] = mix((total[b] - total[a]) * _INV[a] + (b - a).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        i = j
    return out


def find_words(texts: pa.Array, kind: np.ndarray) -> Words:
    """Lower-case A-Z and take the words of every text; null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    column = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    low = int(offsets[0])
    buffer = column.buffers()[2]
    data = _LOWER[np.frombuffer(buffer, dtype=np.uint8)[low : int(offsets[-1])]] if buffer else np.empty(0, np.uint8)
    offsets = offsets - low
    word = kind[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], word))
    after = np.concatenate((word, [False]))
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return Words(data, start, end, _hashes(data, start, end), np.searchsorted(start, offsets))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``size`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        total = np.concatenate(([0], np.cumsum(length)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
