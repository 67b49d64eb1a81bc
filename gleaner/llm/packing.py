"""Cost-balanced packing of documents into training sequences.

The cost of a piece of n tokens is estimated as ``linear * n + quadratic * n * n`` (attention stays within a
piece). Documents are cut into whole sequences and a rest; rests are taken in descending order, each to the
sequence of lowest cost that still has room for it. Where none has room the rest is cut: it fills the lowest
sequence and goes on with what is left, so every sequence of a group is full but the last.

Packing runs where the documents are: a task packs groups of ``group_tokens`` tokens, so nothing is
shuffled, memory is bounded by a group and the longest text, and a lost task packs the same rows again.
At most one sequence per group is padded. A sequence is named by its partition and its number there, which
needs input with stable partitions, such as a file scan.

Defined cases: a null or empty text is a document of the end token alone; rows are packed as they come,
repeated rows and null ids included; extra columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.tokens import Encoder
from gleaner.llm.words import text_slices

SEQUENCE = 2048
END_ID = 1
GROUP_TOKENS = 2 << 20
LINEAR = 1.0
QUADRATIC = 1.0 / 1024
#: sequences of one partition are numbered below this
PER_PARTITION = 1 << 36

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def piece_cost(n, linear: float = LINEAR, quadratic: float = QUADRATIC):
    return linear * n + quadratic * n * n


def assign(lengths: np.ndarray, size: int = SEQUENCE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Place documents of these lengths: ``(document, start, length, sequence, offset)`` of every piece."""
    placed: list[tuple[int, int, int, int, int]] = []
    whole = 0
    rests = []
    for d, n in enumerate(lengths):
        for k in range(n // size):
            placed.append((d, k * size, size, whole, 0))
            whole += 1
        if n % size:
            rests.append((n % size, d, n - n % size))
    count = -(-sum(r[0] for r in rests) // size)
    room = np.full(count, size, dtype=np.int64)
    cost = np.zeros(count)
    for n, d, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        while n:
            fits = room >= n
            at = int(np.argmin(np.where(fits if fits.any() else room > 0, cost, np.inf)))
            take = min(n, int(room[at]))
            placed.append((d, start, take, whole + at, size - int(room[at])))
            room[at] -= take
            cost[at] += piece_cost(take, linear, quadratic)
            n, start = n - take, start + take
    return placed


def _packer(path: str | None, size: int, end_id: int, group: int, linear: float, quadratic: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        next_id = TaskContext.get().partitionId() * PER_PARTITION
        names: list[int | None] = []
        ids: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            if not ids:
                return
            placed = assign(np.array([len(x) for x in ids]), size, linear, quadratic)
            rows = [
                (names[d], s, n, zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()), len(ids[d]), next_id + q, o, float(piece_cost(n, linear, quadratic)))
                for d, s, n, q, o in placed
            ]
            next_id += 1 + max(p[3] for p in placed)
            names.clear()
            ids.clear()
            kinds = [pa.int64()] * 7 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"],
            )

        tokens = 0
        for batch in text_slices(batches):
            for name, text in zip(batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "").to_pylist()):
                names.append(name)
                ids.append(np.append(encoder.ids(text), np.uint32(end_id)))
                tokens += len(ids[-1])
                if tokens >= group:
                    yield from flush()
                    tokens = 0
        yield from flush()

    return run


def pack(
    docs: DataFrame, vocabulary: str | None = None, size: int = SEQUENCE, end_id: int = END_ID,
    group_tokens: int = GROUP_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _packer(vocabulary, size, end_id, group_tokens, linear, quadratic), _PIECES
    )
