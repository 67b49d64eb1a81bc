"""Text quality learnt from positive and unlabelled texts.

Every text is measured (shares of symbols, letters, capitals, repeated words and the like). Trusted good texts
are the positives, all other web text is unlabelled. A small network minimises the non-negative unbiased
risk ``prior * R+(good) + max(0, R-(unlabelled) - prior * R-(good))`` with the sigmoid loss; where the second
term goes below zero its gradient is turned around. The class prior is estimated first, from the least share
of unlabelled to positive texts above any score of a classifier that tells the two apart.

The network is fitted on bounded samples (``POSITIVES`` and ``UNLABELLED`` texts, those with the least hash
of their id); every text is measured and scored.

Defined cases: null and empty texts have all measures 0 and are scored like others; rows without label are
unlabelled; a doc_id labelled twice is positive if any label says so; null doc_ids are never in a sample's
labels but are scored; without positives every score is the prior guess; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.dedup import shingle_hashes
from gleaner.llm.words import SPACED, find_words, text_slices
from gleaner.session import materialize

POSITIVES = 6000
UNLABELLED = 12000
HIDDEN = 16
STEPS = 600
BATCH = 1024
RATE = 0.01
SEED = 7
THRESHOLD = 0.7
HELD_OUT = 2
FOLDS = 4

#: bytes counted in each text, as shares of its bytes in words
_CLASSES = {
    "symbols": b"#*$%&|<>=_~^@\\/+", "stops": b".?;:", "commas": b",", "bangs": b"!", "bars": b"|", "digits": b"0123456789",
    "capitals": bytes(range(65, 91)), "small": bytes(range(97, 123)), "wide": bytes(range(128, 256)),
}
FEATURES = [*_CLASSES, "length", "short_word", "long_word", "variety", "repeats", "lines", "short", "words"]


def measures(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for every text."""
    words = find_words(texts, SPACED)
    docs = len(words.first) - 1
    column = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + docs + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    count = words.count.astype(float)
    n = np.maximum(count, 1)
    size = words.end - words.start

    def summed(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (total[edges[1:]] - total[edges[:-1]]).astype(float)

    chars = summed(size, words.first)
    held = np.maximum(chars, 1)
    out = np.zeros((docs, len(FEATURES)))
    for k, members in enumerate(_CLASSES.values()):
        table = np.zeros(256, dtype=bool)
        table[list(members)] = True
        out[:, k] = summed(table[raw], offsets) / held
    k = len(_CLASSES)
    out[:, k] = chars / n / 8
    out[:, k + 1] = summed(size <= 2, words.first) / n
    out[:, k + 2] = summed(size >= 20, words.first) / n
    grams, first = shingle_hashes(words, 5)
    lines = column.to_pylist()
    for d in range(docs):
        own = words.hash[words.first[d] : words.first[d + 1]]
        if not len(own):
            continue
        out[d, k + 3] = len(np.unique(own)) / np.sqrt(len(own)) / 8
        part = grams[first[d] : first[d + 1]]
        out[d, k + 4] = 1 - len(np.unique(part)) / len(part)
        full = [x for x in lines[d].split("\n") if x.strip()]
        out[d, k + 5] = 1 - len(set(full)) / max(1, len(full))
    out[:, k + 6] = count < 20
    out[:, k + 7] = np.log1p(count) / 10
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        values = measures(batch.column("text")).astype(np.float32)
        offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], names=["doc_id", "measures"]
        )


class Network:
    """One hidden layer; ``score`` is the sigmoid of its output."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.weights = [draw.normal(0, 1 / np.sqrt(inputs), (inputs, hidden)), np.zeros(hidden), draw.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.seed = seed

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = self.weights
        inner = np.tanh(x @ a + b)
        return inner, inner @ c + d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(self._forward(z)[1], -30, 30)))

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, slope, steps: int = STEPS) -> Network:
        """Adam on the slopes of a risk: ``slope(p, u)`` gives those of the scores of both batches."""
        draw = np.random.default_rng(self.seed)
        self.mean, self.scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
        p_all, u_all = (np.clip((x - self.mean) / self.scale, -8, 8) for x in (positive, unlabelled))
        m, v = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        for t in range(1, steps + 1):
            p, u = p_all[draw.integers(0, len(p_all), BATCH)], u_all[draw.integers(0, len(u_all), BATCH)]
            x = np.concatenate([p, u])
            inner, out = self._forward(x)
            s = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            g = slope(s[: len(p)], s[len(p) :])
            back = np.outer(g, self.weights[2]) * (1 - inner**2)
            grads = [x.T @ back + 1e-4 * self.weights[0], back.sum(axis=0), inner.T @ g + 1e-4 * self.weights[2], np.array([g.sum()])]
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                self.weights[i] = self.weights[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return self


def _apart(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Slopes of the log loss of telling positive from unlabelled."""
    return np.concatenate([(p - 1) / len(p), u / len(u)]) / 2


def non_negative_slopes(prior: float):
    """Slopes of the non-negative risk with the sigmoid loss (a positive costs 1 - s, a negative s)."""

    def slope(p: np.ndarray, u: np.ndarray) -> np.ndarray:
        dp, du = p * (1 - p) / len(p), u * (1 - u) / len(u)
        if u.mean() - prior * p.mean() >= 0:
            return np.concatenate([-prior * dp - prior * dp, du])
        return np.concatenate([prior * dp, -du])

    return slope


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of good texts among the unlabelled.

    Positives make up the same part of their own above any score; the least share of unlabelled to positive
    texts above a score, over scores that a fifth of the positives pass, is an upper bound close to the prior.
    """
    half = len(positive) // 2
    model = Network(positive.shape[1]).fit(positive[:half], unlabelled, _apart)
    p, u = np.sort(model.score(positive[half:])), np.sort(model.score(unlabelled))
    cuts = p[: max(1, int(0.8 * len(p)))]
    above_p = 1 - np.searchsorted(p, cuts, "left") / len(p)
    above_u = 1 - np.searchsorted(u, cuts, "left") / len(u)
    return float(np.clip((above_u / above_p).min(), 0.05, 0.98))


class Calibration:
    """Probability of being good by score: ``prior`` times the density of positives over that of unlabelled.

    Densities are taken in bins of equal shares of the unlabelled texts, made monotone by pooling, and read
    between the bins in straight lines. A small part of the score itself keeps the order of texts.
    """

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, bins: int = 40, own: float = 0.02):
        edges = np.unique(np.quantile(unlabelled, np.linspace(0, 1, bins + 1)[1:-1]))
        u = np.bincount(np.searchsorted(edges, unlabelled, "right"), minlength=len(edges) + 1) + 1e-9
        p = np.bincount(np.searchsorted(edges, positive, "right"), minlength=len(edges) + 1)
        pools: list[list[float]] = []
        for good, all_ in zip(prior * p / len(positive), u / len(unlabelled)):
            pools.append([good, all_, 1])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                good, all_, n = pools.pop()
                pools[-1] = [pools[-1][0] + good, pools[-1][1] + all_, pools[-1][2] + n]
        self.value = np.concatenate([np.full(n, min(1.0, good / all_)) for good, all_, n in pools])
        ends = np.concatenate(([unlabelled.min()], edges, [unlabelled.max()]))
        self.at = (ends[1:] + ends[:-1]) / 2
        self.own = own

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return (1 - self.own) * np.interp(score, self.at, self.value) + self.own * score


def _scored(model: Network | None, calibrated: Calibration | None, prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column("measures").flatten(), dtype=float).reshape(batch.num_rows, len(FEATURES))
            scores = calibrated(model.score(values)) if model is not None else np.full(len(values), prior)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return run


def least_hashed(rows: DataFrame, size: int, total: int, *key: str) -> DataFrame:
    """About the ``size`` rows of ``total`` with the least hash of their key, in that order.

    Only rows under twice the share that is needed are sorted, so what tasks send does not grow with
    their number.
    """
    share = 2 * size / max(total, 1)
    if share < 1:
        rows = rows.filter(F.xxhash64(*key) < F.lit(int(-(2**63) + share * 2**64)))
    return rows.orderBy(F.xxhash64(*key), *key).limit(size)


def _sample(rows: DataFrame, size: int, total: int) -> np.ndarray:
    """Measures of the sampled rows."""
    taken = least_hashed(rows, size, total, "doc_id").select("doc_id", "measures").collect()
    taken = sorted((r["doc_id"], r["measures"]) for r in taken)
    return np.array([m for _, m in taken], dtype=float).reshape(len(taken), len(FEATURES))


def fit(measured: DataFrame, good: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[Network | None, Calibration | None, float]:
    """The network, its calibration and the prior, from measured texts and the ``doc_id`` of trusted good ones."""
    good = good.select("doc_id").distinct()
    trusted = measured.join(good, "doc_id", "semi")
    p, u = _sample(trusted, positives, good.count()), _sample(measured.filter("doc_id IS NOT NULL"), unlabelled, measured.count())
    if len(p) < 2 or not len(u):
        return None, None, 0.5
    prior = estimate_prior(p, u)
    model = Network(p.shape[1]).fit(p, u, non_negative_slopes(prior))
    return model, Calibration(model.score(p), model.score(u), prior), prior


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``; texts whose id falls into the held-out fold are not learnt from."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = materialize(texts.mapInArrow(_measured, "doc_id long, measures array<float>"), "measures")
    learn = measured.filter(fold != HELD_OUT)
    scored = measured.mapInArrow(_scored(*fit(learn, labels.filter("quality = 1"))), "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
