"""MinHash near-duplicates with tensored banding.

Every text is a set of word shingles. Two small collections of ``side`` sub-hashes each are computed; a
sub-hash joins ``rows`` minima. Pairing every sub-hash of the first collection with every one of the second
gives ``side * side`` table keys of ``2 * rows`` minima each, for ``2 * side * rows`` minima in all instead of
``2 * rows * side ** 2``. Texts that share a key are candidates and are confirmed on full sets.

A pair of similarity s shares a key with probability ``(1 - (1 - s**rows)**side)**2``: 0.99991 at s = 0.8,
0.99998 at 0.85 with the defaults (``rows`` is 3 there, 1 at 0.5, where it is 0.9999 too). No group is cut and no candidate dropped. First every text is held against the
best connected text it shares a bucket with, which joins most copies. A bucket whose texts are one component then
has nothing left to find; texts of other buckets are contested. Contested texts of different components are
joined exactly: of two sets that are similar enough, the least shingle they have in common, in one order for all,
is among the first ``n - ceil(percent * n / 100) + 1`` of each. Rare shingles come first, counted in a sketch of fixed
size, so a phrase of very many texts is no key. Copies are never expanded into all pairs, and buckets never paired.

Defined cases: a text without words (or null) has an empty set and is linked with nothing; texts with equal
sets are one class from the start; rows that repeat a doc_id are one document; a row without doc_id is never
linked and is kept. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.words import SPACED, find_words, mix, text_slices
from gleaner.operators import graph
from gleaner.session import materialize

SIDE = 14
SEED = 20240229
#: counters of the sketch that tells rare shingles; a power of two
CELLS = 1 << 20
#: 64-bit words of the bitmap of a text's shingles, by which most candidates are told apart
WORDS = 16

_SIGNATURE = "doc_id long, _text long, n_shingles long, _h1 long, _h2 long, _a array<long>, _b array<long>"


def shingle_hashes(words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of all texts in order, and where each text's begin.

    A text with fewer words than ``width`` has its whole sequence as its only shingle.
    """
    count = words.count
    n = len(words.hash)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        rolled[: max(0, n - k)] += mix(words.hash[k:] + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
    rolled = mix(rolled)
    position = np.arange(n) - np.repeat(words.first[:-1], count)
    left = np.repeat(count, count) - position
    whole = (left >= width)
    for d in np.flatnonzero((count > 0) & (count < width)):
        a, b = words.first[d], words.first[d + 1]
        value = np.uint64(int(count[d]))
        for h in words.hash[a:b]:
            value = mix(np.array([value ^ h], dtype=np.uint64))[0]
        rolled[a], whole[a] = value, True
    sizes = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    return rolled[whole], np.concatenate(([0], np.cumsum(sizes)))


def signatures(width: int, rows: int, side: int):
    """mapInArrow: set size, 128-bit set hash and the two collections of sub-hashes of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = np.random.default_rng(SEED).integers(0, 2**63, 2 * side * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in text_slices(batches):
            shingles, first = shingle_hashes(find_words(batch.column("text"), SPACED), width)
            docs = len(first) - 1
            size, h1, h2 = np.zeros(docs, np.int64), np.zeros(docs, np.uint64), np.zeros(docs, np.uint64)
            for d in range(docs):
                own = np.unique(shingles[first[d] : first[d + 1]])
                size[d], h1[d] = len(own), own.sum(dtype=np.uint64)
                h2[d] = mix(own ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
            full = np.flatnonzero(np.diff(first))
            sub = np.zeros((docs, 2 * side), np.uint64)
            if len(full):
                at = first[:-1][full]
                for k in range(2 * side):
                    value = np.full(len(full), k + 1, np.uint64)
                    for r in range(rows):
                        value = mix(value ^ np.minimum.reduceat(shingles * factors[k * rows + r], at))
                    sub[full, k] = value
            flat = sub.view(np.int64)
            offsets = np.arange(docs + 1, dtype=np.int32) * side
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("_text"), pa.array(size), pa.array(h1.view(np.int64)),
                    pa.array(h2.view(np.int64)), pa.ListArray.from_arrays(offsets, np.ascontiguousarray(flat[:, :side]).ravel()),
                    pa.ListArray.from_arrays(offsets, np.ascontiguousarray(flat[:, side:]).ravel()),
                ],
                names=["doc_id", "_text", "n_shingles", "_h1", "_h2", "_a", "_b"],
            )

    return run


def _percents(width: int, least: int):
    """mapInArrow over pairs of texts: keep those with 100 * intersection >= least * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(iter([whole]), "_text_a"):
                a, at = shingle_hashes(find_words(batch.column("_text_a"), SPACED), width)
                b, bt = shingle_hashes(find_words(batch.column("_text_b"), SPACED), width)
                percent = np.zeros(batch.num_rows)
                for i in range(batch.num_rows):
                    x, y = np.unique(a[at[i] : at[i + 1]]), np.unique(b[bt[i] : bt[i + 1]])
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    percent[i] = 100 * both // max(1, len(x) + len(y) - both)
                keep = pa.array(percent >= least)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_x").filter(keep), batch.column("_y").filter(keep), pa.array(percent[percent >= least].astype(np.int64))],
                    names=["_x", "_y", "_percent"],
                )

    return run


def _measured_pairs(pairs: DataFrame, full: DataFrame, width: int, least: int) -> DataFrame:
    """``_x, _y, _percent`` (rounded down) of the pairs of nodes whose full sets are ``least`` percent alike."""
    a = full.select(F.col("_node").alias("_x"), F.col("text").alias("_text_a"))
    b = full.select(F.col("_node").alias("_y"), F.col("text").alias("_text_b"))
    both = pairs.join(a, "_x").join(b, "_y").select("_x", "_y", "_text_a", "_text_b")
    return both.mapInArrow(_percents(width, least), "_x long, _y long, _percent long").distinct()


def _can_reach(a: str, b: str, percent: int):
    """Sets of these sizes can be similar enough."""
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _own_shingles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of texts and the distinct shingles of each."""
    for batch in text_slices(batches):
        shingles, first = shingle_hashes(find_words(batch.column("text"), SPACED), width)
        yield batch, [np.unique(shingles[first[d] : first[d + 1]]) for d in range(len(first) - 1)]


def _cells(width: int):
    """mapInArrow: in how many texts of a task the shingles of each counter stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(CELLS, np.int64)
        for _, sets in _own_shingles(batches, width):
            for own in sets:
                count += np.bincount((own & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) if len(own) > CELLS >> 4 else 0
                if len(own) <= CELLS >> 4:
                    np.add.at(count, (own & np.uint64(CELLS - 1)).astype(np.int64), 1)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held])], names=["cell", "n"])

    return run


def rarity(texts: DataFrame, width: int) -> np.ndarray:
    """The sketch of ``texts (text)``: ``CELLS`` counts, 8 MB whatever the number of texts."""
    counted = texts.select("text").mapInArrow(_cells(width), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[np.asarray(counted.column("cell"))] = np.asarray(counted.column("n"))
    return out


_BITS = [f"_w{w}" for w in range(WORDS)]


def _prefixes(width: int, percent: int, sketch):
    """mapInArrow: the shingles of each text, rarest first, that one it is similar to must share, with their places
    and a bitmap of all its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = sketch.value
        for batch, sets in _own_shingles(batches, width):
            sizes = np.array([len(own) - -(-percent * len(own) // 100) + 1 for own in sets], np.int64)
            picked = [own[np.lexsort((own, rare[(own & np.uint64(CELLS - 1)).astype(np.int64)]))[:k]] for own, k in zip(sets, sizes)]
            place = np.concatenate([np.arange(k) for k in sizes]) if len(sizes) else np.empty(0, np.int64)
            row = np.repeat(np.arange(len(sets)), sizes)
            bits = np.zeros((len(sets), WORDS), np.uint64)
            for d, own in enumerate(sets):
                bit = (own >> np.uint64(40)) & np.uint64(64 * WORDS - 1)
                np.bitwise_or.at(bits[d], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
            grams = np.concatenate(picked).view(np.int64) if picked else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array(row)) for c in ("_node", "n_shingles", "_comp")), pa.array(grams), pa.array(place),
                    *(pa.array(np.ascontiguousarray(bits[row, w]).view(np.int64)) for w in range(WORDS)),
                ],
                names=["_node", "n_shingles", "_comp", "_gram", "_place", *_BITS],
            )

    return run


def _contested_links(contested: DataFrame, full: DataFrame, width: int, percent: int) -> DataFrame:
    """``_x, _y``: all links between texts of ``contested (_node, _comp, n_shingles, text)`` in different components."""
    sketch = contested.sparkSession.sparkContext.broadcast(rarity(contested, width))
    schema = ", ".join(f"{c} long" for c in ("_node", "n_shingles", "_comp", "_gram", "_place", *_BITS))
    keyed = materialize(contested.mapInArrow(_prefixes(width, percent, sketch), schema), "prefixes")
    # a shingle of one component only links nothing
    between = keyed.groupBy("_gram").agg(F.min("_comp").alias("_low"), F.max("_comp").alias("_high")).filter("_low < _high").select("_gram")
    open_ = materialize(keyed.join(between, "_gram", "semi"), "open")
    x, y = (open_.select("_gram", *[F.col(c).alias(f"{c}_{s}") for c in ("_node", "n_shingles", "_comp", "_place", *_BITS)]) for s in "xy")
    # so many shingles two sets of these sizes share at least; after the first one come no more than what follows it
    need = F.ceil((F.col("n_shingles_x") + F.col("n_shingles_y")) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-6))
    rest = F.least(F.col("n_shingles_x") - F.col("_place_x"), F.col("n_shingles_y") - F.col("_place_y"))
    # a bit that only one bitmap has is a shingle that only one set has
    alone = {a: F.expr(" + ".join(f"bit_count({c}_{a} & ~{c}_{b})" for c in _BITS)) for a, b in ("xy", "yx")}
    common = F.least(*[F.col(f"n_shingles_{a}") - alone[a] for a in "xy"])
    met = x.join(
        y, (x["_gram"] == y["_gram"]) & (F.col("_node_x") < F.col("_node_y")) & (F.col("_comp_x") != F.col("_comp_y"))
        & _can_reach("n_shingles_x", "n_shingles_y", percent) & (rest >= need) & (common >= need),
    )
    pairs = met.select(F.col("_node_x").alias("_x"), F.col("_node_y").alias("_y")).distinct()
    return _measured_pairs(materialize(pairs, "pairs"), full, width, percent).select("_x", "_y")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges (_x, _y)`` but the least ones of components."""
    return graph.components(edges, "_x", "_y")


def minima_of(percent: int) -> int:
    """Minima of a sub-hash: as many as two texts at the bound still share with a probability of a half."""
    return max(1, int(np.log(0.5) / np.log(min(percent, 99) / 100)))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int | None = None, side: int = SIDE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per row of ``docs (doc_id, text)``."""
    rows = rows or minima_of(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_text"))
    signed = materialize(texts.mapInArrow(signatures(width, rows, side), _SIGNATURE), "signatures")
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(
        usable.groupBy("_h1", "_h2", "n_shingles")
        .agg(F.min(F.struct("doc_id", "_text", "_a", "_b")).alias("r"))
        .select("_h1", "_h2", "n_shingles", F.col("r.doc_id").alias("_node"), "r._text", "r._a", "r._b"),
        "classes",
    )
    # a table bucket is (place in the one collection, place in the other, the two sub-hashes)
    keyed = (
        classes.select("_node", "n_shingles", F.posexplode("_a").alias("_i", "_va"), "_b")
        .select("_node", "n_shingles", "_i", "_va", F.posexplode("_b").alias("_j", "_vb"))
        .select(F.xxhash64("_i", "_va", "_j", "_vb").alias("_key"), "_node", "n_shingles")
    )
    bucket = Window.partitionBy("_key")
    shared = materialize(
        keyed.withColumn("_k", F.count("*").over(bucket)).filter("_k > 1"),
        "buckets",
    )
    # each class goes to the best connected class it meets, which in a group of copies is their source
    degree = shared.groupBy("_node").agg(F.sum("_k").alias("_degree"))
    led = materialize(shared.join(degree, "_node").select("_key", "_node", "n_shingles", "_degree"), "led")
    best = led.groupBy("_key").agg(F.max(F.struct("_degree", F.col("_node").alias("_lead"), F.col("n_shingles").alias("_size"))).alias("_top"))
    led = led.join(best, "_key")
    nearest = materialize(
        led.filter(F.col("_node") != F.col("_top._lead")).filter(_can_reach("n_shingles", "_top._size", percent))
        .groupBy("_node").agg(F.max("_top").alias("_top")).select(F.col("_node").alias("_x"), F.col("_top._lead").alias("_y")),
        "nearest",
    )
    # texts that have company in a bucket are fetched once, a small part of all
    named = classes.select("_node", "_text").join(shared.select("_node").distinct(), "_node", "semi")
    full = materialize(texts.withColumnRenamed("doc_id", "_node").join(named, ["_node", "_text"], "semi").select("_node", "text"), "texts")
    close = materialize(_measured_pairs(nearest, full, width, percent), "close")
    # a document with several texts ties their classes together
    twofold = (
        usable.join(classes.select("_h1", "_h2", "n_shingles", "_node"), ["_h1", "_h2", "n_shingles"])
        .filter("doc_id <> _node").select(F.col("doc_id").alias("_x"), F.col("_node").alias("_y"))
        .join(classes.select(F.col("_node").alias("_x")).distinct(), "_x", "semi")
    )
    joined = components(close.select("_x", "_y").union(twofold))
    placed = materialize(
        classes.select("_node", "n_shingles").join(joined.select(F.col("node").alias("_node"), "component"), "_node", "left")
        .select("_node", "n_shingles", F.coalesce("component", "_node").alias("_comp")),
        "placed",
    )
    # buckets with texts of two components still hold candidates
    met = shared.select("_key", "_node").join(placed.select("_node", "_comp"), "_node")
    mixed = met.groupBy("_key").agg(F.min("_comp").alias("_low"), F.max("_comp").alias("_high")).filter("_low < _high").select("_key")
    nodes = shared.select("_key", "_node").join(mixed, "_key", "semi").select("_node").distinct()
    contested = materialize(placed.join(nodes, "_node", "semi").join(full, "_node").select("_node", "_comp", "n_shingles", "text"), "contested")
    more = materialize(_contested_links(contested, full, width, percent), "links")
    if not more.isEmpty():
        joined = components(joined.select(F.col("node").alias("_x"), F.col("component").alias("_y")).union(more))
    group = classes.select("_h1", "_h2", "n_shingles", "_node").join(
        joined.withColumnRenamed("node", "_node"), "_node", "left"
    ).select("_h1", "_h2", "n_shingles", F.coalesce("component", "_node").alias("_component"))
    return (
        signed.select("doc_id", "n_shingles", "_h1", "_h2").join(group, ["_h1", "_h2", "n_shingles"], "left")
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("_component"))).otherwise(F.col("doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
