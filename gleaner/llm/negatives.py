"""Hard negatives by best-first search of cover trees.

Rows are integer vectors with a label. For each anchor the rows of its label with the highest inner products are
its positives; for each positive, the rows of other labels whose score lies in a window below the positive's are
its hard negatives, best first.

Candidates get one more coordinate, ``sqrt(M**2 - |x|**2)`` with the greatest norm M of all rows, so all have the
norm M and the inner product with a query (0 there) falls as the distance grows. Bounded shards of them become
cover trees: a node at level l holds rows within ``2 ** l`` of its own row, its children at lower levels
cover what is left of that, and two children of one level are more than the level's radius apart. A node keeps
the exact radius r it covers, which bounds all inner products below it by ``q.c +- |q| r`` and by the distances
``|q' - c'| +- r``. A search opens the nodes with the highest bounds first, skips those that no window reaches
(or whose rows all have the wrong label), and ends when no bound is as high as what it has found; every row it
meets is scored exactly. Bounds have room for rounding, so results are exact.

Queries are a stated set, met block against block: a group is one tree and one chunk of anchors, both bounded;
each answers with its own best few, which are merged by rank. Trees are sharded by a hash of the row, so neither a
hot label nor a hot vector gathers in one of them.

Defined cases: rows with a null label, vector or vec_id, or with a null or non-finite component take no part; a
shorter vector counts as filled up with zeros, an empty one is the zero vector; equal scores rank by vec_id; a
row that repeats a vec_id is another row, which may be its copy's positive; scores beyond a long are cut to its
limits in the result, not in the comparison of one tree; an empty table, or one without anchors, gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import materialize

#: rows of a tree and anchors of a chunk, on average; trees at least
TREE_ROWS = 4096
CHUNK = 2048
TREES = 16
#: rows of a node that are not divided further
LEAF = 8
#: nodes a search opens at a time
BEAM = 256

_TREE = "tree int, size int, ids binary, rows binary, labels binary, points binary, counts binary, radius binary, uniform binary, top double"
_FOUND = "_row long, _window long, id long, other long, score long"
_LONG = (1 << 63) - 1
_EXACT = 1 << 53


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros."""
    column = column.combine_chunks()
    lists = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    sizes = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(lists), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.asarray(lists.flatten())
    return out


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes in breadth-first order as rows of ``points``, the number of children and the covering radius of each.

    A node's rows beyond half of its level's radius are dealt to new centres that cover that half; the others stay
    for its lower levels.
    """
    order, counts, radius = [0], [], []
    pending = [np.arange(1, len(points))]
    at = 0
    while at < len(order):
        own, rest = order[at], pending[at]
        away = np.sqrt(np.square(points[rest] - points[own]).sum(1))
        radius.append(float(away.max(initial=0.0)) * (1 + 1e-9))
        before = len(order)
        while len(rest) > LEAF and away.max() > 0:
            level = 2.0 ** (np.ceil(np.log2(away.max())) - 1)
            far, near = rest[away > level], away <= level
            while len(far):
                centre = far[0]
                covered = np.square(points[far] - points[centre]).sum(1) <= level * level
                covered[0] = True
                order.append(int(centre))
                pending.append(far[covered][1:])
                far = far[~covered]
            rest, away = rest[near], away[near]
        order += rest.tolist()
        pending += [rest[:0]] * len(rest)
        counts.append(len(order) - before)
        pending[at] = None
        at += 1
    return np.array(order), np.array(counts, np.int32), np.array(radius)


def _build(greatest: float):
    """applyInArrow by tree: one row that holds it. ``greatest`` is the square of the greatest norm."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        points = matrix(table.column("v"))
        plain = points.astype(np.float64)
        extra = np.sqrt(np.maximum(0.0, greatest - np.square(plain).sum(1)))
        order, counts, radius = cover_tree(np.concatenate((plain, extra[:, None]), axis=1))
        labels = np.asarray(table.column("label"))[order]
        # whether all rows below a node have one label: children come after their node
        uniform = np.ones(len(order), bool)
        first = 1 + np.concatenate(([0], np.cumsum(counts)))
        for i in range(len(order) - 1, -1, -1):
            if counts[i]:
                below = slice(first[i], first[i + 1])
                uniform[i] = uniform[below].all() and (labels[below] == labels[i]).all()
        packed = {
            "ids": np.asarray(table.column("vec_id"))[order], "rows": np.asarray(table.column("_row"))[order], "labels": labels,
            "points": points[order], "counts": counts, "radius": radius, "uniform": uniform,
        }
        return pa.table({
            "tree": pa.array([key[0].as_py()], pa.int32()), "size": pa.array([len(order)], pa.int32()),
            **{k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in packed.items()}, "top": pa.array([greatest]),
        })

    return run


class Tree:
    """A shard's cover tree, loaded to be searched."""

    def __init__(self, row: dict):
        n = row["size"]
        self.ids, self.rows, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "rows", "labels"))
        self.points = np.frombuffer(row["points"], np.int64).reshape(n, -1)
        self.plain = self.points.astype(np.float64)
        self.counts = np.frombuffer(row["counts"], np.int32)
        self.first = 1 + np.concatenate(([0], np.cumsum(self.counts)))
        self.radius, self.uniform = np.frombuffer(row["radius"]), np.frombuffer(row["uniform"], bool)
        self.top = row["top"]
        self.largest = int(np.abs(self.plain).max(initial=0))
        self.opened = 0

    def _scores(self, nodes: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
        """Inner products, as integers beyond what a double can hold."""
        if exact:
            return self.plain[nodes] @ query.astype(np.float64)
        return self.points[nodes].astype(object) @ query.astype(object) + np.array(0, dtype=object)

    def search(self, query: np.ndarray, label: int, own: int, windows: list[tuple], same: bool, k: int) -> list[list[tuple]]:
        """For each window (low, high) of scores the ``k`` best rows as (-score, id, row): rows of the label but
        ``own`` if ``same``, else those of other labels."""
        width = self.points.shape[1]
        query = np.pad(query[:width], (0, max(0, width - len(query))))
        exact = self.largest * int(np.abs(query.astype(np.float64)).max(initial=0)) * max(1, width) < _EXACT
        square = float(np.square(query.astype(np.float64)).sum())
        norm, slack = square**0.5, 1e-9 * (square + self.top) + 1e-6
        best: list[list[tuple]] = [[] for _ in windows]
        nodes = np.array([0])
        opened, bounds = np.empty(0, np.int64), (np.empty(0), np.empty(0))
        while True:
            # rows met for the first time are scored exactly
            score = self._scores(nodes, query, exact)
            fits = (self.labels[nodes] == label) & (self.rows[nodes] != own) if same else self.labels[nodes] != label
            for j, (low, high) in enumerate(windows):
                least = max(low, -best[j][-1][0]) if len(best[j]) == k else low
                good = np.flatnonzero(fits & (score >= least) & (score <= high))
                if len(good) > 4 * k and exact:
                    good = good[score[good] >= np.partition(score[good], len(good) - k)[len(good) - k]]
                if len(good):
                    new = [(-int(score[i]), int(self.ids[nodes[i]]), int(self.rows[nodes[i]])) for i in good]
                    best[j] = sorted(best[j] + new)[:k]
            # their subtrees wait, unless all their rows have a label that is not wanted
            inner = (self.counts[nodes] > 0) & ~(self.uniform[nodes] & ((self.labels[nodes] != label) if same else (self.labels[nodes] == label)))
            centre, r = score[inner].astype(np.float64), self.radius[nodes[inner]]
            away = np.sqrt(np.maximum(0.0, square + self.top - 2 * centre))
            upper = np.minimum(centre + norm * r, (square + self.top - np.square(np.maximum(0.0, away - r))) / 2) + slack
            lower = np.maximum(centre - norm * r, (square + self.top - np.square(away + r)) / 2) - slack
            opened = np.concatenate((opened, nodes[inner]))
            bounds = (np.concatenate((bounds[0], upper)), np.concatenate((bounds[1], lower)))
            needed = np.zeros(len(opened), bool)
            for j, (low, high) in enumerate(windows):
                least = max(low, -best[j][-1][0]) if len(best[j]) == k else low
                needed |= (bounds[0] >= float(least)) & (bounds[1] <= float(high))
            opened, bounds = opened[needed], (bounds[0][needed], bounds[1][needed])
            if not len(opened):
                return best
            # best first
            chosen = np.zeros(len(opened), bool)
            chosen[np.argpartition(-bounds[0], min(BEAM, len(opened)) - 1)[:BEAM]] = True
            begin, count = self.first[opened[chosen]], self.counts[opened[chosen]]
            nodes = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
            self.opened += len(nodes)
            opened, bounds = opened[~chosen], (bounds[0][~chosen], bounds[1][~chosen])


def _search(same: bool, k: int, low: int, high: int):
    """Cogrouped by (tree, chunk): the best rows of the tree for every anchor and window of the chunk."""

    def run(trees: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if trees.num_rows and anchors.num_rows:
            tree = Tree(trees.to_pylist()[0])
            queries = matrix(anchors.column("v"))
            columns = [anchors.column(c).to_pylist() for c in ("_row", "label", "_tops")]
            for query, row, label, tops in zip(queries, *columns):
                windows = [(-np.inf, np.inf)] if same else [(-(-low * t // 100), high * t // 100) for t in tops]
                for t, found in zip(tops or [0], tree.search(query, label, row, windows, same, k)):
                    out += [(row, t, i, other, max(-_LONG, min(_LONG, -score))) for score, i, other in found]
        return pa.table({c: pa.array([x[i] for x in out], pa.int64()) for i, c in enumerate(("_row", "_window", "id", "other", "score"))})

    return run


def prepared(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, v`` of the rows of ``embeddings (vec_id, embedding, label)`` that take part, with integer
    components ``floor(256 * x)``; where vec_id is divisible by 7 the label moves on by one, modulo 10."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.col("label").cast("long")
    return embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"),
    )


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, tree_rows: int = TREE_ROWS
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of
    ``rows (vec_id, label, v)`` that ``anchor`` picks: negatives score ``low`` to ``high`` percent of the positive."""
    stored = materialize(rows.select("vec_id", "label", "v", F.monotonically_increasing_id().alias("_row")), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    total, asked, greatest = stored.agg(F.count("*"), F.count_if(anchor), F.max(square)).first()
    trees, chunks = max(TREES, -(-total // tree_rows)), max(TREES, -(-asked // CHUNK)) if asked > CHUNK else 1
    shards = stored.withColumn("tree", F.pmod(F.xxhash64("_row"), F.lit(trees)).cast("int"))
    built = materialize(shards.groupBy("tree").applyInArrow(_build(greatest or 0.0), _TREE), "cover-trees")
    every_chunk = built.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    chunk = F.pmod(F.xxhash64("_row", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk")
    anchors = materialize(stored.filter(anchor).select("_row", "vec_id", "label", "v", chunk), "anchors")

    def met(queries: DataFrame, same: bool, k: int) -> DataFrame:
        sent = queries.select("_row", "label", "v", "_tops", "chunk", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
        found = every_chunk.groupBy("tree", "chunk").cogroup(sent.groupBy("tree", "chunk")).applyInArrow(_search(same, k, low, high), _FOUND)
        ranked = Window.partitionBy("_row", "_window").orderBy(F.desc("score"), "id", "other")
        return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)

    best = materialize(met(anchors.withColumn("_tops", F.lit(None).cast("array<long>")), True, positives), "positives")
    # a window holds nothing below a negative score
    tops = best.filter("score >= 0").groupBy("_row").agg(F.collect_set("score").alias("_tops"))
    near = met(anchors.join(tops, "_row"), False, negatives)
    pairs = best.select("_row", F.col("id").alias("positive_id"), F.col("score").alias("_window"))
    ids = anchors.select("_row", F.col("vec_id").alias("anchor_id"))
    return near.join(pairs, ["_row", "_window"]).join(ids, "_row").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("_window").alias("positive_score"), F.col("score").alias("negative_score")
    )
