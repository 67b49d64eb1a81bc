"""Hard negatives against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm.negatives import Tree, _build, cover_tree, hard_negatives, prepared

SCHEMA = "vec_id long, embedding array<double>, label int, v string, _row int, tree int, rank string, `a.b` int"


def brute(rows, step=100):
    """The contract by plain loops over (vec_id, vector, label)."""
    usable = []
    for i, x, label in rows:
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        usable.append((i, [math.floor(256 * c) for c in x], int(math.fmod(label + 1, 10)) if i % 7 == 0 else label))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for at, (anchor, x, label) in enumerate(usable):
        if anchor % step:
            continue
        scored = [(-dot(x, y), i, other) for j, (i, y, other) in enumerate(usable) if j != at]
        for minus, positive, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fits = sorted(s for s in scored if s[2] != label and -80 * minus <= -100 * s[0] <= -100 * minus)[:5]
            out += [(anchor, positive, rank, negative, -minus, -score) for rank, (score, negative, _) in enumerate(fits, 1)]
    return sorted(out)


def got(spark, rows, step=100, **more):
    table = spark.createDataFrame([(i, x, label, "v", 0, 1, "r", 2) for i, x, label in rows], SCHEMA)
    return sorted(map(tuple, hard_negatives(prepared(table), F.col("vec_id") % step == 0, **more).collect()))


def clustered(n, dims, seed, labels=4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, dims))
    return [(int(i), [float(c) for c in centres[draw.integers(6)] + 0.3 * draw.normal(size=dims)], int(draw.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("dims", [2, 16])
def test_against_all_pairs(spark, dims):
    rows = clustered(600, dims, dims)
    assert got(spark, rows, 20, tree_rows=30) == brute(rows, 20)


def test_awkward_rows(spark):
    rows = clustered(60, 3, 9)
    rows += [(100, None, 1), (200, [1.0, None], 1), (300, [float("nan")], 1), (400, [float("inf"), 1.0], 2), (None, [1.0], 1), (500, [1.0, 2.0], None)]
    rows += [(600, [], 1), (700, [0.5], 1), (800, [0.5, 0.25, 0.125, 9.0], 2), (900, [-1.0, -1.0, -1.0], 3), (-100, [0.3, 0.3, 0.3], 0)]
    rows += [(i, list(x), label) for i, x, label in rows[:8]]  # repeated rows
    rows += [(1000 + k, [0.7, 0.1, 0.2], k % 2) for k in range(200)]  # one vector many times
    assert got(spark, rows) == brute(rows)


def test_large_components(spark):
    rows = [(k, [2.0**40 + k * 2.0**20, -(2.0**35), float(k)], k % 2) for k in range(40)] + [(k, [float(k), 1.0, 0.0], k % 2) for k in range(200, 240)]
    fits = [r for r in brute(rows, 10) if all(abs(s) < 2**63 for s in r[4:])]
    assert [r for r in got(spark, rows, 10) if all(abs(s) < 2**63 - 1 for s in r[4:])] == fits


def test_nothing(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert got(spark, [(0, [1.0], 1)], 1) == []


def test_covering_and_separation():
    draw = np.random.default_rng(2)
    points = np.concatenate((draw.normal(size=(300, 4)), np.repeat(draw.normal(size=(1, 4)), 60, 0)))
    order, counts, radius = cover_tree(points)
    assert sorted(order.tolist()) == list(range(360)) and counts.sum() == 359
    first = 1 + np.concatenate(([0], np.cumsum(counts)))

    def below(i):
        return [i] + [x for c in range(first[i], first[i + 1]) for x in below(c)]

    for i in range(len(order)):
        away = np.linalg.norm(points[order[below(i)]] - points[order[i]], axis=1)
        assert away.max() <= radius[i]


def test_search_skips_nodes():
    """On clustered rows a search opens few of the rows."""
    import pyarrow as pa

    rows = clustered(4000, 8, 3)
    v = [[math.floor(256 * c) for c in x] for _, x, _ in rows]
    table = pa.table({"v": pa.array(v, pa.list_(pa.int64())), "vec_id": [r[0] for r in rows], "_row": [r[0] for r in rows], "label": pa.array([r[2] for r in rows], pa.int64())})
    top = max(float(np.square(x).sum()) for x in v)
    tree = Tree(_build(top)((pa.scalar(0),), table).to_pylist()[0])
    for i in range(20):
        tree.search(np.array(v[i]), rows[i][2], i, [(-np.inf, np.inf)], True, 5)
    assert tree.opened < 0.5 * 20 * len(rows)
