"""The similarity join against all pairs, and what its plan may not hold."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import businesses as B, similarity as S, skew


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(draw, text, n):
    letters = list(text)
    for _ in range(n):
        at, kind = draw.randrange(len(letters) + 1), draw.choice("ids")
        if kind == "i" or at == len(letters):
            letters.insert(at, draw.choice("abcé𝕏"))
        elif kind == "d":
            del letters[at]
        else:
            letters[at] = draw.choice("abcé𝕏")
    return "".join(letters)


def test_all_similar_pairs_are_found(spark):
    draw = random.Random(6)
    rows = []
    for block in ("x", "y", None):
        for _ in range(40):
            base = "".join(draw.choice("abc") for _ in range(draw.randint(1, 40)))
            rows += [(block, edited(draw, base, draw.randint(0, 7))) for _ in range(4)]
    rows += [("x", "a" * n) for n in range(0, 60)] + [("x", None), ("z", "alone"), ("x", rows[0][1]), ("y", "q" * 400), ("y", "q" * 390 + "r" * 10)]
    texts = {b: sorted({t for c, t in rows if c == b and t is not None}) for b in ("x", "y", "z")}
    wanted = set()
    for block, own in texts.items():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                allowed = int(max(len(a), len(b)) * 0.15 + 1e-9)
                if allowed and abs(len(a) - len(b)) <= allowed and (d := distance(a, b)) <= allowed:
                    wanted.add((block, a, b, d))
    got = {tuple(r) for r in S.similar_pairs(spark.createDataFrame(rows, "block string, text string")).collect()}
    assert got == wanted and len(wanted) > 300


def test_no_product_and_no_other_pair(spark, monkeypatch):
    """Names of one block and length that differ everywhere: the join puts out nothing, and pairs only by keys."""
    draw = random.Random(7)
    names = spark.createDataFrame([("all", "inn" + "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(17))) for _ in range(3000)], "block string, text string")
    pairs = S.similar_pairs(names)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "levenshtein" in plan
    assert pairs.count() == 0
    keys = S.prefixes(names.distinct()).groupBy("gram").agg(F.count("*").alias("n"))
    met = keys.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    assert met < 0.1 * 3000 * 2999 / 2  # of all pairs, so many meet at a key


def test_parameters_that_would_miss_pairs_are_refused():
    S.check_parameters(S.SHARE, S.GRAM)
    for share, q in ((0.3, 3), (0.0, 2), (1.0, 2), (0.15, 6)):
        with pytest.raises(ValueError):
            S.check_parameters(share, q)


def test_businesses_with_similar_names(spark):
    rows = [
        ("a1", "Hotel Sonnenhof", "x@sonne.org", None, "1 Main", None), ("a2", "Hotel Sonenhof", None, None, "1 MAIN ", None),
        ("a3", "HOTEL SONNENHOFF!", "y@sonne.org", None, None, None), ("b1", "Hotel Sonnenhof Nord", None, None, "9 Side", None),
        ("b2", "Hotel Sonnenhof Nort", None, None, "8 Side", None), ("c1", "Unknown Business", None, None, "1 Main", None),
        ("c2", None, None, None, "1 Main", None), ("d1", "Abc", None, None, "7 Side", "https://w.example/a"), ("d2", "Abd", None, None, "7 Side", "https://w.example/b"),
        (None, "Hotel Sonnenhof", None, None, "1 Main", None),
    ]
    leads = spark.createDataFrame(rows, "id string, business_name string, email string, phone string, address string, website string")
    got = {r["id"]: r["business_id"] for r in B.fuzzy_business_ids(leads).collect()}
    assert got == {"a1": "a1", "a2": "a1", "a3": "a1", "b1": "b1", "b2": "b2", "c1": "c1", "c2": "c2", "d1": "d1", "d2": "d2", None: None}
    assert B.fuzzy_business_ids(leads.limit(0)).count() == 0


def test_hot_block(spark):
    """A third of all leads in one block under a few names: names are compared, not leads."""
    leads = spark.range(3000).selectExpr(
        "concat('l', lpad(id, 5, '0')) AS id", "concat('Gasthaus zum Ochsen', elt(cast(id % 3 as int) + 1, '', 'n', ' e')) AS business_name",
        "cast(NULL AS string) AS email", "cast(NULL AS string) AS phone", "if(id % 3 = 0, 'Hot Main', concat(id, ' Main')) AS address", "cast(NULL AS string) AS website",
    )
    known = B.fuzzy_business_ids(leads)
    assert known.groupBy("business_id").count().count() == 3
    assert B.name_blocks(leads).groupBy("block", "text").count().count() == 2001


def test_only_hot_keys_are_broadcast(spark):
    """Grams and names take little room in a file and much in memory: small files are no reason to broadcast them."""
    left, right = (spark.range(50).select((F.col("id") % 5).alias("k"), F.col("id").alias(c)) for c in "xy")
    joined = skew.salted_join(left, right, "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 2  # of the hot keys, with either side
    assert joined.count() == 500
