"""A similarity join of short texts: pairs within an edit distance, without comparing all with all.

Two texts are similar when their edit distance is at most ``share`` of the longer one's length, rounded down. One
edit touches at most ``q`` of a text's q-grams, so with d edits allowed, the least gram the two have in common
(in any order of grams fixed for all texts) is among the first ``q * d + 1`` of each. With rare grams first, only
those are keys. Length is part of the key, since d edits change it by d at most, and so is the block that
pairs have to share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.skew import salted_join
from gleaner.session import materialize

SHARE = 0.15
GRAM = 3
#: grams in more than this share of all places are ordered last; there are at most ``1 / FREQUENT`` of them
FREQUENT = 0.001


def edits_allowed(length: Column | str, share: float = SHARE) -> Column:
    """Edits between two texts, the longer of which has this length."""
    return F.floor(F.col(length) * F.lit(share) if isinstance(length, str) else length * F.lit(share)).cast("int")


def _most_edits(length: Column, share: float) -> Column:
    """Edits a text of this length may be from a partner, which may be the longer one."""
    return F.floor(length * F.lit(share / (1 - share)) + F.lit(1e-9)).cast("int")


def grams(text: Column | str, q: int = GRAM) -> Column:
    """Distinct q-grams of a text; one shorter than ``q`` has none."""
    chars = F.split(text, "")
    count = F.length(text) - F.lit(q - 1)
    return F.when(
        count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(chars, i, q), "")))
    ).otherwise(F.array().cast("array<string>"))


def letters(text: Column | str) -> Column:
    """Which of 64 classes of characters a text has, as bits. One edit changes two bits at most."""
    bits = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64))))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(b))


def check_parameters(share: float, q: int) -> None:
    """Every text with an edit to spare has more q-grams than its edits can touch; else pairs could be missed."""
    if not 0 < share < 1:
        raise ValueError("share lies between 0 and 1")
    for length in range(1, 10_000):
        most = int(length * share / (1 - share) + 1e-9)
        if most and length - q + 1 <= q * most:
            raise ValueError(f"with q = {q}, texts of {length} characters may lose all grams at a share of {share}; choose less of either")


def prefixes(texts: DataFrame, share: float = SHARE, q: int = GRAM) -> DataFrame:
    """``block, text, n, d, bits, gram`` of distinct ``texts (block, text)``: the grams that a partner must share one of."""
    sized = texts.select("block", "text", F.length("text").alias("n"))
    sized = sized.withColumn("d", _most_edits(F.col("n"), share)).filter("d > 0")
    placed = sized.select("block", "text", "n", "d", F.explode(grams("text", q)).alias("gram"))
    counts = placed.groupBy("gram").agg(F.count("*").alias("times"))
    total = counts.agg(F.sum("times")).scalar()
    frequent = F.broadcast(counts.filter(F.col("times") > total * F.lit(FREQUENT)))
    ranked = placed.join(frequent, "gram", "left").select("block", "text", "n", "d", F.struct(F.coalesce("times", F.lit(0)).alias("times"), "gram").alias("g"))
    first = ranked.groupBy("block", "text", "n", "d").agg(F.slice(F.array_sort(F.collect_list("g")), 1, F.lit(q) * F.col("d") + 1).alias("g"))
    return first.select("block", "text", "n", "d", letters("text").alias("bits"), F.explode("g.gram").alias("gram"))


def similar_pairs(texts: DataFrame, share: float = SHARE, q: int = GRAM) -> DataFrame:
    """``block, a, b, distance`` with ``a < b``: the pairs of different texts of a block that are similar.

    ``texts (block, text)`` may repeat; nulls take no part. A key of very many texts is spread over tasks by
    :func:`salted_join`; what comes out of the join are similar pairs only.
    """
    check_parameters(share, q)
    distinct = texts.select("block", "text").filter("block IS NOT NULL AND text IS NOT NULL").distinct()
    keyed = materialize(prefixes(materialize(distinct, "texts"), share, q), "prefixes")
    key = F.xxhash64("block", "gram", "_n").alias("_key")
    longer = F.sequence("n", F.col("n") + F.col("d"))
    left = keyed.select("*", F.explode(longer).alias("_n")).select(
        key, F.col("block").alias("_b"), F.col("gram").alias("_g"), F.col("text").alias("x"), F.col("n").alias("nx"), F.col("bits").alias("bx")
    )
    right = keyed.withColumn("_n", F.col("n")).select(
        key, "block", "gram", F.col("text").alias("y"), F.col("n").alias("ny"), F.col("bits").alias("by"), edits_allowed("n", share).alias("most")
    )
    met = salted_join(left, right, "_key").filter(
        # a shorter text meets the longer ones, texts of one length meet once; hashes may collide
        "_b = block AND _g = gram AND ny - nx <= most AND (nx < ny OR x < y) AND bit_count(bx ^ by) <= 2 * most AND levenshtein(x, y, most) >= 0"
    )
    pairs = met.select("block", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b"))
