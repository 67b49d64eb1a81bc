"""Content classification as column expressions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gleaner.functions import fixed
from gleaner.functions.common import WORD, col, contains_any, find_all, first_category, let


def content_type(text: Column | str, lexicon: Mapping[str, Iterable[str]] = fixed.CONTENT_TYPES) -> Column:
    return first_category(F.lower(col(text)), lexicon, "other")


def vertical(text: Column | str, terms: Iterable[str] = fixed.VERTICALS) -> Column:
    return first_category(F.lower(col(text)), {t: [t] for t in terms}, "other")


def intent(text: Column | str, lexicon: Mapping[str, Iterable[str]] = fixed.INTENTS) -> Column:
    return first_category(F.lower(col(text)), lexicon, "unknown")


def quality(text: Column | str, terms: Iterable[str] = fixed.VERTICALS) -> Column:
    """Length in thousands of characters, at most 1, plus 0.2 for a vertical term; two decimals.

    Computed in whole hundredths (half up), so no binary rounding is involved.
    """
    text = col(text)
    hundredths = F.floor(
        (F.least(F.length(text), F.lit(1000)) + F.lit(5)) / F.lit(10)
    )
    bonus = F.when(contains_any(F.lower(text), terms), 20).otherwise(0)
    return (hundredths + bonus) / F.lit(100.0)


def is_spam(text: Column | str, patterns: Iterable[str] = fixed.SPAM_PATTERNS) -> Column:
    return col(text).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def words(text: Column | str, min_length: int = 4) -> Column:
    """Lower-case words of at least ``min_length`` letters, in text order."""
    return find_all(F.lower(col(text)), rf"[{WORD}]{{{min_length},}}")


_KEYWORDS = ArrayType(StructType([StructField("word", StringType()), StructField("n", IntegerType())]))


def keyword_counts(text: Column | str, top_n: int = 10, min_length: int = 4) -> Column:
    """The ``top_n`` most frequent words of a text, ties by first occurrence: array of (word, n).

    Counting inside the row needs no shuffle of words. Spark has no counter for array elements; this vectorised
    UDF sends back only ``top_n`` words, and is the faster way by measure (:func:`keyword_runs` is the other).
    """
    pattern = re.compile(rf"\w{{{min_length},}}")

    def count(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: None if t is None else [
                {"word": w, "n": n} for w, n in Counter(pattern.findall(t.lower())).most_common(top_n)
            ]
        )

    return F.pandas_udf(count, _KEYWORDS)(col(text))


def keyword_runs(text: Column | str, top_n: int = 10, min_length: int = 4) -> Column:
    """

    The words are sorted with their places; each run of equal ones is a word with its count and its first place.
    """
    words = find_all(F.lower(col(text)), rf"[{WORD}]{{{min_length},}}")
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def counted(placed: Column) -> Column:
        firsts = F.filter(
            F.transform(placed, lambda p, k: F.when((k == 0) | (F.get(placed, k - 1)["w"] != p["w"]), F.struct(p["w"].alias("w"), p["i"].alias("i"), k.alias("k")))),
            lambda p: p.isNotNull(),
        )

        def ranked(firsts: Column) -> Column:
            runs = F.transform(
                firsts, lambda p, j: F.struct((p["k"] - F.coalesce(F.get(firsts, j + 1)["k"], F.size(placed))).alias("less"), p["i"].alias("i"), p["w"].alias("w"))
            )
            return F.transform(F.slice(F.sort_array(runs), 1, top_n), lambda r: F.struct(r["w"].alias("word"), (-r["less"]).alias("n")))

        return let(firsts, ranked)

    return let(placed, counted)


def keywords(text: Column | str, top_n: int = 10, min_length: int = 4) -> Column:
    """The ``top_n`` most frequent words of a text."""
    return F.transform(keyword_counts(text, top_n, min_length), lambda k: k["word"])
