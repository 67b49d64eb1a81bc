"""Small column helpers shared by all function modules."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode defines it; Java's \s is ASCII only. \h and \v are single tests in the
# matcher, several times faster than the code points spelled out. \h also holds U+180E, a letter
# separator of Mongolian that is no white space: the exact class leaves it out.
WS = r"\h\v\x1c-\x1f"
WS_CLASS = r"[\h\v\x1c-\x1f&&[^\x{180E}]]"
WORD = r"\p{L}\p{N}_"
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    A lambda variable is bound to a computed value, so Catalyst cannot copy the expression behind
    it into every place that uses it. That matters inside array functions, where a copy would be
    evaluated again for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def find_all(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(group))


def find_first(text: Column | str, pattern: str, group: int = 0) -> Column:
    """First match or NULL (``regexp_extract`` gives '' when there is none)."""
    return blank_to_null(F.regexp_extract(col(text), pattern, group))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column | str) -> Column:
    """Trim all Unicode white space from both ends."""
    return F.btrim(col(c), F.lit(WS_CHARS))


def collapse(c: Column | str) -> Column:
    """Replace each run of white space by one blank and trim."""
    return F.trim(squeeze(c))


def squeeze(c: Column | str) -> Column:
    """Replace each run of white space by one blank. Single blanks, by far the most common run,
    are not matched at all."""
    return F.regexp_replace(col(c), rf" {WS_CLASS}+|[{WS}&&[^ \x{{180E}}]]{WS_CLASS}*", " ")


def contains_any(text: Column, words: Iterable[str]) -> Column:
    hit = F.lit(False)
    for i, w in enumerate(words):
        hit = text.contains(w) if i == 0 else hit | text.contains(w)
    return hit


def first_category(text: Column, lexicon: Mapping[str, Iterable[str]], default: str | Column) -> Column:
    """Name of the first lexicon entry, in its given order, with a word inside ``text``."""
    branches = None
    for name, words in lexicon.items():
        cond = contains_any(text, words)
        branches = F.when(cond, F.lit(name)) if branches is None else branches.when(cond, F.lit(name))
    fallback = F.lit(default) if isinstance(default, str) else default
    return fallback if branches is None else branches.otherwise(fallback)


def micros(stamp: Column) -> Column:
    """Microseconds since 1970, for timestamps with and without time zone."""
    return F.unix_micros(stamp.cast("timestamp"))


def first_of(arr: Column) -> Column:
    """First element or NULL."""
    return F.get(arr, F.lit(0))


def one_per_key(pairs: Column, last: bool = False) -> Column:
    """Of an array of (key, value), the first pair of each key, or the last, in the order of the array.

    Sorted twice instead of compared with all others."""
    sign = F.lit(-1 if last else 1)
    placed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), (sign * i).alias("at"), p["value"].alias("value"))))

    def led(sorted_: Column) -> Column:
        kept = F.filter(sorted_, lambda p, i: (i == 0) | (F.get(sorted_, i - 1)["key"] != p["key"]))
        back = F.array_sort(F.transform(kept, lambda p: F.struct((sign * p["at"]).alias("at"), p["key"].alias("key"), p["value"].alias("value"))))
        return F.transform(back, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))

    return let(placed, led)


def sorted_set(arr: Column) -> Column:
    return F.array_sort(F.array_distinct(arr))


def empty_strings() -> Column:
    return F.array().cast("array<string>")
