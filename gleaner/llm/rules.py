"""Quality rules under weak supervision, with DataFrame functions only.

Each rule looks at one measure of a text and votes good (1), bad (-1) or abstains (0). Expectation
maximisation estimates from the votes alone how often each rule votes either way on good and on bad texts,
and how many texts are bad; a text's posterior probability of being good replaces the demand that it pass
every rule. An abstention says nothing, and a rule is taken to be no worse than chance. Votes are counted per pattern first, so the iterations run over at most ``3 ** rules`` rows,
however many texts there are. Expert guesses enter as pseudo-counts worth ``PRIOR_WEIGHT`` of the texts, which
keeps the two classes in place where a corpus holds hardly any bad text.

Defined cases: a null or empty text has no words and fails the base rule; measures look at nothing but
the text, so rows that repeat get equal verdicts whatever their ids; extra columns are carried along by
``passing`` and ignored otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import materialize

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
THRESHOLD = 0.5
ROUNDS = 12
PRIOR_WEIGHT = 0.02
#: guesses to start from: share of bad texts, then how often a rule that votes calls a text bad
BAD_SHARE = 0.15
GUESS = {"good": {1: 0.99, -1: 0.01}, "bad": {1: 0.6, -1: 0.4}}

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures of its texts; row by row, in one stage."""
    text = F.coalesce("text", F.lit(""))

    def without(chars: str) -> Column:
        return F.translate(text, chars, "")

    def count(chars: str) -> Column:
        return F.length(text) - F.length(without(chars))

    with_word = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _SPACE, "")) > 0)
    words = F.filter(F.split(text, "[ \t-\r]+"), lambda x: x != "")
    out = docs.withColumns({"_words": words, "_with_word": with_word}).withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(without(_SPACE)).cast("long"),
        "n_symbols": count(_SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("_with_word") - F.size(F.array_distinct("_with_word"))).cast("long"),
        "_lines": F.size("_with_word").cast("long"),
        "_upper": (F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}+", ""))).cast("long"),
        "_stops": count(".?").cast("long"),
        "_bangs": count("!").cast("long"),
        "_distinct": F.size(F.array_distinct("_words")).cast("long"),
        "_letters": (F.length(text) - F.length(F.regexp_replace(text, "\\p{L}+", ""))).cast("long"),
        "_plain": F.regexp_count(text, F.lit("(?<![^ \t-\r])\\p{L}+[.,;:?]?(?![^ \t-\r])")).cast("long"),
        "_hashes": F.transform("_words", lambda x: F.xxhash64(x)),
    })
    starts = F.when(F.size("_hashes") >= WINDOW, F.sequence(F.lit(0), F.size("_hashes") - WINDOW)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("_windows", F.transform(starts, lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)])))
    # windows next to their equals once sorted, only where a text has equal ones
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn("_sorted", F.when(twice, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    repeated = F.filter("_sorted", lambda x, i: same(x, F.get("_sorted", i - 1)) | same(x, F.get("_sorted", i + 1)))
    out = out.withColumn("_places", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    covered = F.transform("_places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", i + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0), lambda a, b: a + b)
    # the row number keeps a filter on the measures from being pushed down and spelled out over the text
    out = out.withColumns({"n_repeat_words": F.coalesce(total, F.lit(0)).cast("long"), "_row": F.monotonically_increasing_id()})
    return out.drop(
        "_words", "_with_word", "_hashes", "_windows", "_sorted", "_places"
    )


def votes() -> dict[str, Column]:
    """The rules as columns over the measures: 1 good, -1 bad, 0 abstains."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")

    def rule(value: Column, good: tuple[float, float], fair: tuple[float, float], sure: Column | None = None) -> Column:
        """Good within the first range, abstaining within the second, bad outside."""
        vote = F.when(value.between(*good), 1).when(value.between(*fair), 0).otherwise(-1)
        return vote if sure is None else F.when(sure, vote).otherwise(0)

    some = F.col("n_words") >= 20
    return {
        "symbols": rule(F.col("n_symbols") / chars, (0, 0.03), (0, 0.06)),
        "letters": rule(F.col("_letters") / chars, (0.94, 1), (0.9, 1)),
        "plain": rule(F.col("_plain") / words, (0.85, 1), (0.7, 1)),
        "repeats": rule(F.col("n_repeat_words") / words, (0, 0.05), (0, 0.2)),
        "lines": rule(F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1)), (0, 0.1), (0, 0.4)),
        "length": rule(chars / words, (3, 10), (2.5, 13)),
        "capitals": rule(F.col("_upper") / chars, (0, 0.2), (0, 0.4)),
        "shouting": rule(F.col("_bangs") / words, (0, 0.1), (0, 0.3)),
        "sentences": rule(F.col("_stops") / words, (0.015, 0.34), (0.005, 0.6), some),
        "variety": rule(F.col("_distinct") / F.sqrt(words), (3.5, 1e9), (2.2, 1e9), some),
    }


def estimate(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> dict[str, float]:
    """Log weight of every vote and of the share of good texts, from ``patterns`` (the rules and ``n``).

    All rounds are one expression over one row that holds the patterns, at most ``3 ** rules`` of them.
    """
    slots = [(name, v) for name in names for v in (1, -1)]
    # slot 2j + 1 or 2j + 2 of the state holds the log weight of rule j's vote; an abstention has none
    place = F.filter(
        F.array(*[F.when(F.col(name) == 1, 2 * j + 1).when(F.col(name) == -1, 2 * j + 2) for j, name in enumerate(names)]),
        lambda k: k.isNotNull(),
    )
    cast = F.array(*[F.lit(2 * (k // 2) + 1) for k in range(len(slots))])  # the slot of the rule's good vote
    row = patterns.agg(F.collect_list(F.struct(F.col("n").cast("double").alias("n"), place.alias("slots"))).alias("p"))
    row = row.withColumn("total", F.aggregate("p", F.lit(0.0), lambda a, x: a + x["n"]))
    weight = F.col("total") * PRIOR_WEIGHT
    guess = {side: F.array(*[F.lit(GUESS[side][v]) for _, v in slots]) for side in GUESS}
    start = F.array(
        F.lit(math.log((1 - BAD_SHARE) / BAD_SHARE)), *[F.lit(math.log(GUESS["good"][v] / GUESS["bad"][v])) for _, v in slots]
    )

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def step(state: Column) -> Column:
        good = F.transform("p", lambda x: x["n"] / (1.0 + F.exp(
            -(F.get(state, F.lit(0)) + total(F.transform(x["slots"], lambda k: F.get(state, k))))
        )))

        def updated(mass: Column) -> Column:
            n_good = total(mass)
            n_bad = F.col("total") - n_good
            share = (n_good + weight * (1 - BAD_SHARE)) / (F.col("total") + weight)

            def held(values: Column, k: Column) -> Column:
                """What the patterns with vote ``k`` hold."""
                return total(F.transform(values, lambda x, i: F.when(F.array_contains(F.get("p", i)["slots"], k), x).otherwise(0.0)))

            def log_ratio(k: Column) -> Column:
                first = F.get(cast, k - 1)
                rest = F.transform("p", lambda x, i: x["n"] - F.get(mass, i))
                good_vote, good_all = held(mass, k), held(mass, first) + held(mass, first + 1)
                bad_vote, bad_all = held(rest, k), held(rest, first) + held(rest, first + 1)
                p_good = (good_vote + weight * F.get(guess["good"], k - 1)) / (good_all + weight)
                p_bad = (bad_vote + weight * F.get(guess["bad"], k - 1)) / (bad_all + weight)
                ratio = F.log(p_good / p_bad)
                return F.when(k == first, F.greatest(ratio, F.lit(0.0))).otherwise(F.least(ratio, F.lit(0.0)))

            return F.concat(
                F.array(F.log(share / (1 - share))), F.transform(F.sequence(F.lit(1), F.lit(len(slots))), log_ratio)
            )

        return F.get(F.transform(F.array(good), updated), F.lit(0))

    final = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda state, _: step(state))
    logs = row.select(F.when(F.col("total") > 0, final).otherwise(start).alias("logs")).first()["logs"]
    return {"share": logs[0], **{f"{name}:{v}": logs[i + 1] for i, (name, v) in enumerate(slots)}}


def posterior(logs: dict[str, float], rules: dict[str, Column]) -> Column:
    """Probability that a text is good, given its votes."""
    total = F.lit(logs["share"])
    for name, vote in rules.items():
        total = total + F.when(vote == 1, logs[f"{name}:1"]).when(vote == -1, logs[f"{name}:-1"]).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _patterns(measures: DataFrame) -> DataFrame:
    rules = votes()
    counted = measures.select(*[c.alias(k) for k, c in rules.items()]).groupBy(*rules).agg(F.count("*").alias("n"))
    return materialize(counted, "votes")


def _verdict(measures: DataFrame, logs: dict[str, float]) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measures.withColumns({"quality": posterior(logs, votes()), "base_failed": failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= THRESHOLD)
    )


def judged(docs: DataFrame) -> DataFrame:
    """One row per document: the base measures, the posterior ``quality`` and the verdict."""
    measures = materialize(measured(docs.select("doc_id", "text")).drop("text", "_row"), "measures")
    logs = estimate(_patterns(measures), list(votes()))
    return _verdict(measures, logs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"
    )


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    Texts are measured once: rows and measures are written, and the votes are counted and weighed from there.
    """
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    stored = materialize(measured(own.withColumn("text", F.col(names["text"]))).drop("text", "_row"), "rules")
    logs = estimate(_patterns(stored), list(votes()))
    return _verdict(stored, logs).filter("kept").select(*[F.col(n).alias(c) for c, n in names.items()])
