"""Search requests against stored search responses."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import fixed
from gleaner.operators import search
from gleaner.operators.skew import salted_join


def run_search_batch(
    requests: DataFrame,
    hits: DataFrame,
    domains: Iterable[str] = fixed.LOW_QUALITY_DOMAINS,
    lexicon: Mapping[str, Iterable[str]] = fixed.RESULT_CATEGORIES,
    **flags,
) -> DataFrame:
    """Results of all requests: search text, stored hits, per-request cap, processing.

    ``hits.query`` holds the search text a response was stored under, and ``hits.seq`` the position
    in it from 1, so a request's own limit is a filter and needs no ranking. One text may hold most
    of the hits, so the join is salted on their side.
    """
    wanted = search.build_queries(requests, **flags).select(
        F.col("search_text"), F.col("query").alias("request"), "priority", "max_results"
    )
    stored = hits.withColumnRenamed("query", "search_text")
    matched = salted_join(stored, wanted, "search_text")
    capped = matched.filter(F.col("seq") <= F.col("max_results"))
    processed = search.process_hits(
        capped.select(
            F.col("request").alias("query"), "seq", "link", "title", "snippet", "displayLink", "cacheId"
        ),
        domains,
        lexicon,
    )
    return processed
