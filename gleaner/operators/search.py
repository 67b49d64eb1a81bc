"""Search requests and search results."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import fixed
from gleaner.functions.common import contains_any, first_category, micros


def build_query(
    base: Column | None = None,
    location: Column | None = None,
    include: Column | None = None,
    extra: Column | None = None,
    exclude: Column | Iterable[str] | None = None,
    travel_terms: bool = True,
    target_groups: bool = True,
    trip_types: bool = True,
) -> Column:
    """Search text: base, location, fixed term groups, further terms, then ``-word`` exclusions.

    ``include``, ``extra`` and ``exclude`` are array columns; NULL or '' parts are left out.
    """
    groups = [
        *(fixed.TRAVEL_TERMS if travel_terms else []),
        *(fixed.TARGET_GROUP_TERMS if target_groups else []),
        *(fixed.TRIP_TYPE_TERMS if trip_types else []),
    ]
    parts = [F.nullif(p, F.lit("")) for p in (base, location) if p is not None]
    parts += [F.lit(" ".join(groups))] if groups else []
    parts += [F.concat_ws(" ", p) for p in (include, extra) if p is not None]
    if exclude is None:
        exclude = fixed.EXCLUDED_TERMS
    if isinstance(exclude, Column):
        minus = F.concat_ws(" ", F.transform(exclude, lambda w: F.concat(F.lit("-"), w)))
    else:
        minus = F.lit(" ".join(f"-{w}" for w in exclude))
    return F.trim(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in [*parts, minus]]))


def build_queries(requests: DataFrame, **flags) -> DataFrame:
    """Requests with ``search_text`` built from their query and location."""
    location = F.col("location") if "location" in requests.columns else None
    return requests.withColumn("search_text", build_query(F.col("query"), location, **flags))


def drop_low_quality(
    hits: DataFrame, url: str = "url", domains: Iterable[str] = fixed.LOW_QUALITY_DOMAINS
) -> DataFrame:
    return hits.filter(~contains_any(F.col(url), domains))


def result_category(
    url: Column, title: Column, lexicon: Mapping[str, Iterable[str]] = fixed.RESULT_CATEGORIES
) -> Column:
    # a blank keeps the two texts apart
    text = F.lower(F.concat_ws("\n", url, F.coalesce(title, F.lit(""))))
    return first_category(text, lexicon, "other")


def first_seen(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """The first row of each key in the given order.

    A minimum over (order, row) is combined on the map side. A window would sort all copies of a
    URL in one task, however many there are.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return best.select(*keys, "_first.*").select(*rows.columns)


def process_hits(
    hits: DataFrame,
    domains: Iterable[str] = fixed.LOW_QUALITY_DOMAINS,
    lexicon: Mapping[str, Iterable[str]] = fixed.RESULT_CATEGORIES,
) -> DataFrame:
    """Raw hits (query, seq, link, title, snippet, displayLink, cacheId) to processed results:
    rows without a link and of unwanted domains dropped, category added, first hit per URL kept."""
    named = hits.filter(F.coalesce(F.col("link"), F.lit("")) != "").select(
        "query", "seq", F.col("link").alias("url"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("snippet", F.lit("")).alias("description"),
        result_category(F.col("link"), F.col("title"), lexicon).alias("category"),
        F.struct("displayLink", "cacheId").alias("metadata"),
    )
    return first_seen(drop_low_quality(named, "url", domains), ["query", "url"], ["seq"])


def cap_per_query(hits: DataFrame, max_results: int = fixed.MAX_RESULTS) -> DataFrame:
    """At most ``max_results`` hits per query. ``row_number() <= k`` becomes a group limit that
    runs before the shuffle, so a hot query sends only k rows per task."""
    rn = F.row_number().over(W.partitionBy("query").orderBy("seq"))
    return hits.withColumn("_rn", rn).filter(F.col("_rn") <= max_results).drop("_rn")


def order_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs in running order: lower priority value first, then by time."""
    return jobs.orderBy("priority", "timestamp")


def to_frontier(processed: DataFrame, per_query: int = fixed.CRAWLS_PER_SEARCH) -> DataFrame:
    """The first results of each query as crawl requests."""
    rn = F.row_number().over(W.partitionBy("query").orderBy("seq"))
    return (
        processed.withColumn("_rn", rn)
        .filter(F.col("_rn") <= per_query)
        .select("query", F.col("_rn").alias("position"), "url", F.lit(0).alias("priority"))
    )


def search_metrics(jobs: DataFrame, hits: DataFrame, processed: DataFrame) -> DataFrame:
    """One row: jobs, raw results, results after deduplication, elapsed seconds."""
    span = (micros(F.max("finished_at")) - micros(F.min("started_at"))) / F.lit(1e6)
    return jobs.agg(F.count("*").alias("total_jobs"), span.alias("elapsed_time")).select(
        "total_jobs",
        hits.agg(F.count("*")).scalar().alias("total_results"),
        processed.agg(F.count("*")).scalar().alias("deduped_results"),
        "elapsed_time",
    )
