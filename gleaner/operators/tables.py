"""Lead tables: URL and content rows, stored leads and scores, views and statistics.

Ids are not counted up, which would need one writer. Each is the first 128 bits of the SHA-256 of
a natural key: a rerun gives the same id, and a foreign key is computed from the row at hand
instead of being looked up by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import scoring as S, urls as U
from gleaner.functions.common import blank_to_null, col
from gleaner.operators import leads as L
from gleaner.operators.skew import salted_join
from gleaner.session import materialize

#: pages that end before this row are taken as the least rows of each task
NEAR_PAGES = 10_000


def make_id(*parts: Column) -> Column:
    """128-bit id of a natural key. NULL and '' stay different, and parts cannot run together."""
    texts = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("~")) for p in parts]
    return F.substring(F.sha2(F.encode(F.concat_ws("\x1f", *texts), "UTF-8"), 256), 1, 32)


def source_of(source_url: Column | str) -> Column:
    """Source URL with missing values named 'unknown'."""
    s = F.coalesce(blank_to_null(col(source_url)), F.lit("unknown"))
    return F.when(s == "None", "unknown").otherwise(s)


def url_id(source_url: Column | str) -> Column:
    return make_id(F.lit("url"), source_of(source_url))


def content_id(source_url: Column | str) -> Column:
    return make_id(F.lit("content"), source_of(source_url))


LEAD_KEY = [
    "source_url", "email", "phone", "business_name", "contact_person", "address", "website", "lead_type",
    "extraction_method",
]


def lead_id(columns: list[str]) -> Column:
    """Id of a lead: of the id it came with, else of what it says and where it was found."""
    key = ["id"] if "id" in columns else LEAD_KEY
    return make_id(F.lit("lead"), *[F.col(c) for c in key])


def upsert_dims(
    leads: DataFrame, now: str, url: DataFrame | None = None, content: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """New rows for the ``url`` and ``crawled_content`` tables, one per source not stored yet.

    Sources are made distinct first (combined on the map side), so a source with very many leads is
    one row when it meets the stored tables.
    """
    stamp = S.as_timestamp(now)
    sources = leads.select(source_of("source_url").alias("url")).distinct()
    new_urls = sources if url is None else sources.join(url.select("url"), "url", "left_anti")
    new_urls = new_urls.select(
        url_id("url").alias("id"), "url", U.domain("url").alias("domain"),
        F.lit("lead_extraction").alias("discovered_from"), F.lit("completed").alias("crawl_status"),
        stamp.alias("created_at"),
    )
    rows = sources.select(
        content_id("url").alias("id"), url_id("url").alias("url_id"), F.lit("").alias("raw_html_path"),
        F.concat(F.lit("Content from "), "url").alias("title"), F.lit("").alias("extracted_text"),
        F.lit("completed").alias("processing_status"), stamp.alias("created_at"),
    )
    if content is not None:
        rows = rows.join(content.select("url_id"), "url_id", "left_anti").select(*rows.columns)
    return new_urls, rows


def store_leads(leads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``extracted_lead`` and ``lead_score``. A lead without scoring has no score row."""
    rows = leads.withColumn("id", lead_id(leads.columns)).withColumn("content_id", content_id("source_url"))
    lead_rows = rows.select(
        "id", "content_id", "business_name", "contact_person", "email", "phone", "address", "website",
        "lead_type", "confidence_score", "extraction_method", "created_at",
    )
    if "scoring" not in leads.columns:
        return lead_rows, None
    score_rows = rows.filter(F.col("scoring").isNotNull()).select(
        make_id(F.lit("score"), F.col("id"), F.col("scoring.scored_at")).alias("id"),
        F.col("id").alias("lead_id"),
        *[F.col(f"scoring.{c}").alias(c) for c in (
            "completeness_score", "relevance_score", "freshness_score", "final_score", "scoring_factors", "scored_at",
        )],
    )
    return lead_rows, score_rows


def lead_view(lead: DataFrame, content: DataFrame, url: DataFrame, score: DataFrame) -> DataFrame:
    """Leads with source URL and their first scoring; both may be missing.

    The first score is a minimum per lead, not a window. Source tables are joined with each other
    before they meet the leads; a source that has very many leads is salted.
    """
    sources = content.select(F.col("id").alias("content_id"), "url_id").join(
        url.select(F.col("id").alias("url_id"), F.col("url").alias("source_url")), "url_id", "left"
    ).select("content_id", "source_url")
    first = score.groupBy("lead_id").agg(
        F.min(F.struct("scored_at", "id", "completeness_score", "relevance_score", "freshness_score",
                       "final_score", "scoring_factors")).alias("s")
    ).select(
        F.col("lead_id").alias("id"),
        F.struct("s.completeness_score", "s.relevance_score", "s.freshness_score", "s.final_score",
                 "s.scoring_factors", "s.scored_at").alias("scoring"),
    )
    return (
        salted_join(lead, sources, "content_id", "left").join(first, "id", "left")
        .select("id", *L.LEAD_COLUMNS, "scoring")
    )


def lead_page(view: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` by creation time and id; no limit, or 0, means all.

    Pages near the start are the least rows of each task. Others are found by number: rows are dealt by
    ranges and written once, and the number of rows in the ranges before tells where a range begins,
    so no task sorts more than its range.
    """
    if limit and offset + limit <= NEAR_PAGES or not offset:
        out = view.orderBy("created_at", "id")
        out = out.offset(offset) if offset else out
        return out.limit(limit) if limit else out
    dealt = materialize(
        view.repartitionByRange("created_at", "id").withColumn("_range", F.spark_partition_id()), "ranges"
    )
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("created_at", "id"))
    numbered = dealt.withColumn("_own", own).join(starts, "_range").withColumn("_at", F.col("_start") + F.col("_own"))
    wanted = F.col("_at") > offset
    if limit:
        wanted &= F.col("_at") <= offset + limit
    return numbered.filter(wanted).orderBy("created_at", "id").select(*view.columns)


def lead_stats(lead: DataFrame) -> DataFrame:
    return lead.groupBy("lead_type", "extraction_method").agg(F.count("*").alias("n_leads"))


def lead_count(lead: DataFrame) -> DataFrame:
    return lead.agg(F.count("*").alias("total_leads"))


def page_envelope(view: DataFrame, page: int = 1, page_size: int = 20) -> tuple[DataFrame, DataFrame]:
    """One page of leads, and one row (total, page, page_size)."""
    rows = lead_page(view, page_size, (page - 1) * page_size)
    head = view.agg(F.count("*").alias("total")).select(
        "total", F.lit(page).alias("page"), F.lit(page_size).alias("page_size")
    )
    return rows, head


def ingest_leads(leads: DataFrame, now: str, **scoring) -> tuple[DataFrame, DataFrame]:
    """Leads supplied from outside: scored, then stored."""
    return store_leads(L.score_leads(leads, now, **scoring))
