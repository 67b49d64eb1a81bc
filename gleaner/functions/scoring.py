"""Lead scores. All sums are whole hundredths and are divided once at the end, so equal inputs
give equal doubles on any engine."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import fixed
from gleaner.functions.common import blank_to_null, contains_any, micros


def _filled(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) != ""


def completeness(
    columns: Mapping[str, Column], weights: Mapping[str, int] = fixed.COMPLETENESS_WEIGHTS
) -> Column:
    """Hundredths for each field that has a value."""
    total = F.lit(0)
    for name, weight in weights.items():
        if name in columns:
            total = total + F.when(_filled(columns[name]), weight).otherwise(0)
    return total


def relevance(
    columns: Mapping[str, Column],
    keywords: Iterable[str] = fixed.TARGET_KEYWORDS,
    geo: str | None = None,
) -> Column:
    """Hundredths for target words, target place, website, social profiles and reviews."""
    parts = [
        F.lower(F.coalesce(columns[f], F.lit("")))
        for f in ("business_name", "lead_type", "description", "website") if f in columns
    ]
    text = F.concat_ws(" ", *parts)
    total = F.when(contains_any(text, keywords), 50).otherwise(0)
    if geo:
        total = total + F.when(text.contains(geo.lower()), 20).otherwise(0)
    if "website" in columns:
        total = total + F.when(_filled(columns["website"]), 10).otherwise(0)
    if "social_profiles" in columns:
        total = total + F.when(F.coalesce(F.size(columns["social_profiles"]), F.lit(0)) > 0, 10).otherwise(0)
    if "review_count" in columns:
        total = total + F.when(F.coalesce(columns["review_count"], F.lit(0)) > 0, 10).otherwise(0)
    return F.least(total, F.lit(100))


def _age_points(date_text: Column, now: Column, bands: Iterable[tuple[int, int]]) -> Column:
    stamp = F.try_to_timestamp(date_text)
    days = F.floor((micros(now) - micros(stamp)) / F.lit(86_400_000_000))
    points = None
    for limit, value in bands:
        points = F.when(days < limit, value) if points is None else points.when(days < limit, value)
    return F.coalesce(points.otherwise(0), F.lit(0))


def freshness(columns: Mapping[str, Column], now: Column) -> Column:
    """Hundredths for recent dates and an old domain. Dates in the future count as fresh; dates
    that do not parse count as absent."""

    def value(name: str) -> Column:
        return blank_to_null(columns[name]) if name in columns else F.lit(None).cast("string")

    total = F.lit(0)
    if "publish_date" in columns or "content_date" in columns:
        published = F.coalesce(value("publish_date"), value("content_date"))
        total = total + _age_points(published, now, fixed.PUBLISHED_BANDS)
    for name, bands in (
        ("website_last_updated", fixed.UPDATED_BANDS),
        ("recent_social_activity_date", fixed.SOCIAL_BANDS),
        ("recent_review_date", fixed.REVIEW_BANDS),
    ):
        if name in columns:
            total = total + _age_points(value(name), now, bands)
    if "domain_age_years" in columns:
        total = total + F.when(F.coalesce(columns["domain_age_years"], F.lit(0.0)) > 5, 10).otherwise(0)
    return F.least(total, F.lit(100))


def final(comp: Column, rel: Column, fresh: Column) -> Column:
    """40 % completeness, 40 % relevance, 20 % freshness, in hundredths.

    Completeness is a multiple of 5, the others of 10, so the division by ten is exact.
    """
    return F.floor((comp * 4 + rel * 4 + fresh * 2) / 10)


def to_score(hundredths: Column) -> Column:
    return hundredths / F.lit(100.0)


def as_timestamp(now: str | datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(str(now)).cast("timestamp")
