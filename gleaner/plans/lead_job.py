"""Pages to stored leads, end to end."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import fixed, text as T
from gleaner.operators import leads as L, tables
from gleaner.session import materialize


def page_texts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source_url, text) of every page."""
    return pages.select(F.col(url).alias("source_url"), T.html_to_text(html).alias("text"))


def scored_leads(
    pages: DataFrame,
    now: str,
    type_words: Iterable[str] = fixed.BUSINESS_WORDS,
    model_responses: DataFrame | None = None,
    keywords: Iterable[str] = fixed.TARGET_KEYWORDS,
    geo: str | None = None,
) -> DataFrame:
    """Scored flat leads of pages, and of stored model responses if given. The page part is one
    scan without a shuffle; ``try_`` functions stand in for per-lead error handling."""
    leads = L.flat_leads(page_texts(pages), now, type_words=type_words)
    if model_responses is not None:
        leads = leads.unionByName(L.parse_model_leads(model_responses, now).drop("seq"))
    return L.score_leads(leads, now, keywords, geo)


def run_lead_job(pages: DataFrame, now: str, staged: bool = True, **options) -> dict[str, DataFrame]:
    """Rows for all lead tables, keyed by table name.

    Four tables are made from the same leads, and extraction is the expensive part: with ``staged``
    the leads are extracted once into the checkpoint folder. Otherwise everything stays lazy.
    """
    scored = scored_leads(pages, now, **options)
    if staged:
        scored = materialize(scored, "leads")
    lead, score = tables.store_leads(scored)
    urls, content = tables.upsert_dims(scored, now)
    return {"url": urls, "crawled_content": content, "extracted_lead": lead, "lead_score": score}
