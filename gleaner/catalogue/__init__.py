"""Registered queries with their checking SQL."""

from gleaner.catalogue import (  # noqa: F401
    business_queries, contact_queries, crawl_queries, html_queries, lead_queries, report_queries, search_queries, table_queries, text_queries,
)
from gleaner.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
