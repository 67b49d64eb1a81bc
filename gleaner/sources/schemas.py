"""Schemas of stored inputs and of the lead tables, as DDL."""

PAGE = (
    "url string, final_url string, canonical_url string, status_code int, headers map<string,string>, "
    "content_type string, content_length bigint, html string"
)
SEARCH_RESPONSE = (
    "query string, items array<struct<link:string,title:string,snippet:string,displayLink:string,cacheId:string>>"
)
ROBOTS = "domain string, robots_txt string"
ATTEMPT = "url string, domain string, priority int, ok boolean, ts timestamp"
JOB = (
    "id string, type string, priority int, status string, progress double, payload string, result string, "
    "error string, created_at timestamp, updated_at timestamp"
)
LEAD = (
    "business_name string, contact_person string, email string, phone string, address string, website string, "
    "lead_type string, confidence_score double, extraction_method string, created_at timestamp, source_url string"
)
SCORING = (
    "struct<completeness_score:double,relevance_score:double,freshness_score:double,final_score:double,"
    "scoring_factors:struct<completeness:double,relevance:double,freshness:double>,scored_at:timestamp>"
)
TABLES = {
    "search_query": (
        "id string, query_text string, search_engine string, status string, total_results_found int, created_at timestamp"
    ),
    "url": (
        "id string, url string, domain string, discovered_from string, search_query_id string, first_seen timestamp, "
        "last_crawled timestamp, crawl_status string, http_status_code int, content_type string, "
        "content_length bigint, robots_allowed boolean, created_at timestamp"
    ),
    "crawled_content": (
        "id string, url_id string, raw_html_path string, title string, meta_description string, extracted_text string, "
        "language string, crawl_timestamp timestamp, processing_status string, created_at timestamp"
    ),
    "extracted_lead": (
        "id string, content_id string, business_name string, contact_person string, email string, phone string, "
        "address string, website string, lead_type string, confidence_score double, extraction_method string, "
        "created_at timestamp"
    ),
    "lead_score": (
        "id string, lead_id string, completeness_score double, relevance_score double, freshness_score double, "
        "final_score double, scoring_factors struct<completeness:double,relevance:double,freshness:double>, "
        "scored_at timestamp"
    ),
}
