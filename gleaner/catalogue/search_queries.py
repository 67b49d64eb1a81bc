"""Search requests, stored hits and their processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalogue import sql as S
from gleaner.catalogue.registry import query, table
from gleaner.functions import fixed
from gleaner.operators import search as X
from gleaner.plans.search_batch import run_search_batch
from gleaner.sources import readers, schemas

# a stored response holds 25 pages, and every third of them a second time
_G = "page_id - page_id % 25"
REQUEST = {
    "query": "concat('tours ', g)",
    "location": "CASE WHEN g % 75 = 0 THEN NULL ELSE concat('City ', g % 175) END",
    "priority": "g % 100",
    "max_results": "10 + g % 45",
    "g": "g",
}
REQUESTS_SQL = (
    "SELECT " + ", ".join(f"{e} AS {n}" for n, e in REQUEST.items()) + f" FROM (SELECT DISTINCT {_G} AS g FROM pages) x"
)
_TERMS = " ".join([*fixed.TRAVEL_TERMS, *fixed.TARGET_GROUP_TERMS, *fixed.TRIP_TYPE_TERMS])
_MINUS = " ".join(f"-{w}" for w in fixed.EXCLUDED_TERMS)
_SEARCH_TEXT = f"concat_ws(' ', query, location, '{_TERMS}', '{_MINUS}')"

_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
HIT = {
    "seq": "page_id % 25 + 1 + 25 * dup",
    "link": "CASE WHEN page_id % 17 = 0 AND dup = 0 THEN NULL WHEN page_id % 17 = 1 THEN concat(url, '&from=pinterest.com') ELSE url END",
    "title": f"CASE WHEN page_id % 7 = 0 THEN concat('Hotel ', {_TITLE}) WHEN page_id % 7 = 3 THEN NULL ELSE {_TITLE} END",
    "snippet": "concat('page ', page_id)",
    "displayLink": "regexp_extract(url, '//([^/]*)', 1)",
    "cacheId": "CASE WHEN page_id % 2 = 0 THEN concat('c', page_id) END",
}
_COPIES = "SELECT *, 0 AS dup FROM pages UNION ALL SELECT *, 1 AS dup FROM pages WHERE page_id % 3 = 0"
HITS_SQL = (
    f"SELECT concat('tours ', {_G}) AS query, " + ", ".join(f"{e} AS {n}" for n, e in HIT.items()) + f" FROM ({_COPIES}) c"
)
LOW = [*fixed.LOW_QUALITY_DOMAINS, "spam-farm"]
CATEGORIES = {"blog": ["blog", "post"], "business": ["hotel", "resort"], "social": ["//m.", "facebook"]}


def requests(spark, sf):
    g = table(spark, sf, "pages").select(F.expr(_G).alias("g")).distinct()
    return g.select(*[F.expr(e).alias(n) for n, e in REQUEST.items()])


def hits(spark, sf):
    pages = table(spark, sf, "pages")
    again = pages.filter("page_id % 3 = 0").withColumn("dup", F.lit(1))
    copies = pages.withColumn("dup", F.lit(0)).union(again)
    return copies.select(F.expr(f"concat('tours ', {_G})").alias("query"), *[F.expr(e).alias(n) for n, e in HIT.items()])


def _category(url: str, title: str) -> str:
    return S.first_of_lexicon(f"lower({url} || chr(10) || coalesce({title}, ''))", CATEGORIES, "'other'")


@query(
    "search_hit_scan",
    f"""SELECT query, row_number() OVER (PARTITION BY query ORDER BY seq) AS seq, coalesce(link, '') AS link, coalesce(title, '') AS title,
    snippet, coalesce(cacheId, '') AS cache_id FROM ({HITS_SQL}) h""",
)
def _(spark, sf):
    # stored responses as they come from disk: one JSON text per query
    item = F.struct("seq", "link", "title", "snippet", "displayLink", "cacheId")
    stored = hits(spark, sf).groupBy("query").agg(F.array_sort(F.collect_list(item)).alias("items"))
    as_json = stored.select(F.to_json(F.struct("query", "items")).alias("body"))
    parsed = as_json.select(F.from_json("body", f"struct<{_json_type(schemas.SEARCH_RESPONSE)}>").alias("r")).select("r.*")
    out = readers.flatten_responses(parsed)
    return out.select(
        "query", F.col("seq").cast("bigint").alias("seq"), F.coalesce("link", F.lit("")).alias("link"),
        F.coalesce("title", F.lit("")).alias("title"), "snippet", F.coalesce("cacheId", F.lit("")).alias("cache_id"),
    )


def _json_type(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString().removeprefix("struct<").removesuffix(">")


@query("search_texts", f"SELECT query, {_SEARCH_TEXT} AS search_text FROM ({REQUESTS_SQL}) r")
def _(spark, sf):
    return X.build_queries(requests(spark, sf)).select("query", "search_text")


@query(
    "search_texts_custom",
    f"""SELECT query, trim(concat_ws(' ', query, location, '{' '.join(fixed.TRAVEL_TERMS)}', 'extra ' || priority, '-no -x' || g)) AS search_text
    FROM ({REQUESTS_SQL}) r""",
)
def _(spark, sf):
    text = X.build_query(
        F.col("query"), F.col("location"), include=F.array(F.lit("extra")), extra=F.array(F.col("priority").cast("string")),
        exclude=F.array(F.lit("no"), F.concat(F.lit("x"), "g")), target_groups=False, trip_types=False,
    )
    return requests(spark, sf).select("query", text.alias("search_text"))


@query("domain_quality", f"SELECT page_id, url FROM pages WHERE NOT {S.any_of('url', LOW)}")
def _(spark, sf):
    return X.drop_low_quality(table(spark, sf, "pages").select("page_id", "url"), "url", LOW)


@query("result_category", f"SELECT page_id, {_category('url', _TITLE)} AS category FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", X.result_category(F.col("url"), F.expr(_TITLE), CATEGORIES).alias("category")
    )


@query(
    "first_seen_results",
    f"""SELECT link, query, seq FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY query, seq) AS rn FROM ({HITS_SQL}) h
    WHERE link IS NOT NULL) x WHERE rn = 1""",
)
def _(spark, sf):
    # across all searches
    rows = hits(spark, sf).filter("link is not null").select("query", "seq", "link")
    return X.first_seen(rows, ["link"], ["query", "seq"]).select("link", "query", "seq")


def _processed(source: str) -> str:
    return f"""SELECT query, seq, url, title, description, category, display_link FROM (SELECT query, seq, link AS url, coalesce(title, '') AS title,
      snippet AS description, {_category('link', 'title')} AS category, displayLink AS display_link,
      row_number() OVER (PARTITION BY query, link ORDER BY seq) AS rn FROM ({source}) h
      WHERE link IS NOT NULL AND NOT {S.any_of('link', LOW)}) x WHERE rn = 1"""


@query("processed_results", _processed(HITS_SQL))
def _(spark, sf):
    return _flat(X.process_hits(hits(spark, sf), LOW, CATEGORIES))


def _flat(df):
    return df.select("query", "seq", "url", "title", "description", "category", F.col("metadata.displayLink").alias("display_link"))


@query(
    "capped_results",
    f"SELECT query, seq, snippet FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY seq) AS rn FROM ({HITS_SQL}) h) x WHERE rn <= 12",
)
def _(spark, sf):
    return X.cap_per_query(hits(spark, sf), 12).select("query", "seq", "snippet")


@query("search_job_order", f"SELECT query, priority, g AS timestamp FROM ({REQUESTS_SQL}) r ORDER BY priority, timestamp")
def _(spark, sf):
    return X.order_jobs(requests(spark, sf).withColumnRenamed("g", "timestamp")).select("query", "priority", "timestamp")


@query(
    "search_metrics",
    f"""SELECT (SELECT count(*) FROM ({REQUESTS_SQL}) r) AS total_jobs, (SELECT count(*) FROM ({HITS_SQL}) h) AS total_results,
    (SELECT count(*) FROM ({_processed(HITS_SQL)}) p) AS deduped_results,
    (SELECT epoch(max(ts)) - epoch(min(ts)) FROM events) AS elapsed_time""",
)
def _(spark, sf):
    # the jobs run over the whole period of the event table
    events = table(spark, sf, "events")
    jobs = requests(spark, sf).select(
        "query", events.agg(F.min("ts")).scalar().alias("started_at"), events.agg(F.max("ts")).scalar().alias("finished_at")
    )
    h = hits(spark, sf)
    return X.search_metrics(jobs, h, X.process_hits(h, LOW, CATEGORIES))


@query(
    "search_to_frontier",
    f"""SELECT query, rn AS position, url FROM (SELECT query, url, row_number() OVER (PARTITION BY query ORDER BY seq) AS rn
    FROM ({_processed(HITS_SQL)}) p) x WHERE rn <= 10""",
)
def _(spark, sf):
    out = X.to_frontier(X.process_hits(hits(spark, sf), LOW, CATEGORIES))
    return out.select("query", F.col("position").cast("bigint").alias("position"), "url")


@query(
    "search_batch",
    _processed(f"SELECT h.* FROM ({HITS_SQL}) h JOIN ({REQUESTS_SQL}) r ON h.query = r.query WHERE h.seq <= r.max_results"),
)
def _(spark, sf):
    r = requests(spark, sf)
    # responses are stored under the text that was searched for
    texts = X.build_queries(r).select("query", "search_text")
    stored = hits(spark, sf).join(texts, "query").drop("query").withColumnRenamed("search_text", "query")
    return _flat(run_search_batch(r, stored, LOW, CATEGORIES))
