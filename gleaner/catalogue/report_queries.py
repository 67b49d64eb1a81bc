"""Operational reports and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleaner.catalogue import crawl_queries as CQ, inputs as I, lead_queries as LQ, sql as S
from gleaner.catalogue.registry import query, table
from gleaner.operators import reports as X, tables
from gleaner.session import checkpoint_dir
from gleaner.sources import sinks
from gleaner.sources.upserts import UpsertTable
from gleaner.streaming import jobs as K
from gleaner.streaming.visited import VisitedUrls
from gleaner.streaming.windows import WindowedSums

# jobs, crawls and log lines spelled from events
JOB = {
    "id": "event_id",
    "type": "CASE event_id % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'crawl' ELSE 'lead_processing' END",
    "status": "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'in_progress' WHEN 'error' THEN 'failed' ELSE 'completed' END",
    "progress": "CASE WHEN event_type = 'view' THEN 0.0 ELSE 1.0 END",
    "payload": "props",
    "result": "CASE WHEN event_type IN ('purchase', 'signup') THEN 'ok' END",
    "error": "CASE WHEN event_type = 'error' THEN concat('failed for ', user_id) END",
    "duration": "value",
}
JOBS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in JOB.items()) + ", ts AS created_at, ts AS updated_at FROM events"
METRICS_SQL = """SELECT ts, concat('site', user_id % 13) AS domain, CASE WHEN event_type IN ('view', 'click') THEN user_id % 4 ELSE 0 END AS pages,
    CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS leads, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS api_calls,
    CASE WHEN event_type = 'signup' THEN 0.25 ELSE 0 END AS api_cost, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 100 END AS duration_sec FROM events"""


def jobs(spark, sf):
    fields = [F.expr(e).alias(n) for n, e in JOB.items()]
    return table(spark, sf, "events").select(*fields, F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))


def metrics(events):
    return events.selectExpr(
        "ts", "concat('site', user_id % 13) AS domain",
        "CASE WHEN event_type IN ('view', 'click') THEN user_id % 4 ELSE 0 END AS pages",
        "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS leads",
        "CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS api_calls",
        "CASE WHEN event_type = 'signup' THEN 0.25D ELSE 0D END AS api_cost",
        "CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 100 END AS duration_sec",
    )


@query(
    "job_backlog",
    f"""SELECT count(*) FILTER (WHERE type = 'search' AND status IN ('pending', 'in_progress')) AS search_jobs,
    count(*) FILTER (WHERE type = 'crawl' AND status IN ('pending', 'in_progress')) AS crawl_jobs, (SELECT count(*) FROM orders) AS leads FROM ({JOBS_SQL}) j""",
)
def _(spark, sf):
    return X.backlog(jobs(spark, sf), LQ.order_leads(spark, sf))


@query("job_list", f"SELECT id AS job_id, type, status, payload, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM ({JOBS_SQL}) j")
def _(spark, sf):
    out = X.list_jobs(jobs(spark, sf))
    return out.select("job_id", "type", "status", "payload", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("job_lookup", f"SELECT id AS job_id, type, status, coalesce(result, '') AS result, coalesce(error, '') AS error FROM ({JOBS_SQL}) j WHERE id = 123")
def _(spark, sf):
    out = X.job_by_id(jobs(spark, sf), 123)
    return out.select("job_id", "type", "status", *[F.coalesce(c, F.lit("")).alias(c) for c in ("result", "error")])


@query(
    "job_outcomes",
    f"""SELECT id, type, CASE WHEN err IS NULL THEN 'completed' ELSE 'failed' END AS status, coalesce(err, '') AS error FROM
    (SELECT id, type, CASE WHEN duration > lim THEN 'Job timed out after ' || lim || ' seconds' WHEN error IS NOT NULL THEN error
      WHEN result IS NULL THEN 'No result or exception returned' END AS err FROM
      (SELECT *, CASE type WHEN 'search' THEN 30 WHEN 'crawl' THEN 25 ELSE 20 END AS lim FROM ({JOBS_SQL}) j) k) l""",
)
def _(spark, sf):
    return X.job_outcome(jobs(spark, sf)).select("id", "type", "status", F.coalesce("error", F.lit("")).alias("error"))


@query(
    "throughput",
    f"""SELECT *, leads_extracted / uptime_hours AS leads_per_hour, pages_crawled / uptime_hours AS pages_per_hour, api_cost / leads_extracted AS avg_api_cost_per_lead
    FROM (SELECT sum(pages)::BIGINT AS pages_crawled, sum(leads)::BIGINT AS leads_extracted, sum(api_calls)::BIGINT AS api_calls, sum(api_cost)::DOUBLE AS api_cost,
      (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS uptime_hours FROM ({METRICS_SQL}) m) t""",
)
def _(spark, sf):
    return X.throughput(metrics(table(spark, sf, "events")))


@query(
    "crawl_efficiency",
    f"""SELECT domain, sum(pages)::BIGINT AS pages, sum(pages) * 3600.0::DOUBLE / sum(duration_sec) AS pages_per_hour FROM ({METRICS_SQL}) m
    WHERE duration_sec > 0 GROUP BY domain""",
)
def _(spark, sf):
    return X.crawl_efficiency(metrics(table(spark, sf, "events")))


@query(
    "success_rates",
    """SELECT sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)::BIGINT * 100.0::DOUBLE / count(*) AS crawl_success_rate,
    sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END)::BIGINT * 100.0::DOUBLE / sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)::BIGINT AS lead_success_rate
    FROM events""",
)
def _(spark, sf):
    return X.success_rates(table(spark, sf, "events").select(
        (F.col("event_type") != "error").alias("crawl_ok"), F.col("event_type").isin("purchase", "signup").alias("lead_ok")
    ))


def _log(spark, sf):
    """Event log lines; every 50th line is cut short."""
    e = table(spark, sf, "events")
    line = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"),
        F.col("event_type").alias("event"), F.col("user_id"), F.get_json_object("props", "$.k").alias("k"),
    ))
    return e.select(F.when(F.col("event_id") % 50 == 0, F.substring(line, 1, 30)).otherwise(line).alias("line"))


@query(
    "event_log",
    """SELECT CASE WHEN cut THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS ts, CASE WHEN cut THEN '' WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
    CASE WHEN cut THEN '' ELSE event_type END AS event, CASE WHEN cut THEN '' ELSE user_id::VARCHAR END AS user_id,
    CASE WHEN cut THEN '' ELSE json_extract_string(props, '$.k') END AS k FROM (SELECT *, event_id % 50 = 0 AS cut FROM events) e""",
)
def _(spark, sf):
    out = X.parse_event_log(_log(spark, sf))
    return out.select(
        F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("ts"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("level", "event")],
        *[F.coalesce(F.col("fields")[c], F.lit("")).alias(c) for c in ("user_id", "k")],
    )


@query(
    "event_counts",
    """SELECT coalesce(level, '') AS level, coalesce(event, '') AS event, count(*) AS n_events FROM (SELECT CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
    CASE WHEN event_id % 50 <> 0 THEN event_type END AS event FROM events) e GROUP BY 1, 2""",
)
def _(spark, sf):
    out = X.event_counts(X.parse_event_log(_log(spark, sf)))
    return out.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("level", "event")], "n_events")


# --- streams -------------------------------------------------------------------------------
def _stream(spark, sf, name):
    """A table of the test folder, a file or a folder of files, as a file stream."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    # as a pattern: a stream takes a plain path for a folder, and a file fails
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _batches(df, order, files: int = 3):
    """Rows dealt over files by ``order``, which a stream reads in batches of one file each."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    df.repartitionByRange(files, order).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _base(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("stream_incremental_leads", f"SELECT source_url, business_name, email, phone, lead_type, final_score FROM ({LQ.FLAT_SCORED_SQL}) v WHERE NOT starts_with(source_url, 'doc:') AND NOT contains(source_url, '/dir/home')")
def _(spark, sf):
    base = f"{checkpoint_dir(spark)}/leads-{uuid.uuid4().hex}"
    store = sinks.Tables(spark, f"{base}/tables")
    K.incremental_leads(
        _stream(spark, sf, "pages"), store, f"{base}/checkpoint", I.NOW, keywords=LQ._KEYWORDS
    ).awaitTermination()
    view = tables.lead_view(*[store.read(t) for t in ("extracted_lead", "crawled_content", "url", "lead_score")])
    return view.select(
        "source_url", "business_name", F.coalesce("email", F.lit("")).alias("email"),
        F.coalesce("phone", F.lit("")).alias("phone"), "lead_type", "scoring.final_score",
    )


def _attempts(spark, sf):
    return table(spark, sf, "events").select(
        F.expr(CQ._URL).alias("url"), (F.col("event_type") != "error").alias("ok"), F.col("ts").cast("timestamp").alias("ts")
    )


@query("stream_distinct_urls", f"SELECT DISTINCT url FROM ({CQ.ATTEMPTS_SQL}) a")
def _(spark, sf):
    # dealt by a hash: URLs and event times are mixed over the batches
    base = _base(spark, "visits")
    visited = VisitedUrls(spark, f"{base}/visited", buckets=8, bits=1 << 16)
    K.first_visits(_batches(_attempts(spark, sf), F.xxhash64("ts", "url")), visited, f"{base}/checkpoint").awaitTermination()
    return visited.urls().select("url")


@query("stream_crawl_status", CQ.CRAWL_STATUS_SQL)
def _(spark, sf):
    base = _base(spark, "status")
    store = UpsertTable(spark, f"{base}/table", K.STATUS, ["url"], buckets=8)
    K.status_upserts(_batches(_attempts(spark, sf), "ts"), store, f"{base}/checkpoint").awaitTermination()
    return store.read()


@query(
    "stream_throughput",
    f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, domain, sum(pages)::BIGINT AS n_pages, sum(leads)::BIGINT AS n_leads
    FROM ({METRICS_SQL}) m GROUP BY 1, 2""",
)
def _(spark, sf):
    base = _base(spark, "throughput")
    events = metrics(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    sums = WindowedSums(spark, f"{base}/sums", "domain", ["pages", "leads"])
    # dealt by a hash: later batches hold rows of windows that the first one has finished
    K.throughput_windows(_batches(events, F.xxhash64("ts", "domain")), sums, f"{base}/checkpoint").awaitTermination()
    rows = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    out = sums.corrected(rows)
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "domain", F.col("pages").alias("n_pages"), F.col("leads").alias("n_leads"))
