"""Structured Streaming forms of the batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators import frontier
from gleaner.plans.lead_job import run_lead_job
from gleaner.session import staged
from gleaner.sources.sinks import Tables
from gleaner.sources.upserts import UpsertTable
from gleaner.streaming.visited import VisitedUrls
from gleaner.streaming.windows import WindowedSums

STATUS = "url string, status string, n_failures long"


def incremental_leads(pages: DataFrame, tables: Tables, checkpoint: str, now: str, **options) -> StreamingQuery:
    """Each batch of new page files runs the lead job and adds to the lead tables.

    Ids are hashes of natural keys and only new ones are added, so a batch that is replayed after a
    failure adds nothing twice. What a batch stages on its way is removed when it is stored.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        with staged(batch.sparkSession):
            for table, rows in run_lead_job(batch, now, **options).items():
                tables.append_new(table, rows)

    return (
        pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def distinct_urls(urls: DataFrame, delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """First arrival of each URL. State is kept for ``delay`` of event time; :func:`first_visits` knows what
    comes back later as well."""
    return urls.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["url"])


def first_visits(urls: DataFrame, visited: VisitedUrls, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each URL of ``(url, ts)`` once, however late it comes: a batch is held against the buckets of the visited
    table that may have its URLs. No state is kept in the stream, and no row is dropped for its event time."""

    def run(batch: DataFrame, batch_id: int) -> None:
        visited.admit(batch, batch_id)

    return urls.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def status_upserts(
    attempts: DataFrame, table: UpsertTable, checkpoint: str, max_retries: int = 2, trigger: dict | None = None
) -> StreamingQuery:
    """Crawl status kept in a table: each batch puts the URLs it changed in the place of their old rows."""

    def run(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, batch_id)

    return (
        running_status(attempts, max_retries).writeStream.outputMode("update").foreachBatch(run)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def throughput_windows(events: DataFrame, sums: WindowedSums, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Sums per window that end by event time; rows that come too late are kept beside them."""

    def run(batch: DataFrame, batch_id: int) -> None:
        sums.add(batch, batch_id)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_status(attempts: DataFrame, max_retries: int = 2) -> DataFrame:
    """Crawl status that is updated as attempts arrive; use update or complete output mode."""
    return frontier.crawl_status(attempts, max_retries)


def windowed_throughput(
    events: DataFrame, by: str = "domain", window: str = "1 hour", delay: str = "1 hour", ts: str = "ts"
) -> DataFrame:
    """(start, by, n_pages, n_leads) per hour from (ts, by, pages, leads). A batch table gives the
    same rows."""
    source = events.withWatermark(ts, delay) if events.isStreaming else events
    return (
        source.groupBy(F.window(ts, window), by)
        .agg(F.sum("pages").alias("n_pages"), F.sum("leads").alias("n_leads"))
        .select(F.col("window.start").alias("start"), by, "n_pages", "n_leads")
    )
