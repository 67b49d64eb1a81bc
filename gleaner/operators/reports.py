"""Operational reports over job, attempt and log tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import fixed
from gleaner.functions.common import micros


def backlog(jobs: DataFrame, leads: DataFrame) -> DataFrame:
    """One row: open search jobs, open crawl jobs, leads."""
    is_open = F.col("status").isin("pending", "in_progress")
    return jobs.agg(
        F.count_if(is_open & (F.col("type") == "search")).alias("search_jobs"),
        F.count_if(is_open & (F.col("type") == "crawl")).alias("crawl_jobs"),
    ).select("search_jobs", "crawl_jobs", leads.agg(F.count("*")).scalar().alias("leads"))


def list_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        F.col("id").alias("job_id"), "type", "status", "progress", "payload", "created_at", "updated_at"
    )


def job_by_id(jobs: DataFrame, job_id: int | str) -> DataFrame:
    return jobs.filter(F.col("id") == job_id).select(
        F.col("id").alias("job_id"), "type", "status", "progress", "result", "error", "payload",
        "created_at", "updated_at",
    )


def job_outcome(jobs: DataFrame, timeouts: Mapping[str, float] = fixed.JOB_TIMEOUTS) -> DataFrame:
    """Final status of each job: over its time limit or with an error, failed; with a result,
    completed; with neither, failed. The limits are a small fixed map, so they are literals."""
    limits = F.create_map(*[F.lit(x) for kv in timeouts.items() for x in kv])
    limit = F.try_element_at(limits, F.col("type"))
    late = F.coalesce(F.col("duration") > limit, F.lit(False))
    seconds = limit.cast("int").cast("string")
    error = (
        F.when(late, F.concat(F.lit(fixed.JOB_LATE[0]), seconds, F.lit(fixed.JOB_LATE[1])))
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("result").isNull(), fixed.JOB_EMPTY)
    )
    return jobs.withColumn("error", error).withColumn(
        "status", F.when(F.col("error").isNotNull(), "failed").otherwise("completed")
    )


def throughput(metrics: DataFrame) -> DataFrame:
    """One row of totals and rates from (ts, pages, leads, api_calls, api_cost)."""
    hours = (micros(F.max("ts")) - micros(F.min("ts"))) / F.lit(3.6e9)
    totals = metrics.agg(
        F.coalesce(F.sum("pages"), F.lit(0)).alias("pages_crawled"),
        F.coalesce(F.sum("leads"), F.lit(0)).alias("leads_extracted"),
        F.coalesce(F.sum("api_calls"), F.lit(0)).alias("api_calls"),
        F.coalesce(F.sum("api_cost"), F.lit(0.0)).alias("api_cost"),
        F.coalesce(hours, F.lit(0.0)).alias("uptime_hours"),
    )

    def rate(top: str, bottom: str):
        return F.coalesce(F.try_divide(F.col(top), F.col(bottom)), F.lit(0.0))

    return totals.select(
        "*",
        rate("leads_extracted", "uptime_hours").alias("leads_per_hour"),
        rate("pages_crawled", "uptime_hours").alias("pages_per_hour"),
        rate("api_cost", "leads_extracted").alias("avg_api_cost_per_lead"),
    )


def crawl_efficiency(crawls: DataFrame) -> DataFrame:
    """(domain, pages, pages_per_hour) from (domain, pages, duration_sec); crawls without a
    duration count for neither."""
    timed = crawls.filter(F.col("duration_sec") > 0)
    return timed.groupBy("domain").agg(
        F.sum("pages").alias("pages"),
        (F.sum("pages") * F.lit(3600.0) / F.sum("duration_sec")).alias("pages_per_hour"),
    )


def success_rates(attempts: DataFrame) -> DataFrame:
    """One row of percentages from (crawl_ok, lead_ok): crawls that worked, and of these the ones
    that gave leads. 0 where there is nothing to divide by."""
    n = attempts.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("crawl_ok")).alias("crawled"),
        F.count_if(F.col("crawl_ok") & F.col("lead_ok")).alias("led"),
    )
    return n.select(
        F.coalesce(F.try_divide(F.col("crawled") * 100.0, F.col("n")), F.lit(0.0)).alias("crawl_success_rate"),
        F.coalesce(F.try_divide(F.col("led") * 100.0, F.col("crawled")), F.lit(0.0)).alias("lead_success_rate"),
    )


def parse_event_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """(ts, level, event, fields) from JSON log lines; open fields go to a map. Lines that are no
    JSON object keep NULLs, so they can be counted."""
    parsed = lines.select(F.from_json(line, "map<string,string>").alias("m"))
    fixed_part = ["timestamp", "level", "event"]
    return parsed.select(
        F.try_to_timestamp(F.col("m")["timestamp"]).alias("ts"),
        F.col("m")["level"].alias("level"),
        F.col("m")["event"].alias("event"),
        F.map_filter("m", lambda k, v: ~k.isin(fixed_part)).alias("fields"),
    )


def event_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("level", "event").agg(F.count("*").alias("n_events"))
