"""Streams over several files give what the batch gives."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gleaner.operators import frontier as Q
from gleaner.plans import lead_job
from gleaner.session import checkpoint_dir, materialize, staged
from gleaner.sources import readers, sinks
from gleaner.sources.upserts import UpsertTable
from gleaner.streaming import jobs as K
from gleaner.streaming.visited import VisitedUrls
from gleaner.streaming.windows import WindowedSums

SF = "/root/testdata/sf0.001"
NOW = "2024-02-01 00:00:00"


@pytest.fixture(scope="module")
def attempts(spark, tmp_path_factory):
    events = spark.read.parquet(f"{SF}/events.parquet").select(
        F.expr("concat('http://s', user_id % 7, '/', event_id % 30)").alias("url"), F.expr("concat('s', user_id % 7)").alias("domain"),
        (F.col("event_type") != "error").alias("ok"), F.col("ts").cast("timestamp").alias("ts"),
        F.lit(1).alias("pages"), F.expr("int(event_type = 'purchase')").alias("leads"),
    )
    path = str(tmp_path_factory.mktemp("attempts") / "in")
    events.repartitionByRange(6, "ts").write.parquet(path)
    return spark.read.parquet(path), spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(path)


def last_result(df, tmp_path, mode):
    out = str(tmp_path / "out")
    query = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(
        lambda b, i: b.write.mode("overwrite").parquet(out)
    ).start()
    query.awaitTermination()
    assert len(query.recentProgress) > 1
    return df.sparkSession.read.parquet(out)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_running_status(attempts, tmp_path):
    batch, stream = attempts
    assert rows(last_result(K.running_status(stream), tmp_path, "complete")) == rows(Q.crawl_status(batch))


def test_windowed_throughput(attempts, tmp_path):
    batch, stream = attempts
    assert rows(last_result(K.windowed_throughput(stream), tmp_path, "complete")) == rows(K.windowed_throughput(batch))


def test_distinct_urls(spark, attempts, tmp_path):
    batch, stream = attempts
    K.distinct_urls(stream, "60 days").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "o")).option(
        "checkpointLocation", str(tmp_path / "c")
    ).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o")).select("url")
    assert rows(got) == rows(batch.select("url").distinct())


def test_incremental_leads_and_replay(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.concat(F.lit("http://d/"), "doc_id").alias("url"), F.col("text").alias("html")
    )
    source = str(tmp_path / "pages")
    pages.repartition(4).write.parquet(source)
    store = sinks.Tables(spark, str(tmp_path / "tables"))
    for run in ("one", "two"):  # the second run replays every file from the start
        stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(source)
        K.incremental_leads(stream, store, str(tmp_path / run), NOW).awaitTermination()
    batch = lead_job.run_lead_job(pages, NOW)
    for table, frame in batch.items():
        assert rows(store.read(table).select("id")) == rows(frame.select("id")), table


# --- tables that streams change ---------------------------------------------------------------
def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_status_table_in_update_mode(attempts, tmp_path):
    batch, stream = attempts
    table = UpsertTable(batch.sparkSession, str(tmp_path / "status"), K.STATUS, ["url"], buckets=16)
    query = K.status_upserts(stream, table, str(tmp_path / "cp"))
    query.awaitTermination()
    assert len(query.recentProgress) > 1
    assert rows(table.read()) == rows(Q.crawl_status(batch))


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), K.STATUS, ["url"], buckets=16)
    first = [(f"u{i}", "retrying", 1) for i in range(300)] + [(None, "retrying", 1)]
    assert len(table.upsert(spark.createDataFrame(first, K.STATUS), 0)) == 16
    before = files(tmp_path / "t/data/version=0")
    assert len(before) == 16
    touched = table.upsert(spark.createDataFrame([("u3", "done", 1), ("new", "done", 0), (None, "done", 2)], K.STATUS), 1)
    assert 1 <= len(touched) <= 3
    after = files(tmp_path / "t/data/version=0")
    # the files of the version before stay for its readers; none was written again
    assert after == before and len(files(tmp_path / "t/data/version=1")) == len(touched)
    wanted = {u: (s, n) for u, s, n in first} | {"u3": ("done", 1), "new": ("done", 0), None: ("done", 2)}
    assert {r.url: (r.status, r.n_failures) for r in table.read().collect()} == wanted and table.read().count() == 302
    # a replay of a committed batch changes nothing, and two versions on the old files are gone
    assert table.upsert(spark.createDataFrame([("u3", "failed", 9)], K.STATUS), 1) == []
    table.upsert(spark.createDataFrame([("u3", "failed", 9)], K.STATUS), 2)
    left = files(tmp_path / "t/data")
    assert len([p for p in left if "version=0" in p]) == 16 - len(touched)
    assert table.upsert(spark.createDataFrame([], K.STATUS), 3) == [] and table.read().count() == 302


def test_unfinished_version_is_not_seen(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), K.STATUS, ["url"], buckets=4)
    table.upsert(spark.createDataFrame([("a", "done", 0)], K.STATUS), 0)
    table.upsert(spark.createDataFrame([("a", "failed", 3), ("b", "done", 0)], K.STATUS), 1)
    os.remove(tmp_path / "t/log/version=1/_SUCCESS")
    assert rows(table.read()) == [("a", "done", 0)]
    table.upsert(spark.createDataFrame([("a", "failed", 3), ("b", "done", 0)], K.STATUS), 1)
    assert rows(table.read()) == [("a", "failed", 3), ("b", "done", 0)]


def files_read(df):
    """How many files the scans of a plan read, after partitions are pruned."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return sum(s.selectedPartitions().totalNumberOfFiles() for s in scans if s.nodeName().startswith("Scan parquet"))


EVENTS = "ts timestamp, domain string, pages int, leads int"


def test_windows_end_and_late_rows_are_kept(spark, tmp_path):
    def at(*minutes):
        made = [(None if m is None else f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00", "d", 1, 2) for m in minutes]
        return spark.createDataFrame(made, "t string, domain string, pages int, leads int").selectExpr("cast(t as timestamp) AS ts", "domain", "pages", "leads")

    sums = WindowedSums(spark, str(tmp_path / "w"), "domain", ["pages", "leads"])
    hours = lambda df: sorted((r.start.hour, r.pages, r.leads) for r in df.collect())
    sums.add(at(10, 70, 75), 0)  # watermark 00:15 afterwards
    assert hours(sums.finished()) == [] and hours(sums.open()) == [(0, 1, 2), (1, 2, 4)]
    sums.add(at(20, 190), 1)  # 02:10 afterwards: hours 0 and 1 are complete
    assert hours(sums.finished()) == [(0, 2, 4), (1, 2, 4)] and hours(sums.open()) == [(3, 1, 2)]
    done = files(tmp_path / "w/finished")
    sums.add(at(30, 125, None), 2)  # hour 0 is over, hour 2 is not
    assert [r.ts and r.ts.minute for r in sums.late(EVENTS).orderBy("ts").collect()] == [None, 30]
    assert done.items() <= files(tmp_path / "w/finished").items()
    sums.add(at(1000), 2)  # replayed: nothing
    sums.add(at(), 3)
    assert hours(sums.open()) == [(2, 1, 2), (3, 1, 2)] and hours(sums.corrected(EVENTS)) == [(0, 3, 6), (1, 2, 4), (2, 1, 2), (3, 1, 2)]


def test_windows_and_late_rows_are_all_rows(attempts, tmp_path):
    batch, _ = attempts
    spark, source = batch.sparkSession, str(tmp_path / "mixed")
    batch.repartition(5).write.parquet(source)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(source)
    sums = WindowedSums(spark, str(tmp_path / "w"), "domain", ["pages", "leads"])
    K.throughput_windows(stream, sums, str(tmp_path / "cp")).awaitTermination()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.schema)
    late = sums.late(schema).count()
    held = sums.finished().unionByName(sums.open()).agg(F.sum("pages")).first()[0]
    assert late > 0 and held > 0 and late + held == batch.count()
    wanted = K.windowed_throughput(batch)
    assert rows(sums.corrected(schema).select("start", "domain", "pages", "leads")) == rows(wanted)


def test_visited_urls_past_any_delay(attempts, tmp_path):
    batch, _ = attempts
    spark, source = batch.sparkSession, str(tmp_path / "mixed")
    batch.unionByName(batch).repartition(4).write.parquet(source)
    visited = VisitedUrls(spark, str(tmp_path / "v"), buckets=8, bits=1 << 12)
    for run in ("one", "two"):  # the second stream brings everything again
        stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = K.first_visits(stream.select("url", "ts"), VisitedUrls(spark, str(tmp_path / "v"), 8, 1 << 12) if run == "one" else visited, str(tmp_path / run))
        query.awaitTermination()
        if run == "one":
            assert rows(visited.urls()) == rows(batch.select("url").distinct())
    again = batch.select("url", "ts")
    assert visited.admit(again, visited.versions.last() + 1).count() == 0
    assert rows(visited.urls()) == rows(batch.select("url").distinct())


def test_visited_reads_the_buckets_it_must(spark, tmp_path):
    visited = VisitedUrls(spark, str(tmp_path / "v"), buckets=32, bits=1 << 14)
    made = lambda *names: spark.createDataFrame([(n, k) for k, n in enumerate(names)], "url string, ts long")
    assert visited.admit(made(*[f"http://s/{i}" for i in range(1000)], None, "http://s/1"), 0).count() == 1000
    stored = len(files(tmp_path / "v/urls"))
    assert stored == 32
    assert files_read(visited.candidates(made("http://s/7").select("url"))) == 1
    new = made(*[f"http://other/{i}" for i in range(20)])
    assert files_read(visited.candidates(new.select("url"))) <= 1
    got = visited.admit(made("http://s/7", "http://other/1", "http://other/1"), 1)
    assert [tuple(r) for r in got.collect()] == [("http://other/1", 1)]
    assert [tuple(r) for r in visited.admit(made("http://more"), 1).collect()] == [("http://other/1", 1)]
    with pytest.raises(ValueError):
        VisitedUrls(spark, "x", bits=100)


def test_new_leads_meet_the_parts_of_their_ids(spark, tmp_path):
    store = sinks.Tables(spark, str(tmp_path / "t"))
    made = spark.range(2000).select(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 32).alias("id"), F.col("id").cast("string").alias("url"))
    store.append_new("url", made)
    few = made.limit(3)
    read = store.stored_ids("url", few)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_part#" in plan and 1 <= files_read(read) <= 3
    store.append_new("url", made.union(spark.createDataFrame([("ab" * 16, "x"), (None, "y")], "id string, url string")))
    assert store.read("url").count() == 2002 and store.read("url").filter("id LIKE '00%'").count() == made.filter("id LIKE '00%'").count()


def test_staged_tables_are_removed(spark):
    folder = checkpoint_dir(spark)
    before = set(os.listdir(folder))
    with staged(spark):
        assert materialize(spark.range(3), "kept").count() == 3
        with pytest.raises(ValueError), staged(spark):
            materialize(spark.range(3), "inner")
            raise ValueError
        assert len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before


# --- sources and sinks ---------------------------------------------------------------------
def test_search_hits_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"query": "q",\n "items": [{"link": "u1", "title": "é"}, {"link": null}]}', encoding="utf-8")
    (tmp_path / "b.json").write_text('{"query": "none"}')
    got = [(r["query"], r["seq"], r["link"], r["title"]) for r in readers.read_search_hits(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [("q", 1, "u1", "é"), ("q", 2, None, None)]


def test_pages_get_missing_columns(spark):
    pages = readers.read_pages(spark, f"{SF}/pages.parquet")
    assert pages.columns[:8] == ["url", "final_url", "canonical_url", "status_code", "headers", "content_type", "content_length", "html"]
    assert "page_id" in pages.columns


def test_csv_header_without_leads(spark, tmp_path):
    from gleaner.operators import leads as L

    none = spark.createDataFrame([], "source_url string, text string")
    sinks.export_csv(L.score_leads(L.flat_leads(none, NOW), NOW), str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert text.strip() == ",".join([*L.LEAD_COLUMNS, *L.SCORE_COLUMNS])


def test_json_keeps_text_and_nulls(spark, tmp_path):
    sinks.export_json(spark.createDataFrame([("é", None)], "a string, b string"), str(tmp_path / "json"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "json").glob("*.json"))
    assert text.strip() == '{"a":"é","b":null}'


def test_registered_stream_reads_a_file_and_a_folder(spark, tmp_path):
    from gleaner.catalogue import QUERIES

    one = spark.createDataFrame([(1, "http://s/1", "<p>write to a@b.org</p>"), (2, "http://s/2", "<p>or to c@d.org</p>")], "page_id long, url string, html string")
    (tmp_path / "folder").mkdir()
    one.repartition(2).write.parquet(str(tmp_path / "folder" / "pages.parquet"))
    (tmp_path / "file").mkdir()
    one.coalesce(1).write.parquet(str(tmp_path / "part"))
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "file" / "pages.parquet")
    for kind in ("folder", "file"):
        rows = QUERIES["stream_incremental_leads"](spark, str(tmp_path / kind)).collect()
        assert sorted((r["source_url"], r["email"]) for r in rows) == [("http://s/1", "a@b.org"), ("http://s/2", "c@d.org")]


def test_replay_stages_ids_only(spark, tmp_path, monkeypatch):
    staged_columns = []
    monkeypatch.setattr(sinks, "materialize", lambda df, label: staged_columns.append(df.columns) or materialize(df, label))
    store = sinks.Tables(spark, str(tmp_path / "t"))
    schema = "id string, lead_id string, final_score double"
    first = spark.createDataFrame([("aa1", "x", 1.0), ("aa1", "w", 1.0), (None, "n", 0.0)], schema)
    more = first.unionByName(spark.createDataFrame([("ab2", "y", 2.0), ("aa3", "z", 3.0)], schema)).filter("id IS NOT NULL")
    store.append_new("lead_score", first)
    for _ in range(2):
        store.append_new("lead_score", more)
    rows = sorted((r["id"] or "", r["lead_id"]) for r in store.read("lead_score").collect())
    assert rows == [("", "n"), ("aa1", "w"), ("aa3", "z"), ("ab2", "y")]
    assert staged_columns and all(columns == ["id"] for columns in staged_columns)
