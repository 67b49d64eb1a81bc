"""Sums per window of event time, finished by a watermark, with the rows that came too late on the side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import staged
from gleaner.sources.upserts import Versions, remove


class WindowedSums:
    """Batches of ``(ts, by, <sums>)`` as windows that end once the watermark has passed them.

    The watermark is the latest event time of all earlier batches minus ``delay``. A row whose window ended before
    it is late: it goes to the side table as it is. All others add to the open windows, the only rows that are
    written again with each batch; a window is finished, and never touched again, when the watermark that the
    batch leaves passes its end. So finished windows, open windows and late rows hold every row once. Rows
    without event time go to the side table, in no window. A batch that is replayed writes the same version again.
    """

    def __init__(self, spark: SparkSession, path: str, by: str, sums: list[str], window: str = "1 hour", delay: str = "1 hour") -> None:
        self.spark, self.path, self.by, self.sums = spark, path.rstrip("/"), by, sums
        self.window, self.delay = window, delay
        self.versions = Versions(spark, self.path, "top timestamp")
        self.schema = f"start timestamp, end timestamp, `{by}` string, " + ", ".join(f"`{c}` long" for c in sums)

    def _at(self, table: str, version: int) -> str:
        return f"{self.path}/{table}/version={version}"

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("start", "end", self.by).agg(*[F.sum(c).cast("long").alias(c) for c in self.sums])

    def add(self, rows: DataFrame, version: int) -> None:
        last = self.versions.last()
        if version <= last:
            return
        top = self.versions.entries(last)[0][0] if last >= 0 else None
        passed = F.lit(top).cast("timestamp") - F.expr(f"INTERVAL {self.delay}")
        with staged(self.spark):
            # window() leaves rows without event time out
            placed = rows.withColumn("_w", F.window("ts", self.window))
            late = F.coalesce(F.col("_w.end") <= passed, F.lit(False))
            aside = placed.filter(late).drop("_w").unionByName(rows.filter("ts IS NULL"))
            aside.write.mode("overwrite").parquet(self._at("late", version))
            arrived = self._summed(placed.filter(~late).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), self.by, *self.sums))
            before = self._read("open", [last] if last >= 0 else [])
            reached = rows.agg(F.max("ts")).first()[0]
            now = max((t for t in (top, reached) if t is not None), default=None)
            done = F.coalesce(F.col("end") <= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {self.delay}"), F.lit(False))
            merged = self._summed(arrived.unionByName(before)).withColumn("_done", done)
            merged.write.mode("overwrite").partitionBy("_done").parquet(self._at("merged", version))
            both = self.spark.read.schema(f"{self.schema}, _done boolean").parquet(self._at("merged", version))
            both.filter("_done").drop("_done").write.mode("overwrite").parquet(self._at("finished", version))
            both.filter("NOT _done").drop("_done").write.mode("overwrite").parquet(self._at("open", version))
        self.versions.commit(version, [(now,)])
        remove(self.spark, self._at("merged", version))
        for old in self.versions.numbers()[:-2]:
            remove(self.spark, self._at("open", old))

    def _read(self, table: str, versions: list[int], schema: str | None = None) -> DataFrame:
        schema = schema or self.schema
        paths = [self._at(table, v) for v in versions]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def finished(self) -> DataFrame:
        """``start, end, by, <sums>`` of the windows that are complete; each is written once."""
        return self._read("finished", self.versions.numbers())

    def open(self) -> DataFrame:
        """Windows that may still grow."""
        last = self.versions.last()
        return self._read("open", [last] if last >= 0 else [])

    def late(self, schema: str) -> DataFrame:
        """Rows that came after their window was finished."""
        return self._read("late", self.versions.numbers(), schema)

    def corrected(self, schema: str) -> DataFrame:
        """All windows, with what the late rows add to them."""
        late = self.late(schema).withColumn("_w", F.window("ts", self.window)).select(
            F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), self.by, *self.sums
        )
        return self._summed(self.finished().unionByName(self.open()).unionByName(late))
