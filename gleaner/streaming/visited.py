"""The set of visited URLs as a table with Bloom filters, for arrivals older than any watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import materialize, staged
from gleaner.sources.upserts import Versions

#: bits of a bucket's filter that a URL sets
PROBES = 5


class VisitedUrls:
    """URLs by hash bucket, each bucket with a Bloom filter of ``bits`` bits, a power of two.

    The filters are a table of 64-bit words, so they are built and asked by plain aggregates and joins. A batch asks
    them first and reads only the buckets that may hold one of its URLs. With ten bits for each URL of a bucket
    about one in a hundred new URLs is looked up in vain; with less it is more, and results stay right.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, bits: int = 1 << 20) -> None:
        if bits < 64 or bits & (bits - 1):
            raise ValueError("bits is a power of two, 64 at least")
        self.spark, self.path, self.buckets, self.bits = spark, path.rstrip("/"), buckets, bits
        self.versions = Versions(spark, self.path, "urls long")

    def _bucket(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.buckets)).cast("int")

    def _probes(self, urls: DataFrame) -> DataFrame:
        """``url, bucket, word, bit``: the bits of each URL, five rows."""
        places = F.array(*[F.pmod(F.xxhash64("url", F.lit(i)), F.lit(self.bits)) for i in range(1, PROBES + 1)])
        placed = urls.select("url", self._bucket(F.col("url")).alias("bucket"), F.explode(places).alias("_at"))
        return placed.select("url", "bucket", (F.col("_at") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(_at % 64 as int))").alias("bit"))

    def _stored(self, table: str, schema: str) -> DataFrame:
        """Rows of the committed versions."""
        last = self.versions.last()
        if last < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, version long").parquet(f"{self.path}/{table}").filter(F.col("version") <= last).drop("version")

    def urls(self) -> DataFrame:
        """All visited URLs, each once."""
        return self._stored("urls", "url string, bucket int").select("url")

    def maybe(self, urls: DataFrame) -> DataFrame:
        """``url, bucket`` of the URLs that the filters know: all visited ones and few others."""
        probes = self._probes(urls)
        # words that several batches have written are put together
        words = self._stored("filters", "bucket int, word int, bits long").groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
        hits = probes.join(words, ["bucket", "word"]).filter(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        # two probes of a URL may be one bit, which its rows then have twice as well
        return hits.groupBy("url", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") == PROBES).select("url", "bucket")

    def candidates(self, urls: DataFrame) -> DataFrame:
        """Stored URLs of the buckets that may hold one of ``urls``; other buckets are not read."""
        asked = sorted(r[0] for r in self.maybe(urls).select("bucket").distinct().collect())
        return self._stored("urls", "url string, bucket int").filter(F.col("bucket").isin(asked)).select("url")

    def admit(self, rows: DataFrame, version: int) -> DataFrame:
        """The rows of a batch whose URL was never visited, each URL once (its earliest row by ``ts``); they count as
        visited from now on. A batch that is committed already gives what it gave."""
        admitted = f"{self.path}/admitted/version={version}"
        if version > self.versions.last():
            with staged(self.spark):
                others = [c for c in rows.columns if c != "url"]
                first = rows.filter("url IS NOT NULL").groupBy("url").agg(F.min(F.struct("ts", *[c for c in others if c != "ts"])).alias("r"))
                first = materialize(first.select("url", "r.*").select(*rows.columns), "arrivals")
                fresh = first.join(self.candidates(first.select("url")), "url", "left_anti").select(*rows.columns)
                fresh.write.mode("overwrite").parquet(admitted)
            new = self.spark.read.schema(rows.schema).parquet(admitted)
            bucket = self._bucket(F.col("url")).alias("bucket")
            new.select("url", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/urls/version={version}")
            self._probes(new).groupBy("bucket", "word").agg(F.bit_or("bit").alias("bits")).write.mode("overwrite").parquet(f"{self.path}/filters/version={version}")
            self.versions.commit(version, [(new.count(),)])
        return self.spark.read.schema(rows.schema).parquet(admitted)
