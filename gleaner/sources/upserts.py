"""Tables that batches change: versions of hash buckets, committed by a log.

A version is the number of the batch that wrote it. Its files are written first and its log last, so what a lost
job left is not seen and is written again, the same, when the batch is replayed; a batch that is committed
already changes nothing. Only names of folders and the log, which has a row per bucket, pass the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import materialize, staged


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    folder, store = _folder(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(folder)) if store.exists(folder) else []


def remove(spark: SparkSession, path: str) -> None:
    folder, store = _folder(spark, path)
    store.delete(folder, True)


class Versions:
    """The committed versions of a table below ``path``; ``schema`` is that of its log."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def numbers(self) -> list[int]:
        """Versions whose log is complete, oldest first."""
        names = [n for n in children(self.spark, f"{self.path}/log") if n.startswith("version=")]
        whole = [n for n in names if "_SUCCESS" in children(self.spark, f"{self.path}/log/{n}")]
        return sorted(int(n.removeprefix("version=")) for n in whole)

    def last(self) -> int:
        """The newest version, -1 before the first."""
        return max(self.numbers(), default=-1)

    def entries(self, version: int) -> list[tuple]:
        """The log of a version: as many rows as it was given."""
        return [tuple(r) for r in self.spark.read.schema(self.schema).parquet(f"{self.path}/log/version={version}").collect()]

    def commit(self, version: int, entries: list[tuple]) -> None:
        rows = self.spark.createDataFrame(entries, self.schema).coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.path}/log/version={version}")


class UpsertTable:
    """Rows by key in ``buckets`` hash buckets; a batch rewrites the buckets that its keys fall into, no others.

    Choose so many buckets that one is a file or two. Keys may have nulls. The rows of a batch have different keys.
    The last ``keep`` versions can be read, older files are removed.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 64, keep: int = 2) -> None:
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.buckets, self.keep = buckets, keep
        self.versions = Versions(spark, self.path, "bucket int, version long")

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def current(self) -> dict[int, int]:
        """The version of every bucket that has rows."""
        last = self.versions.last()
        return dict(self.versions.entries(last)) if last >= 0 else {}

    def read(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        held = [f"{self.path}/data/version={v}/_bucket={b}" for b, v in self.current().items() if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*held) if held else self.spark.createDataFrame([], self.schema)

    def upsert(self, rows: DataFrame, version: int) -> list[int]:
        """Put ``rows`` in the place of those with their keys; the buckets that were written."""
        if version <= self.versions.last():
            return []
        current = self.current()
        with staged(self.spark):
            own = materialize(rows.withColumn("_bucket", self._bucket()), "upsert")
            touched = sorted(r[0] for r in own.select("_bucket").distinct().collect())
            keys = own.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key)])
            same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.key)]
            kept = self.read(touched).join(keys, same, "left_anti").withColumn("_bucket", self._bucket())
            merged = kept.unionByName(own.select(*kept.columns))
            merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/version={version}")
        self.versions.commit(version, sorted((current | dict.fromkeys(touched, version)).items()))
        self._vacuum()
        return touched

    def _vacuum(self) -> None:
        """Remove what none of the last versions refers to."""
        numbers = self.versions.numbers()
        for old in numbers[: -self.keep]:
            remove(self.spark, f"{self.path}/log/version={old}")
        used = {entry for n in numbers[-self.keep :] for entry in self.versions.entries(n)}
        for name in children(self.spark, f"{self.path}/data"):
            version = int(name.removeprefix("version="))
            held = [c for c in children(self.spark, f"{self.path}/data/{name}") if c.startswith("_bucket=")]
            gone = [c for c in held if (int(c.removeprefix("_bucket=")), version) not in used]
            for c in gone:
                remove(self.spark, f"{self.path}/data/{name}/{c}")
            if len(gone) == len(held):
                remove(self.spark, f"{self.path}/data/{name}")
