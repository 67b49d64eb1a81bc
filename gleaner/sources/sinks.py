"""Exports and the lead tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import leads as L
from gleaner.session import materialize, staged
from gleaner.sources import schemas
from gleaner.sources.readers import with_schema


def archive_columns(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with the SHA-256 and the length in bytes of their source."""
    return pages.select(
        "*", F.sha2(F.encode(html, "UTF-8"), 256).alias("sha256"), F.octet_length(html).alias("n_bytes")
    )


def archive_pages(pages: DataFrame, path: str, html: str = "html") -> None:
    archive_columns(pages, html).write.option("compression", "gzip").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines with nested values; absent values are written as null."""
    df.write.option("ignoreNullFields", False).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def export_csv(leads: DataFrame, path: str) -> None:
    """The sixteen flat columns with a header, which is written for no leads as well."""
    L.flatten_leads(leads).write.option("header", True).option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    ).option("escape", '"').csv(path)


def export_all(leads: DataFrame, folder: str) -> DataFrame:
    """JSON, CSV and Parquet under one folder; returns a manifest (format, path, rows).

    Leads are computed once, as Parquet; the other formats and the counts are made from that, so
    nothing has to fit in memory."""
    spark = leads.sparkSession
    leads.write.parquet(f"{folder}/parquet")
    stored = spark.read.schema(leads.schema).parquet(f"{folder}/parquet")
    export_json(stored, f"{folder}/json")
    export_csv(stored, f"{folder}/csv")
    formats = F.explode(F.array(*[F.lit(f) for f in ("csv", "json", "parquet")]))
    return (
        stored.agg(F.count("*").alias("rows"))
        .select(formats.alias("format"), "rows")
        .select("format", F.concat(F.lit(f"{folder}/"), "format").alias("path"), "rows")
    )


class Tables:
    """The five lead tables as Parquet folders below one path, each in 256 parts by the first two digits of the id.

    Ids are hashes, so parts are of one size, and a batch of few rows meets the stored rows of few parts.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _stored(self, table: str) -> DataFrame:
        return self.spark.read.schema(f"{schemas.TABLES[table]}, _part string").parquet(f"{self.path}/{table}")

    def read(self, table: str) -> DataFrame:
        return self._stored(table).drop("_part")

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows. Ids are keys: rows that may be stored already go through :meth:`append_new`."""
        wanted = with_schema(rows, schemas.TABLES[table]).withColumn("_part", _part())
        # rows of a part go to one file, or to several where it is large
        wanted.hint("rebalance", F.col("_part")).write.mode("append").partitionBy("_part").parquet(f"{self.path}/{table}")

    def exists(self, table: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def stored_ids(self, table: str, rows: DataFrame) -> DataFrame:
        """Ids of the stored rows in the parts that ``rows`` fall into; other parts are not read."""
        parts = sorted(r[0] for r in rows.select(_part().alias("_part")).distinct().collect())
        return self._stored(table).filter(F.col("_part").isin(parts)).select("id")

    def append_new(self, table: str, rows: DataFrame) -> None:
        """Add the rows whose id is not stored yet, each once, so a replay changes nothing. Of rows with
        one id the most confident, then the earliest is taken."""
        rest = [c for c in rows.columns if c != "id"]
        order = [-F.col(c) if c == "confidence_score" else F.col(c) for c in ("confidence_score", "created_at") if c in rest]
        first = F.min_by(F.struct(*rest), F.struct(*order, F.to_json(F.struct(*rest))))
        with staged(self.spark):
            if self.exists(table):
                # ids are met first: rows that are stored already are neither shuffled nor written for that
                ids = materialize(rows.select("id").distinct(), "ids")
                new = materialize(ids.join(self.stored_ids(table, ids), "id", "left_anti"), "new-ids").withColumnRenamed("id", "_new")
                rows = rows.join(new, F.col("id").eqNullSafe(F.col("_new")), "left_semi")
            self.append(table, rows.groupBy("id").agg(first.alias("_row")).select("id", "_row.*").select(*rows.columns))

    def write_jdbc(self, table: str, url: str, **options) -> None:
        self.read(table).write.jdbc(url, table, mode="append", properties={k: str(v) for k, v in options.items()})


def _part():
    return F.coalesce(F.substring("id", 1, 2), F.lit("none"))
