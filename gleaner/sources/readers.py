"""Stored inputs as DataFrames with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.functions import html as H
from gleaner.sources import schemas


def with_schema(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema, cast where needed; missing ones become NULL, others are kept."""
    wanted = StructType.fromDDL(ddl)
    columns = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted
    ]
    return df.select(*columns, *[c for c in df.columns if c not in wanted.names])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page snapshots. A column that is never used, the page source above all, is never read."""
    return with_schema(spark.read.parquet(path), schemas.PAGE)


def read_search_hits(spark: SparkSession, path: str) -> DataFrame:
    """(query, seq, link, title, snippet, displayLink, cacheId) from stored JSON responses, one
    document per file; ``seq`` counts from 1."""
    responses = spark.read.schema(schemas.SEARCH_RESPONSE).json(path, multiLine=True)
    return flatten_responses(responses)


def flatten_responses(responses: DataFrame) -> DataFrame:
    return responses.select("query", F.posexplode("items").alias("p", "i")).select(
        "query", (F.col("p") + 1).alias("seq"), "i.*"
    )


def sitemap_urls(sitemaps: DataFrame, xml: str = "xml") -> DataFrame:
    """(all other columns, seq, url): every location of stored sitemaps."""
    keep = [c for c in sitemaps.columns if c != xml]
    return sitemaps.select(*keep, F.posexplode(H.sitemap_locations(xml)).alias("seq", "url"))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], parts: int = 32, **options) -> DataFrame:
    """A relational table read in parallel by ranges of a numeric key; a read without ranges would
    go through one task."""
    return spark.read.jdbc(
        url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts,
        properties={k: str(v) for k, v in options.items()},
    )
