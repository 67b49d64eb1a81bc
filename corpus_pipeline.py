"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept, and returns a
DataFrame; ``run`` writes each result as Parquet into the shared checkpoint folder and reads it again. All
stages but the last return the columns of ``documents``.

Defined cases: stages treat nulls, empty texts, ties, repeated rows and extra columns as their operators do;
an empty table goes through all stages; rows that repeat a doc_id are one document for near-duplicates and
are kept or dropped together with it; near-duplicate shingles take five words, at a similarity of 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.decontam import decontaminated
from gleaner.llm.dedup import near_duplicates
from gleaner.llm.packing import pack
from gleaner.llm.pii import with_surrogates
from gleaner.llm.rules import passing
from gleaner.session import materialize, ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the rules, weighed against each other, take for good."""
    ship_package(spark)
    return passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near copies."""
    ship_package(spark)
    dropped = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the documents that hold a window of the benchmark."""
    ship_package(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; the length follows the text."""
    ship_package(spark)
    replaced = with_surrogates(docs)
    if "n_chars" in docs.columns:
        replaced = replaced.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return replaced.select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in training sequences."""
    ship_package(spark)
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", packing),
]

#: estimation, minima of hashes and keyed replacements have no SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
