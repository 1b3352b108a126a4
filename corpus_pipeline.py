"""A corpus pipeline over the documents: quality rules, near-duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame, which is
written as Parquet to the shared folder and read again as the next stage's docs. All stages but the last return the columns of
documents; the last returns one row per document that is left, with its token count and digests.

Cases: the stages follow their operators. Nulls, empty texts, repeated rows and extra columns of any name pass through;
null and empty texts fail the quality rules; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slate.llm import decontam, pieces, quality, simhash
from slate.session import scratch, ship, small_batches, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the production policy; the others go."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    ship(spark)
    small_batches(spark)
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    ship(spark)
    small_batches(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    ship(spark)
    small_batches(spark)
    return pieces.query(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Fingerprints, components and merges are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
