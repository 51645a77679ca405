"""The corpus pipeline: toxic documents go, quality rules, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
columns of documents; the last returns the packed pieces. Null and empty texts are not toxic, but
the quality rules reject them. Rows without doc_id are treated as all others, but teach nothing.
Repeated rows are near-duplicates of each other, so one stays. Texts of any length are worked on
as wholes. Columns beyond doc_id and text go along unchanged whatever their names. An empty table
gives an empty result in each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkspan.llm import jaccard, packing, pii, quality, toxicity
from linkspan.llm.common import delete, fresh_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, by labels of the documents at hand; null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, less their failed lines; null and wordless texts go."""
    return quality.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles are similar: SimHash links, each checked by exact Jaccard of 0.8 or more, and exactly what these leave.

    It is the one with the smallest doc_id, one without doc_id only where no other is there.
    """
    return jaccard.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null texts stay null."""
    return pii.redact(docs, pii.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' pieces in packed sequences; a null text is the end id alone."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", clean_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack),
]

#: Stages learn models and evolve packings, which SQL cannot express; a test holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each written as Parquet and read again; what no later stage reads is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        at = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            delete(spark, before)
        before = at
    return docs
