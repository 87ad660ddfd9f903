"""The corpus pipeline: STAGES in order, each written as Parquet and read again as the next one's documents.

Null, empty and blank texts have no n-gram and go in the first stage. Rows with a null doc_id go through every stage: near-
duplicates are looked for among rows with an id. Rows that share a doc_id are judged by their texts in the classifier, are
one node in the near-duplicates stage and are packed each. Rows tied at the classifier's last key are all kept. Texts of any
length are taken whole. Other columns, whatever their names, stay until the last stage, which returns pieces. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontamination, near_dedup, packing, pii, quality_classifier
from textloom.llm.common import read, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier selects."""
    return quality_classifier.select(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, on shingles of five words at a similarity of 0.8."""
    return near_dedup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by kind marks."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents as sequences, with their token ids."""
    return packing.pack(docs, with_ids=True, most=200_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("personal data", redacted),
    ("packing", packed),
]

#: SQL can't express the classifier's sampling, the edit-distance check and the tokenizer; a brute-force test stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{i}")
    return docs
