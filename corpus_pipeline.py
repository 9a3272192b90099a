"""A corpus pipeline: quality classifier, near-duplicate removal, secret redaction, source mixing, packing.

Every stage is written as Parquet and read again as the next one's documents. All stages but the last return the
columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import jaccard, mixing, packing, quality, secrets
from eventloom.llm.common import checked_broadcast, stored

#: Ids of dropped documents up to which they are broadcast, some 40 bytes each; more are joined by a shuffle of the texts.
DROPPED = 1_000_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null or empty text is judged as one empty passage, repeated rows alike, null ids don't matter; an empty table stays empty.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays; a null doc_id is never a duplicate.

    Rows that share the least doc_id are one document and stay together; documents without words stay; an empty table
    stays empty.
    """
    found = jaccard.near_duplicate_components(docs.select("doc_id", "text"))
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(checked_broadcast(stored(gone, "pipeline-gone"), DROPPED), "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the spans that the scan finds are masked in its text."""
    return secrets.redacted(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them; those without words stay once, null ids and repeated rows are
    documents like others, an empty table stays empty."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset; null and empty texts are one piece of the end id, other columns go, an
    empty table gives an empty result."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_to_weights),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier and a tokenizer aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
