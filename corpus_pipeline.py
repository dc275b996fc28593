"""A training corpus from raw documents: four stages, each on all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, and further columns under whatever names as they are. Nulls
in other columns than text and doc_id mean nothing; a null doc_id is an id that names no class. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gramlode.llm import bagminhash, packing, pii, ranking
from gramlode.llm.common import keep, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, learned from the labels, predicts to be of label 0.

    Null and empty texts are scored like others. Repeated rows share their fate. Without labels of both kinds all stay.
    """
    return ranking.good(docs, ranking.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, that of the least doc_id.

    Null and empty texts are one group. Of equal doc_ids the text that is first by a hash stays, of repeated rows the first.
    """
    return bagminhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put marks in place of personal data; n_chars counts the new text, where it was not null. Null texts stay null."""
    found = keep(pii.find_in_rows(docs), "pii")
    return pii.redact(found, pii.accepted_cells(found))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens. A null or empty text is its end token; every row is packed."""
    return packing.digests(packing.pack(docs))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
