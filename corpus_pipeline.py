"""A corpus pipeline: quality draw, near duplicates, decontamination, personal data, packing.

Each stage takes what the one before kept, written as Parquet in the shared folder and read again, so a lost
executor costs a stage's tasks and no more. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm.common import read_table, stored
from loomspark.llm.decontaminate import clean
from loomspark.llm.jaccard_trie import keep_one
from loomspark.llm.packing import pack, pieces_of
from loomspark.llm.pii import redact
from loomspark.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance draw takes; the labels train it."""
    return keep_good(spark, docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return clean(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind; n_chars follows the text."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their place in training sequences."""
    return pack(pieces_of(docs))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models and a packing's choice have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None
