"""The training-data pipeline: documents -> quality -> exact copies -> near copies -> mix -> packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.

Odd rows: a null text is an empty one; texts without words are rejected by the first stage. A null ``doc_id`` is a row like
others, but of equal or similar texts one with an id stays. Repeated rows are copies. Very long texts are read
whole. Extra columns are handed on, whatever their names; an empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litscout.llm.common import table
from litscout.storage import stored
from litscout.llm.exact_dedup import exact_dedup
from litscout.llm.mixing import mixed_documents
from litscout.llm.ngram_join import near_dedup
from litscout.llm.packing import pack
from litscout.llm.quality import keep_good


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps: not of low quality, not toxic."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each complete take of a document, and one for the words of a partial take."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier is not expressible in SQL; tests compare the other stages with brute force.
ORACLE_SQL = None
