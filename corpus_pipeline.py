"""From raw documents to packed training sequences, stage by stage.

Each stage reads what its predecessor wrote, in full, and all but the last return the columns of ``documents``, and any
other columns as they are, whatever their names. An empty table stays empty in every stage. A null text counts as empty,
and null ids are ids like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from priorline.llm import jaccard_join, mixing, packing, pii, quality
from priorline.llm.queries import table
from priorline.session import stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; empty and null texts have the score of no words, repeated rows one score."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of repeated rows one; documents without words all stay."""
    return jaccard_join.one_of_each(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in them replaced by marks; null texts stay null, repeated rows stay."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and in the order, as the mix of sources takes them; those without words are left out."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; a document that the mix took twice is packed twice."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("personal data", remove_personal_data),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the schedule. The tests hold each stage against its operator's rows, and the
#: operators against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
