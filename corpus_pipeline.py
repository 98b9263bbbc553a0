"""A training-data pipeline over ``documents``: each stage's rows are written as Parquet and read again as the next one's input.

Cases: null ids and null or empty texts pass all stages (null texts count as empty; one document without text stays after exact dedup);
of rows that are equal in id and text one stays; very long texts are read whole; an empty table gives an empty result; further columns
of ``documents``, whatever their names, pass all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratapanel.llm import exactdedup, minhash, mixing, pieces, toxicity
from stratapanel.llm.common import materialise, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from ``labels``, does not reject."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exactdedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return minhash.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and scores of the N best segmentations of every copy that the mix took."""
    return pieces.encode_texts(docs, alternatives=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean_documents),
    ("exact_dedup", distinct_texts),
    ("minhash_near_dedup", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: The toxicity model and MinHash can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
