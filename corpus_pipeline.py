"""Corpus pipeline: toxicity, language, near duplicates, benchmark passages, packing.

Each stage works on all that the one before it kept. All but the last return the columns of ``documents``; the last
returns the pieces of the packed sequences with their tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborscale.llm import decontaminate, langid, neardup, pack, toxicity
from arborscale.llm._shared import ship, written
from arborscale.llm.queries import table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity models reject."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language is unknown or not clear."""
    ship(spark)
    return langid.keep_identified(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates."""
    ship(spark)
    return neardup.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which a window of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences."""
    ship(spark)
    return pack.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("language", keep_languages),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("packing", pack_sequences),
]

#: SQL can't express these stages; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
