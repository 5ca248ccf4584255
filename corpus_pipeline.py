"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept and returns a DataFrame, which is
written as Parquet in the shared folder and read back as the next one's ``docs``. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hemline.llm import decontam, exact, language, packing, simhash
from hemline.llm.base import table
from hemline.llm.queries import word_tokenizer
from hemline.session import written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised."""
    return language.recognised(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    return exact.exact_distinct(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (four-word shingles, four bits) the one with the smallest id."""
    return simhash.near_distinct(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in their sequences, with token ids."""
    return packing.packed(docs, word_tokenizer(), with_ids=True)


STAGES = [
    ("language", language_stage),
    ("exact_duplicates", exact_stage),
    ("near_duplicates", near_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

# Fingerprints, components and token ids are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
