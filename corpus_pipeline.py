"""From raw documents to packed training sequences, in five stages that each write their result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqatlas.llm import decontaminate, language, near_duplicates, packing, suffix_dedup
from seqatlas.llm.common import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null and empty ones, and those no language clearly fits go."""
    return language.reject_unidentified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays."""
    return near_duplicates.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 250-byte strings that occur more than once go; every document stays.

    Passages of over fifty words have at least about 280 bytes, so the window lies inside each.
    """
    return suffix_dedup.without_repeats(docs, window=250, gram=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least one word in twenty inside a benchmark window go; from the others, runs of hit words
    as long as a window or longer are cut."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cut_longer_than=12)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 2048 tokens."""
    packed = packing.pack_documents(docs)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# Language models, sampling hashes and tokenizers are beyond SQL; tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
