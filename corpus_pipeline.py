"""A training-data pipeline over ``documents``: quality, line dedup, near-duplicate dedup, packing.

Every stage takes the table that the stage before it wrote, all columns of ``documents`` in it, and
works on all of its rows; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from learnlens.llm import hamming_join, kneser_ney, line_runs, packing
from learnlens.llm.queries import tokenizer
from learnlens.llm.shared import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies within the band of their language."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return kneser_ney.kept_documents(docs, labels, Scratch(spark, "quality"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; ``n_chars`` follows the text."""
    return line_runs.shortened(docs, Scratch(spark, "line-dedup"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8."""
    return hamming_join.one_of_each(docs, Scratch(spark, "near-dedup"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(docs, Scratch(spark, "pack"), tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("best_fit_packing", pack),
]

# Perplexity, near duplicates and packing have no SQL form; tests hold the stages against
# brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = scratch.stage(docs, name)
    return docs
