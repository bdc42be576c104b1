"""Metadata collections, read by the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from learnlens import schemas


def named_key(documents: DataFrame, name: str) -> DataFrame:
    """Rename the document key to the name it has in joins."""
    return documents.withColumnRenamed("_id", schemas.DIMENSION_KEYS[name])


def read_dimension(
    spark: SparkSession,
    name: str,
    path: str,
    columns: Sequence[str] = (),
    file_format: str = "parquet",
) -> DataFrame:
    """A metadata collection with a declared schema; ``columns`` prunes the scan."""
    documents = spark.read.format(file_format).schema(schemas.DIMENSIONS[name]).load(path)
    df = named_key(documents, name)
    return df.select(*columns) if columns else df
