"""Vocabulary and embedding tables on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_vocab(vocab: DataFrame, path: str) -> None:
    """Write ``(id, piece, score, type)`` range-sorted by id."""
    columns = vocab.select(
        F.col("id").cast("int"), "piece", F.col("score").cast("double"), F.col("type").cast("int")
    )
    columns.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id int, piece string, score double, type int").parquet(path)


def write_embeddings(embeddings: DataFrame, path: str) -> None:
    """Write ``(id, vec)`` range-sorted by id."""
    columns = embeddings.select(F.col("id").cast("int"), F.col("vec").cast("array<float>"))
    columns.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id int, vec array<float>").parquet(path)
