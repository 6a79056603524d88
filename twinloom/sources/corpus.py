"""Corpus readers and writers. Schemas are declared, never inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.functions.languages import LANGUAGES, LEZGIAN, RUSSIAN

RAW_SCHEMA = T.StructType(
    [T.StructField("text_ru", T.StringType()), T.StructField("text_lez", T.StringType())]
)
PAIR_SCHEMA = T.StructType([T.StructField(lang.column, T.StringType()) for lang in LANGUAGES])
SPLITS = ("train", "val", "test")

# RFC 4180 quoting, so quoted line breaks and doubled quotes survive a round trip.
CSV_OPTIONS = {
    "header": True,
    "multiLine": True,
    "quote": "\"",
    "escape": "\"",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    """Read the declared columns by name; the job stops where one is missing."""
    if fmt == "csv":
        # The header decides which file column is which, so it is read first.
        header = spark.read.options(**CSV_OPTIONS).csv(path).schema
        source = spark.read.schema(header).options(**CSV_OPTIONS).csv(path)
    else:
        source = spark.read.format(fmt).load(path)
    missing = [f.name for f in schema if f.name not in source.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return source.select([F.col(f.name).cast(f.dataType) for f in schema])


def project_pair(raw: DataFrame) -> DataFrame:
    """Keep the two text columns under their short names."""
    return raw.select(
        F.col("text_ru").alias(RUSSIAN.column), F.col("text_lez").alias(LEZGIAN.column)
    )


def read_parallel(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Raw parallel corpus with columns ``text_ru`` and ``text_lez``; others are ignored."""
    return project_pair(_read(spark, path, RAW_SCHEMA, fmt))


def read_split(spark: SparkSession, path: str, split: str, fmt: str = "parquet") -> DataFrame:
    """One split of a folder written by ``write_splits``: a single partition directory."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    return _read(spark, f"{path}/split={split}", PAIR_SCHEMA, fmt)


def load_corpora(
    spark: SparkSession, path: str, splits: tuple[str, ...] = SPLITS, fmt: str = "parquet"
) -> DataFrame:
    """Union of splits; all three by default, so vocabulary learning sees held-out text."""
    return reduce(DataFrame.unionByName, [read_split(spark, path, s, fmt) for s in splits])


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write ``(ru, lez, split)`` in one pass, one directory per split."""
    options = CSV_OPTIONS if fmt == "csv" else {}
    columns = [*PAIR_SCHEMA.names, "split"]
    writer = df.select(columns).write.partitionBy("split").mode("overwrite")
    writer.format(fmt).options(**options).save(path)


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns))


def one_line(text: F.Column) -> F.Column:
    """Flatten line breaks, so that one text is one line."""
    return F.regexp_replace(text, r"[\r\n]+", " ")


def write_plain_text(df: DataFrame, column: str, path: str) -> None:
    """One raw text per line."""
    lines = drop_missing(df, column).select(one_line(F.col(column)).alias("value"))
    lines.write.mode("overwrite").text(path)
