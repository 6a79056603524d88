"""A training-data pipeline: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.llm import bpe, exact_dedup, mixing, quality, simhash
from twinloom.llm.common import table
from twinloom.llm.queries import tokenizer_path
from twinloom.storage import scratch_path

# Mixing and the isolation forest aren't expressible in SQL.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, unchanged.

    Missing, empty and short texts go; repeated rows go or stay alike; an empty table gives no rows.
    """
    _small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, that of the smallest id; a missing id comes last.

    Texts that differ only in runs of blanks are equal, and a missing one is empty. A repeated row stays once.
    """
    _small_batches(spark)
    return exact_dedup.drop_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, that of the smallest id; a missing id comes last.

    Texts without words have one fingerprint, and one of them stays. A repeated row stays once.
    """
    _small_batches(spark)
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its mixing rate says: not at all, once or more.

    Equal rows get equal numbers of copies; texts without words count for no tokens.
    """
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, lang, n_tokens, ids`` of every row; a missing or empty text has no ids."""
    _small_batches(spark)
    encoded = bpe.encode(docs.select("doc_id", "source", "lang", "text"), tokenizer_path())
    return encoded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids")


# Rows of a batch that Python workers get at once, where the session does not say: documents are long.
BATCH_ROWS = "1000"
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def _small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH) == _DEFAULT:
        spark.conf.set(_BATCH, BATCH_ROWS)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("mixing to target weights", mix_sources),
    ("BPE encoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage reads what the one before it has stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
