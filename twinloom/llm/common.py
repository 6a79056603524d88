"""What several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.storage import cut_lineage

# The white space of the contracts: blank, and tab to carriage return. ``bytes.split()``
# without arguments splits at exactly these six bytes.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_BYTES = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(df: DataFrame) -> list[Column]:
    """Every column by its literal name, dots included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a missing id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; a missing text is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterable[pa.RecordBatch]:
    """Smaller batches, so that what a step makes of one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def give_back() -> None:
    """Return what Arrow keeps for later; a Python worker lives through many stages."""
    pa.default_memory_pool().release_unused()


def words_of(text: Column) -> Column:
    """Non-empty words between blanks; none for a missing text."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANKS)
    return F.filter(parts, lambda w: w != "")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``(a, b)`` as ``(node, root)``, root being the smallest node.

    Large-star and small-star steps alternate until the edges stay the same. Every step is a
    grouped minimum, combined before the shuffle, and a join that adaptive execution may split,
    so a node with very many neighbours is no bottleneck. Nothing but a count and a checksum
    reaches the driver.
    """

    def settled(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    directed = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = cut_lineage(directed.distinct())
    before = settled(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        nearest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(nearest, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = cut_lineage(small.unionByName(nearest.withColumnRenamed("m", "b")).distinct())
        after = settled(current)
        if after == before:
            break
        before = after
    node, root = F.col("a").alias("node"), F.col("b").alias("root")
    return current.select(node, root).unionByName(current.select(F.col("b").alias("node"), root).distinct())
