"""Character statistics of a normalised corpus."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.functions.text import chars
from twinloom.operators.pieces import portions

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: rarer characters are not forced into the vocabulary.
MIN_CHAR_COUNT = 3

# Bytes of text that are counted together.
COUNTED_TOGETHER = 4 << 20


def explode_chars(df: DataFrame, text: Column | str) -> DataFrame:
    """One row ``ch`` per code point."""
    source = F.col(text) if isinstance(text, str) else text
    return df.select(F.explode(chars(source)).alias("ch"))


def char_counts(df: DataFrame, text: Column | str) -> DataFrame:
    """``(ch, n)``: a histogram of fixed size per task, so one row for each of its characters is shuffled."""
    source = F.col(text) if isinstance(text, str) else text
    points = df.select(source.alias("_t")).mapInArrow(_histogram, "ch string, n long")
    return points.groupBy("ch").agg(F.sum("n").alias("n"))


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0x110000, dtype=np.int64)
    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        for start, stop in portions(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), COUNTED_TOGETHER):
            whole = b"".join(t for t in texts.slice(start, stop - start).to_pylist() if t)
            points = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
            counts = np.bincount(points)
            total[: len(counts)] += counts
    seen = np.flatnonzero(total)
    chars = pa.array([chr(p) for p in seen.tolist()], pa.string())
    yield pa.RecordBatch.from_arrays([chars, pa.array(total[seen])], ["ch", "n"])


def char_filter(counts: DataFrame, min_count: int = MIN_CHAR_COUNT) -> DataFrame:
    """Frequent characters without the space."""
    return counts.where((F.col("n") >= min_count) & (F.col("ch") != " "))


def join_chars(counts: DataFrame) -> DataFrame:
    """One row ``required_chars``: characters by falling count, ties by code point.

    The list holds distinct characters, so its length is bounded by Unicode.
    """
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("rank"), "ch")))
    return counts.agg(F.array_join(ordered["ch"], "").alias("required_chars"))


def required_chars(df: DataFrame, text: Column | str) -> DataFrame:
    return join_chars(char_filter(char_counts(df, text)))
