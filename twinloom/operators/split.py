"""Train / validation / test assignment (90 / 5 / 5)."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.functions.keyed import hash32
from twinloom.operators.ordering import with_row_idx

# Held-out share, and the share of it that becomes the test split.
HELD_OUT = 0.1
TEST_OF_HELD_OUT = 0.5
SEED = 42
HASH_SLOTS = 10_000
HISTOGRAM_BUCKETS = 4096
HASH_RANGE = 1 << 32


def split_90_5_5(df: DataFrame, *key: str, seed: int = SEED) -> DataFrame:
    """Assign ``split`` by a hash of ``key``: one scan, and stable when rows are appended."""
    slot = hash32(seed, *[F.col(k) for k in key]) % HASH_SLOTS
    train = round(HASH_SLOTS * (1 - HELD_OUT))
    val = round(train + (HASH_SLOTS - train) * (1 - TEST_OF_HELD_OUT))
    label = F.when(slot < train, "train").when(slot < val, "val").otherwise("test")
    return df.withColumn("split", label)


def split_sizes(n: int) -> tuple[int, int, int]:
    """Row counts of train, validation and test: the smaller parts round up."""
    held_out = ceil(HELD_OUT * n)
    test = ceil(TEST_OF_HELD_OUT * held_out)
    return n - held_out, held_out - test, test


def split_exact(df: DataFrame, *key: str, seed: int = SEED) -> DataFrame:
    """Assign ``split`` with exact sizes, in order of a hash of ``key``.

    A histogram over leading hash bits (its size is fixed) tells which buckets the two cuts
    fall into. All other rows are decided by their bucket alone, without a shuffle; only the
    rows of the cut buckets are ranked, and copies of a row there spread over the cluster.
    """
    hashed = df.withColumn("_h", hash32(seed, *[F.col(k) for k in key]))
    hashed = hashed.withColumn("_b", F.floor(F.col("_h") / (HASH_RANGE // HISTOGRAM_BUCKETS)))
    histogram = {r["_b"]: r["count"] for r in hashed.groupBy("_b").count().collect()}
    sizes = [histogram.get(b, 0) for b in range(HISTOGRAM_BUCKETS)]
    ends = list(accumulate(sizes))
    train, val, _ = split_sizes(ends[-1])
    cuts = (train, train + val)
    # The bucket that holds the row at each cut; past-the-end cuts hold none.
    cut_buckets = sorted({b for b in (bisect_right(ends, c) for c in cuts) if b < len(ends)})
    if not cut_buckets:
        return hashed.withColumn("split", F.lit("train")).drop("_h", "_b")

    label = lambda at: F.when(at < cuts[0], "train").when(at < cuts[1], "val").otherwise("test")
    below = [ends[b] - sizes[b] for b in cut_buckets]
    settled_start = F.lit(0)
    for b in cut_buckets:
        settled_start = F.when(F.col("_b") > b, F.lit(ends[b])).otherwise(settled_start)
    settled = hashed.where(~F.col("_b").isin(cut_buckets)).withColumn("split", label(settled_start))

    ranked = with_row_idx(hashed.where(F.col("_b").isin(cut_buckets)), "_h", *key, name="_at")
    # Positions restart at 0 for the cut rows; shift each bucket back to its global start.
    seen, shift = 0, F.lit(0)
    for b, start in zip(cut_buckets, below):
        shift = F.when(F.col("_b") == b, F.lit(start - seen)).otherwise(shift)
        seen += sizes[b]
    contested = ranked.withColumn("split", label(F.col("_at") + shift)).drop("_at")
    return settled.unionByName(contested).drop("_h", "_b")
