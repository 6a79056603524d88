"""Dense row positions, shuffles and sampling without a single-task window."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.functions.keyed import hash32, hash60
from twinloom.storage import cut_lineage

# monotonically_increasing_id() keeps the position inside a partition in its low 33 bits.
POSITION_BITS = 33
MIN_BUCKETS = 4096
ROWS_PER_BUCKET = 100_000
HASH_RANGE = 1 << 32

# Values of these types are as small as a position; rows of them are sorted as they are.
FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
# Bytes of keys that are sent to every task; what a key takes beside its text.
SENT_BYTES = 8 << 20
KEY_OVERHEAD = 24


def with_row_idx(df: DataFrame, *order: Column | str, name: str = "row_idx") -> DataFrame:
    """Dense 0-based position in ``order``, as a distributed range sort.

    Of rows that hold texts, arrays or the like beside ``order``, only the distinct keys are sorted
    and stored, with their counts. The rows then look their position up, and do not move if the keys
    are few enough to be sent. Rows that share a key are told apart by sorting these rows alone.
    ``order`` must give a row the same key whenever it is evaluated. Narrow rows are sorted as they are.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    named = {f"_k{i}": key for i, key in enumerate(keys)}
    plain = {str(key) for key in keys}
    beside = [f for f in df.schema if str(F.col(f"`{f.name}`")) not in plain and str(F.col(f.name)) not in plain]
    if all(isinstance(f.dataType, FIXED_WIDTH) for f in beside):
        return _by_rows(df, named, name)
    return _by_keys(df, named, name)


def _starts(sizes: DataFrame, *counts: str) -> DataFrame:
    """``(_part, <count>_before)``: sums over the partitions before each one. One row per partition."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in counts))


def _by_rows(df: DataFrame, named: dict[str, Column], name: str) -> DataFrame:
    """Whole rows sorted by the keys.

    The source partition joins the sort key, so copies of one row spread over several
    ranges. Range bounds come from a sample that may differ between runs; the sorted rows
    are therefore materialised once before partition sizes are added up.
    """
    keyed = df.withColumns({**named, "_src": F.spark_partition_id()})
    sort_keys = [*named, "_src"]
    ranged = keyed.repartitionByRange(*sort_keys).sortWithinPartitions(*sort_keys)
    placed = cut_lineage(
        ranged.withColumn("_place", F.monotonically_increasing_id()).drop(*sort_keys)
    )
    part = F.shiftright("_place", POSITION_BITS)
    starts = _starts(placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows")), "_rows")
    position = F.col("_rows_before") + F.col("_place").bitwiseAND((1 << POSITION_BITS) - 1)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, position)
        .drop("_part", "_rows_before", "_place")
    )


def _by_keys(df: DataFrame, named: dict[str, Column], name: str) -> DataFrame:
    """Distinct keys sorted; every row finds the position of its key."""
    keyed = df.withColumns(named)
    counts = keyed.groupBy(*named).agg(F.count("*").alias("_n"))
    ranged = counts.repartitionByRange(*named).sortWithinPartitions(*named)
    placed = cut_lineage(ranged.withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_place", POSITION_BITS))
    tied = F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)
    size = sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(1)) for k in named), F.lit(KEY_OVERHEAD))
    sizes = placed.groupBy("_part").agg(F.sum("_n").alias("_rows"), F.sum(tied).alias("_tied"), F.sum(size).alias("_bytes"))
    sizes = cut_lineage(sizes)
    ties, weight = sizes.agg(F.sum("_tied"), F.sum("_bytes")).first()
    placed = placed.join(F.broadcast(_starts(sizes, "_rows", "_tied")), "_part")
    if ties:
        # Keys before in the same partition; a partition is a range of keys.
        before = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        rows, ahead = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("_n", tied))
    else:
        rows, ahead = F.col("_place").bitwiseAND((1 << POSITION_BITS) - 1), F.lit(0)
    index = placed.select(
        *(F.col(k).alias(f"_of{k}") for k in named),
        F.col("_n"),
        (F.col("_rows_before") + rows).alias("_first"),
        (F.col("_tied_before") + ahead).alias("_ahead"),
    )
    # Only the keys are held for the look-up; rows are not sorted for it.
    index = F.broadcast(index) if (weight or 0) <= SENT_BYTES else index.hint("shuffle_hash")
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in named))
    found = keyed.join(index, same, "left")
    alone = found.withColumn(name, F.col("_first")).select(*df.columns, name)
    if not ties:
        return alone
    alone = found.where(F.col("_n") == 1).withColumn(name, F.col("_first")).select(*df.columns, name)
    shared = found.where(F.col("_n") > 1).select(*df.columns, *named, "_first", "_ahead")
    ranked = _by_rows(shared, {k: F.col(k) for k in named}, "_rank").drop(*named)
    return alone.unionByName(ranked.withColumn(name, F.col("_first") + F.col("_rank") - F.col("_ahead")).select(*df.columns, name))


def epoch_shuffle(
    df: DataFrame, *key: str, seed: int = 42, epoch: int = 0, name: str = "row_idx"
) -> DataFrame:
    """Position of every row in this epoch's shuffle; ``key`` must identify a row.

    A hash orders the rows, so its leading bits are an even range partitioning: one narrow
    count per bucket gives the offsets, and one shuffle ranks inside the buckets. There is a
    bucket for every ``ROWS_PER_BUCKET`` rows, so buckets stay small as the data grows.
    """
    order = hash32(seed, epoch, *[F.col(k) for k in key])
    hashed = df.withColumn("_h", order)
    buckets = max(MIN_BUCKETS, -(-df.count() // ROWS_PER_BUCKET))
    bucket = F.floor(F.col("_h") * buckets / HASH_RANGE).alias("_bucket")
    sizes = hashed.groupBy(bucket).count()
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_bucket").orderBy("_h", *key)
    return (
        hashed.withColumn("_bucket", F.floor(F.col("_h") * buckets / HASH_RANGE))
        .withColumn("_rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), "_bucket")
        .withColumn(name, F.col("_start") + F.col("_rank"))
        .drop("_h", "_bucket", "_rank", "_start")
    )


def take_positional(df: DataFrame, *positions: int, name: str = "row_idx") -> DataFrame:
    return df.where(F.col(name).isin(*positions))


def sample_with_replacement(df: DataFrame, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """Poisson sampling: no shuffle, and ``fraction`` of the rows in expectation."""
    return df.sample(withReplacement=True, fraction=fraction, seed=seed)


def draw_rows(
    indexed: DataFrame, n: int, seed: int = 42, epoch: int = 0, name: str = "row_idx"
) -> DataFrame:
    """Exactly ``n`` uniform draws with replacement from a table with dense positions.

    Draw ``d`` takes position ``hash(seed, epoch, d) mod count``, so a re-run repeats it.
    """
    total = indexed.agg(F.count(F.lit(1)).alias("_total"))
    draws = indexed.sparkSession.range(n).withColumnRenamed("id", "draw")
    picked = draws.crossJoin(F.broadcast(total)).select(
        "draw", F.pmod(hash60(seed, epoch, F.col("draw")), F.col("_total")).alias(name)
    )
    return picked.join(indexed, name)


def most_common(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Order by descending count; equal counts order by key."""
    return counts.orderBy(F.desc(n), key)


def corpus_size(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))
