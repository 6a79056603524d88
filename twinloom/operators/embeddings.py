"""Embedding tables ``(id, vec)``: initialising new rows and growing the matrix."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of sums that a task holds before it adds up those of equal keys, and hands them on if many remain.
HELD_BYTES = 32 << 20


def embedding_mean(
    members: DataFrame, embeddings: DataFrame, key: str = "piece", out: str = "vec"
) -> DataFrame:
    """Element-wise mean of the vectors of each key's member ids, repeats counted.

    Repeats fold into a weight before the join. Whole vectors are added up inside each task, and
    one for each key and task is shuffled, so a key with very many members gathers nowhere. A
    member id without a vector is an error, and so are vectors of different lengths.
    """
    weighted = members.groupBy(key, "id").agg(F.count(F.lit(1)).alias("_w"))
    vectors = embeddings.select("id", F.col("vec").cast("array<double>").alias("_v"))
    joined = weighted.join(vectors, "id", "left")
    lacking = F.concat(F.lit("no vector for id "), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    checked = F.coalesce("_v", F.raise_error(lacking).cast("array<double>"))
    found = joined.select(key, F.col("_w").cast("double").alias("_w"), checked.alias("_v"))
    schema = found.schema
    partial = found.mapInArrow(_task_sums, schema)
    # A key's partial sums, at most one for each task and flush, arrive sorted and are added as they come.
    placed = partial.repartition(key).sortWithinPartitions(key)
    total = placed.mapInArrow(_sorted_sums, schema)
    return total.select(key, F.transform("_v", lambda v: v / F.col("_w")).alias(out))


def _matrix(column: pa.Array, width: int | None) -> np.ndarray:
    """Vectors as rows of one flat buffer; missing components count as not a number."""
    lengths = column.value_lengths().to_numpy()
    width = int(lengths[0]) if width is None else width
    if (lengths != width).any():
        raise ValueError(f"vectors of {width} and of {int(lengths[lengths != width][0])} components")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _rows(keys: pa.Array, weight: np.ndarray, sums: np.ndarray, like: pa.Schema) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(keys) + 1) * sums.shape[1], pa.int32())
    vectors = pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))
    return pa.RecordBatch.from_arrays([keys, pa.array(weight), vectors.cast(like.types[2])], names=like.names)


def _added(keys: pa.Array, weight: np.ndarray, vectors: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """One row per key: the rows are brought together by key and summed in segments."""
    coded = keys.dictionary_encode(null_encoding="encode")
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
    return coded.dictionary, np.add.reduceat(weight[order], starts), np.add.reduceat(vectors[order], starts, axis=0)


def _task_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sums of a task's vectors, handed on when their bytes are many."""
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    size, like, width = 0, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        like = batch.schema
        weight = batch.column(1).to_numpy()
        vectors = _matrix(batch.column(2), width)
        width = vectors.shape[1]
        held.append(_added(batch.column(0), weight, vectors * weight[:, None]))
        size += held[-1][2].nbytes
        if size > HELD_BYTES:
            held = [_joined(held)]
            size = held[0][2].nbytes
            if size > HELD_BYTES // 2:
                yield _rows(*held[0], like)
                held, size = [], 0
    if held:
        yield _rows(*_joined(held), like)


def _joined(held: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    keys, weights, sums = zip(*held, strict=True)
    return _added(pa.concat_arrays(keys), np.concatenate(weights), np.concatenate(sums))


def _sorted_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over rows that arrive sorted by key; a batch's last key waits for the next batch."""
    held, width = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        like = batch.schema
        vectors = _matrix(batch.column(2), width)
        width = vectors.shape[1]
        own = (batch.column(0), batch.column(1).to_numpy(), vectors)
        keys, weight, sums = _added(*own) if held is None else _joined([held, own])
        if len(keys) > 1:
            yield _rows(keys[:-1], weight[:-1], sums[:-1], like)
        held = (keys[-1:], weight[-1:], sums[-1:])
    if held is not None:
        yield _rows(*held, like)


def init_embeddings(
    tokenized: DataFrame, embeddings: DataFrame, unk_id: int, key: str = "piece"
) -> DataFrame:
    """``(piece, vec)`` for tokens with old sub-token ids ``ids``.

    No ids means unknown, and so does an id without a vector.
    """
    members = tokenized.select(key, F.explode_outer("ids").alias("id"))
    present = embeddings.select("id", F.lit(True).alias("_present"))
    known = members.join(present, "id", "left").select(
        key, F.when(F.col("_present"), F.col("id")).otherwise(unk_id).alias("id")
    )
    return embedding_mean(known, embeddings, key)


def resize_embeddings(
    new_vocab: DataFrame, old_vocab: DataFrame, old_embeddings: DataFrame, initial: DataFrame
) -> DataFrame:
    """Matrix of the new vocabulary: kept pieces keep their vector, added ones get ``initial``.

    Rows are matched on the piece, so it does not matter whether an id moved.
    """
    kept = old_vocab.select("piece", "id").join(old_embeddings, "id").select(
        "piece", F.col("vec").alias("_kept")
    )
    fresh = initial.select("piece", F.col("vec").cast("array<float>").alias("_fresh"))
    joined = new_vocab.select("id", "piece").join(kept, "piece", "left").join(fresh, "piece", "left")
    return joined.select("id", F.coalesce("_kept", "_fresh").alias("vec"))


