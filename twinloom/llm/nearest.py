"""Approximate nearest neighbours by cosine, with a bound on the chance of missing one.

Unit vectors are projected on a few random Gaussian directions. The squared distance of two
projections, divided by the squared distance of the vectors, follows a chi-square distribution. A
query goes through candidates in order of projected distance and compares the vectors themselves.
It stops when what comes next is so far away in the projection that a vector nearer than the worst of
the found ones would have come before, with the wanted confidence.

The projections are indexed by a kd-tree in two levels. Upper splits come from a bounded sample; all
rows are then dealt to the cells below, and a cell of many rows is cut into blocks. A query asks for
its nearest cells first and for more cells round by round, as long as its test does not hold. Inside
a block, a kd-tree of its rows gives the order. What a query found so far travels with it, so a later
block is left early.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.llm.common import columns_of, slices
from twinloom.llm.vector_codes import common_length, usable
from twinloom.storage import cut_lineage

NEIGHBOURS = 5
# Directions; an even number has a closed form of the chi-square distribution.
DIRECTIONS = 8
CONFIDENCE = 0.98
SEED = 42

# Rows that the upper splits are fitted on, cells at most, rows of a block, and of a leaf in it.
SAMPLE = 20_000
CELLS = 4096
BLOCK = 2048
LEAF = 32
# Queries of one group, cells of the first round, and how many times more each round asks for.
QUERIES_TOGETHER = 4096
FIRST_CELLS = 4
GROWTH = 4

# Rounding of projected distances and cosines.
SLACK = 1e-9

FOUND = "q long, score double, id long, row long"


def chi_square(x: float, directions: int) -> float:
    """Chance of a chi-square value of ``directions`` (even) degrees up to ``x``."""
    term = total = 1.0
    for j in range(1, directions // 2):
        term *= x / 2 / j
        total += term
    return 1.0 - math.exp(-x / 2) * total


def chi_square_quantile(confidence: float, directions: int) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, directions) < confidence:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, directions) < confidence else (low, middle)
    return high


def directions_of(size: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, count))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def _projected(batches: Iterable[pa.RecordBatch], size: int, count: int, seed: int):
    onto = directions_of(size, count, seed)
    for batch in slices(batches, 4096):
        place = _lists(_unit(_matrix(batch.column("vector"))) @ onto)
        yield pa.RecordBatch.from_arrays([*batch.columns, place], [*batch.schema.names, "place"])


def fit_splits(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and threshold of each inner node of a complete kd-tree, in breadth-first order.

    Nodes are cut at the median of their widest axis.
    """
    axis, threshold = np.zeros((1 << depth) - 1, dtype=np.int64), np.zeros((1 << depth) - 1)
    parts = [sample]
    for node in range(len(axis)):
        own = parts[node]
        if len(own):
            axis[node] = np.argmax(own.max(axis=0) - own.min(axis=0))
            threshold[node] = np.median(own[:, axis[node]])
        left = own[:, axis[node]] < threshold[node]
        parts += [own[left], own[~left]]
    return axis, threshold


def cell_of(places: np.ndarray, axis: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    node = np.zeros(len(places), dtype=np.int64)
    rows = np.arange(len(places))
    for _ in range((len(axis) + 1).bit_length() - 1):
        node = 2 * node + 1 + (places[rows, axis[node]] >= threshold[node])
    return node - len(axis)


def _celled(batches: Iterable[pa.RecordBatch], splits):
    for batch in batches:
        cell = cell_of(_matrix(batch.column("place")), *splits.value)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])


def box_distances(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from places to boxes: ``(places, boxes)``."""
    total = np.zeros((len(places), len(low)))
    for k in range(places.shape[1]):
        x = places[:, k, None]
        total += np.maximum(np.maximum(low[None, :, k] - x, x - high[None, :, k]), 0.0) ** 2
    return total


def reach(score: np.ndarray | float, quantile: float) -> np.ndarray | float:
    """Squared projected distance at which the test holds, given the worst of the found cosines."""
    return quantile * np.maximum(2.0 - 2.0 * score, 0.0) + SLACK


def _asked(batches: Iterable[pa.RecordBatch], cells, quantile: float, start: int, stop: int):
    """``(cell, q, vector, place, bound)``: the cells that queries need next, by rising distance.

    ``bound`` is the cosine of the worst of enough found neighbours, or -2.
    """
    number, low, high = cells.value
    for batch in slices(batches, max(1, (1 << 20) // len(number))):
        bound = batch.column("bound").to_numpy(zero_copy_only=False)
        distance = box_distances(_matrix(batch.column("place")), low, high)
        order = np.argsort(distance, axis=1, kind="stable")[:, start:stop]
        near = np.take_along_axis(distance, order, axis=1) <= reach(bound, quantile)[:, None]
        query, at = np.nonzero(near)
        rows = pa.array(query)
        yield pa.RecordBatch.from_arrays(
            [pa.array(number[order[query, at]]), *(batch.column(c).take(rows) for c in ("q", "vector", "place", "bound"))],
            ["cell", "q", "vector", "place", "bound"],
        )


class Leaves:
    """A kd-tree over the rows of a block: leaves as slices of an order, with their boxes."""

    def __init__(self, places: np.ndarray):
        order = np.arange(len(places))
        cuts, open_parts = [], [(0, len(places))]
        while open_parts:
            begin, end = open_parts.pop()
            own = order[begin:end]
            spread = np.ptp(places[own], axis=0)
            if end - begin <= LEAF or not spread.max() > 0:
                cuts.append((begin, end))
                continue
            half = (end - begin) // 2
            order[begin:end] = own[np.argpartition(places[own, np.argmax(spread)], half)]
            open_parts += [(begin, begin + half), (begin + half, end)]
        self.order = order
        self.begin, self.end = np.array(sorted(cuts)).T
        sorted_places = places[order]
        self.low = np.minimum.reduceat(sorted_places, self.begin)
        self.high = np.maximum.reduceat(sorted_places, self.begin)

    def rows(self, leaves: np.ndarray) -> np.ndarray:
        return np.concatenate([self.order[self.begin[x] : self.end[x]] for x in leaves])


class Block:
    """The rows of one block, ready for queries."""

    def __init__(self, row: np.ndarray, key: np.ndarray, vectors: np.ndarray, places: np.ndarray):
        self.row, self.key, self.places = row, key, places
        # Scaled to a largest component of one: cosines stay, and squares neither vanish nor overflow.
        self.vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        self.norm = np.sqrt((self.vectors**2).sum(axis=1))
        self.unit = self.vectors / self.norm[:, None]
        self.leaves = Leaves(places)

    def cosines(self, rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
        """Sums run over one row at a time, so equal vectors have equal cosines wherever they lie."""
        return (self.vectors[rows] * vector).sum(axis=1) / (self.norm[rows] * math.sqrt((vector**2).sum()))

    def search(self, q: int, vector: np.ndarray, place: np.ndarray, distance: np.ndarray, bound: float, k: int, quantile: float):
        """The best ``k`` rows with a cosine of at least ``bound``, as rows and cosines."""
        vector = vector / np.abs(vector).max()
        unit = vector / math.sqrt((vector**2).sum())
        order = np.argsort(distance, kind="stable")
        best, score = np.empty(0, dtype=np.int64), np.empty(0)
        at, step = 0, 1
        while at < len(order) and distance[order[at]] <= reach(bound, quantile):
            leaves = order[at : at + step]
            at, step = at + step, step * 2
            rows = self.leaves.rows(leaves)
            apart = ((self.places[rows] - place) ** 2).sum(axis=1)
            rows = rows[(apart <= reach(bound, quantile)) & (self.row[rows] != q)]
            rows = rows[self.unit[rows] @ unit >= bound - SLACK]
            if not len(rows):
                continue
            best, score = np.append(best, rows), np.append(score, self.cosines(rows, vector))
            first = np.lexsort((self.row[best], self.key[best], -score))[:k]
            best, score = best[first], score[first]
            if len(best) == k:
                bound = max(bound, score[-1])
        return best, score


# Stands for a missing key: it comes after all others.
NO_KEY = np.iinfo(np.int64).max


def _verified(left: pa.Table, right: pa.Table, k: int, quantile: float) -> pa.Table:
    """Neighbours that the queries of ``right`` have in the block ``left``."""
    schema = pa.schema([("q", pa.int64()), ("score", pa.float64()), ("id", pa.int64()), ("row", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    key = left.column("id").fill_null(NO_KEY).to_numpy()
    block = Block(left.column("row").to_numpy(), key, _matrix(left.column("vector")), _matrix(left.column("place")))
    vectors, places = _matrix(right.column("vector")), _matrix(right.column("place"))
    distance = box_distances(places, block.leaves.low, block.leaves.high)
    queries, bounds = right.column("q").to_numpy(), right.column("bound").to_numpy()
    found = [
        block.search(q, vectors[n], places[n], distance[n], bounds[n], k, quantile) for n, q in enumerate(queries)
    ]
    rows = np.concatenate([r for r, _ in found]).astype(np.int64)
    columns = [
        pa.array(np.repeat(queries, [len(r) for r, _ in found])),
        pa.array(np.concatenate([s for _, s in found])),
        pa.array(block.key[rows], mask=block.key[rows] == NO_KEY),
        pa.array(block.row[rows]),
    ]
    return pa.Table.from_arrays(columns, schema=schema)


def _index(vectors: DataFrame, size: int, directions: int, seed: int) -> tuple[DataFrame, list]:
    """The stored rows with place and block, and ``(cell, blocks, low..., high...)`` of each cell."""
    spark = vectors.sparkSession
    schema = T.StructType([*vectors.schema.fields, T.StructField("place", T.ArrayType(T.DoubleType()))])
    projected = cut_lineage(vectors.mapInArrow(lambda b: _projected(b, size, directions, seed), schema))
    rows = projected.count()
    depth = min(CELLS, max(1, rows // BLOCK)).bit_length() - 1
    sample = projected.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("place").toArrow()
    splits = spark.sparkContext.broadcast(fit_splits(_matrix(sample.column(0)), depth))
    schema = T.StructType([*projected.schema.fields, T.StructField("cell", T.LongType())])
    celled = projected.mapInArrow(lambda b: _celled(b, splits), schema)
    ends = [f(F.col("place")[k]).alias(f"{f.__name__}{k}") for f in (F.min, F.max) for k in range(directions)]
    blocks = F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    # At most CELLS rows.
    cells = celled.groupBy("cell").agg(blocks, *ends).collect()
    counts = spark.createDataFrame([(c["cell"], c["blocks"]) for c in cells], "cell long, blocks int")
    part = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    placed = celled.join(F.broadcast(counts), "cell").withColumn("part", part).drop("blocks")
    return cut_lineage(placed), cells


def nearest(
    df: DataFrame,
    is_query: Column,
    vector: str = "embedding",
    key: str = "vec_id",
    k: int = NEIGHBOURS,
    directions: int = DIRECTIONS,
    confidence: float = CONFIDENCE,
    seed: int = SEED,
) -> DataFrame:
    """``(query_id, rank, key, score)``: the rows with the largest cosines to each query's vector.

    Queries are the rows of ``df`` where ``is_query`` holds; candidates are all rows but the query's
    own. Each of the ``k`` nearest is found with a chance of at least ``confidence``, over the random
    directions; ``score`` is the cosine of the vectors themselves, in double precision. Equal scores
    rank by key, a missing key last.

    Vectors that are missing, zero or hold a missing or non-finite component take no part, nor do empty
    ones and those of another length than the most frequent one. A repeated row is a query, and a
    candidate, of its own. Fewer candidates than ``k`` are all returned; no candidate gives no row.
    Other columns are not read. At most ``SAMPLE`` rows decide where the index is split; all are in it.
    """
    if directions < 2 or directions % 2:
        raise ValueError("the number of directions is even")
    spark = df.sparkSession
    named = dict(zip(df.columns, columns_of(df), strict=True))
    asks = F.coalesce(is_query, F.lit(False)).alias("asks")
    ready = df.select(named[key].cast("long").alias("id"), named[vector].alias("vector"), asks)
    ready = ready.where(usable(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    size = common_length(ready, "vector") or 1
    ready = ready.where(F.size("vector") == size).withColumn("row", F.monotonically_increasing_id())
    index, cells = _index(ready, size, directions, seed)

    quantile = chi_square_quantile(confidence, directions)
    number = np.array([c["cell"] for c in cells], dtype=np.int64)
    ends = np.array([c[2:] for c in cells], dtype=np.float64).reshape(len(cells), 2 * directions)
    boxes = spark.sparkContext.broadcast((number, ends[:, :directions], ends[:, directions:]))
    counts = spark.createDataFrame([(c["cell"], c["blocks"]) for c in cells], "cell long, blocks int")
    queries = index.where("asks").select(F.col("row").alias("q"), F.col("id").alias("query_id"), "vector", "place")
    together = max(1, -(-queries.count() // QUERIES_TOGETHER))

    best = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in
        (("far", T.DoubleType()), ("last", T.BooleanType()), ("id", T.LongType()), ("row", T.LongType()))]))
    state = queries.withColumn("best", F.array().cast(best))
    kind = index.schema["vector"].dataType.simpleString()
    asked = f"cell long, q long, vector {kind}, place array<double>, bound double"
    start, stop = 0, FIRST_CELLS
    while start < len(cells):
        bound = F.when(F.size("best") >= k, -F.get("best", F.lit(k - 1))["far"]).otherwise(-2.0).alias("bound")
        wanted = state.select("q", "vector", "place", bound)
        requests = wanted.mapInArrow(lambda b, i=start, j=stop: _asked(b, boxes, quantile, i, j), asked)
        parts = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part")
        requests = requests.join(F.broadcast(counts), "cell").select(*requests.columns, parts)
        requests = cut_lineage(requests.withColumn("chunk", F.pmod(F.xxhash64("q"), F.lit(together))))
        if requests.isEmpty():
            break
        group = ["cell", "part", "chunk"]
        needed = index.drop("asks").join(requests.select(*group).distinct(), ["cell", "part"])
        own = {c: f"of_{c}" for c in group}
        pairs = needed.groupBy(*group).cogroup(requests.withColumnsRenamed(own).groupBy(*own.values()))
        found = pairs.applyInArrow(lambda a, b: _verified(a, b, k, quantile), FOUND)
        ranked = F.struct((-F.col("score")).alias("far"), F.col("id").isNull().alias("last"), "id", "row")
        merged = found.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(ranked)), 1, k).alias("more"))
        better = F.slice(F.sort_array(F.concat("best", F.coalesce("more", F.array().cast(best)))), 1, k)
        state = cut_lineage(state.join(merged, "q", "left").withColumn("best", better).drop("more"))
        start, stop = stop, stop * GROWTH
    ranks = state.select("query_id", F.posexplode("best").alias("n", "b"))
    return ranks.select("query_id", (F.col("n") + 1).alias("rank"), F.col("b.id").alias(key), (-F.col("b.far")).alias("score"))
