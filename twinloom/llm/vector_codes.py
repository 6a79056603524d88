"""Product codes of vectors: short integer codes from small codebooks, one for each part of a vector.

A task keeps its vectors in groups. Inside a group the points of each part lie in Hilbert order, cut
into flat blocks that know their box and their sum. The groups are stored once; no vector moves after
that. In a round, the distances between a block's box and the entries leave a shortlist: entries that
are nearest to some place in the box, whatever the points. A block with one such entry goes to it as a
whole, by its stored sum; the points of the others are compared with their shortlist only. All is
integer arithmetic, so results do not depend on how rows are spread.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.llm.common import columns_of, slices
from twinloom.storage import cut_lineage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256

# Rows of a group (places are 16-bit numbers), points of a block.
GROUP = 16_384
BLOCK = 32
# Bits of a place on the curve, and of one component of it. Order has no effect on results.
KEY_BITS = 62
COMPONENT_BITS = 10

STORED = ("points", "places", "low", "high", "sums")


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of the rows of ``x``, whose components have ``bits`` bits.

    Skilling's transposition: undo the rotations of each level, then Gray-encode and interleave.
    """
    axes = [c.astype(np.int64) for c in x.T]
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for i, axis in enumerate(axes):
            inverted = (axis & level) != 0
            swapped = np.where(inverted, 0, (axes[0] ^ axis) & below)
            axes[0] = axes[0] ^ np.where(inverted, below, swapped)
            axes[i] = axes[i] ^ swapped
        level >>= 1
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turned = np.zeros(len(x), dtype=np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        turned = np.where(axes[-1] & level, turned ^ (level - 1), turned)
        level >>= 1
    key = np.zeros(len(x), dtype=np.int64)
    for bit in reversed(range(bits)):
        for axis in axes:
            key = key << 1 | ((axis ^ turned) >> bit) & 1
    return key


def _curve_order(points: np.ndarray) -> np.ndarray:
    used = points[:, :KEY_BITS].astype(np.int64)
    low = used.min(axis=0)
    spread = np.maximum(used.max(axis=0) - low, 1)
    bits = min(COMPONENT_BITS, KEY_BITS // used.shape[1])
    return np.argsort(hilbert_keys((used - low) * ((1 << bits) - 1) // spread, bits), kind="stable")


def largest(size: int) -> int:
    """What components count as at most, on either side of zero, so that an error fits a long.

    It is 2^27 for vectors of 64 components.
    """
    return 1 << (60 - max(size - 1, 0).bit_length()) // 2


def integers(vectors: np.ndarray, parts: int, scale: float) -> np.ndarray:
    """``floor(scale * x)`` as ``(parts, rows, width)``; a last part that falls short gets zeros."""
    rows, size = vectors.shape
    bound = largest(size)
    width = -(-size // parts)
    whole = np.zeros((rows, parts * width), dtype=np.int32)
    whole[:, :size] = np.clip(np.floor(vectors.astype(np.float64) * scale), -bound, bound)
    return np.ascontiguousarray(whole.reshape(rows, parts, width).transpose(1, 0, 2))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _blocks(points: np.ndarray) -> dict[str, np.ndarray]:
    """The stored arrays of a group, from ``(parts, rows, width)``."""
    parts, rows, width = points.shape
    places = np.empty((parts, rows), dtype=np.uint16)
    starts = np.arange(0, rows, BLOCK)
    shape = (parts, len(starts), width)
    low, high, sums = np.empty(shape, np.int32), np.empty(shape, np.int32), np.empty(shape, np.int64)
    ordered = np.empty_like(points)
    for k in range(parts):
        places[k] = _curve_order(points[k])
        ordered[k] = points[k][places[k]]
        low[k] = np.minimum.reduceat(ordered[k], starts)
        high[k] = np.maximum.reduceat(ordered[k], starts)
        sums[k] = np.add.reduceat(ordered[k].astype(np.int64), starts)
    return dict(zip(STORED, (ordered, places, low, high, sums), strict=True))


def _grouped(batches: Iterable[pa.RecordBatch], vector_at: int, kept: list[str], parts: int, scale: float):
    """Groups of up to ``GROUP`` rows: the kept columns as lists, and the stored arrays."""

    def group(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        stored = _blocks(integers(_matrix(whole.column(vector_at).chunk(0)), parts, scale))
        rest = [c for k, c in enumerate(whole.columns) if k != vector_at]
        lists = [pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), c.chunk(0)) for c in rest]
        return pa.RecordBatch.from_arrays(
            [*lists, *(pa.array([a.tobytes()], pa.binary()) for a in stored.values())], [*kept, *STORED]
        )

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in slices(batches, GROUP // 4):
        if rows + batch.num_rows > GROUP:
            yield group(held)
            held, rows = [], 0
        held.append(batch)
        rows += batch.num_rows
    if rows:
        yield group(held)


def _arrays(batch: pa.RecordBatch, row: int, parts: int, width: int) -> dict[str, np.ndarray]:
    kinds = (np.int32, np.uint16, np.int32, np.int32, np.int64)
    raw = {c: np.frombuffer(batch.column(c)[row].as_buffer(), kind) for c, kind in zip(STORED, kinds, strict=True)}
    return {c: a.reshape(parts, -1) if c == "places" else a.reshape(parts, -1, width) for c, a in raw.items()}


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries can be nearest to a place in each box: ``(boxes, entries)``.

    An entry is out if another one is nearer to every place of the box: because its farthest place
    is nearer, or, for the entry nearest to the middle, by the corner where it does worst.
    """
    entries = book.astype(np.int64)
    low, high = low.astype(np.int64), high.astype(np.int64)
    below, above = low[:, None] - entries[None], entries[None] - high[:, None]
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
    most = (np.maximum(-below, -above) ** 2).sum(axis=2)
    near = least <= most.min(axis=1, keepdims=True)
    middle = (low + high) // 2
    rival = entries[((middle[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)]
    # |x - rival|^2 - |x - entry|^2 is linear in x, and largest at a corner of the box.
    slope = 2 * (entries[None] - rival[:, None])
    worst = (np.where(slope > 0, high[:, None], low[:, None]) * slope).sum(axis=2)
    worst += (rival**2).sum(axis=1)[:, None] - (entries**2).sum(axis=1)[None]
    return near & (worst >= 0)


def _compared(points: np.ndarray, blocks: np.ndarray, near: np.ndarray, book: np.ndarray) -> Iterator[tuple]:
    """``(rows, entry, distance)`` of the points of ``blocks``, compared with their shortlists.

    Blocks with about equally long shortlists are worked on together. Entries come by index and a
    short list repeats its last one, so the first of equally near entries has the lowest index.
    """
    length = near.sum(axis=1)
    entries = book.astype(np.int64)
    room = 1
    while len(blocks):
        now = length[blocks] <= room
        some, blocks = blocks[now], blocks[~now]
        if len(some):
            # Entries of the shortlist first, each list in order of index.
            listed = np.argsort(~near[some], axis=1, kind="stable")[:, :room]
            last = np.minimum(np.arange(room)[None], length[some][:, None] - 1)
            listed = np.take_along_axis(listed, last, axis=1)
            rows = some[:, None] * BLOCK + np.arange(BLOCK)[None]
            inside = rows < len(points)
            own = points[np.minimum(rows, len(points) - 1)].astype(np.int64)
            distance = np.zeros((len(some), BLOCK, room), dtype=np.int64)
            for k in range(points.shape[1]):
                distance += (own[:, :, k, None] - entries[listed][:, None, :, k]) ** 2
            best = distance.argmin(axis=2)
            entry = np.take_along_axis(listed, best, axis=1)
            nearest = np.take_along_axis(distance, best[:, :, None], axis=2)[:, :, 0]
            yield rows[inside], entry[inside], nearest[inside]
        room *= 2


def part_sums(part: dict[str, np.ndarray], book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points and component sums of each entry's share of one part of a group."""
    points = part["points"]
    near = shortlists(part["low"], part["high"], book)
    alone = near.sum(axis=1) == 1
    sizes = np.minimum(BLOCK, len(points) - np.arange(len(near)) * BLOCK)
    count = np.zeros(len(book), dtype=np.int64)
    total = np.zeros(book.shape, dtype=np.int64)
    entry = near.argmax(axis=1)
    np.add.at(count, entry[alone], sizes[alone])
    np.add.at(total, entry[alone], part["sums"][alone])
    for rows, found, _ in _compared(points, np.flatnonzero(~alone), near, book):
        count += np.bincount(found, minlength=len(book))
        np.add.at(total, found, points[rows].astype(np.int64))
    return count, total


def part_codes(part: dict[str, np.ndarray], book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of each row of a group, for one part."""
    points, places = part["points"], part["places"]
    code, error = np.empty(len(points), dtype=np.int64), np.empty(len(points), dtype=np.int64)
    near = shortlists(part["low"], part["high"], book)
    for rows, found, distance in _compared(points, np.arange(len(near)), near, book):
        code[places[rows]], error[places[rows]] = found, distance
    return code, error


def _each_part(batches: Iterable[pa.RecordBatch], parts: int, width: int):
    """``(batch, row, part, arrays of the part)`` for all groups."""
    for batch in batches:
        for row in range(batch.num_rows):
            stored = _arrays(batch, row, parts, width)
            for k in range(parts):
                yield batch, row, k, {c: a[k] for c, a in stored.items()}


def _summed(batches: Iterable[pa.RecordBatch], books):
    """One row for each used entry: ``part, entry, n, sums`` over the whole task."""
    current = books.value
    count = np.zeros(current.shape[:2], dtype=np.int64)
    total = np.zeros(current.shape, dtype=np.int64)
    for _, _, k, part in _each_part(batches, len(current), current.shape[2]):
        own_count, own_total = part_sums(part, current[k])
        count[k] += own_count
        total[k] += own_total
    part, entry = np.nonzero(count)
    offsets = pa.array(np.arange(len(part) + 1) * current.shape[2], pa.int32())
    sums = pa.ListArray.from_arrays(offsets, pa.array(total[part, entry].ravel()))
    yield pa.RecordBatch.from_arrays(
        [pa.array(part), pa.array(entry), pa.array(count[part, entry]), sums], ["part", "entry", "n", "sums"]
    )


def _coded(batches: Iterable[pa.RecordBatch], books, kept: list[str]):
    current = books.value
    parts = len(current)
    codes: list[np.ndarray] = []
    error = 0
    for batch, row, k, part in _each_part(batches, parts, current.shape[2]):
        code, distance = part_codes(part, current[k])
        codes, error = ([code], distance) if k == 0 else ([*codes, code], error + distance)
        if k == parts - 1:
            offsets = pa.array(np.arange(len(code) + 1) * parts, pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.stack(codes, axis=1).ravel().astype(np.int32)))
            rest = [batch.column(c)[row].values for c in kept]
            yield pa.RecordBatch.from_arrays([*rest, lists, pa.array(error)], [*kept, "codes", "error"])


def usable(vector: Column) -> Column:
    """Vectors with components, all of them finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def common_length(vectors: DataFrame, vector: str) -> int | None:
    """The most frequent length, the larger of equally frequent ones; None without vectors."""
    lengths = vectors.groupBy(F.size(vector).alias("length")).count()
    row = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    return row["length"] if row else None


def compress(
    df: DataFrame,
    vector: str = "embedding",
    key: str = "vec_id",
    keep: tuple[str, ...] = (),
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: float = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """``(key, *keep, codes, error)`` of each vector, and codebooks ``(parts, entries, width)``.

    A component ``x`` counts as ``floor(scale * x)``, and as 2^27 at most on either side of zero. The
    codebooks start as the parts of the vectors with the ``entries`` smallest keys; equal keys go by
    their vectors, missing ones come last. A round gives every part to its nearest entry, the first of
    equally near ones, and moves an entry to the floor of its parts' mean; an unused one stays.
    ``codes`` has the final entry of each part, ``error`` the squared distances to them.

    Vectors that are missing, empty or hold a missing or non-finite component take no part, nor do
    those of another length than the most frequent one. A length that ``parts`` does not divide is
    filled up with zeros. Repeated rows repeat. Without vectors there are no rows, and no entries.
    Other columns are not read.
    """
    if not 0 < parts or not 0 < entries:
        raise ValueError("there is at least one part and one entry")
    kept = [key, *keep]
    named = dict(zip(df.columns, columns_of(df), strict=True))
    columns = [named[c].alias(f"k{n}") for n, c in enumerate(kept)]
    ready = df.select(*columns, named[vector].alias("vector")).where(usable(F.col("vector")))
    length = common_length(ready, "vector")
    ready = ready.where(F.size("vector") == (length or 0))
    width = -(-(length or 1) // parts)

    first = ready.orderBy(F.col("k0").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = np.array([r["vector"] for r in first], dtype=np.float64).reshape(len(first), length or 0)
    books = integers(start, parts, scale).astype(np.int64) if first else np.zeros((parts, 0, width), np.int64)
    source = ready.schema
    fields = [T.StructField(c, T.ArrayType(source[c].dataType)) for c in source.names[:-1]]
    schema = T.StructType([*fields, *(T.StructField(c, T.BinaryType()) for c in STORED)])
    names = source.names[:-1]
    groups = cut_lineage(
        ready.mapInArrow(lambda b: _grouped(b, len(names), names, parts, scale), schema)
    )

    context = df.sparkSession.sparkContext
    for _ in range(rounds if first else 0):
        shared = context.broadcast(books)
        shares = groups.select(*STORED).mapInArrow(
            lambda b, s=shared: _summed(b, s), "part long, entry long, n long, sums array<long>"
        )
        sums = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]
        # At most one row for each entry comes back.
        moved = shares.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect()
        books = books.copy()
        for part, entry, n, *total in moved:
            books[part, entry] = np.array(total) // n
        shared.destroy()

    shared = context.broadcast(books)
    out = T.StructType(
        [
            *(T.StructField(c, source[c].dataType) for c in names),
            T.StructField("codes", T.ArrayType(T.IntegerType())),
            T.StructField("error", T.LongType()),
        ]
    )
    coded = groups.mapInArrow(lambda b: _coded(b, shared, names), out)
    return coded.select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(kept)), "codes", "error"), books


# Bytes of labels and sums that are sent to every task; more of them are joined.
SENT_BYTES = 8 << 20


def total_errors(coded: DataFrame, by: str = "label", name: str = "label_error") -> DataFrame:
    """``coded`` with the summed ``error`` of the rows that share ``by``, missing values together.

    Sums combine inside tasks. A sum beyond the range of a long counts as its largest value.
    """
    stored = cut_lineage(coded)
    whole = F.least(F.sum(F.col("error").cast("decimal(19,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)"))
    sums = cut_lineage(stored.groupBy(F.col(by).alias("_by")).agg(whole.cast("long").alias(name)))
    size = sums.agg(F.sum(16 + F.coalesce(F.octet_length(F.col("_by").cast("string")), F.lit(0)))).first()[0]
    small = F.broadcast(sums) if (size or 0) <= SENT_BYTES else sums
    return stored.join(small, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
