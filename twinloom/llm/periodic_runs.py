"""Periodic runs of words: stretches in which a text repeats itself, and texts without them.

The texts of a slice are laid out as one array of word numbers, with a number of its own after
each. A run of period ``p`` holds a stretch of places ``i`` where word ``i`` equals word ``i + p``,
so long that a grid with that step, finer for short periods, meets it. All grids together have
about ``n log n`` places (harmonic sum). At a place, the common extensions of ``i`` and ``i + p``
in both directions give the run.

Extensions come from a difference cover: only suffixes at places whose remainder is in the cover
are sorted. For any two places there is a short step that brings both to such remainders. The words
on the way are compared one by one; from there the answer is a minimum over the sorted suffixes,
read from a sparse table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.llm.common import columns_of, fresh, slices, utf8

MIN_LENGTH = 24
MIN_REPEATS = 3

# A perfect difference set; every remainder is a difference of two of its members.
MODULUS = 31
COVER = (0, 1, 3, 8, 12, 18)

# Bytes of text that are searched together, and places of the grids that are looked at together.
TOGETHER = 4 << 20
PLACES = 1 << 20

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def _steps() -> np.ndarray:
    """For remainders ``(i, j)`` the least step that brings both into the cover."""
    inside = np.isin(np.arange(MODULUS), COVER)
    rows = [[min(d for d in range(MODULUS) if inside[(i + d) % MODULUS] and inside[(j + d) % MODULUS])
             for j in range(MODULUS)] for i in range(MODULUS)]
    return np.array(rows)


STEPS = _steps()


def _agreement(ids: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many words agree from ``i`` and ``j`` on, compared one by one up to ``limit``."""
    length = limit.copy()
    live = np.arange(len(i))
    step = 0
    while len(live := live[limit[live] > step]):
        same = ids[i[live] + step] == ids[j[live] + step]
        length[live[~same]] = step
        live = live[same]
        step += 1
    return length


def _refine(rank: np.ndarray, active: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Split groups of equal rank by ``second``; returns the places that still share a rank.

    A rank is the sorted place of the group's first member, so other ranks don't change.
    """
    order = np.lexsort((second, rank[active]))
    active, second = active[order], second[order]
    group = rank[active]
    opens = np.ones(len(active), dtype=bool)
    opens[1:] = group[1:] != group[:-1]
    parts = opens.copy()
    parts[1:] |= second[1:] != second[:-1]
    at = np.arange(len(active))
    part_start = np.maximum.accumulate(np.where(parts, at, 0))
    rank[active] = group + part_start - np.maximum.accumulate(np.where(opens, at, 0))
    sizes = np.diff(np.append(np.flatnonzero(parts), len(active)))
    return active[np.repeat(sizes, sizes) > 1]


class Extensions:
    """Common extensions to the right in ``ids``, whose last member occurs only once."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        lengths = [-(-(len(ids) - r) // MODULUS) if len(ids) > r else 0 for r in COVER]
        self.offset = np.zeros(MODULUS, dtype=np.int64)
        self.offset[list(COVER)] = np.cumsum([0, *lengths[:-1]])
        # Sampled places, remainder by remainder, so that a slot's next one is a block further on.
        self.place = np.concatenate([np.arange(r, len(ids), MODULUS) for r in COVER])
        self.end = np.repeat(np.cumsum(lengths), lengths)

    @cached_property
    def levels(self) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by their first 1, 2, 4, ... blocks."""
        n = len(self.place)
        rank = np.zeros(n, dtype=np.int64)
        active = np.arange(n)
        padded = np.append(self.ids, np.full(MODULUS, -1))
        for k in range(MODULUS):
            if not len(active):
                break
            active = _refine(rank, active, padded[self.place[active] + k])
        found, blocks = [rank.copy()], 1
        while len(active):
            ahead = active + blocks
            second = np.where(ahead < self.end[active], rank[np.minimum(ahead, n - 1)], -1)
            active = _refine(rank, active, second)
            found.append(rank.copy())
            blocks *= 2
        return found

    @cached_property
    def shared(self) -> np.ndarray:
        """Sparse table: row ``k`` holds minima of ``2^k`` neighbours' common lengths in sorted order."""
        rank = self.levels[-1]
        order = np.empty_like(rank)
        order[rank] = np.arange(len(rank))
        a, b = order[:-1].copy(), order[1:].copy()
        length = np.zeros(len(a), dtype=np.int64)
        for k in reversed(range(len(self.levels) - 1)):
            same = self.levels[k][a] == self.levels[k][b]
            # Suffixes that agree so far do not hold the last word, so a block follows.
            a[same] += 1 << k
            b[same] += 1 << k
            length[same] += MODULUS << k
        i, j = self.place[a], self.place[b]
        most = np.minimum(MODULUS, len(self.ids) - np.maximum(i, j))
        lowest = [length + _agreement(self.ids, i, j, most)]
        while 2 << len(lowest) - 1 <= len(a):
            half = 1 << len(lowest) - 1
            row = lowest[-1].copy()
            row[:-half] = np.minimum(row[:-half], row[half:])
            lowest.append(row)
        return np.stack(lowest)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of words that agree from ``i`` and from ``j`` on, for ``i != j``."""
        step = STEPS[i % MODULUS, j % MODULUS]
        length = _agreement(self.ids, i, j, step)
        synced = np.flatnonzero(length == step)
        # A sample may differ at once; that is found without the table.
        x, y = i[synced] + step[synced], j[synced] + step[synced]
        alike = self.ids[x] == self.ids[y]
        synced, x, y = synced[alike], x[alike], y[alike]
        if len(synced):
            rank = self.levels[-1]
            p = rank[self.offset[x % MODULUS] + x // MODULUS]
            q = rank[self.offset[y % MODULUS] + y // MODULUS]
            low, high = np.minimum(p, q), np.maximum(p, q)
            k = np.frexp((high - low).astype(np.float64))[1] - 1
            length[synced] += np.minimum(self.shared[k, low], self.shared[k, high - (1 << k)])
        return length


def _grids(sizes: np.ndarray, ends: np.ndarray, min_length: int, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods ``(i, p)`` that meet every run, some at a time.

    ``sizes`` fall; texts too short for a period lie behind ``ends`` of the last one that is not.
    """
    periods = np.arange(1, int(sizes[0]) // repeats + 1)
    texts = np.searchsorted(-sizes, -np.maximum(min_length, repeats * periods), side="right")
    gap = np.maximum(min_length - periods, (repeats - 1) * periods)
    limit = np.where(texts > 0, ends[np.maximum(texts, 1) - 1], 0)
    counts = np.maximum((limit - periods - 1) // gap, 0)
    total = np.cumsum(counts)
    start = 0
    while start < len(periods):
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + PLACES, side="right")))
        number = counts[start:stop]
        first = np.cumsum(number) - number
        at = np.arange(number.sum()) - np.repeat(first, number) + 1
        yield at * np.repeat(gap[start:stop], number), np.repeat(periods[start:stop], number)
        start = stop


def find_runs(texts: list[np.ndarray], min_length: int, repeats: int) -> list[np.ndarray]:
    """Rows ``(start, length, period)`` of each text of word numbers (from 0), by start and period."""
    none = np.empty((0, 3), dtype=np.int64)
    result = [none] * len(texts)
    order = sorted((k for k in range(len(texts)) if len(texts[k]) >= min_length), key=lambda k: -len(texts[k]))
    if not order:
        return result
    sizes = np.array([len(texts[k]) for k in order])
    # A number of its own in front, and one behind each text, end every common extension.
    words = 1 + max(int(texts[k].max()) for k in order)
    ends = np.cumsum(sizes + 1)
    ids = np.empty(int(ends[-1]) + 1, dtype=np.int64)
    ids[0] = words
    for n, k in enumerate(order):
        ids[ends[n] - sizes[n] : ends[n]] = texts[k]
        ids[ends[n]] = words + 1 + n
    met = []
    for i, p in _grids(sizes, ends, min_length, repeats):
        hit = ids[i] == ids[i + p]
        met.append((i[hit], p[hit]))
    i, p = (np.concatenate(x) for x in zip(*met, strict=True))
    ahead = Extensions(ids).of(i, i + p)
    back = Extensions(ids[::-1]).of(len(ids) - i, len(ids) - i - p)
    length = ahead + back + p
    long = length >= np.maximum(min_length, repeats * p)
    start, length, p = (i - back)[long], length[long], p[long]
    # The same stretch with a larger period repeats the run of the smallest one.
    rising = np.lexsort((p, length, start))
    start, length, p = start[rising], length[rising], p[rising]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, p = start[first], length[first], p[first]
    inside = np.searchsorted(ends, start)
    begin = ends[inside] - sizes[inside]
    cuts = np.searchsorted(inside, np.arange(len(order) + 1))
    rows = np.stack([start - begin, length, p], axis=1)
    for n, k in enumerate(order):
        own = rows[cuts[n] : cuts[n + 1]]
        result[k] = own[np.lexsort((own[:, 2], own[:, 0]))]
    return result


def _kept(size: int, runs: np.ndarray) -> np.ndarray:
    """Which words remain: those in no run, or among a run's first ``period`` words."""
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:size] == 0


def _searched(texts: list[bytes], min_length: int, repeats: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Runs and collapsed texts."""
    words = [t.split() for t in texts]
    numbers = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode().indices.to_numpy()
    cuts = np.cumsum([len(own) for own in words])[:-1]
    runs = find_runs(np.split(numbers, cuts), min_length, repeats)
    collapsed = []
    for own, found in zip(words, runs, strict=True):
        if len(found):
            own = [own[k] for k in np.flatnonzero(_kept(len(own), found))]
        collapsed.append(b" ".join(own))
    return runs, collapsed


def _portions(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts in order, some megabytes at a time; a longer text stands alone."""
    held: list[bytes] = []
    size = 0
    for text in utf8(column):
        if held and size + len(text) > TOGETHER:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _with_runs(batches: Iterable[pa.RecordBatch], text_at: int, names: list[str], min_length: int, repeats: int):
    for batch in slices(batches, 2000):
        runs: list[np.ndarray] = []
        collapsed: list[bytes] = []
        for texts in _portions(batch.column(text_at)):
            for kept, more in zip((runs, collapsed), _searched(texts, min_length, repeats), strict=True):
                kept += more
        offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        rows = np.concatenate([np.empty((0, 3), dtype=np.int64), *runs])
        fields = pa.StructArray.from_arrays([pa.array(rows[:, k].copy()) for k in range(3)], fields=[pa.field(f.name, pa.int64(), False) for f in RUN])
        made = [pa.ListArray.from_arrays(offsets, fields), pa.array(collapsed, pa.string())]
        kept_columns = [batch.column(c) for c in range(batch.num_columns) if c != text_at]
        yield pa.RecordBatch.from_arrays([*kept_columns, *made], names)


def periodic_runs(
    docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS
) -> DataFrame:
    """The other columns of ``docs``, with ``runs`` and ``collapsed`` for each ``text``.

    ``runs`` lists ``(start, length, period)`` in words, by start and period: stretches of at
    least ``min_length`` words and ``min_repeats`` times their smallest period, as long as they
    go. ``collapsed`` has the words outside of runs and the first ``period`` words of each run,
    joined by blanks. A missing text counts as empty; texts without words have no run and
    collapse to nothing. Texts of any length are searched whole. Rows are independent, so repeated
    ones repeat. Columns of these names get an underscore behind the new one.
    """
    if min_repeats < 2 or min_length < 1:
        raise ValueError("a run repeats itself at least twice, and has a word")
    rest = docs.drop(text)
    runs, collapsed = fresh(rest, "runs"), fresh(rest, "collapsed")
    source = docs.select(*columns_of(docs))
    made = [T.StructField(runs, T.ArrayType(RUN, False)), T.StructField(collapsed, T.StringType())]
    schema = T.StructType([*rest.schema.fields, *made])
    text_at = docs.columns.index(text)
    return source.mapInArrow(lambda b: _with_runs(b, text_at, schema.names, min_length, min_repeats), schema)
