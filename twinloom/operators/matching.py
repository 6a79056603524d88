"""N-grams that two texts of a pair share, for many pairs at once.

Items are numbered, and the n-grams of one order are numbered from those of the order before, so that an
n-gram is one whole number however long it is. Sorted with their pair and side, equal ones lie together.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from twinloom.functions.ngrams import ASCII_PUNCT
from twinloom.operators.pieces import portions

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of texts whose n-grams are matched together.
TOGETHER = 1 << 18
# Keys stay below this.
KEYS = 1 << 62

Items = tuple[np.ndarray, np.ndarray]


def chars_of(texts: list[str]) -> Items:
    """Numbers of the characters that are not blank, one text behind the other, and how many each has."""
    solid = ["".join(t.split()) for t in texts]
    points = np.frombuffer("".join(solid).encode("utf-32-le"), np.uint32)
    present = np.zeros(0x110000, dtype=bool)
    present[points] = True
    return (np.cumsum(present) - 1)[points], np.fromiter(map(len, solid), np.int64, len(solid))


def words_of(texts: list[str], split: Callable[[str], list[str]] = str.split) -> Items:
    """Numbers of the words, one text behind the other, and how many each has."""
    lists = [split(t) for t in texts]
    words = list(chain.from_iterable(lists))
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), np.fromiter(map(len, lists), np.int64, len(lists))


def cut_words(text: str) -> list[str]:
    """Words with one trailing, else one leading, punctuation mark split off, as ``chrf_words`` does."""
    words = []
    for word in text.split():
        if len(word) > 1 and word[-1] in ASCII_PUNCT:
            words += (word[:-1], word[-1])
        elif len(word) > 1 and word[0] in ASCII_PUNCT:
            words += (word[0], word[1:])
        else:
            words.append(word)
    return words


def matched(items: np.ndarray, sizes: np.ndarray, longest: int) -> np.ndarray:
    """Clipped matches of each pair, a column for each order; ``sizes`` are those of all first sides, then of all second."""
    pairs = len(sizes) // 2
    found = np.zeros((pairs, longest), dtype=np.int64)
    side, pair = np.divmod(np.repeat(np.arange(2 * pairs), sizes), max(pairs, 1))
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(items))
    kinds = int(items.max(initial=0)) + 1
    at, gram, bound = np.arange(len(items)), items.astype(np.int64), kinds
    for n in range(1, longest + 1):
        if n > 1:
            if bound * kinds * 2 * pairs >= KEYS:
                distinct, gram = np.unique(gram, return_inverse=True)
                bound = len(distinct)
            fits = left[at] >= n
            at, gram = at[fits], gram[fits]
            gram, bound = gram * kinds + items[at + n - 1], bound * kinds
        if not len(at):
            break
        key = (pair[at] * bound + gram) * 2 + side[at]
        key.sort()
        same = key >> 1
        starts = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
        second = np.add.reduceat(key & 1, starts)
        both = np.minimum(second, np.diff(np.append(starts, len(key))) - second)
        found[:, n - 1] = np.bincount(same[starts] // bound, both, pairs).astype(np.int64)
    return found


def match_batches(
    batches: Iterator[pa.RecordBatch], keep: list[str], kinds: dict[str, tuple[str, str, Callable[[list[str]], Items], int]]
) -> Iterator[pa.RecordBatch]:
    """Columns ``keep`` with ``<kind>_h`` and ``<kind>_r``, numbers of items, and ``<kind>_m``, matches by order.

    ``kinds`` gives the columns of both sides, what makes items of their texts, and the longest order.
    """
    read = list(dict.fromkeys(c for h, r, *_ in kinds.values() for c in (h, r)))
    for batch in batches:
        texts = {c: batch.column(c).cast(pa.string()) for c in read}
        sizes = sum(pc.binary_length(t).to_numpy().astype(np.int64) for t in texts.values())
        for start, stop in portions(sizes, TOGETHER):
            plain = {c: t.slice(start, stop - start).to_pylist() for c, t in texts.items()}
            columns, names = [batch.column(c).slice(start, stop - start) for c in keep], [*keep]
            for kind, (hyp, ref, items_of, longest) in kinds.items():
                items, lengths = items_of(plain[hyp] + plain[ref])
                counts = matched(items, lengths, longest)
                offsets = pa.array(np.arange(len(counts) + 1) * longest, pa.int32())
                columns += [pa.array(lengths[: len(counts)], pa.int32()), pa.array(lengths[len(counts) :], pa.int32())]
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(counts.ravel())))
                names += [f"{kind}_h", f"{kind}_r", f"{kind}_m"]
            yield pa.RecordBatch.from_arrays(columns, names)
