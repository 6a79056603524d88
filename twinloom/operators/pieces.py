"""A compact dictionary of pieces, and all matches of its pieces in many words at once.

Pieces lie one behind the other in byte order. For each one, the table knows the longest other piece
that it begins with. All pieces that a text begins with are then found from one place: the last piece
that is not greater than the text. What the two have in common bounds the matches, and these are that
piece or pieces it begins with, link by link. Numpy does it for every place of every word together.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from twinloom.operators.lattice import NO_PIECE, Edges, best_paths

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes compared at once. A byte of zero fills up what a text lacks, so a zero character is spelled in two bytes.
CHUNK = 8
ZERO, SPELLED = b"\x00", b"\xc0\x80"
# Bytes of a table beside the pieces themselves: place, first chunk, link, score and id of each.
BYTES_PER_PIECE = 4 + CHUNK + 4 + 8 + 4


def _spelled(texts: pa.Array | pa.ChunkedArray) -> pa.Array | pa.ChunkedArray:
    return pc.replace_substring(texts.cast(pa.binary()), ZERO, SPELLED)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def portions(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about ``limit`` in total; a larger row stands alone."""
    total = np.cumsum(sizes)
    start = 0
    while start < len(total):
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield start, stop
        start = stop


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each range, one behind the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins, with the end of the last."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _key(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The next ``CHUNK`` bytes as a number that orders like them; zeros stand behind ``end``."""
    key = np.zeros(len(at), dtype=np.uint64)
    last = max(len(data) - 1, 0)
    for k in range(CHUNK):
        inside = at + k < end
        byte = np.where(inside, data[np.minimum(at + k, last)] if len(data) else 0, 0)
        key = key << np.uint64(8) | byte.astype(np.uint64)
    return key


def _same_bytes(difference: np.ndarray) -> np.ndarray:
    """How many leading bytes of a chunk are equal, from the exclusive or of two keys."""
    same = np.zeros(len(difference), dtype=np.int64)
    for k in range(1, CHUNK + 1):
        same += difference >> np.uint64(8 * (CHUNK - k)) == 0
    return same


@dataclass(frozen=True)
class PieceTable:
    """Pieces in byte order; immutable, and a broadcast of a few flat arrays."""

    data: np.ndarray  # bytes of all pieces
    offset: np.ndarray  # where each begins, with the end of the last
    leading: np.ndarray  # the first chunk of each
    link: np.ndarray  # the longest other piece that it begins with, or -1
    score: np.ndarray
    id: np.ndarray

    @staticmethod
    def build(pieces: pa.ChunkedArray, score: pa.ChunkedArray, ids: pa.ChunkedArray) -> PieceTable:
        """From non-empty pieces in any order; of equal ones the best counts, then the lowest id."""
        rows = pa.table({"piece": _spelled(pieces), "score": score.cast(pa.float64()), "id": ids.cast(pa.int32())})
        order = [("piece", "ascending"), ("score", "descending"), ("id", "ascending")]
        rows = rows.take(pc.sort_indices(rows, order)).combine_chunks()
        data, offset = _buffers(_flat(rows.column("piece")))
        first = np.append(True, _common(data, offset[:-2], offset[1:-1], data, offset[1:-1], offset[2:]) < np.maximum(np.diff(offset)[1:], np.diff(offset)[:-1]))
        if not first[: len(rows)].all():
            rows = rows.filter(pa.array(first)).combine_chunks()
            data, offset = _buffers(_flat(rows.column("piece")))
        return PieceTable(
            data.copy(),
            offset.astype(np.int32),
            _key(data, offset[:-1], offset[1:]),
            _links(data, offset),
            rows.column("score").to_numpy(),
            rows.column("id").to_numpy(),
        )

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.data, self.offset, self.leading, self.link, self.score, self.id))

    def __len__(self) -> int:
        return len(self.id)

    def last_not_greater(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each text ``data[at:end]`` the last piece that is not greater, or -1.

        Only among pieces that share its first chunk is there a bisection.
        """
        key = _key(data, at, end)
        low, high = np.searchsorted(self.leading, key), np.searchsorted(self.leading, key, side="right")
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            greater = _greater(self.data, self.offset[middle], self.offset[middle + 1], data, at[open_], end[open_])
            high[open_[greater]] = middle[greater]
            low[open_[~greater]] = middle[~greater] + 1
            open_ = open_[low[open_] < high[open_]]
        return low - 1

    def matches(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(text, piece)`` for every piece that a text begins with."""
        piece = self.last_not_greater(data, at, end)
        text = np.flatnonzero(piece >= 0)
        piece = piece[text]
        common = _common(self.data, self.offset[piece], self.offset[piece + 1], data, at[text], end[text])
        texts, pieces = [], []
        while len(text):
            fits = self.offset[piece + 1] - self.offset[piece] <= common
            texts.append(text[fits])
            pieces.append(piece[fits])
            piece = self.link[piece].astype(np.int64)
            more = piece >= 0
            text, piece, common = text[more], piece[more], common[more]
        none = np.empty(0, dtype=np.int64)
        return np.concatenate([none, *texts]), np.concatenate([none, *pieces])

    def found(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Characters of each word, and every piece in it: begin, end, piece and word, by word, end and begin."""
        data, offset = _buffers(_spelled(words))
        first = np.ones(len(data) + 1, dtype=bool)
        first[:-1] = (data & 0xC0) != 0x80
        place = np.cumsum(first) - 1  # characters before a byte
        begin = place[offset[:-1]]
        size = place[offset[1:]] - begin
        starts = np.flatnonzero(first[:-1])
        owner = np.repeat(np.arange(len(words)), size)
        text, piece = self.matches(data, starts, offset[owner + 1])
        end = place[starts[text] + self.offset[piece + 1] - self.offset[piece]]
        # Places count through all words, so this sorts by word first.
        order = np.lexsort((text, end))
        text, end, piece = text[order], end[order], piece[order]
        word = owner[text]
        return size, text - begin[word], end - begin[word], piece, word

    def segment(self, words: pa.Array, unk_id: int, unknown_score: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best segmentations of the words, one behind the other, and how many each has.

        Of equally good segmentations, that whose last piece is longest. A character without a piece of
        its own may stand alone, as ``unk_id``.
        """
        size, source, target, piece, word = self.found(words)
        # Every word has one state more than characters.
        begin = np.cumsum(size + 1) - (size + 1)
        alone = np.zeros(int((size + 1).sum()), dtype=bool)
        alone[begin + size] = True  # no edge leaves the end
        alone[begin[word] + source] |= target == source + 1
        bare = np.flatnonzero(~alone)
        owner = np.repeat(np.arange(len(size)), size + 1)[bare]
        source = np.append(begin[word] + source, bare)
        target = np.append(begin[word] + target, bare + 1)
        piece = np.append(piece, np.full(len(bare), NO_PIECE))
        order = np.lexsort((source, target))
        edges = Edges(begin, begin + size, source[order], target[order], piece[order], np.append(word, owner)[order])
        path, _ = best_paths(edges, np.append(self.score, unknown_score)[edges.pid])
        found = np.append(self.id, np.int32(unk_id))[edges.pid[path]]
        return found, np.bincount(edges.word[path], minlength=len(words))


@dataclass(frozen=True)
class Spelling:
    """Ids in order with the bytes of their pieces."""

    id: np.ndarray
    data: np.ndarray
    offset: np.ndarray

    @staticmethod
    def build(ids: pa.ChunkedArray, pieces: pa.ChunkedArray) -> Spelling:
        order = pc.sort_indices(ids)
        data, offset = _buffers(_flat(pieces.cast(pa.binary()).take(order)))
        return Spelling(ids.take(order).to_numpy().astype(np.int32), data.copy(), offset.astype(np.int32))

    def texts(self, lists: pa.ListArray) -> list[str]:
        """The pieces of each list joined; ids without a piece are skipped, as are missing lists."""
        per_text = lists.value_lengths().fill_null(0).to_numpy()
        wanted = lists.flatten().fill_null(-1).to_numpy()
        place = np.searchsorted(self.id, wanted)
        known = place < len(self.id)
        known[known] = self.id[place[known]] == wanted[known]
        place = place[known]
        length = np.zeros(len(wanted), dtype=np.int64)
        length[known] = self.offset[place + 1] - self.offset[place]
        whole = self.data[ragged(self.offset[place].astype(np.int64), length[known])].tobytes()
        cuts = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(per_text))]
        return [whole[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _links(data: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """For sorted pieces the longest other one that each begins with.

    That is the piece before it, or one which that piece begins with. Beginnings that are still shared
    form a stack; a piece closes those that go beyond what it has in common with the one before.
    """
    size = np.diff(offset)
    common = np.zeros(len(size), dtype=np.int64)
    common[1:] = _common(data, offset[:-2], offset[1:-1], data, offset[1:-1], offset[2:])
    link = np.full(len(size), -1, dtype=np.int32)
    shared: list[int] = []
    for n in range(len(size)):
        while shared and size[shared[-1]] > common[n]:
            shared.pop()
        if shared:
            link[n] = shared[-1]
        shared.append(n)
    return link


def _common(a: np.ndarray, a_at: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Lengths of common beginnings of ``a[a_at:a_end]`` and ``b[b_at:b_end]``."""
    most = np.minimum(a_end - a_at, b_end - b_at)
    common = np.zeros(len(most), dtype=np.int64)
    live = np.arange(len(most))
    done = 0
    while len(live := live[most[live] > done]):
        x, y = _key(a, a_at[live] + done, a_end[live]), _key(b, b_at[live] + done, b_end[live])
        common[live] = done + _same_bytes(x ^ y)
        live = live[x == y]
        done += CHUNK
    return np.minimum(common, most)


def _greater(a: np.ndarray, a_at: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether ``a[a_at:a_end]`` comes behind ``b[b_at:b_end]``; no text holds a zero byte."""
    greater = np.zeros(len(a_at), dtype=bool)
    live = np.arange(len(a_at))
    done = 0
    while len(live):
        x, y = _key(a, a_at[live] + done, a_end[live]), _key(b, b_at[live] + done, b_end[live])
        greater[live] = x > y
        done += CHUNK
        live = live[(x == y) & (a_at[live] + done < a_end[live])]
    return greater
