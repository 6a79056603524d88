"""Language-model scores by logistic mixing of hashed-context bit predictors.

Tokens are words and one end for each text. A text is the stream of its words' bytes, each word with a
blank behind it, and a line feed at the end; a byte is eight bits. Each context (the stream's last one
to five bytes, across blanks, and all bytes of the word so far) counts zeros and ones in hashed
slots. The log odds of the contexts are combined by weights that a gate selects, learned online as
bits come, and an adaptive map corrects what comes out.

A bit depends on the last five bytes and on the word so far. The first four bytes of a word see what stands
before it: such a *head* is the byte with its place and the five bytes before. Later bytes see
the word only. So distinct heads, and distinct words from the fifth byte on, are scored once, however
often they occur, and nothing that the contexts see is left out.

Texts are read once: each chunk of them keeps its documents as word numbers, and names its distinct words
and heads in buckets. Names are counted, the predictors learned and every distinct name scored; the
gains go back to the chunks, where documents add them up. Only the slots and weights, whose size is
fixed, reach the driver.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.llm.common import utf8
from twinloom.storage import cut_lineage, scratch_path

# A chunk ends at so many distinct words, tokens or bytes.
CHUNK_WORDS = 400_000
CHUNK_TOKENS = 3_000_000
CHUNK_BYTES = 32 << 20
# Groups of words, and of heads, in which names are counted.
BUCKETS = 512
# Bytes of the longest context of the stream; one less is how many bytes of a word it leaves by the blank.
BACK = 5
HEAD = BACK - 1
# Slots of each context, as powers of two: last byte, two, three, four, all of the word so far, last five.
SLOTS = (16, 18, 19, 20, 20, 20)
STARTS = tuple(np.cumsum([0, *(1 << s for s in SLOTS)]).tolist())
BLOCK = 1 << 12
# Distinct names for each task that counts slots: it hands on all slots, a fixed size.
NAMES_PER_TASK = 500_000
WORDS_AT_ONCE = 4_000
BYTES_AT_ONCE = 1 << 15

PLACES = 4
# Gates: where the word so far is new, by how long a context is known; else by how often it was seen; and
# whether the last five bytes are known.
NEW, SEEN = 3, 7
GATES = (NEW + SEEN) * PLACES * 2
LEVELS, LIMIT = 49, 12.0
# Bits of an online step, and its share of the way to the best weights.
STEP_BITS = 16_384
RATE = 0.03
FIRST_WEIGHTS = (0.1, 0.1, 0.2, 0.2, 0.5, 0.2)
PRIOR = 0.2
LEAST = 1e-6
KEPT = np.uint64((1 << 8 * BACK) - 1)


class Spelled:
    """The bytes of some words, a blank or line feed included, with what lies before each."""

    def __init__(self, words: list[bytes]):
        spelled = [w + b" " if w else b"\n" for w in words]
        self.sizes = np.array([len(s) for s in spelled], np.int64)
        self.data = np.frombuffer(b"".join(spelled), np.uint8)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.word = np.repeat(np.arange(len(words)), self.sizes)
        self.place = np.arange(len(self.data)) - self.begin[self.word]
        # The word's last bytes before each place, the latest lowest, and behind its last.
        last = np.zeros(len(self.data) + 1, np.uint64)
        for back in range(min(BACK, len(self.data))):
            found = np.zeros(len(self.data), np.uint64)
            found[back:] = self.data[: len(self.data) - back]
            found[self.place < back] = 0
            last[1:] |= found << np.uint64(8 * back)
        self.tail = last[self.begin + self.sizes]
        self.recent = np.where(self.place > 0, last[:-1], np.uint64(0))

    def history(self) -> np.ndarray:
        """Last bytes before each place, where a blank and nothing else stands before the word."""
        blank = np.uint64(0x20) << (8 * np.minimum(self.place, BACK)).astype(np.uint64)
        return self.recent | blank & KEPT

    def prefix(self) -> np.ndarray:
        """All bytes so far in the word, as a polynomial whose sums wrap around."""
        powers = np.cumprod(np.full(int(self.place.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
        terms = np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[self.place])
        before = np.append(np.uint64(0), terms)[:-1]
        return before - before[self.begin][self.word]


class Bits:
    """All bits of some bytes, with the slot of each under every context; ``word`` is what a byte belongs to."""

    def __init__(self, words: list[bytes], first: int = 0):
        """Words behind a blank, from their place ``first`` on."""
        spelled = Spelled(words)
        kept = spelled.place >= first
        given = (spelled.history(), spelled.data, spelled.place, spelled.prefix(), spelled.word)
        self._set(*(column[kept] for column in given))

    @classmethod
    def of_heads(cls, heads: np.ndarray) -> Bits:
        made = cls.__new__(cls)
        data, place = (heads & np.uint64(255)).astype(np.uint8), (heads >> np.uint64(56)).astype(np.int64)
        made._set(heads >> np.uint64(8) & KEPT, data, place, np.zeros(len(heads), np.uint64), np.arange(len(heads)))
        return made

    def _set(self, history: np.ndarray, data: np.ndarray, place: np.ndarray, prefix: np.ndarray, word: np.ndarray) -> None:
        short = place.astype(np.uint64) << np.uint64(56) | history & ~(KEPT << (8 * np.minimum(place, HEAD)).astype(np.uint64))
        contexts = [history & np.uint64((1 << 8 * back) - 1) for back in range(1, 5)]
        contexts += [np.where(place < HEAD, short, prefix), history]
        steps = np.arange(8)
        node = ((1 << steps) | (data[:, None] >> (8 - steps)).astype(np.int64)).astype(np.uint64)
        self.bit = (data[:, None] >> (7 - steps) & 1).astype(np.float32).ravel()
        self.word = np.repeat(word, 8)
        self.place = np.repeat(np.minimum(place, PLACES - 1), 8)
        self.slots = []
        for context, bits, start in zip(contexts, SLOTS, STARTS[:-1], strict=True):
            mixed = context * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            mixed = (mixed[:, None] + node) * np.uint64(0x9FB21C651E98DF25)
            self.slots.append((mixed >> np.uint64(64 - bits)).astype(np.int64).ravel() + start)


def heads_of(spelled: Spelled, tokens: np.ndarray) -> Iterator[np.ndarray]:
    """Heads of the tokens of whole texts, for each place; tokens that are too short have none there.

    The place, the bytes before and the byte, from the highest to the lowest. Before a text stands a blank.
    """
    end = (spelled.sizes == 1) & (spelled.data[spelled.begin] == 10)
    tail = np.where(end, np.uint64(0x20), spelled.tail)
    length = np.where(end, BACK, np.minimum(spelled.sizes, BACK))
    before, filled = np.full(len(tokens), 0x20, np.uint64), np.full(len(tokens), BACK)
    before[1:], filled[1:] = tail[tokens[:-1]], length[tokens[:-1]]
    for back in range(2, BACK + 1):
        open_ = np.flatnonzero(filled < BACK)
        if not len(open_):
            break
        first = open_ < back
        earlier = tokens[np.maximum(open_ - back, 0)]
        more = np.where(first, np.uint64(0x20), tail[earlier])
        before[open_] |= more << (8 * filled[open_]).astype(np.uint64) & KEPT
        filled[open_] = np.minimum(filled[open_] + np.where(first, BACK, length[earlier]), BACK)

    def at_place(place: int) -> np.ndarray:
        has = spelled.sizes > place
        at = np.where(has, spelled.begin + place, 0)
        inside = spelled.recent[at] << np.uint64(8) | spelled.data[at]
        rows = np.flatnonzero(has[tokens])
        history = before[rows] << np.uint64(8 * place) & KEPT
        return np.uint64(place << 56) | history << np.uint64(8) | inside[tokens[rows]]

    yield from map(at_place, range(HEAD))


def _log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR)))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class Mixer:
    """Gated weights and the adaptive map behind them."""

    def __init__(self, weights: np.ndarray | None = None, ones: np.ndarray | None = None, seen: np.ndarray | None = None):
        self.weights = np.tile(FIRST_WEIGHTS, (GATES, 1)) if weights is None else weights
        centres = _squash(np.linspace(-LIMIT, LIMIT, LEVELS))
        self.seen = np.full((GATES, LEVELS), 50.0) if seen is None else seen
        self.ones = self.seen * centres if ones is None else ones
        self.mass = np.zeros(GATES)

    @staticmethod
    def gate(seen: list[np.ndarray], place: np.ndarray) -> np.ndarray:
        """By how often the contexts were seen, the word so far above all, and the place in the word."""
        often = np.minimum(np.log2(np.maximum(seen[4], 1)) / 2, SEEN - 1).astype(np.int64)
        new = (seen[3] > 0).astype(np.int64) + (seen[2] > 0)
        return (np.where(seen[4] > 0, NEW + often, new) * PLACES + place) * 2 + (seen[5] > 0)

    def mix(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", self.weights.astype(np.float32)[gate], odds), -LIMIT, LIMIT)

    def refine(self, mixed: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean of the mix and the map's rate at its level, between the two nearest levels."""
        at = (mixed + np.float32(LIMIT)) * np.float32((LEVELS - 1) / (2 * LIMIT))
        low = np.minimum(at.astype(np.int32), LEVELS - 2)
        part = at - low.astype(np.float32)
        rate, cell = (self.ones / self.seen).astype(np.float32).ravel(), gate * LEVELS + low
        mapped = rate[cell] * (1 - part) + rate[cell + 1] * part
        p = np.clip((_squash(mixed) + mapped) / 2, LEAST, 1 - LEAST)
        return p, low, part

    def learn(self, odds: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> None:
        """Online steps over runs of bits: the map first sees what the weights so far make of them."""
        for at in range(0, len(bit), STEP_BITS):
            run = slice(at, at + STEP_BITS)
            self._step(odds[run], gate[run], bit[run], weight[run])

    def _step(self, odds: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> None:
        mixed = self.mix(odds, gate)
        _, low, part = self.refine(mixed, gate)
        for level, share in ((low, 1 - part), (low + 1, part)):
            at = gate * LEVELS + level
            self.seen += np.bincount(at, weight * share, GATES * LEVELS).reshape(GATES, LEVELS)
            self.ones += np.bincount(at, weight * share * bit, GATES * LEVELS).reshape(GATES, LEVELS)
        p = _squash(mixed)
        error, spread = (bit - p) * weight, p * (1 - p) * weight
        mass = np.bincount(gate, weight, GATES)
        self.mass += mass
        for k in range(odds.shape[1]):
            slope = np.bincount(gate, error * odds[:, k], GATES)
            curve = np.bincount(gate, spread * odds[:, k] ** 2, GATES)
            self.weights[:, k] += RATE * slope / (curve + 0.02 * mass + 1.0)


def _names(kind: bool, names: bytes) -> list[bytes] | np.ndarray:
    """Packed words, or heads (``kind``)."""
    return np.frombuffer(names, np.uint64) if kind else names.split(b"\n")


def _bits(names: list[bytes] | np.ndarray):
    """``(slice, bits)`` of so many words, from their fifth byte on, or heads, as are worked on at once."""
    heads = isinstance(names, np.ndarray)
    step = BYTES_AT_ONCE if heads else WORDS_AT_ONCE
    for start in range(0, len(names), step):
        part = slice(start, start + step)
        yield part, Bits.of_heads(names[part]) if heads else Bits(names[part], HEAD)


def _learnable(batches: Iterable[pa.RecordBatch]):
    """``(bits, weights)`` of the names that were learned, from rows ``(bucket, names, n)``."""
    for batch in batches:
        for bucket, names, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            names, n = _names(bucket >= BUCKETS, names), np.frombuffer(n, np.int64).astype(float)
            known = np.flatnonzero(n)
            chosen = names[known] if bucket >= BUCKETS else [names[i] for i in known.tolist()]
            n = n[known]
            for part, bits in _bits(chosen):
                if len(bits.bit):
                    yield bits, n[part][bits.word]


def _slot_counts(batches: Iterable[pa.RecordBatch]):
    """Zeros and ones of all slots over the task's names, in blocks; those without any are left out."""
    totals = np.zeros((2, STARTS[-1]))
    for bits, weight in _learnable(batches):
        ones = bits.bit > 0
        for slots in bits.slots:
            np.add.at(totals[1], slots[ones], weight[ones])
            np.add.at(totals[0], slots[~ones], weight[~ones])
    for block in range(0, STARTS[-1], BLOCK):
        part = totals[:, block : block + BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part.tobytes()])], ["block", "counts"])


def _added(batches: Iterable[pa.RecordBatch]):
    """Sums of blocks that arrive in order, one at a time."""
    current, total = None, None

    def made():
        data = total.astype(np.float32).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([current]), pa.array([data])], ["block", "counts"])

    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if block != current:
                if current is not None:
                    yield made()
                current, total = block, np.zeros(2 * BLOCK)
            total += np.frombuffer(data)
    if current is not None:
        yield made()


def _inputs(bits: Bits, zeros: np.ndarray, ones: np.ndarray, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of each context and the gate; ``leave_out`` takes the bit itself out of the counts."""
    odds = np.empty((len(bits.bit), len(SLOTS)), np.float32)
    seen = []
    for k, slots in enumerate(bits.slots):
        one, zero = ones[slots], zeros[slots]
        if leave_out:
            one, zero = np.maximum(one - bits.bit, 0), np.maximum(zero - (1 - bits.bit), 0)
        odds[:, k] = _log_odds(zero, one)
        seen.append(one + zero)
    return odds, Mixer.gate(seen, bits.place)


def _learned(batches: Iterable[pa.RecordBatch], slots):
    """The mixer after the task's names, with the mass that each gate saw."""
    zeros, ones = slots.value
    mixer = Mixer()
    for bits, weight in _learnable(batches):
        odds, gate = _inputs(bits, zeros, ones, True)
        mixer.learn(odds, gate, bits.bit, weight)
    if mixer.mass.any():
        mass = np.repeat(mixer.mass, len(SLOTS))
        data = np.concatenate([mixer.weights.ravel() * mass, mixer.ones.ravel(), mixer.seen.ravel()])
        mass = np.append(mass, np.zeros(len(data) - len(mass)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(data))), pa.array(data), pa.array(mass)], ["at", "value", "mass"])


class Model:
    """Slots and mixer, both of fixed size."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, mixer: Mixer):
        self.zeros, self.ones, self.mixer = zeros, ones, mixer

    def _gains(self, bits: Bits, size: int) -> np.ndarray:
        odds, gate = _inputs(bits, self.zeros, self.ones, False)
        p, _, _ = self.mixer.refine(self.mixer.mix(odds, gate), gate)
        gain = np.log10(np.where(bits.bit == 1, p, 1 - p))
        return np.bincount(bits.word, gain, size)

    def log10_of(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each token behind a blank; the empty word is the end."""
        return self._gains(Bits(words), len(words))

    def gains(self, names: list[bytes] | np.ndarray) -> np.ndarray:
        """log10 probability of words from their fifth byte on, or of heads."""
        found = [np.empty(0)]
        found += [self._gains(bits, len(names[part])) for part, bits in _bits(names)]
        return np.concatenate(found)


def learn(vocabulary: DataFrame) -> tuple[Broadcast, Mixer]:
    """Fit on ``(bucket, names, n, known)``, the training counts of all distinct names: broadcast slots, and the mixer."""
    spark = vocabulary.sparkSession
    names = vocabulary.select("bucket", "names", "n")
    total = vocabulary.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    tasks = min(math.ceil(total / NAMES_PER_TASK), spark.sparkContext.defaultParallelism)
    parts = names.coalesce(max(1, tasks)).mapInArrow(_slot_counts, "block long, counts binary")
    summed = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_added, "block long, counts binary")
    zeros, ones = np.zeros(STARTS[-1], np.float32), np.zeros(STARTS[-1], np.float32)
    for row in summed.collect():
        at, data = row["block"], np.frombuffer(row["counts"], np.float32)
        size = min(BLOCK, STARTS[-1] - at)
        zeros[at : at + size], ones[at : at + size] = data[:size], data[BLOCK : BLOCK + size]
    slots = spark.sparkContext.broadcast((zeros, ones))
    runs = names.mapInArrow(lambda b: _learned(b, slots), "at long, value double, mass double")
    sums = runs.groupBy("at").agg(F.sum("value").alias("value"), F.sum("mass").alias("mass"))
    found = sorted((r["at"], r["value"], r["mass"]) for r in sums.collect())
    if not found:
        return slots, Mixer()
    values, mass = np.array([v for _, v, _ in found]), np.array([m for _, _, m in found])
    cut = GATES * len(SLOTS)
    first = np.tile(FIRST_WEIGHTS, GATES)
    weights = np.where(mass[:cut] > 0, values[:cut] / np.maximum(mass[:cut], 1e-9), first).reshape(GATES, -1)
    hits, seen = values[cut:].reshape(2, GATES, LEVELS)
    return slots, Mixer(weights, hits, seen)


# --- texts --------------------------------------------------------------------------------

CHUNKS = "chunk long, doc_id {}, held_out boolean, n_bytes long, tokens binary, words binary, bucket int, names binary, n binary"


def _head_buckets(heads: np.ndarray) -> np.ndarray:
    mixed = heads * np.uint64(0x9FB21C651E98DF25)
    return BUCKETS + ((mixed ^ mixed >> np.uint64(29)) >> np.uint64(20)).astype(np.int64) % BUCKETS


def _dealt(bucket: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """Order by bucket, and the runs of each."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)).tolist()
    return order, [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _packed_tokens(tokens: np.ndarray) -> bytes:
    """Compressed by byte: high ones hardly differ."""
    return zlib.compress(tokens.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked_tokens(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


def _distinct_heads(heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct heads of one place by bucket, the bucket of each, and the number of every head given."""
    found, number = np.unique(heads, return_inverse=True)
    bucket = _head_buckets(found)
    order, _ = _dealt(bucket)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found[order], bucket[order], rank[number]


def _chunked(batches: Iterable[pa.RecordBatch]):
    """Rows of documents (word numbers), of their words, and of buckets of distinct words and heads, by chunk."""
    base = TaskContext.get().partitionId() << 32
    names = [part.split()[0] for part in CHUNKS.split(", ")]
    number = count()

    def rows(docs: list[tuple], places: dict[bytes, int], id_type: pa.DataType):
        kinds = [pa.int64(), id_type, pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        chunk = base + next(number)

        def made(length: int, **values):
            values["chunk"] = [chunk] * length
            arrays = [pa.array(values[n], k) if n in values else pa.nulls(length, k) for n, k in zip(names, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names)

        # Words are numbered by bucket.
        words = list(places)
        bucket = np.fromiter((zlib.crc32(w) % BUCKETS for w in words), np.int64, len(words))
        order, runs = _dealt(bucket)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        words = [words[i] for i in order.tolist()]
        tokens = rank[np.concatenate([d[3] for d in docs])]
        sizes = [len(d[3]) for d in docs]
        weight = np.repeat([not d[1] for d in docs], sizes)
        n = np.bincount(tokens[weight], minlength=len(words))
        yield made(
            len(runs),
            bucket=bucket[order][[r.start for r in runs]],
            names=[b"\n".join(words[r]) for r in runs],
            n=[n[r].astype(np.int32).tobytes() for r in runs],
        )
        spelled = Spelled(words)
        for place, heads in enumerate(heads_of(spelled, tokens)):
            found, bucket, at = _distinct_heads(heads)
            n = np.bincount(at[weight[spelled.sizes[tokens] > place]], minlength=len(found)).astype(np.int32)
            runs = _dealt(bucket)[1]
            yield made(
                len(runs),
                bucket=bucket[[r.start for r in runs]],
                names=[found[r].tobytes() for r in runs],
                n=[n[r].tobytes() for r in runs],
            )
        yield made(1, words=[zlib.compress(b"\n".join(words), 1)])
        ends = np.cumsum(sizes).tolist()
        texts = [_packed_tokens(tokens[end - size : end]) for size, end in zip(sizes, ends, strict=True)]
        ids, held_out, n_bytes, _ = zip(*docs, strict=True)
        yield made(len(docs), doc_id=ids, held_out=held_out, n_bytes=n_bytes, tokens=texts)

    places: defaultdict[bytes, int] = defaultdict(count().__next__)
    docs, tokens, size, id_type = [], 0, 0, pa.int64()
    for batch in batches:
        id_type = batch.column(0).type
        columns = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)))
        for doc_id, held_out, text in zip(*columns, strict=True):
            words = text.lower().split()
            words.append(b"")
            docs.append((doc_id, held_out, len(text), np.array([places[w] for w in words], np.int32)))
            tokens, size = tokens + len(words), size + len(text)
            if len(places) > CHUNK_WORDS or tokens > CHUNK_TOKENS or size > CHUNK_BYTES:
                yield from rows(docs, places, id_type)
                places, docs, tokens, size = defaultdict(count().__next__), [], 0, 0
    if docs:
        yield from rows(docs, places, id_type)


COUNTED = "at_chunk long, bucket int, names binary, n binary, at binary, learned long, known long"


def _counted(rows: pa.Table) -> pa.Table:
    """Distinct names of a bucket with their training counts, then for each row of a chunk where its names stand."""
    bucket = rows.column("bucket")[0].as_py()
    lists = [_names(bucket >= BUCKETS, names) for names in rows.column("names").to_pylist()]
    counts = np.concatenate([np.frombuffer(n, np.int32) for n in rows.column("n").to_pylist()])
    ends = np.cumsum([len(names) for names in lists])
    if bucket >= BUCKETS:
        found, at = np.unique(np.concatenate(lists), return_inverse=True)
        packed, size = found.tobytes(), len(found)
    else:
        places: defaultdict[bytes, int] = defaultdict(count().__next__)
        at = np.fromiter((places[w] for names in lists for w in names), np.int64, ends[-1])
        packed, size = b"\n".join(places), len(places)
    n = np.bincount(at, counts, size).astype(np.int64)
    places = [part.astype(np.int32).tobytes() for part in np.split(at, ends[:-1])]
    nothing = [None] * len(lists)
    return pa.table(
        {
            "at_chunk": pa.array([None, *rows.column("chunk").to_pylist()], pa.int64()),
            "bucket": pa.array([bucket] * (len(lists) + 1), pa.int32()),
            "names": pa.array([packed, *nothing], pa.binary()),
            "n": pa.array([n.tobytes(), *nothing], pa.binary()),
            "at": pa.array([None, *places], pa.binary()),
            "learned": pa.array([0 if bucket >= BUCKETS else int(n.sum()), *nothing], pa.int64()),
            "known": pa.array([int((n > 0).sum()), *nothing], pa.int64()),
        }
    )


GAINS = "at_chunk long, bucket int, place int, n binary, gain binary"


def _gained(batches: Iterable[pa.RecordBatch], slots: Broadcast, mixer: Mixer):
    """Counts and gains of the names of each chunk's row, from a bucket's names and the rows behind them."""
    model = Model(*slots.value, mixer)
    n = gain = place = None
    for batch in batches:
        columns = [batch.column(c) for c in ("at_chunk", "bucket", "names", "n", "at")]
        for start in range(0, batch.num_rows, 256):
            made = []
            for chunk, bucket, names, packed, at in zip(*(c.slice(start, 256).to_pylist() for c in columns), strict=True):
                if chunk is None:
                    n, heads = np.frombuffer(packed, np.int64), bucket >= BUCKETS
                    names = _names(heads, names)
                    gain = model.gains(names).astype(np.float32)
                    place = (names >> np.uint64(56)).astype(np.int64) if heads else np.full(len(names), -1)
                else:
                    at = np.frombuffer(at, np.int32)
                    counts = b"" if bucket >= BUCKETS else n[at].tobytes()
                    made.append((chunk, bucket, int(place[at[0]]), counts, gain[at].tobytes()))
            if made:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                arrays = [pa.array(v, k) for v, k in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [part.split()[0] for part in GAINS.split(", ")])


def _summed(docs: pa.Table, gains: pa.Table, train_tokens: int, distinct: int) -> pa.Table:
    """Scores of a chunk's documents from the counts and gains of its words and heads."""
    gains = gains.sort_by([("place", "ascending"), ("bucket", "ascending")])
    place = gains.column("place").to_numpy()

    def joined(column: str, where: int, kind: type) -> np.ndarray:
        chosen = gains.filter(pa.array(place == where)).column(column).to_pylist()
        return np.frombuffer(b"".join(chosen), kind)

    n = joined("n", -1, np.int64)
    words = next(zlib.decompress(w) for w in docs.column("words").to_pylist() if w is not None).split(b"\n")
    docs = docs.filter(docs.column("words").is_null())
    tokens = [_unpacked_tokens(t) for t in docs.column("tokens").to_pylist()]
    n_tokens = np.array([len(t) for t in tokens], np.int64)
    starts = np.cumsum(n_tokens) - n_tokens
    tokens = np.concatenate(tokens)
    spelled = Spelled(words)
    own = joined("gain", -1, np.float32).astype(float)[tokens]
    for at, heads in enumerate(heads_of(spelled, tokens)):
        own[spelled.sizes[tokens] > at] += joined("gain", at, np.float32)[_distinct_heads(heads)[2]]
    score = np.add.reduceat(own, starts)
    base = np.log10((n + 1) / (train_tokens + distinct + 1))
    n_bytes = docs.column("n_bytes").to_numpy()
    return pa.table(
        {
            "doc_id": docs.column("doc_id"),
            "held_out": docs.column("held_out"),
            "n_tokens": pa.array(n_tokens, pa.int64()),
            "n_known": pa.array(np.add.reduceat((n > 0).astype(np.int64)[tokens], starts), pa.int64()),
            "train_tokens": pa.array(np.full(len(starts), train_tokens), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base[tokens], starts), pa.float64()),
            "score": pa.array(score, pa.float64()),
            "bits_per_byte": pa.array(-score / math.log10(2) / np.maximum(n_bytes, 1), pa.float64()),
        }
    )


RESULT = (
    "doc_id {}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double, bits_per_byte double"
)


def score_texts(docs: DataFrame) -> DataFrame:
    """Scores of ``(doc_id, held_out, text)``, learning from rows that are not held out.

    A missing or empty text is one end token. Repeated rows count, and are scored, as often as
    they occur. With nothing to learn from, contexts are empty and every bit costs about one bit;
    an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text")
    id_type = source.schema["doc_id"].dataType.simpleString()
    path = scratch_path(spark, "chunks")
    source.mapInArrow(_chunked, CHUNKS.format(id_type)).write.option("compression", "zstd").parquet(path)
    stored = spark.read.parquet(path)
    texts = stored.where("bucket is null").select("chunk", "doc_id", "held_out", "n_bytes", "tokens", "words")
    named = stored.where("bucket is not null").select("chunk", "bucket", "names", "n")
    # A bucket's names stand before the rows that use them.
    counted = cut_lineage(named.groupBy("bucket").applyInArrow(_counted, COUNTED))
    vocabulary = counted.where("at_chunk is null")
    found = vocabulary.agg(F.coalesce(F.sum("learned"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("bucket") < BUCKETS, F.col("known"))), F.lit(0)))
    train_tokens, distinct = found.first()
    slots, mixer = learn(vocabulary)
    gains = counted.mapInArrow(lambda b: _gained(b, slots, mixer), GAINS)
    return (
        texts.groupBy("chunk")
        .cogroup(gains.groupBy("at_chunk"))
        .applyInArrow(lambda d, g: _summed(d, g, train_tokens, distinct), RESULT.format(id_type))
    )
