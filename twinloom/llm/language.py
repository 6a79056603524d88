"""Language identification by rank-order profiles.

A profile is the most frequent letter n-grams in order. A text goes to the language whose profile
has the smallest out-of-place distance to the text's own: the sum over its n-grams of how far
their ranks lie apart, or of the longest distance where the profile lacks one.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
PROFILE = 400
# Code points counted at once. One has 21 bits, so up to three make one number.
CHUNK = 1 << 20
BITS = 21
# Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """Lower-case code point of each letter; a blank for all else, as between words."""
    table = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            lower = char.lower()
            table[code] = ord(lower) if len(lower) == 1 else code
    return table


def _letters(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _letter_table()[codes]


def _ngrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all n-grams of one to three inside words and their two edges, and for each the
    place of one of its letters. Runs of blanks are one blank; it may only stand at an end."""
    blank = codes == 32
    at = np.flatnonzero(np.append(True, ~(blank[1:] & blank[:-1])))
    wide, letter = codes[at].astype(np.uint64), ~blank[at]
    shift = np.uint64(BITS)
    ones, threes = np.flatnonzero(letter), np.flatnonzero(letter[1:-1])
    pairs = wide[:-1] << shift | wide[1:]
    twos = np.arange(len(pairs)) + letter[1:]
    keys = [wide[ones], pairs, pairs[threes] << shift | wide[threes + 2]]
    return np.concatenate(keys), at[np.concatenate([ones, twos, threes + 1])]


def ranked_ngrams(text: str, size: int = PROFILE) -> np.ndarray:
    """The text's most frequent n-grams; equal counts in the order of their numbers."""
    codes = np.concatenate([[32], _letters(text), [32]]).astype(np.uint32)
    totals: dict[int, int] | None = None
    if len(codes) <= CHUNK:
        keys, counts = np.unique(_ngrams(codes)[0], return_counts=True)
    else:
        totals = Counter()
        # Chunks end between words, so no n-gram is cut except inside a word longer than a chunk.
        start = 0
        while start < len(codes) - 1:
            end = min(start + CHUNK, len(codes))
            if end < len(codes):
                blanks = np.flatnonzero(codes[start + 1 : end] == 32)
                end = start + 2 + int(blanks[-1]) if len(blanks) else end
            part, n = np.unique(_ngrams(codes[start:end])[0], return_counts=True)
            totals.update(dict(zip(part.tolist(), n.tolist(), strict=True)))
            start = end - 1
        keys = np.array(sorted(totals), np.uint64)
        counts = np.array([totals[k] for k in keys.tolist()])
    order = np.argsort(-counts, kind="stable")[:size]
    return keys[order]


class Profiles:
    """Ranks of each language's n-grams; a missing one lies ``size`` places away."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(ranked), size
        self.keys = np.unique(np.array([k for v in ranked.values() for k in v], np.uint64))
        # The last column stands for n-grams that no profile has.
        self.ranks = np.full((len(self.langs), len(self.keys) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            places = np.searchsorted(self.keys, np.array(ranked[lang], np.uint64))
            self.ranks[i, places] = np.arange(len(places))

    def predict(self, text: str) -> tuple[str, float]:
        """The nearest language and how near it is, from 0 to 1; ties go to the first by name."""
        if not self.langs or not np.any(_letters(text) != 32):
            return UNKNOWN, 0.0
        keys = ranked_ngrams(text, self.size)
        places = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        places[self.keys[places] != keys] = len(self.keys)
        ranks = self.ranks[:, places]
        apart = np.abs(ranks - np.arange(len(keys)))
        distances = np.where(ranks < 0, self.size, np.minimum(apart, self.size)).sum(axis=1)
        best = int(np.argmin(distances))
        return self.langs[best], 1.0 - float(distances[best]) / (self.size * len(keys))


def _ngram_counts(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts of counted words, each between two blanks."""
    codes = _letters(" " + " ".join(words) + " ")
    weights = np.repeat([*words.values()], [len(w) + 1 for w in words])
    keys, letters = _ngrams(codes)
    unique, place = np.unique(keys, return_inverse=True)
    # A word's letters follow the blank before it.
    return unique, np.bincount(place, weights[np.minimum(letters, len(codes) - 2) - 1]).astype(np.int64)


def _counted(batches: Iterable[pa.RecordBatch]):
    """Partial n-gram counts of a task; words are counted first, as each repeats many times."""

    def made(counts: dict[str, Counter]):
        for lang, words in counts.items():
            if words:
                keys, n = _ngram_counts(words)
                columns = [pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])

    counts: defaultdict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[lang].update(text.split())
        if sum(map(len, counts.values())) > HELD_WORDS:
            yield from made(counts)
            counts.clear()
    yield from made(counts)


def learn_profiles(labelled: DataFrame, size: int = PROFILE) -> DataFrame:
    """``(lang, gram, n, rank)``: each language's most frequent n-grams over all its texts.

    Words end at anything that is not a letter, so n-grams at a word's edge hold one blank.
    """
    source = labelled.where("lang is not null and text is not null").select("lang", "text")
    counts = source.mapInArrow(_counted, "lang string, gram long, n long")
    totals = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return totals.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < size)


def _predicted(batches: Iterable[pa.RecordBatch], profiles: Profiles):
    for batch in batches:
        found = [profiles.predict(t or "") for t in batch.column(1).to_pylist()]
        langs, scores = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
            ["doc_id", "lang_pred", "score"],
        )


def identify(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score``.

    ``und`` with score 0 where the text is missing, has no letter, or nothing was learned.
    Repeated rows are judged alike; only ``doc_id`` and ``text`` are read.
    """
    ranked: dict[str, list[int]] = {}
    # A profile for each language, of fixed size.
    for row in learned.orderBy("lang", "rank").select("lang", "gram").collect():
        ranked.setdefault(row["lang"], []).append(row["gram"])
    profiles = Profiles(ranked)
    source = docs.select("doc_id", "text")
    schema = T.StructType(
        [source.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    return source.mapInArrow(lambda b: _predicted(b, profiles), schema)
