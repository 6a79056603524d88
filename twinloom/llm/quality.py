"""Quality rules: fixed rules, and an isolation forest on rule statistics.

Statistics of each text come from one Arrow pass. Forests are grown on small subsamples, as the
method asks: one each for characters, repetition and words, so that what is odd in one respect is
not hidden by being plain in the others. Their thresholds are set from all labelled rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from itertools import product
from math import log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.llm.common import give_back, slices, utf8
from twinloom.storage import cut_lineage

# Fixed rules.
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"

# The forest: its subsamples are the only bounded part, and bounded by the method.
TREES = 100
SUBSAMPLE = 256
# Share of labelled good rows that the forest may reject.
GOOD_LOSS = 0.002
SCORE_STEPS = 1000
# Parts in which kinds of statistics share that loss.
SHARES = 20

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["upper", "shout", "symbol", "repeat", "dup_line", "words", "word_length"]
# Statistics of one kind share a forest.
KINDS = (slice(0, 3), slice(3, 5), slice(5, 7))
STATS = T.StructType(
    [T.StructField(c, T.LongType()) for c in BASE] + [T.StructField(c, T.DoubleType()) for c in FEATURES]
)

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_CONTINUED = bytes(range(0x80, 0xC0))
_WIDE = bytes(range(0xC0, 0x100))


def _count(text: bytes, members: bytes) -> int:
    return len(text) - len(text.translate(None, members))


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a window of five that occurs twice or more."""
    if len(words) < WINDOW + 1:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


def text_stats(text: bytes) -> tuple:
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) - _count(joined, _CONTINUED)
    symbols = _count(joined, SYMBOLS)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    letters = max(_count(joined, _UPPER + _LOWER + _WIDE), 1)
    # Roots and logarithms spread the small values, where random cuts would hardly fall.
    features = (
        _count(joined, _UPPER) / letters,
        sqrt(_count(joined, b"!?") / max(chars, 1)),
        sqrt(symbols / max(chars, 1)),
        sqrt(repeats / max(len(words), 1)),
        sqrt(dup_lines / max(len(lines), 1)),
        log1p(len(words)),
        log1p(chars / max(len(words), 1)),
    )
    return (len(words), chars, symbols, dup_lines, repeats, *features)


def _stats_array(texts: list[bytes]) -> pa.StructArray:
    rows = [text_stats(t) for t in texts]
    columns = list(zip(*rows, strict=True)) or [()] * len(STATS)
    kinds = [pa.int64()] * len(BASE) + [pa.float64()] * len(FEATURES)
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.StructArray.from_arrays(arrays, names=STATS.names)


def _with_stats(batches: Iterable[pa.RecordBatch], names: list[str]):
    for batch in slices(batches, 1000):
        made = _stats_array(utf8(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *made.flatten()], ["doc_id", *names])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts and the features of every text."""
    source = docs.select("doc_id", "text")
    schema = T.StructType([source.schema["doc_id"], *STATS.fields])
    return source.mapInArrow(lambda batches: _with_stats(batches, STATS.names), schema)


# --- isolation forest ---------------------------------------------------------------------


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    many = np.maximum(n, 2)
    length = 2 * (np.log(np.maximum(many - 1, 1)) + np.euler_gamma) - 2 * (many - 1) / many
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, length))


class Forest:
    """Random splits as arrays: node i of tree t has feature, cut and children, or a path length."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 42):
        draw = np.random.default_rng(seed)
        size = min(subsample, len(rows))
        self.height = max(int(np.ceil(np.log2(max(size, 2)))), 1)
        self.unit = max(float(_mean_path(size)), 1e-9)
        nodes = 2 ** (self.height + 1)
        self.feature = np.zeros((trees, nodes), np.int32)
        self.cut = np.full((trees, nodes), np.inf)
        self.path = np.zeros((trees, nodes))
        for t in range(trees):
            chosen = rows[draw.choice(len(rows), size, replace=False)]
            self._grow(t, 1, chosen, 0, draw)

    def _grow(self, t: int, node: int, rows: np.ndarray, depth: int, draw: np.random.Generator) -> None:
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth == self.height or not len(open_features):
            # Everything below goes left, so the length is the same at any depth.
            while True:
                self.path[t, node] = depth + float(_mean_path(len(rows)))
                if 2 * node >= self.path.shape[1]:
                    return
                node *= 2
        feature = int(draw.choice(open_features))
        cut = draw.uniform(low[feature], high[feature])
        self.feature[t, node], self.cut[t, node] = feature, cut
        left = rows[:, feature] <= cut
        self._grow(t, 2 * node, rows[left], depth + 1, draw)
        self._grow(t, 2 * node + 1, rows[~left], depth + 1, draw)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for rows that few splits isolate."""
        total = np.zeros(len(rows))
        at_row = np.arange(len(rows))
        for feature, cut, path in zip(self.feature, self.cut, self.path, strict=True):
            node = np.ones(len(rows), np.int64)
            for _ in range(self.height):
                node = 2 * node + (rows[at_row, feature[node]] > cut[node])
            total += path[node]
        return 2.0 ** (-total / len(self.path) / self.unit)


Forests = list[Forest] | None
ANOMALIES = [f"anomaly_{k}" for k in range(len(KINDS))]


def _anomalies(forests: Forests, columns: list[pa.Array]) -> np.ndarray:
    """One column of scores for each kind."""
    if forests is None or not len(columns[0]):
        return np.zeros((len(columns[0]), len(KINDS)))
    rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])
    return np.column_stack([f.scores(rows[:, k]) for f, k in zip(forests, KINDS, strict=True)])


def _with_scores(batches: Iterable[pa.RecordBatch], forests: Forests):
    for batch in batches:
        made = _anomalies(forests, [batch.column(c) for c in FEATURES])
        columns = [pa.array(made[:, k]) for k in range(len(KINDS))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *ANOMALIES])


def _scored(stats: DataFrame, forests: Forests) -> DataFrame:
    schema = T.StructType([*stats.schema.fields, *(T.StructField(a, T.DoubleType()) for a in ANOMALIES)])
    return stats.mapInArrow(lambda b: _with_scores(b, forests), schema)


def _sample(stats: DataFrame, rows: int) -> np.ndarray:
    """About ``rows`` rows, the same ones on every run: those with the smallest hashes."""
    total = stats.count()
    drawn = F.xxhash64("doc_id", *FEATURES) / F.lit(2.0**64) + F.lit(0.5)
    few = stats.where(drawn <= min(rows / max(total, 1), 1.0)) if total > rows else stats
    found = few.select(*FEATURES).toPandas().to_numpy(float)
    return found[np.lexsort(found.T)] if len(found) else found


def _thresholds(scored: DataFrame, labels: DataFrame, good_loss: float) -> list[float]:
    """For each kind the score above which the most labelled bad rows go while few good ones do.

    All labelled rows count, as histograms of fixed size. The kinds share ``good_loss`` as catches most.
    Where no bad row is odd in a kind, what is odder than all good rows goes. Infinite, so that nothing
    is rejected, unless both labels occur.
    """
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality")
    steps = [F.struct(F.lit(k).alias("kind"), F.floor(F.col(a) * SCORE_STEPS).alias("step")) for k, a in enumerate(ANOMALIES)]
    table = scored.where(f"n_words >= {MIN_WORDS}").select("doc_id", *ANOMALIES).join(known, "doc_id")
    counts = table.select("quality", F.explode(F.array(*steps)).alias("at")).groupBy("at.kind", "at.step").agg(
        F.count_if(F.col("quality") > 0).alias("good"), F.count_if(F.col("quality") <= 0).alias("bad")
    )
    good, bad = np.zeros((2, len(KINDS), SCORE_STEPS + 2))
    for row in counts.collect():
        good[row["kind"], row["step"]], bad[row["kind"], row["step"]] = row["good"], row["bad"]
    if not good.sum() or not bad.sum():
        return [float("inf")] * len(KINDS)
    # Rows at steps >= s are rejected.
    lost, caught = (n[:, ::-1].cumsum(axis=1)[:, ::-1] / n[0].sum() for n in (good, bad))

    def best(kind: int, share: int) -> tuple[float, int]:
        allowed = np.flatnonzero(lost[kind] <= good_loss * share / SHARES)
        gain = caught[kind, allowed] - lost[kind, allowed]
        return gain.max(), int(allowed[gain.argmax()])

    choices = [[best(kind, share) for share in range(SHARES + 1)] for kind in range(len(KINDS))]
    splits = (split for split in product(range(SHARES + 1), repeat=len(KINDS)) if sum(split) == SHARES)
    chosen = max(splits, key=lambda split: sum(c[share][0] for c, share in zip(choices, split, strict=True)))
    return [c[share][1] / SCORE_STEPS for c, share in zip(choices, chosen, strict=True)]


def fit(docs: DataFrame, labels: DataFrame, good_loss: float = GOOD_LOSS) -> tuple[DataFrame, Forests, list[float]]:
    """Statistics of all documents, the forests, and their thresholds."""
    stats = cut_lineage(rule_statistics(docs))
    rows = _sample(stats, TREES * SUBSAMPLE)
    forests = [Forest(rows[:, k]) for k in KINDS] if len(rows) else None
    return stats, forests, _thresholds(_scored(stats, forests), labels, good_loss)


def _failed(n_words: str = "n_words", n_repeat: str = "n_repeat_words"):
    words, repeats = F.col(n_words), F.col(n_repeat)
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, the base counts, ``base_failed, kept, anomaly``.

    A missing or empty text has no words and fails. Repeated rows are judged alike. Labels with a
    missing id or quality are not used; without labels of both kinds only the fixed rules reject.
    ``anomaly`` is the largest of the kinds.
    """
    stats, forests, limits = fit(docs, labels)
    scored = _scored(stats, forests)
    kept = ~F.col("base_failed")
    for name, limit in zip(ANOMALIES, limits, strict=True):
        kept &= F.col(name) < limit
    return scored.withColumn("base_failed", _failed()).select(
        "doc_id", *BASE, "base_failed", kept.alias("kept"), F.greatest(*ANOMALIES).alias("anomaly")
    )


def _passing(batches: Iterable[pa.RecordBatch], text_at: int, forests: Forests, limits: list[float]):
    for batch in slices(batches, 1000):
        made = _stats_array(utf8(batch.column(text_at)))
        words, repeats = (made.field(c).to_numpy() for c in ("n_words", "n_repeat_words"))
        plain = (_anomalies(forests, [made.field(c) for c in FEATURES]) < limits).all(axis=1)
        failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)
        yield batch.filter(pa.array(~failed & plain, pa.bool_()))
        give_back()


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns unchanged.

    A row with a missing or empty text goes, repeated rows go or stay alike, and no row comes of an
    empty table.
    """
    _, forests, limits = fit(docs, labels)
    text_at = docs.columns.index("text")
    return docs.mapInArrow(lambda b: _passing(b, text_at, forests, limits), docs.schema)
