"""Segmentation lattices.

A lattice row lists the vocabulary pieces found inside one word as edges ``s -> e``. The
rows come from a join of substrings with the vocabulary. The path sums below walk all
lattices of an Arrow batch together, position by position, in numpy.
"""

from __future__ import annotations

import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.operators.parts import explode_substrings, text_ranges
from twinloom.storage import fan_out

# The kernels travel inside the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NO_PIECE = -1


def build_lattice(
    words: DataFrame,
    pieces: DataFrame,
    max_length: int,
    *keep: str,
    unknown_score: float | None = None,
) -> DataFrame:
    """``(*keep, size)`` of ``words(word, *keep)`` and the parallel edge arrays ``e``, ``s``, ``pid``.

    ``keep`` identifies a word, so that the word itself need not travel with its edges. ``pieces`` is
    ``(piece, pid)``, or ``(piece, pid, score)`` to add an array ``score``. Given an
    ``unknown_score``, a character without a piece of its own gets an edge ``NO_PIECE``, so that
    every word has a path. Words are exploded in ranges.
    """
    sized = words.select(*keep, F.col("word").alias("_text"), F.length("word").alias("size"))
    ranges = fan_out(text_ranges(sized, "_text", max_length, *keep, "size"), *keep, "at")
    parts = explode_substrings(ranges, "_text", max_length, *keep, "size", "at", starts="own")
    values = [c for c in ("pid", "score") if c in pieces.columns]
    lookup = pieces.select("piece", *values)
    if unknown_score is None:
        found = parts.join(lookup, "piece")
    else:
        fallback = {"pid": F.lit(NO_PIECE), "score": F.lit(unknown_score)}
        found = (
            parts.join(lookup, "piece", "left")
            .where(F.col("pid").isNotNull() | (F.col("e") - F.col("s") == 1))
            .withColumns({c: F.coalesce(c, fallback[c]) for c in values})
        )
    edge = ("e", "s", *values)
    moved = [(F.col("at") + F.col(c)).alias(c) for c in ("e", "s")]
    edges = F.sort_array(F.collect_list(F.struct(*moved, *values)))
    return (
        found.groupBy(*keep, "size")
        .agg(edges.alias("_edges"))
        .select(*keep, "size", *[F.col("_edges")[c].alias(c) for c in edge])
    )


class Edges(NamedTuple):
    """The lattices of one batch; states are word positions, numbered through the batch."""

    begin: np.ndarray  # first state of each word
    end: np.ndarray  # last state of each word
    source: np.ndarray  # state an edge leaves
    target: np.ndarray  # state an edge enters
    pid: np.ndarray
    word: np.ndarray  # row an edge belongs to

    @property
    def states(self) -> int:
        return int(self.end[-1]) + 1 if len(self.end) else 0


def read_edges(batch: pa.RecordBatch) -> Edges:
    size = batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) if len(size) else size
    per_word = batch.column("pid").value_lengths().to_numpy(zero_copy_only=False)
    word = np.repeat(np.arange(len(size)), per_word)

    def flat(name: str) -> np.ndarray:
        return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    return Edges(begin, begin + size, begin[word] + flat("s"), begin[word] + flat("e"), flat("pid"), word)


def select_edges(edges: Edges, keep: np.ndarray) -> Edges:
    return edges._replace(
        source=edges.source[keep], target=edges.target[keep], pid=edges.pid[keep], word=edges.word[keep]
    )


def _levels(position: np.ndarray) -> list[np.ndarray]:
    """Edge indices grouped by rising position, each group in batch order."""
    # Numpy sorts short integers by their digits, in one pass.
    short = position.astype(np.int16) if len(position) and position.max() <= np.iinfo(np.int16).max else position
    order = np.argsort(short, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(position[order])) + 1) if len(order) else []


def _group_starts(states: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], states[1:] != states[:-1]]))


def _log_sums(
    levels: list[np.ndarray], read: np.ndarray, write: np.ndarray, score: np.ndarray, state: np.ndarray
) -> np.ndarray:
    """Log-sum-exp of all paths into each state, filled in level by level."""
    for edge in levels:
        value = state[read[edge]] + score[edge]
        into = write[edge]
        starts = _group_starts(into)
        top = np.maximum.reduceat(value, starts)
        base = np.where(np.isfinite(top), top, 0.0)
        repeat = np.diff(np.append(starts, len(into)))
        with np.errstate(divide="ignore"):
            total = np.log(np.add.reduceat(np.exp(value - np.repeat(base, repeat)), starts))
        state[into[starts]] = base + total
    return state


def edge_posteriors(edges: Edges, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each edge over all segmentations, and each word's log-likelihood."""
    first, last = edges.begin[edges.word], edges.end[edges.word]
    forward = np.full(edges.states, -np.inf)
    forward[edges.begin] = 0.0
    _log_sums(_levels(edges.target - first), edges.source, edges.target, score, forward)
    backward = np.full(edges.states, -np.inf)
    backward[edges.end] = 0.0
    _log_sums(_levels(last - edges.source), edges.target, edges.source, score, backward)
    likelihood = forward[edges.end]
    joint = forward[edges.source] + score + backward[edges.target]
    with np.errstate(invalid="ignore"):
        posterior = np.exp(joint - likelihood[edges.word])
    return np.nan_to_num(posterior, nan=0.0), likelihood


def best_paths(edges: Edges, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges on the best segmentation of each word in reading order, and its score."""
    best = np.full(edges.states, -np.inf)
    best[edges.begin] = 0.0
    arrived = np.full(edges.states, -1, dtype=np.int64)
    for edge in _levels(edges.target - edges.begin[edges.word]):
        value = best[edges.source[edge]] + score[edge]
        into = edges.target[edge]
        starts = _group_starts(into)
        top = np.maximum.reduceat(value, starts)
        repeat = np.diff(np.append(starts, len(into)))
        at_top = np.flatnonzero((value == np.repeat(top, repeat)) & np.isfinite(value))
        # The first of equally good edges wins.
        winners = at_top[_group_starts(into[at_top])] if len(at_top) else at_top
        best[into[winners]] = value[winners]
        arrived[into[winners]] = edge[winners]
    steps = []
    state = edges.end.copy()
    live = np.flatnonzero(np.isfinite(best[edges.end]) & (edges.end > edges.begin))
    while len(live):
        edge = arrived[state[live]]
        steps.append(edge)
        state[live] = edges.source[edge]
        live = live[state[live] > edges.begin[live]]
    path = np.concatenate(steps[::-1]) if steps else np.empty(0, dtype=np.int64)
    return path[np.argsort(edges.word[path], kind="stable")], best[edges.end]
