"""Learning a unigram subword vocabulary (Kudo 2018) as a sequence of Spark jobs.

Words are counted once; everything after works on distinct words. Seed pieces are the repeated
substrings. The lattice of a word holds all seeds inside it; a compact table of the seeds finds them
where the words lie, or a join does if the table is too large to be sent. Every EM round is one pass
over the lattices followed by a grouped sum. Only the model itself, a float and a table entry per
seed piece and so at most the initial model's size, moves through the driver.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.functions.subwords import SPACE_MARK, script_runs
from twinloom.operators.lattice import (
    Edges,
    best_paths,
    build_lattice,
    edge_posteriors,
    read_edges,
    select_edges,
)
from twinloom.operators.ordering import with_row_idx
from twinloom.operators.parts import cut
from twinloom.operators.pieces import BYTES_PER_PIECE, PieceTable
from twinloom.operators.substrings import repeated_substrings
from twinloom.operators.vocabulary import CONTROL, NORMAL, UNKNOWN
from twinloom.storage import cut_lineage, fan_out

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Reserved pieces by id, and the constants of the training procedure.
RESERVED = ((0, "<pad>", CONTROL), (1, "</s>", CONTROL), (2, "<unk>", UNKNOWN))
MIN_EXPECTED = 0.5
OVERSHOOT = 1.1
FLOOR_STEP = 0.0001
TOP_K_BUCKETS_PER_DOUBLING = 64

# Pieces that EM starts from; one float for each moves through the driver in a round.
INITIAL_MODEL = 1_000_000

LATTICE = ("size", "e", "s", "pid")

# Bytes of seeds, as a table, that are sent to every task.
SENT_BYTES = 128 << 20
# Pieces whose sums are shuffled as one row.
SUM_BLOCK = 1 << 12
# Texts whose words are counted between two looks at how many are held, and words that may be.
COUNTED_TOGETHER = 256
HELD_WORDS = 300_000
# Words whose seeds are looked for together.
MATCHED_TOGETHER = 4096


@dataclass(frozen=True)
class UnigramOptions:
    vocab_size: int = 13_398
    max_piece_length: int = 128
    max_sentence_bytes: int | None = None
    seed_size: int | None = None
    shrinking_factor: float = 0.75
    sub_iterations: int = 2
    dummy_prefix: bool = False


def word_counts(
    df: DataFrame, text: Column | str, options: UnigramOptions = UnigramOptions()
) -> DataFrame:
    """``(word, n)`` over all texts, or over those of at most ``max_sentence_bytes`` if given.

    Words are cut where the script changes: no piece may cross that point.
    """
    source = F.col(text) if isinstance(text, str) else text
    texts = df.select(source.alias("_t"))
    if options.max_sentence_bytes is not None:
        texts = texts.where(F.octet_length("_t") <= options.max_sentence_bytes)
    prefix = options.dummy_prefix
    marked = texts.mapInArrow(lambda b: _task_counts(b, prefix), "_w string, _n long")
    return (
        marked.groupBy("_w")
        .agg(F.sum("_n").alias("_n"))
        .select(F.explode(script_runs(F.col("_w"))).alias("word"), "_n")
        .groupBy("word")
        .agg(F.sum("_n").alias("n"))
    )


def _task_counts(batches: Iterator[pa.RecordBatch], dummy_prefix: bool) -> Iterator[pa.RecordBatch]:
    """Words, marked as ``marked_words`` does, with counts; handed on when many are held."""
    counts: Counter[str] = Counter()

    def made() -> pa.RecordBatch:
        numbers = pa.array(counts.values(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), numbers], ["_w", "_n"])

    for batch in batches:
        for start in range(0, batch.num_rows, COUNTED_TOGETHER):
            for text in batch.column(0).slice(start, COUNTED_TOGETHER).to_pylist():
                # Python splits at the blanks that column functions name.
                words = (text or "").split()
                if words and not dummy_prefix:
                    counts[words[0]] += 1
                    del words[0]
                counts.update([SPACE_MARK + w for w in words])
            if len(counts) > HELD_WORDS:
                yield made()
                counts.clear()
    if counts:
        yield made()


def substring_seeds(
    words: DataFrame, options: UnigramOptions = UnigramOptions()
) -> DataFrame:
    """``(piece, freq, size, weight)``: all characters and all repeated substrings.

    ``weight`` is frequency times length. With ``seed_size`` only so many of the longer ones are
    returned, those of highest weight.
    """
    usable = repeated_substrings(words, options.max_piece_length)
    weighted = usable.select("piece", "freq", "size", (F.col("freq") * F.col("size")).alias("weight"))
    if options.seed_size is None:
        return weighted
    letters = weighted.where(F.col("size") == 1)
    longer = top_weighted(weighted.where(F.col("size") > 1), options.seed_size)
    return letters.unionByName(longer)


def top_weighted(candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of highest ``weight``, ties by piece, without sorting all of them.

    A log-scale histogram of fixed size finds the weight class of the cut; only rows of that
    class are ordered.
    """
    scale = F.floor(F.log2("weight") * TOP_K_BUCKETS_PER_DOUBLING)
    classed = candidates.withColumn("_c", scale)
    histogram = sorted(((r["_c"], r["count"]) for r in classed.groupBy("_c").count().collect()), reverse=True)
    room, cut = k, None
    for weight_class, count in histogram:
        if count > room:
            cut = weight_class
            break
        room -= count
    if cut is None:
        return candidates
    above = classed.where(F.col("_c") > cut).drop("_c")
    at_cut = with_row_idx(classed.where(F.col("_c") == cut).drop("_c"), -F.col("weight"), F.col("piece"))
    return above.unionByName(at_cut.where(F.col("row_idx") < room).drop("row_idx"))


def digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 7, then the asymptotic series."""
    shift = np.arange(7)
    y = x + 7.0
    r = 1.0 / y**2
    series = np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r / 252))
    return series - (1.0 / (np.asarray(x)[..., None] + shift)).sum(axis=-1)


def _sum_over_pieces(
    lattices: DataFrame,
    model: np.ndarray,
    per_batch: Callable[[pa.RecordBatch, Edges, np.ndarray], tuple[np.ndarray, np.ndarray]],
) -> np.ndarray:
    """Run ``per_batch`` over all lattices and add up its ``(pid, value)`` pairs.

    ``model`` holds a log-probability per piece, minus infinity for pruned ones. Values
    combine per task first, then across tasks, in blocks of consecutive pieces.
    """
    context = lattices.sparkSession.sparkContext
    shared = context.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = shared.value
        total = np.zeros(len(logp))
        for batch in batches:
            edges = read_edges(batch)
            edges = select_edges(edges, np.isfinite(logp[edges.pid]))
            pid, value = per_batch(batch, edges, logp)
            total += np.bincount(pid, weights=value, minlength=len(logp))
        starts = [at for at in range(0, len(total), SUM_BLOCK) if total[at : at + SUM_BLOCK].any()]
        sums = [total[at : at + SUM_BLOCK].tobytes() for at in starts]
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array(sums, pa.binary())], ["block", "sums"])

    def added(block: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in block.column("sums").to_pylist())
        return pa.table({"block": block.column("block")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    # A task hands on as much as the model has pieces, so there are no more tasks than run at a time.
    dealt = lattices.coalesce(context.defaultParallelism)
    schema = "block int, sums binary"
    table = dealt.mapInArrow(run, schema).groupBy("block").applyInArrow(added, schema).toArrow()
    result = np.zeros(len(model))
    for at, sums in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
        result[at : at + SUM_BLOCK] = np.frombuffer(sums)
    shared.destroy()
    return result


def live_edges(lattices: DataFrame, logp: np.ndarray) -> DataFrame:
    """The lattices without the edges of pruned pieces, stored for the rounds to come."""
    shared = lattices.sparkSession.sparkContext.broadcast(np.isfinite(logp))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = shared.value
        for batch in batches:
            edges = read_edges(batch)
            keep = live[edges.pid]
            per_word = np.bincount(edges.word[keep], minlength=batch.num_rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum(per_word)]).astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(offsets, batch.column(c).flatten().filter(pa.array(keep)))
                for c in ("e", "s", "pid")
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("n"), batch.column("size"), *lists], ["n", *LATTICE]
            )

    return lattices.mapInArrow(run, lattices.schema).persist(StorageLevel.MEMORY_AND_DISK)


def expected_counts(lattices: DataFrame, logp: np.ndarray) -> np.ndarray:
    """E-step: expected number of uses of each piece."""

    def per_batch(batch, edges, logp):
        posterior, _ = edge_posteriors(edges, logp[edges.pid])
        n = batch.column("n").to_numpy(zero_copy_only=False)
        return edges.pid, posterior * n[edges.word]

    return _sum_over_pieces(lattices, logp, per_batch)


def viterbi_counts(lattices: DataFrame, logp: np.ndarray) -> np.ndarray:
    """Uses of each piece in the best segmentations."""

    def per_batch(batch, edges, logp):
        path, _ = best_paths(edges, logp[edges.pid])
        n = batch.column("n").to_numpy(zero_copy_only=False)
        return edges.pid[path], n[edges.word[path]].astype(np.float64)

    return _sum_over_pieces(lattices, logp, per_batch)


def maximise(expected: np.ndarray, is_char: np.ndarray) -> np.ndarray:
    """M-step: log-probabilities; rarely used pieces drop out, single characters stay."""
    count = np.where(is_char, np.maximum(expected, MIN_EXPECTED), expected)
    kept = count >= MIN_EXPECTED
    logp = np.full(len(count), -np.inf)
    logp[kept] = digamma(count[kept]) - digamma(np.array(count[kept].sum()))
    return logp


def lattices(words: DataFrame, pieces: DataFrame, max_length: int, *keep: str) -> DataFrame:
    """``(*keep, size, e, s, pid)`` of each word of ``words(word, *keep)``; ``keep`` identifies a word."""
    size = pieces.agg(F.sum(F.octet_length("piece") + BYTES_PER_PIECE)).first()[0]
    if (size or 0) > SENT_BYTES:
        return build_lattice(words, pieces, max_length, *keep)
    rows = pieces.select("piece", "pid").toArrow()
    same = pa.chunked_array([pa.nulls(len(rows), pa.float64()).fill_null(0.0)])
    table = words.sparkSession.sparkContext.broadcast(PieceTable.build(rows.column("piece"), same, rows.column("pid")))
    spread = fan_out(words.select(F.col("word").alias("_text"), *keep), "_text")
    schema = T.StructType([*(spread.schema[c] for c in keep), T.StructField("size", T.IntegerType())])
    for c in LATTICE[1:]:
        schema.add(c, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, MATCHED_TOGETHER):
                part = batch.slice(start, MATCHED_TOGETHER)
                size, source, target, piece, word = table.value.found(part.column("_text"))
                offsets = pa.array(np.append(0, np.cumsum(np.bincount(word, minlength=len(size)))), pa.int32())
                edges = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (target, source, table.value.id[piece])]
                columns = [*(part.column(c) for c in keep), pa.array(size, pa.int32()), *edges]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *LATTICE])

    return spread.mapInArrow(run, schema)


def piece_lattices(pieces: DataFrame, logp: np.ndarray, max_length: int) -> DataFrame:
    """Lattices of the longer live pieces over the other live pieces."""
    pids = pa.table({"pid": pa.array(np.flatnonzero(np.isfinite(logp)), pa.int32())})
    live = cut_lineage(pieces.join(pieces.sparkSession.createDataFrame(pids), "pid"))
    own = live.where(F.col("size") > 1).select(F.col("piece").alias("word"), F.col("pid").alias("self"))
    edges = F.arrays_zip("e", "s", "pid")
    # A piece is no alternative to itself.
    proper = F.filter(edges, lambda x: x["e"] - x["s"] < F.col("size"))
    found = lattices(own, live, max_length, "self").withColumn("_x", proper)
    return found.select("self", "size", "_x.e", "_x.s", "_x.pid").persist(StorageLevel.MEMORY_AND_DISK)


def prune(
    inner: DataFrame, logp: np.ndarray, freq: np.ndarray, is_char: np.ndarray, target: int
) -> np.ndarray:
    """Keep the ``target`` pieces whose removal would cost most likelihood.

    A removed piece is replaced by the best segmentation of its own text from the others. A
    piece that is already worse than that goes; one without an alternative stays.
    """
    total = freq.sum()
    missing = -1.0

    def per_batch(batch, edges, logp):
        own = batch.column("self").to_numpy(zero_copy_only=False).astype(np.int64)
        path, score = best_paths(edges, logp[edges.pid])
        word = edges.word[path]
        parts = np.bincount(word, minlength=len(own))
        used = freq[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            log_total = np.log(total + used * (parts - 1))
            each = np.log(freq[edges.pid[path]] + used[word])
            replaced = np.bincount(word, weights=each, minlength=len(own)) - parts * log_total
            loss = used / total * (np.log(used) - np.log(total) - replaced)
        # Negative marks pieces that already lose to their parts; zero is "no alternative".
        value = np.where(score > logp[own], missing, np.maximum(loss, 1e-300))
        live = np.isfinite(score) & np.isfinite(logp[own]) & (used > 0)
        return own[live], value[live]

    loss = _sum_over_pieces(inner, logp, per_batch)
    alive = np.isfinite(logp) & ((freq > 0) | is_char)
    keep = alive & ((loss == 0.0) | is_char)
    candidates = np.flatnonzero(alive & (loss > 0.0) & ~is_char)
    room = max(target - int(keep.sum()), 0)
    best = candidates[np.argsort(-loss[candidates], kind="stable")[:room]]
    keep[best] = True
    return np.where(keep, logp, -np.inf)


def learn_vocab(
    df: DataFrame,
    text: Column | str,
    options: UnigramOptions = UnigramOptions(),
    required_chars: str = "",
) -> DataFrame:
    """Vocabulary ``(id, piece, score, type)`` learned from normalised texts.

    ``seed_size`` is the size of the initial model, ``INITIAL_MODEL`` unless given: EM starts from
    that many repeated substrings of highest weight. A vocabulary must hold all characters; it is
    an error if they do not fit.
    """
    words = cut_lineage(word_counts(df, text, options))
    initial = replace(options, seed_size=options.seed_size or INITIAL_MODEL)
    seeds = substring_seeds(words, initial)
    order = (F.col("size") > 1, -F.col("weight"), F.col("piece"))
    numbered = with_row_idx(seeds, *order, name="pid").withColumn("pid", F.col("pid").cast("int"))
    pieces = cut_lineage(numbered)

    # A word longer than a range is learned from in parts: no row holds more than a range's paths.
    parts = words.select(F.explode(cut(F.col("word"))).alias("word"), "n").withColumn("wid", F.monotonically_increasing_id())
    graphs = lattices(cut_lineage(parts), pieces, options.max_piece_length, "wid", "n").drop("wid")
    graphs = graphs.persist(StorageLevel.MEMORY_AND_DISK)
    table = pieces.select("pid", "weight", "size").toArrow()
    place = table.column("pid").to_numpy()
    weight, size = np.zeros(len(place)), np.zeros(len(place), dtype=np.int64)
    weight[place], size[place] = table.column("weight").to_numpy(), table.column("size").to_numpy()
    is_char = size == 1
    logp = np.log(weight) - np.log(weight.sum())

    needed = len(set(required_chars) | set(pieces.where("size = 1").select("piece").toPandas()["piece"]))
    if needed > options.vocab_size - len(RESERVED):
        raise ValueError(f"{needed} characters do not fit a vocabulary of {options.vocab_size}")
    desired = int(options.vocab_size * OVERSHOOT)
    inner, stored = None, len(logp)
    while True:
        for _ in range(options.sub_iterations):
            logp = maximise(expected_counts(graphs, logp), is_char)
        alive = int(np.isfinite(logp).sum())
        if alive <= desired:
            break
        if alive <= stored // 2:
            full, graphs, stored = graphs, live_edges(graphs, logp), alive
            graphs.count()
            full.unpersist()
        target = max(desired, int(options.shrinking_factor * alive))
        freq = viterbi_counts(graphs, logp)
        # The first round drops most seeds, and a dropped piece never returns.
        inner = inner or piece_lattices(pieces, logp, options.max_piece_length)
        logp = prune(inner, logp, freq, is_char, target)
        if int(np.isfinite(logp).sum()) >= alive:
            # What is left cannot be spelled by other pieces; the best of it are chosen below.
            break
    graphs.unpersist()
    if inner is not None:
        inner.unpersist()
    return finalise(pieces, logp, is_char, options, required_chars)


def finalise(
    pieces: DataFrame, logp: np.ndarray, is_char: np.ndarray, options: UnigramOptions, required_chars: str
) -> DataFrame:
    """Exactly ``vocab_size`` pieces: reserved ones, all characters, then the best of the rest."""
    spark = pieces.sparkSession
    pids = np.flatnonzero(np.isfinite(logp))
    lowest = float(logp[pids].min()) if len(pids) else 0.0
    model = spark.createDataFrame(
        pa.table({"pid": pa.array(pids, pa.int32()), "score": pa.array(logp[pids])})
    )
    known = pieces.select("pid", "piece", "size").join(model, "pid")
    wanted = list(dict.fromkeys(required_chars))
    floor = [(c, lowest - FLOOR_STEP * (i + 1)) for i, c in enumerate(wanted)]
    extra = spark.createDataFrame(floor, "piece string, score double").join(
        known.select("piece"), "piece", "left_anti"
    )
    allowed = known.select("piece", "score", (F.col("size") > 1).alias("optional")).unionByName(
        extra.select("piece", "score", F.lit(False).alias("optional"))
    )
    room = options.vocab_size - len(RESERVED)
    kept = with_row_idx(allowed, "optional", -F.col("score"), F.col("piece"))
    kept = kept.where((F.col("row_idx") < room) | ~F.col("optional"))
    ranked = with_row_idx(kept.drop("row_idx"), -F.col("score"), F.col("piece"))
    normal = ranked.select(
        (F.col("row_idx") + len(RESERVED)).cast("int").alias("id"),
        "piece",
        "score",
        F.lit(NORMAL).alias("type"),
    )
    reserved = spark.createDataFrame(
        [(i, p, 0.0, t) for i, p, t in RESERVED], "id int, piece string, score double, type int"
    )
    return cut_lineage(reserved.unionByName(normal))
