"""Text to subword ids and back.

A vocabulary is the small side: it is sent to the tasks as a few flat arrays, after their size has
been checked, and texts are encoded where they lie, without a shuffle. A vocabulary too large for that
is joined.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.functions.subwords import SPACE_MARK, marked_words
from twinloom.operators.lattice import NO_PIECE, best_paths, build_lattice, read_edges
from twinloom.operators.pieces import BYTES_PER_PIECE, PieceTable, Spelling, portions, ragged
from twinloom.operators.vocabulary import NORMAL, normal_pieces
from twinloom.storage import fan_out

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: how far an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0

# Bytes of the arrays that are sent to every task, and held there.
SHIPPED_BYTES = 64 << 20
# Bytes of texts, or ids, that are worked on together.
TOGETHER = 1 << 20
# Bytes of new words that are segmented together: what that takes is some thousand times as much.
SEGMENTED = 1 << 15
# Distinct words, and their ids, that a task remembers before it begins anew.
REMEMBERED = 200_000


def shipped(vocab: DataFrame, limit: int | None = None) -> pa.Table | None:
    """Normal pieces ``(id, piece, score)`` on the driver, or None if their arrays are over ``limit``."""
    normal = normal_pieces(vocab).where("piece <> ''").select("id", "piece", F.col("score").cast("double"))
    size = normal.agg(F.coalesce(F.sum(F.octet_length("piece") + BYTES_PER_PIECE), F.lit(0))).first()[0]
    return normal.toArrow() if size <= (SHIPPED_BYTES if limit is None else limit) else None


def piece_table(pieces: pa.Table) -> PieceTable:
    return PieceTable.build(pieces.column("piece"), pieces.column("score"), pieces.column("id"))


class _Encoder:
    """Ids of lists of texts; a word is segmented when a task first meets it.

    What is remembered is bounded, and so is what is worked on at once, however many rows a task has.
    """

    def __init__(self, table: PieceTable, unk_id: int, unknown_score: float, dummy_prefix: bool):
        self.table, self.unk_id, self.unknown_score, self.dummy_prefix = table, unk_id, unknown_score, dummy_prefix
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.ids, self.length = np.empty(0, np.int32), np.empty(0, np.int64)

    def _words(self, text: str | None) -> list[str]:
        """As ``marked_words`` gives them; Python splits at the blanks that it names."""
        words = (text or "").split()
        if self.dummy_prefix or not words:
            return [SPACE_MARK + w for w in words]
        return [words[0], *(SPACE_MARK + w for w in words[1:])]

    def _learn(self, words: list[str]) -> None:
        if len(self.places) > REMEMBERED or len(self.ids) > 8 * REMEMBERED:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.places]
        if not new:
            return
        self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
        spelled = pa.array(new, pa.string())
        found, length = [self.ids], [self.length]
        for start, stop in portions(pc.binary_length(spelled).to_numpy(), SEGMENTED):
            ids, counts = self.table.segment(spelled.slice(start, stop - start), self.unk_id, self.unknown_score)
            found.append(ids.astype(np.int32))
            length.append(counts.astype(np.int64))
        self.ids, self.length = np.concatenate(found), np.concatenate(length)

    def __call__(self, texts: pa.Array) -> pa.ListArray:
        """Missing texts have no ids."""
        split = [self._words(t) for t in texts.to_pylist()]
        per_text = np.fromiter(map(len, split), np.int64, len(split))
        words = list(chain.from_iterable(split))
        self._learn(words)
        word = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        starts = np.cumsum(self.length) - self.length
        length = self.length[word]
        tokens = self.ids[ragged(starts[word], length)]
        cuts = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(per_text))]
        # A run of unknown characters is one unknown token.
        kept = np.ones(len(tokens), dtype=bool)
        kept[1:] = (tokens[1:] != self.unk_id) | (tokens[:-1] != self.unk_id)
        kept[cuts[:-1][cuts[:-1] < len(tokens)]] = True
        offsets = np.append(0, np.cumsum(kept))[cuts]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens[kept], pa.int32()))


def encode_columns(
    df: DataFrame,
    columns: dict[str, str],
    vocab: DataFrame,
    unk_id: int,
    dummy_prefix: bool = True,
    clean: Callable[[pa.Array], pa.Array] | None = None,
    keep: list[str] | None = None,
) -> DataFrame | None:
    """``df``, or its columns ``keep``, with the ids of each text column, named by ``{new: column}``, or None.

    ``clean`` normalises a batch of texts first. No row moves. None stands for a vocabulary that is too
    large to be sent.
    """
    pieces = shipped(vocab)
    if pieces is None:
        return None
    table = piece_table(pieces)
    unknown = float(table.score.min() if len(table) else 0.0) - UNKNOWN_PENALTY
    model = df.sparkSession.sparkContext.broadcast(table)
    kept = df.columns if keep is None else keep
    ready = df.select(*kept, *(F.col(old).alias(f"_text_{new}") for new, old in columns.items()))
    fields = (ready.schema[c] for c in kept)
    whole = T.StructType([*fields, *(T.StructField(new, T.ArrayType(T.IntegerType())) for new in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = _Encoder(model.value, unk_id, unknown, dummy_prefix)
        for batch in batches:
            texts = [batch.column(f"_text_{new}").cast(pa.string()) for new in columns]
            sizes = sum(pc.fill_null(pc.binary_length(t), 0).to_numpy().astype(np.int64) for t in texts)
            for start, stop in portions(sizes, TOGETHER):
                parts = [t.slice(start, stop - start) for t in texts]
                made = [encode_texts(clean(t) if clean else t) for t in parts]
                rows = [batch.column(c).slice(start, stop - start) for c in kept]
                yield pa.RecordBatch.from_arrays([*rows, *made], [*kept, *columns])
            pa.default_memory_pool().release_unused()

    return ready.mapInArrow(run, whole)


def segment_words(words: DataFrame, vocab: DataFrame, unk_id: int) -> DataFrame:
    """``(word, ids)``: the best segmentation of each word of ``words(word)``, by joins."""
    pieces = normal_pieces(vocab).select("piece", F.col("id").alias("pid"), F.col("score").cast("double"))
    span, lowest = pieces.agg(F.max(F.length("piece")), F.min("score")).first()
    unknown = (lowest or 0.0) - UNKNOWN_PENALTY
    # A word's digest stands for it while its edges are gathered.
    named = words.withColumn("_w", F.unhex(F.md5(F.encode("word", "UTF-8"))))
    lattice = build_lattice(named, pieces, span or 1, "_w", unknown_score=unknown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = read_edges(batch)
            path, _ = best_paths(edges, batch.column("score").flatten().to_numpy())
            ids = np.where(edges.pid[path] == NO_PIECE, unk_id, edges.pid[path])
            per_word = np.bincount(edges.word[path], minlength=batch.num_rows)
            offsets = np.concatenate([[0], np.cumsum(per_word)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("_w"), lists], ["_w", "ids"])

    return named.join(lattice.mapInArrow(run, "_w binary, ids array<int>"), "_w").select("word", "ids")


def merge_unknown(ids: Column, unk_id: int) -> Column:
    """A run of unknown characters counts as one unknown token."""
    return F.filter(
        ids, lambda t, i: (t != unk_id) | (i == 0) | (F.get(ids, F.greatest(i - 1, F.lit(0))) != unk_id)
    )


def encode(
    df: DataFrame, key: list[str], text: Column | str, vocab: DataFrame, unk_id: int, dummy_prefix: bool = True
) -> DataFrame:
    """``(*key, ids)``: subword ids of each normalised text; a missing text has none.

    Rows stay where they are, so ``key`` need not identify one. Only with a vocabulary too large
    to be sent must it do so: then distinct words are segmented by joins and brought back.
    """
    source = F.col(text) if isinstance(text, str) else text
    ready = df.select(*key, source.alias("_text"))
    encoded = encode_columns(ready, {"ids": "_text"}, vocab, unk_id, dummy_prefix, keep=list(key))
    if encoded is not None:
        return encoded
    return encode_by_joins(ready, key, vocab, unk_id, dummy_prefix)


def encode_by_joins(
    ready: DataFrame, key: list[str], vocab: DataFrame, unk_id: int, dummy_prefix: bool = True
) -> DataFrame:
    """``encode`` of ``_text`` for any size of vocabulary; adaptive execution splits frequent words."""
    texts = fan_out(ready.select(*key, marked_words(F.col("_text"), dummy_prefix).alias("_words")), *key)
    occurrences = texts.select(*key, F.posexplode_outer("_words").alias("_pos", "word"))
    distinct = occurrences.where(F.col("word").isNotNull()).select("word").distinct()
    joined = occurrences.join(segment_words(distinct, vocab, unk_id), "word", "left")
    ordered = F.sort_array(F.collect_list(F.struct("_pos", "ids")))
    none = F.array().cast("array<int>")
    parts = F.flatten(F.transform("_parts", lambda p: F.coalesce(p["ids"], none)))
    whole = joined.groupBy(*key).agg(ordered.alias("_parts")).select(*key, parts.alias("ids"))
    return whole.withColumn("ids", merge_unknown(F.col("ids"), unk_id))


def decode(df: DataFrame, key: list[str], ids: str, vocab: DataFrame) -> DataFrame:
    """``(*key, text)``: pieces joined, special tokens skipped, space marks resolved."""
    pieces = shipped(vocab)
    if pieces is None:
        return decode_by_join(df, key, ids, vocab)
    spelled = df.sparkSession.sparkContext.broadcast(Spelling.build(pieces.column("id"), pieces.column("piece")))
    ready = df.select(*key, F.col(ids).alias("_ids"))
    schema = T.StructType([*ready.drop("_ids").schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_ids")
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            for start, stop in portions(sizes, TOGETHER):
                joined = spelled.value.texts(lists.slice(start, stop - start))
                texts = pa.array([t.replace(SPACE_MARK, " ").strip(" ") for t in joined], pa.string())
                rows = [batch.column(c).slice(start, stop - start) for c in key]
                yield pa.RecordBatch.from_arrays([*rows, texts], [*key, "text"])

    return ready.mapInArrow(run, schema)


def decode_by_join(df: DataFrame, key: list[str], ids: str, vocab: DataFrame) -> DataFrame:
    """``decode`` for any size of vocabulary; ``key`` must identify a row."""
    lookup = vocab.select(F.col("id").alias("_id"), "piece", "type")
    placed = fan_out(df, *key).select(*key, F.posexplode_outer(ids).alias("_pos", "_id"))
    joined = placed.join(lookup, "_id", "left")
    kept = F.when(F.col("type") == NORMAL, F.struct("_pos", "piece"))
    pieces = F.sort_array(F.collect_list(kept))["piece"]
    text = F.trim(F.replace(F.array_join("_pieces", ""), F.lit(SPACE_MARK), F.lit(" ")))
    return (
        joined.groupBy(*key)
        .agg(pieces.alias("_pieces"))
        .select(*key, text.alias("text"))
    )
