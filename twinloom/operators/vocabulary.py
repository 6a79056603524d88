"""Vocabulary tables ``(id, piece, score, type)`` and the set operations on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.operators.ordering import with_row_idx

# Piece types and the keys of the reserved tokens.
NORMAL, UNKNOWN, CONTROL = 1, 2, 3
RESERVED_KEYS = ("0", "1", "2", "3")


def normal_pieces(vocab: DataFrame) -> DataFrame:
    return vocab.where(F.col("type") == NORMAL)


def reserved_tokens(added: Column) -> Column:
    """Keep the reserved entries of an ``added tokens`` map."""
    return F.map_filter(added, lambda key, _: key.isin(*RESERVED_KEYS))


def distinct_pieces(vocab: DataFrame) -> DataFrame:
    return vocab.select("piece").distinct()


def last_score(vocab: DataFrame) -> DataFrame:
    """One row: the score of the piece with the highest id, which need not be the lowest score."""
    return vocab.agg(F.max_by("score", "id").alias("last_score"))


def shift_scores(new: DataFrame, base: DataFrame) -> DataFrame:
    """Move the scores of ``new`` below the base vocabulary's last piece."""
    shifted = new.crossJoin(F.broadcast(last_score(base)))
    return shifted.withColumn("score", F.col("score") + F.col("last_score")).drop("last_score")


def merge_vocab(base: DataFrame, new: DataFrame) -> DataFrame:
    """Append the new normal pieces the base lacks; base ids stay, new ids follow on."""
    lacking = normal_pieces(new).join(base.select("piece"), "piece", "left_anti")
    numbered = with_row_idx(shift_scores(lacking, base), "id")
    next_id = base.agg((F.max("id") + 1).alias("_next"))
    appended = numbered.crossJoin(F.broadcast(next_id)).select(
        (F.col("_next") + F.col("row_idx")).cast("int").alias("id"), "piece", "score", "type"
    )
    return base.select(F.col("id").cast("int"), "piece", "score", "type").unionByName(appended)


def added_vocab(new: DataFrame, old: DataFrame) -> DataFrame:
    """Pieces of ``new`` that ``old`` does not have, once each."""
    return new.select("piece").subtract(old.select("piece"))


def extend_codes(base: DataFrame, extra: DataFrame) -> DataFrame:
    """All language codes in byte order; a code in both lists appears twice."""
    return base.select("code").unionByName(extra.select("code")).orderBy("code")


def token_id(tokens: DataFrame, vocab: DataFrame, unk_id: int, token: str = "piece") -> DataFrame:
    """Add ``token_id``; tokens outside the vocabulary get ``unk_id``."""
    lookup = vocab.select(F.col("piece").alias(token), F.col("id").alias("token_id"))
    found = tokens.join(lookup, token, "left")
    return found.withColumn("token_id", F.coalesce("token_id", F.lit(unk_id)).cast("int"))
