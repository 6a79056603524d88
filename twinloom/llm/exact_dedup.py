"""Exact duplicates by skew-safe combining.

Equal means identical after each run of blanks became one space. Duplicates are combined inside
a task, then inside salted digest groups, then across the salts. Every combination compares
whole texts; a digest only decides where texts meet. No task sees more of a group of copies than
one salt's share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinloom.llm.common import BLANK_BYTES, BLANKS, columns_of, fresh, give_back, utf8

# One bit of a long for each salt, so the salts of a group travel as a number.
SALTS = 64
# Content that the local step of ``drop_copies`` remembers before it starts afresh.
LOCAL_BYTES = 16 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _salt(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int")


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    A missing text is empty. The smallest ``doc_id`` of a group stays; a missing one only where
    the group has no other. Of rows that share id and text one is kept. An empty table gives no
    rows, and other columns are not read.
    """
    keyed = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    keyed = keyed.withColumns({"digest": digest(F.col("norm")), "salt": _salt(F.col("doc_id"))})
    # Partial aggregation is the local step; its keys hold the whole text.
    salted = keyed.groupBy("digest", "salt", "norm").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("n")
    )
    whole = salted.groupBy("digest", "norm").agg(
        F.min("keep_id").alias("keep_id"),
        F.sum("n").alias("group_size"),
        F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"),
    )
    present = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("salts", s) == 1)
    winners = whole.select(
        F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size", F.explode(present).alias("salt")
    )
    rows = docs.select(
        "doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"), _salt(F.col("doc_id")).alias("salt")
    )
    first = Window.partitionBy("text_sha256", "salt").orderBy(F.asc_nulls_last("doc_id"))
    placed = rows.join(winners, ["text_sha256", "salt"]).withColumn("_place", F.row_number().over(first))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_place") == 1)
    return placed.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def _blank_runs_to_spaces(text: bytes) -> bytes:
    joined = b" ".join(text.split())
    if not joined:
        return b" " if text else b""
    return b" " * (text[0] in BLANK_BYTES) + joined + b" " * (text[-1] in BLANK_BYTES)


def _drop_local_copies(batches: Iterable[pa.RecordBatch], id_at: int, text_at: int):
    """Drop a row if one with the same text and no larger id was let through by this task."""
    seen: dict[bytes, int | None] = {}
    held = 0
    for batch in batches:
        passes = []
        for doc_id, text in zip(batch.column(id_at).to_pylist(), utf8(batch.column(text_at)), strict=True):
            norm = _blank_runs_to_spaces(text)
            known = norm in seen
            if known and (doc_id is None or (seen[norm] is not None and seen[norm] <= doc_id)):
                passes.append(False)
                continue
            passes.append(True)
            if not known:
                held += len(norm)
            seen[norm] = doc_id
            if held > LOCAL_BYTES:
                seen, held = {}, 0
        yield batch.filter(pa.array(passes, pa.bool_()))
        give_back()


def drop_copies(docs: DataFrame, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged; the same rules as ``exact_groups``.

    Rows travel with their text once per combination; the normalised text is made where it is
    compared.
    """
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    local = docs.mapInArrow(lambda batches: _drop_local_copies(batches, id_at, text_at), docs.schema)
    key, salt, norm, place = (fresh(docs, c) for c in ("_digest", "_salt", "_norm", "_place"))
    text = normalised(F.col("text"))
    rows = local.withColumns({key: digest(text), salt: _salt(F.col("doc_id"))})
    for keys in ([key, salt], [key]):
        best = Window.partitionBy(*keys, norm).orderBy(F.asc_nulls_last("doc_id"))
        rows = rows.repartition(*keys).withColumn(norm, text)
        rows = rows.withColumn(place, F.row_number().over(best)).where(F.col(place) == 1).drop(norm, place)
    return rows.select(columns_of(docs))
