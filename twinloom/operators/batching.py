"""Fixed-size batches, translation directions and padded token batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinloom.functions import tokens
from twinloom.functions.keyed import hash32
from twinloom.functions.languages import LEZGIAN, RUSSIAN, Language, check_direction

# Fixed values.
TRAIN_BATCH_SIZE = 16
TEST_BATCH_SIZE = 1
DEFAULT_BEAMS = 4


def assign_batches(
    df: DataFrame, batch_size: int = TRAIN_BATCH_SIZE, position: str = "row_idx"
) -> DataFrame:
    """Consecutive positions share a batch; the last batch may be short."""
    return df.withColumn("batch_id", F.floor(F.col(position) / batch_size))


def _directed(df: DataFrame, src: Language, tgt: Language) -> DataFrame:
    return df.withColumns(
        {
            "src_text": F.col(src.column),
            "tgt_text": F.col(tgt.column),
            "src_lang": F.lit(src.code),
            "tgt_lang": F.lit(tgt.code),
        }
    )


def fixed_direction(df: DataFrame, src_lang: str, tgt_lang: str) -> DataFrame:
    """Add source and target text of one direction; other direction codes are an error."""
    return _directed(df, *check_direction(src_lang, tgt_lang))


def random_direction(df: DataFrame, seed: int = 42, epoch: int = 0) -> DataFrame:
    """One coin per batch decides the direction of all its rows."""
    forward = hash32(seed, epoch, F.col("batch_id")) % 2 == 0

    def pick(yes: Column, no: Column) -> Column:
        return F.when(forward, yes).otherwise(no)

    ru, lez = F.col(RUSSIAN.column), F.col(LEZGIAN.column)
    ru_code, lez_code = F.lit(RUSSIAN.code), F.lit(LEZGIAN.code)
    return df.withColumns(
        {
            "src_text": pick(ru, lez),
            "tgt_text": pick(lez, ru),
            "src_lang": pick(ru_code, lez_code),
            "tgt_lang": pick(lez_code, ru_code),
        }
    )


def both_directions(df: DataFrame) -> DataFrame:
    """Every pair once per direction, tagged 0 (from Russian) and 1 (from Lezgian)."""
    forward = _directed(df, RUSSIAN, LEZGIAN).withColumn("loader", F.lit(0))
    back = _directed(df, LEZGIAN, RUSSIAN).withColumn("loader", F.lit(1))
    return forward.unionByName(back)


def batch_width(ids: str, batch: str = "batch_id") -> Column:
    """Longest id list of the batch."""
    return F.max(F.size(ids)).over(Window.partitionBy(batch))


def pad_batch(df: DataFrame, ids: str = "ids", pad_id: int = 0, batch: str = "batch_id") -> DataFrame:
    """Right-pad ``ids`` to the longest of its batch; adds ``<ids>_mask`` and ``<ids>_len``."""
    width = f"{ids}_len"
    wide = df.withColumn(width, batch_width(ids, batch))
    return wide.withColumns(
        {
            ids: tokens.pad_ids(F.col(ids), F.col(width), pad_id),
            f"{ids}_mask": tokens.attention_mask(F.col(ids), F.col(width)),
        }
    )


def train_batch(
    encoded: DataFrame, pad_id: int, eos_id: int, max_length: int = tokens.BATCH_MAX_LENGTH
) -> DataFrame:
    """Padded training rows ``(batch_id, row_idx, x, x_mask, y, y_mask)``.

    ``encoded`` holds plain ids ``x``, ``y`` and the language ids ``src_id``, ``tgt_id``. Both
    sides pad over the same partitioning, so they share one shuffle.
    """
    eos = F.lit(eos_id)

    def framed(ids: str, lang: str) -> Column:
        return tokens.add_special(tokens.truncate_ids(F.col(ids), max_length), F.col(lang), eos)

    rows = encoded.select(
        "batch_id", "row_idx", framed("x", "src_id").alias("x"), framed("y", "tgt_id").alias("y")
    )
    padded = pad_batch(pad_batch(rows, "x", pad_id), "y", pad_id)
    return padded.select(
        "batch_id",
        "row_idx",
        "x",
        "x_mask",
        tokens.mask_labels(F.col("y"), pad_id).alias("y"),
        "y_mask",
    )


def test_batch(
    encoded: DataFrame,
    pad_id: int,
    eos_id: int,
    a: float = tokens.NEW_TOKENS_BASE,
    b: float = tokens.NEW_TOKENS_PER_INPUT,
    num_beams: int = DEFAULT_BEAMS,
    max_input_length: int | None = None,
) -> DataFrame:
    """Padded evaluation rows with the generation settings of their batch.

    Inputs stay whole unless ``max_input_length`` is given.
    """
    ids = F.col("x")
    if max_input_length is not None:
        ids = tokens.truncate_ids(ids, max_input_length)
    rows = encoded.withColumn("x", tokens.add_special(ids, F.col("src_id"), F.lit(eos_id)))
    return pad_batch(rows, "x", pad_id).select(
        "batch_id",
        "row_idx",
        "x",
        "x_mask",
        F.col("tgt_id").alias("forced_bos_token_id"),
        tokens.max_new_tokens(F.col("x_len"), a, b).alias("max_new_tokens"),
        F.lit(num_beams).alias("num_beams"),
        "tgt_text",
        "src_lang",
        "tgt_lang",
    )


def collect_batches(rows: DataFrame) -> DataFrame:
    """One record per batch; a batch holds at most ``batch_size`` rows."""
    items = [c for c in rows.columns if c != "batch_id"]
    ordered = F.sort_array(F.collect_list(F.struct("row_idx", *[c for c in items if c != "row_idx"])))
    return rows.groupBy("batch_id").agg(ordered.alias("items"))
