"""Token-id array expressions: truncation, special ids, padding and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
IGNORE_INDEX = -100
BATCH_MAX_LENGTH = 128
TRANSLATE_MAX_LENGTH = 1024
NEW_TOKENS_BASE = 32
NEW_TOKENS_PER_INPUT = 3


def truncate_ids(ids: Column, max_length: int = BATCH_MAX_LENGTH) -> Column:
    """Leave room for the language code and the end token."""
    return F.slice(ids, 1, max(max_length - 2, 0))


def add_special(ids: Column, lang_id: Column, eos_id: Column) -> Column:
    return F.concat(F.array(lang_id.cast("int")), ids, F.array(eos_id.cast("int")))


def pad_ids(ids: Column, length: Column, pad_id: int) -> Column:
    fill = F.array_repeat(F.lit(pad_id).cast("int"), (length - F.size(ids)).cast("int"))
    return F.concat(ids, fill)


def attention_mask(ids: Column, length: Column) -> Column:
    real = F.array_repeat(F.lit(1), F.size(ids))
    return F.concat(real, F.array_repeat(F.lit(0), (length - F.size(ids)).cast("int")))


def mask_labels(ids: Column, pad_id: int, ignore_index: int = IGNORE_INDEX) -> Column:
    return F.transform(ids, lambda t: F.when(t == pad_id, F.lit(ignore_index)).otherwise(t))


def max_new_tokens(
    length: Column, a: float = NEW_TOKENS_BASE, b: float = NEW_TOKENS_PER_INPUT
) -> Column:
    return (F.lit(a) + F.lit(b) * length).cast("int")
