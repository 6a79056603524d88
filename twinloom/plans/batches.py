"""Directed, encoded and padded batches for a trainer or an evaluation run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.functions.languages import LEZGIAN, RUSSIAN, Language
from twinloom.functions.text import cleaner, preprocess
from twinloom.functions.tokens import NEW_TOKENS_BASE, NEW_TOKENS_PER_INPUT
from twinloom.operators import batching
from twinloom.operators.ordering import draw_rows, epoch_shuffle, with_row_idx
from twinloom.operators.segment import encode_by_joins, encode_columns
from twinloom.storage import cut_lineage


def encode_texts(
    df: DataFrame, columns: dict[str, str], vocab: DataFrame, unk_id: int, keep: list[str] | None = None
) -> DataFrame:
    """``df``, or its columns ``keep``, with the ids of its normalised texts, each text once and in place.

    Tasks normalise and encode in one pass. With a vocabulary too large to be sent, texts are encoded
    by joins on numbers given to the rows.
    """
    encoded = encode_columns(df, columns, vocab, unk_id, True, cleaner(), keep)
    if encoded is None:
        clean = df.withColumns({f"_clean_{new}": preprocess(F.col(old)) for new, old in columns.items()})
        # Stored, so that every join sees the same numbers.
        encoded = numbered = cut_lineage(clean.withColumn("_row", F.monotonically_increasing_id()))
        for new in columns:
            ready = numbered.select("_row", F.col(f"_clean_{new}").alias("_text"))
            ids = encode_by_joins(ready, ["_row"], vocab, unk_id).withColumnRenamed("ids", new)
            encoded = encoded.join(ids, "_row")
    return encoded.select(*(df.columns if keep is None else keep), *columns)


def _language_ids(lang_ids: dict[str, int]) -> dict[str, F.Column]:
    code_id = F.create_map(*[F.lit(p) for item in lang_ids.items() for p in item])
    return {"src_id": code_id[F.col("src_lang")], "tgt_id": code_id[F.col("tgt_lang")]}


def encode_sides(
    directed: DataFrame, vocab: DataFrame, unk_id: int, lang_ids: dict[str, int]
) -> DataFrame:
    """``(batch_id, row_idx, src_lang, tgt_lang, x, y, src_id, tgt_id)``."""
    row = ["batch_id", "row_idx", "src_lang", "tgt_lang"]
    known = directed.na.drop(subset=["src_text", "tgt_text"]).select(*row, "src_text", "tgt_text")
    encoded = encode_texts(known, {"x": "src_text", "y": "tgt_text"}, vocab, unk_id, keep=row)
    return encoded.withColumns(_language_ids(lang_ids))


def training_batches(
    pairs: DataFrame,
    key: list[str],
    vocab: DataFrame,
    lang_ids: dict[str, int],
    pad_id: int,
    eos_id: int,
    unk_id: int,
    seed: int = 42,
    epoch: int = 0,
    batch_size: int = batching.TRAIN_BATCH_SIZE,
    replacement: bool = False,
) -> DataFrame:
    """One epoch: shuffle, batch, one direction per batch, encode, pad.

    With ``replacement`` the epoch has as many rows, each drawn from all of them.
    """
    if replacement:
        indexed = with_row_idx(pairs, *key)
        drawn = draw_rows(indexed, indexed.count(), seed, epoch)
        shuffled = drawn.drop("row_idx").withColumnRenamed("draw", "row_idx")
    else:
        shuffled = epoch_shuffle(pairs, *key, seed=seed, epoch=epoch)
    directed = batching.random_direction(batching.assign_batches(shuffled, batch_size), seed, epoch)
    encoded = encode_sides(directed, vocab, unk_id, lang_ids)
    return batching.train_batch(encoded, pad_id, eos_id)


def validation_batches(
    indexed: DataFrame,
    vocab: DataFrame,
    lang_ids: dict[str, int],
    pad_id: int,
    eos_id: int,
    unk_id: int,
    batch_size: int = batching.TRAIN_BATCH_SIZE,
) -> DataFrame:
    """Both directions in row order, as ``loader`` 0 (from Russian) and 1 (from Lezgian)."""
    columns = {f"{lang.column}_ids": lang.column for lang in (RUSSIAN, LEZGIAN)}
    known = batching.assign_batches(indexed, batch_size).na.drop(subset=[*columns.values()])
    encoded = encode_texts(known, columns, vocab, unk_id, keep=["batch_id", "row_idx"])

    def loader(number: int, src: Language, tgt: Language) -> F.Column:
        return F.struct(
            F.lit(number).alias("loader"),
            F.col(f"{src.column}_ids").alias("x"),
            F.col(f"{tgt.column}_ids").alias("y"),
            F.lit(lang_ids[src.code]).alias("src_id"),
            F.lit(lang_ids[tgt.code]).alias("tgt_id"),
        )

    both = F.explode(F.array(loader(0, RUSSIAN, LEZGIAN), loader(1, LEZGIAN, RUSSIAN)))
    # A batch of a loader pads on its own, and each text is encoded once for the two.
    rows = encoded.select("batch_id", "row_idx", both.alias("_l")).select("batch_id", "row_idx", "_l.*")
    paired = rows.withColumn("batch_id", F.struct("batch_id", "loader"))
    padded = batching.train_batch(paired, pad_id, eos_id)
    return padded.withColumns({"loader": F.col("batch_id.loader"), "batch_id": F.col("batch_id.batch_id")})


def evaluation_batches(
    indexed: DataFrame,
    src_lang: str,
    tgt_lang: str,
    vocab: DataFrame,
    lang_ids: dict[str, int],
    pad_id: int,
    eos_id: int,
    unk_id: int,
    batch_size: int = batching.TEST_BATCH_SIZE,
    num_beams: int = batching.DEFAULT_BEAMS,
    a: float = NEW_TOKENS_BASE,
    b: float = NEW_TOKENS_PER_INPUT,
    max_input_length: int | None = None,
) -> DataFrame:
    """Encoded source, normalised target text and generation settings per row."""
    batched = batching.assign_batches(indexed, batch_size)
    directed = batching.fixed_direction(batched, src_lang, tgt_lang)
    known = directed.na.drop(subset=["src_text", "tgt_text"])
    kept = ["batch_id", "row_idx", "tgt_text", "src_lang", "tgt_lang"]
    encoded = encode_texts(known, {"x": "src_text"}, vocab, unk_id, keep=kept).withColumns(
        {"tgt_text": preprocess(F.col("tgt_text")), **_language_ids(lang_ids)}
    )
    return batching.test_batch(encoded, pad_id, eos_id, a, b, num_beams, max_input_length)
