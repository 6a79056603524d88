"""From split corpora to an extended vocabulary with initialised embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinloom.functions.languages import LEZGIAN
from twinloom.functions.text import preprocess
from twinloom.operators.charstats import required_chars
from twinloom.operators.embeddings import init_embeddings, resize_embeddings
from twinloom.operators.segment import encode
from twinloom.operators.unigram import UnigramOptions, learn_vocab
from twinloom.operators.vocabulary import CONTROL, added_vocab, merge_vocab
from twinloom.sources.corpus import drop_missing, write_plain_text
from twinloom.storage import cut_lineage


def prepare_corpus(corpus: DataFrame, column: str = LEZGIAN.column) -> DataFrame:
    """Texts of one column without missing ones, with their normalised form ``clean``."""
    known = drop_missing(corpus.select(column), column)
    # Characters and words both read the normalised texts, so they are stored.
    return cut_lineage(known.withColumn("clean", preprocess(F.col(column))))


def corpus_for_vocab(
    corpus: DataFrame, plain_text_path: str | None = None, column: str = LEZGIAN.column
) -> tuple[DataFrame, DataFrame]:
    """The prepared corpus and its one-row required characters; optionally dump the raw texts."""
    prepared = prepare_corpus(corpus, column)
    if plain_text_path is not None:
        write_plain_text(prepared, column, plain_text_path)
    return prepared, required_chars(prepared, "clean")


def learn_from_corpus(
    corpus: DataFrame, options: UnigramOptions = UnigramOptions(), column: str = LEZGIAN.column
) -> DataFrame:
    """Learn pieces from one column; every character seen often enough becomes one."""
    prepared, required = corpus_for_vocab(corpus, column=column)
    # Distinct characters of the corpus: one short string.
    wanted = required.first()["required_chars"]
    return learn_vocab(prepared, "clean", options, wanted)


def add_codes(vocab: DataFrame, codes: list[str]) -> DataFrame:
    """``vocab`` with the language codes that it lacks, as control pieces behind all others."""
    spark = vocab.sparkSession
    wanted = spark.createDataFrame([(c,) for c in sorted(set(codes))], "piece string")
    missing = wanted.join(vocab.select("piece"), "piece", "left_anti")
    # A language list is short: ranks over it need no distribution.
    place = F.row_number().over(Window.orderBy("piece"))
    top = vocab.agg(F.max("id").alias("_top"))
    rows = missing.withColumn("_place", place).crossJoin(F.broadcast(top))
    return vocab.unionByName(
        rows.select(
            (F.col("_top") + F.col("_place")).cast("int").alias("id"),
            "piece",
            F.lit(0.0).alias("score"),
            F.lit(CONTROL).alias("type"),
        )
    )


def extend_vocabulary(
    base: DataFrame, learned: DataFrame, base_embeddings: DataFrame, unk_id: int, codes: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Merge learned pieces and new language codes into ``base``.

    The vectors of both are means of the vectors of their old sub-pieces.
    """
    merged = cut_lineage(add_codes(merge_vocab(base, learned), codes or []))
    added = added_vocab(merged, base)
    tokenized = encode(added, ["piece"], "piece", base, unk_id)
    initial = init_embeddings(tokenized, base_embeddings, unk_id)
    return merged, resize_embeddings(merged, base, base_embeddings, initial)
