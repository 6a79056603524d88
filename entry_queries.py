"""Registered queries: each operator on the given tables.

Pairs of a user turn and the next assistant turn stand in for a parallel corpus, documents for
its monolingual side. Array results are rendered as text, so that engines compare alike.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.functions import keyed, languages, text, tokens
from twinloom.functions.languages import LEZGIAN, RUSSIAN
from twinloom.operators import (
    batching,
    charstats,
    embeddings,
    ordering,
    scoring,
    segment,
    split,
    training_log,
    translate,
    unigram,
    vocabulary,
)
from twinloom.plans import batches as batch_plans
from twinloom.plans import evaluation
from twinloom.plans import vocabulary as vocab_plans
from twinloom.sources import corpus, tables
from twinloom.storage import cut_lineage, scratch_path

# The stand-in translator travels inside the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LANG_IDS = {RUSSIAN.code: 3, LEZGIAN.code: 4}
PAD, EOS, UNK = 0, 1, 2
# A language that the base vocabulary does not know.
NEW_CODE = "agx_Cyrl"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return corpus.read_table(spark, f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``(conv_id, turn, ru, lez)``: a user turn and the assistant turn after it."""
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("text_ru"))
    reply = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_lez")
    )
    joined = user.join(reply, ["conv_id", "turn"])
    known = joined.na.drop(subset=["text_ru", "text_lez"])
    return known.select("conv_id", "turn", F.col("text_ru").alias("ru"), F.col("text_lez").alias("lez"))


def scored_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pairs(spark, folder).select(
        "conv_id", "turn", F.col("ru").alias("hyp"), F.col("lez").alias("ref")
    )


def indexed_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.with_row_idx(pairs(spark, folder), "conv_id", "turn")


def joined(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda t: t.cast("string")), " ")


def vocab_of(spark: SparkSession, folder: str, part: str = "all") -> DataFrame:
    """A vocabulary from the words of the documents; its three top words count as control pieces.

    ``part`` "first" is English and German, "second" all the rest, so the two cover the table.
    """
    first = F.coalesce("lang", F.lit("")).isin("en", "de")
    words = documents(spark, folder).where({"all": F.lit(True), "first": first, "second": ~first}[part])
    counts = (
        words.select(F.explode(text.words(F.col("text"))).alias("piece"))
        .groupBy("piece")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = counts.agg(F.sum("n").alias("total"))
    ranked = ordering.with_row_idx(counts, -F.col("n"), F.col("piece"), name="id")
    score = F.round(F.log(F.col("n") / F.col("total")), 6)
    kind = F.when(F.col("id") < 3, vocabulary.CONTROL).otherwise(vocabulary.NORMAL)
    scored = ranked.crossJoin(F.broadcast(total)).select(
        F.col("id").cast("int"), "piece", score.alias("score"), kind.alias("type")
    )
    return cut_lineage(scored)


def seed_vocab(spark: SparkSession, folder: str) -> DataFrame:
    """A subword vocabulary of 8,000 pieces and all characters, from seed statistics of the documents.

    Scores are whole numbers, ten-thousandths of a log-probability, so that path sums are exact.
    """
    clean = documents(spark, folder).select(text.preprocess(F.col("text")).alias("clean"))
    options = unigram.UnigramOptions(seed_size=8000, dummy_prefix=True)
    seeds = unigram.substring_seeds(unigram.word_counts(clean, "clean", options), options)
    order = (F.col("size") > 1, -F.col("weight"), F.col("piece"))
    ranked = ordering.with_row_idx(seeds, *order)
    total = ranked.agg(F.sum("weight").alias("total"))
    normal = ranked.crossJoin(F.broadcast(total)).select(
        (F.col("row_idx") + 5).cast("int").alias("id"),
        "piece",
        F.round(F.log(F.col("weight") / F.col("total")) * 10_000).alias("score"),
        F.lit(vocabulary.NORMAL).alias("type"),
    )
    special = [(PAD, "<pad>"), (EOS, "</s>"), (UNK, "<unk>"), (3, RUSSIAN.code), (4, LEZGIAN.code)]
    reserved = spark.createDataFrame(
        [(i, p, 0.0, vocabulary.CONTROL) for i, p in special],
        "id int, piece string, score double, type int",
    )
    return cut_lineage(reserved.unionByName(normal))


def word_ids(source: Column) -> Column:
    """Ids for tests of the array operators: a hash of each word, clear of the special ids."""
    return F.transform(text.words(source), lambda w: (keyed.hash32(w) % 1000 + 10).cast("int"))


def encoded_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Directed pairs with hashed word ids in place of a tokeniser."""
    directed = batching.random_direction(batching.assign_batches(indexed_pairs(spark, folder)))
    code_id = F.create_map(*[F.lit(p) for item in LANG_IDS.items() for p in item])
    return directed.withColumns(
        {
            "x": word_ids(F.col("src_text")),
            "y": word_ids(F.col("tgt_text")),
            "src_id": code_id[F.col("src_lang")],
            "tgt_id": code_id[F.col("tgt_lang")],
        }
    )


# --- sources and sinks ---------------------------------------------------------------------


def parallel_pairs(spark, folder):
    return pairs(spark, folder)


def read_parallel(spark, folder):
    path = scratch_path(spark, "raw")
    raw = pairs(spark, folder).select(
        F.col("lez").alias("text_lez"), "conv_id", F.col("ru").alias("text_ru")
    )
    raw.write.options(**corpus.CSV_OPTIONS).csv(path)
    return corpus.read_parallel(spark, path)


def _written_splits(spark, folder, fmt="parquet"):
    path = scratch_path(spark, "splits")
    corpus.write_splits(split.split_90_5_5(pairs(spark, folder), "conv_id", "turn"), path, fmt)
    return path


def write_splits(spark, folder):
    path = _written_splits(spark, folder, "csv")
    return spark.read.schema("ru string, lez string, split string").options(**corpus.CSV_OPTIONS).csv(path)


def read_split(spark, folder):
    return corpus.read_split(spark, _written_splits(spark, folder), "train")


def load_corpora(spark, folder):
    return corpus.load_corpora(spark, _written_splits(spark, folder))


def write_plain_text(spark, folder):
    path = scratch_path(spark, "plain")
    corpus.write_plain_text(documents(spark, folder), "text", path)
    return spark.read.text(path)


def write_vocab(spark, folder):
    path = scratch_path(spark, "vocab")
    tables.write_vocab(vocab_of(spark, folder), path)
    return tables.read_vocab(spark, path)


def _dims(df: DataFrame, *key: str) -> DataFrame:
    """One row per element of ``vec``."""
    placed = df.select(*key, F.posexplode("vec").alias("dim", "v"))
    return placed.select(*key, "dim", F.round(F.col("v").cast("double"), 5).alias("v"))


def _matrix(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("int").alias("id"), F.col("embedding").alias("vec")
    )


def write_embeddings(spark, folder):
    path = scratch_path(spark, "embeddings")
    tables.write_embeddings(_matrix(spark, folder), path)
    return _dims(tables.read_embeddings(spark, path), "id")


# --- projections and filters ---------------------------------------------------------------


def drop_missing(spark, folder):
    labelled = documents(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")
    return corpus.drop_missing(labelled, "quality").select("doc_id", "quality")


def char_filter(spark, folder):
    return charstats.char_filter(charstats.char_counts(documents(spark, folder), "text"))


def normal_pieces(spark, folder):
    return vocabulary.normal_pieces(vocab_of(spark, folder))


def reserved_tokens(spark, folder):
    turns = table(spark, folder, "conversations")
    added = F.create_map(
        F.col("turn").cast("string"), F.col("role"), (F.col("turn") + 3).cast("string"), F.lit("later")
    )
    kept = vocabulary.reserved_tokens(added)
    listed = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return turns.select("conv_id", "turn", F.array_join(listed, " ").alias("kept"))


def resolve_lang(spark, folder):
    name = (
        F.when(F.col("lang") == "en", RUSSIAN.name)
        .when(F.col("lang") == "fr", LEZGIAN.name)
        .otherwise(F.col("lang"))
    )
    return documents(spark, folder).select("doc_id", languages.resolve_lang(name).alias("code"))


def lang_to_column(spark, folder):
    code = F.when(F.col("turn") % 4 == 0, RUSSIAN.code).otherwise(LEZGIAN.code)
    return pairs(spark, folder).select("conv_id", "turn", languages.text_in(code).alias("text"))


def check_direction(spark, folder):
    rows = batching.random_direction(batching.assign_batches(indexed_pairs(spark, folder)))
    direction = languages.assert_direction(F.col("src_lang"), F.col("tgt_lang"))
    return rows.select("conv_id", "turn", direction.alias("direction"))


# --- text ----------------------------------------------------------------------------------


def normalize_punct(spark, folder):
    return documents(spark, folder).select("doc_id", text.normalize_punct(F.col("text")).alias("text"))


def normalize_punct_pages(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", text.normalize_punct(F.col("html")).alias("text")
    )


def replace_nonprint(spark, folder):
    return documents(spark, folder).select("doc_id", text.replace_nonprint(F.col("text")).alias("text"))


def nfkc(spark, folder):
    return documents(spark, folder).select("doc_id", text.nfkc(F.col("text")).alias("text"))


def preprocess(spark, folder):
    return documents(spark, folder).select("doc_id", text.preprocess(F.col("text")).alias("text"))


def explode_chars(spark, folder):
    """Raw characters, counted, with their code points."""
    rows = charstats.explode_chars(documents(spark, folder), "text")
    counted = rows.groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.ascii("ch").cast("bigint").alias("code_point"), "n")


def char_counts(spark, folder):
    return charstats.char_counts(documents(spark, folder), text.preprocess(F.col("text")))


def required_chars(spark, folder):
    return charstats.required_chars(documents(spark, folder), text.preprocess(F.col("text")))


def most_common(spark, folder):
    counts = charstats.char_counts(documents(spark, folder), "text")
    return ordering.most_common(counts, "ch")


# --- splits, order, batches ----------------------------------------------------------------


def split_90_5_5(spark, folder):
    return split.split_90_5_5(documents(spark, folder).select("doc_id"), "doc_id")


def split_exact(spark, folder):
    return split.split_exact(documents(spark, folder).select("doc_id"), "doc_id")


def with_row_idx(spark, folder):
    rows = documents(spark, folder).select("doc_id", "lang")
    return ordering.with_row_idx(rows, "lang", "doc_id").select("doc_id", "row_idx")


def take_positional(spark, folder):
    rows = ordering.with_row_idx(documents(spark, folder).select("doc_id", "lang"), "lang", "doc_id")
    return ordering.take_positional(rows, 0, 17, 123)


def epoch_shuffle(spark, folder):
    return ordering.epoch_shuffle(documents(spark, folder).select("doc_id"), "doc_id", epoch=3)


def sample_with_replacement(spark, folder):
    """An epoch of uniform draws: as many as there are rows."""
    rows = documents(spark, folder).select("doc_id")
    indexed = ordering.with_row_idx(rows, "doc_id")
    return ordering.draw_rows(indexed, rows.count()).select("draw", "doc_id")


def sample_poisson(spark, folder):
    """What holds for the fixed seed: the sample's size is near the table's, and no id is new."""
    ids = documents(spark, folder).select("doc_id")
    drawn = ordering.sample_with_replacement(ids)
    strangers = drawn.join(ids, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("strangers"))
    size = ids.agg(F.count(F.lit(1)).alias("n")).crossJoin(drawn.agg(F.count(F.lit(1)).alias("drawn")))
    near = F.col("drawn").between(0.8 * F.col("n"), 1.2 * F.col("n"))
    return size.crossJoin(strangers).select("n", near.alias("near"), "strangers")


def assign_batches(spark, folder):
    rows = batching.assign_batches(indexed_pairs(spark, folder))
    return rows.select("conv_id", "turn", "row_idx", "batch_id")


_DIRECTED = ["conv_id", "turn", "src_text", "tgt_text", "src_lang", "tgt_lang"]


def random_direction(spark, folder):
    rows = batching.random_direction(batching.assign_batches(indexed_pairs(spark, folder)))
    return rows.select(*_DIRECTED)


def fixed_direction(spark, folder):
    rows = batching.fixed_direction(pairs(spark, folder), LEZGIAN.code, RUSSIAN.code)
    return rows.select(*_DIRECTED)


def both_directions(spark, folder):
    return batching.both_directions(pairs(spark, folder)).select(*_DIRECTED, "loader")


# --- token arrays --------------------------------------------------------------------------


def _document_ids(spark, folder):
    ids = documents(spark, folder).select("doc_id", word_ids(F.col("text")).alias("ids"))
    rows = ordering.with_row_idx(ids, "doc_id")
    return batching.assign_batches(rows)


def add_special(spark, folder):
    ids = tokens.add_special(F.col("ids"), F.lit(3), F.lit(EOS))
    return _document_ids(spark, folder).select("doc_id", joined(ids).alias("ids"))


def truncate_ids(spark, folder):
    return _document_ids(spark, folder).select(
        "doc_id", joined(tokens.truncate_ids(F.col("ids"))).alias("ids")
    )


def pad_batch(spark, folder):
    padded = batching.pad_batch(_document_ids(spark, folder), pad_id=PAD)
    return padded.select(
        "doc_id", joined(F.col("ids")).alias("ids"), joined(F.col("ids_mask")).alias("mask")
    )


def mask_labels(spark, folder):
    padded = batching.pad_batch(_document_ids(spark, folder), pad_id=PAD)
    return padded.select("doc_id", joined(tokens.mask_labels(F.col("ids"), PAD)).alias("ids"))


def max_new_tokens(spark, folder):
    width = batching.batch_width("ids")
    return _document_ids(spark, folder).select("doc_id", tokens.max_new_tokens(width).alias("limit"))


def token_id(spark, folder):
    words = vocab_of(spark, folder, "second").select("piece")
    return vocabulary.token_id(words, vocab_of(spark, folder, "first"), unk_id=UNK)


def train_batch(spark, folder):
    rows = batching.train_batch(encoded_pairs(spark, folder), PAD, EOS)
    return rows.select("batch_id", "row_idx", *[joined(F.col(c)).alias(c) for c in ("x", "x_mask", "y", "y_mask")])


def test_batch(spark, folder):
    rows = batching.test_batch(encoded_pairs(spark, folder), PAD, EOS)
    return rows.withColumns({c: joined(F.col(c)) for c in ("x", "x_mask")})


def collect_batches(spark, folder):
    rows = batching.train_batch(encoded_pairs(spark, folder), PAD, EOS)
    records = batching.collect_batches(rows.select("batch_id", "row_idx", "x"))
    listed = F.transform(F.col("items"), lambda i: F.concat_ws(":", i["row_idx"], joined(i["x"])))
    return records.select("batch_id", F.array_join(listed, ",").alias("items"))


def encode(spark, folder):
    clean = documents(spark, folder).select("doc_id", text.preprocess(F.col("text")).alias("clean"))
    ids = segment.encode(clean, ["doc_id"], "clean", seed_vocab(spark, folder), UNK)
    return ids.select("doc_id", joined(F.col("ids")).alias("ids"))


def decode(spark, folder):
    """Encoding and decoding give back the normalised text."""
    clean = documents(spark, folder).select("doc_id", text.preprocess(F.col("text")).alias("clean"))
    vocab = seed_vocab(spark, folder)
    ids = segment.encode(clean, ["doc_id"], "clean", vocab, UNK)
    return segment.decode(ids, ["doc_id"], "ids", vocab)


def _trained(spark: SparkSession, folder: str, replacement: bool) -> DataFrame:
    vocab = seed_vocab(spark, folder)
    rows = batch_plans.training_batches(
        pairs(spark, folder), ["conv_id", "turn"], vocab, LANG_IDS, PAD, EOS, UNK, replacement=replacement
    )
    return rows.withColumns({c: joined(F.col(c)) for c in ("x", "x_mask", "y", "y_mask")})


def training_batches(spark, folder):
    return _trained(spark, folder, False)


def drawn_batches(spark, folder):
    """An epoch of as many rows, each drawn from all pairs."""
    return _trained(spark, folder, True)


def validation_batches(spark, folder):
    rows = batch_plans.validation_batches(
        indexed_pairs(spark, folder), seed_vocab(spark, folder), LANG_IDS, PAD, EOS, UNK
    )
    return rows.withColumns({c: joined(F.col(c)) for c in ("x", "x_mask", "y", "y_mask")})


def evaluation_batches(spark, folder):
    rows = batch_plans.evaluation_batches(
        indexed_pairs(spark, folder),
        RUSSIAN.code,
        LEZGIAN.code,
        seed_vocab(spark, folder),
        LANG_IDS,
        PAD,
        EOS,
        UNK,
    )
    return rows.withColumns({c: joined(F.col(c)) for c in ("x", "x_mask")})


# --- aggregates ----------------------------------------------------------------------------


def corpus_size(spark, folder):
    return ordering.corpus_size(documents(spark, folder))


def distinct_pieces(spark, folder):
    both = vocab_of(spark, folder, "first").unionByName(vocab_of(spark, folder, "second"))
    return vocabulary.distinct_pieces(both)


def _metrics(spark, folder):
    """Events as a metric log: a day is an epoch, the event type a loader."""
    return table(spark, folder, "events").select(
        F.dayofmonth("ts").alias("epoch"),
        F.col("event_type").alias("loader"),
        F.col("event_id").alias("step"),
        "value",
        (F.col("event_id") % 16 + 1).alias("n_rows"),
    )


def mean_loss_by_loader(spark, folder):
    means = training_log.mean_loss_by_loader(_metrics(spark, folder))
    return means.withColumn("val_loss", F.round("val_loss", 9))


def macro_loss(spark, folder):
    means = training_log.mean_loss_by_loader(_metrics(spark, folder))
    return training_log.macro_loss(means, n_loaders=5).withColumn("val_loss", F.round("val_loss", 9))


def _checkpoints(spark, folder):
    return _metrics(spark, folder).select(
        F.col("loader").alias("run"), "epoch", "step", F.col("value").alias("val_loss")
    )


def best_checkpoints(spark, folder):
    return training_log.best_checkpoints(_checkpoints(spark, folder), "run")


def checkpoint_name(spark, folder):
    named = _checkpoints(spark, folder).select(
        "step", training_log.checkpoint_name(F.col("epoch"), F.col("val_loss")).alias("name")
    )
    epoch, loss = training_log.parse_checkpoint_name(F.col("name"))
    return named.select("step", "name", epoch.alias("epoch"), loss.alias("val_loss"))


def embedding_mean(spark, folder):
    source = table(spark, folder, "embeddings")
    members = source.select("label", F.col("vec_id").cast("int").alias("id"))
    return _dims(embeddings.embedding_mean(members, _matrix(spark, folder), "label"), "label")


def corpus_bleu(spark, folder):
    return scoring.corpus_bleu(scored_pairs(spark, folder)).withColumn("bleu", F.round("bleu", 6))


def corpus_bleu_by_turn(spark, folder):
    return scoring.corpus_bleu(scored_pairs(spark, folder), "turn").withColumn("bleu", F.round("bleu", 6))


def corpus_chrf(spark, folder):
    return scoring.corpus_chrf(scored_pairs(spark, folder)).withColumn("chrf", F.round("chrf", 6))


def _rounded_scores(rows: DataFrame) -> DataFrame:
    parts = ("bleu", "chrf", "brevity_penalty", *(f"precision_{n}" for n in range(1, 5)))
    return rows.withColumns({c: F.round(c, 6) for c in parts})


def metrics_row(spark, folder):
    return _rounded_scores(scoring.metrics_row(scored_pairs(spark, folder), "turn"))


# --- vocabularies and embeddings -----------------------------------------------------------


def word_counts(spark, folder):
    clean = documents(spark, folder).select(text.preprocess(F.col("text")).alias("clean"))
    return unigram.word_counts(clean, "clean")


def substring_seeds(spark, folder):
    clean = documents(spark, folder).select(text.preprocess(F.col("text")).alias("clean"))
    return unigram.substring_seeds(unigram.word_counts(clean, "clean"))


def learn_vocab(spark, folder):
    """What a learned vocabulary must fulfil; its pieces are no SQL engine's business."""
    clean = cut_lineage(documents(spark, folder).select(text.preprocess(F.col("text")).alias("clean")))
    words = cut_lineage(unigram.word_counts(clean, "clean"))
    learned = cut_lineage(unigram.learn_vocab(clean, "clean"))
    letters = words.select(F.explode(F.split("word", "")).alias("piece")).where("piece <> ''").distinct()
    present = letters.join(learned.where(F.col("type") == vocabulary.NORMAL), "piece")
    later = learned.alias("a").join(learned.alias("b"), F.expr("a.id + 1 = b.id and a.type = 1 and b.score > a.score"))
    return (
        learned.agg(
            F.count(F.lit(1)).alias("pieces"),
            F.countDistinct("piece").alias("distinct_pieces"),
            (F.max("id") - F.min("id") + 1).cast("bigint").alias("span"),
            F.count_if(F.length("piece") > 128).alias("too_long"),
            (F.sum(F.when(F.col("type") == vocabulary.NORMAL, F.exp("score"))) < 1.1).alias("probable"),
        )
        .crossJoin(present.agg(F.count(F.lit(1)).alias("letters")))
        .crossJoin(later.agg(F.count(F.lit(1)).alias("out_of_order")))
    )


def prep_corpus_for_vocab(spark, folder):
    loaded = corpus.load_corpora(spark, _written_splits(spark, folder))
    path = scratch_path(spark, "plain")
    _, required = vocab_plans.corpus_for_vocab(loaded, path)
    lines = spark.read.text(path).agg(F.count(F.lit(1)).alias("n_lines"))
    return required.crossJoin(lines)


def merge_vocab(spark, folder):
    merged = vocabulary.merge_vocab(vocab_of(spark, folder, "first"), vocab_of(spark, folder, "second"))
    return merged.withColumn("score", F.round("score", 6))


def shift_scores(spark, folder):
    shifted = vocabulary.shift_scores(vocab_of(spark, folder, "second"), vocab_of(spark, folder, "first"))
    return shifted.withColumn("score", F.round("score", 6))


def added_vocab(spark, folder):
    return vocabulary.added_vocab(vocab_of(spark, folder, "second"), vocab_of(spark, folder, "first"))


def _codes(spark, folder):
    base = documents(spark, folder).select(F.col("lang").alias("code")).distinct()
    extra = table(spark, folder, "conversations").select(F.col("role").alias("code")).distinct()
    return base, extra.unionByName(base.where("code = 'fr'"))


def extend_codes(spark, folder):
    return vocabulary.extend_codes(*_codes(spark, folder))


def sorted_codes(spark, folder):
    base, extra = _codes(spark, folder)
    return ordering.with_row_idx(base.unionByName(extra), "code")


def init_embeddings(spark, folder):
    """Benchmark words take the vectors at their characters' code points."""
    matrix = _matrix(spark, folder)
    size = matrix.count()
    words = table(spark, folder, "benchmark").select(
        F.explode(text.words(F.col("text"))).alias("piece")
    )
    ids = F.transform(text.chars(F.col("piece")), lambda c: (F.ascii(c) % size).cast("int"))
    tokenized = words.distinct().withColumn("ids", ids)
    return _dims(embeddings.init_embeddings(tokenized, matrix, unk_id=UNK), "piece")


def resize_embeddings(spark, folder):
    """Reversed ids for the old rows, and one added piece per label."""
    source = table(spark, folder, "embeddings")
    matrix = _matrix(spark, folder)
    top = source.agg(F.max("vec_id").alias("top"))
    old = source.select(F.col("vec_id").cast("int").alias("id"), F.concat(F.lit("p"), "vec_id").alias("piece"))
    moved = source.crossJoin(F.broadcast(top)).select(
        (F.col("top") - F.col("vec_id")).cast("int").alias("id"), F.concat(F.lit("p"), "vec_id").alias("piece")
    )
    members = source.select(F.concat(F.lit("label"), "label").alias("piece"), F.col("vec_id").cast("int").alias("id"))
    labels = source.select("label").distinct().crossJoin(F.broadcast(top))
    fresh = labels.select(
        (F.col("top") + 1 + F.col("label")).cast("int").alias("id"),
        F.concat(F.lit("label"), "label").alias("piece"),
    )
    initial = embeddings.embedding_mean(members, matrix)
    return _dims(embeddings.resize_embeddings(moved.unionByName(fresh), old, matrix, initial), "id")


def extend_vocabulary(spark, folder):
    """Pieces learned from all texts and a new code join the seed vocabulary, with vectors.

    What must hold is returned: the base keeps its ids, ids have no gaps, nothing lacks a vector.
    """
    base = seed_vocab(spark, folder)
    learned = vocab_plans.learn_from_corpus(documents(spark, folder).withColumnRenamed("text", "lez"))
    size = table(spark, folder, "embeddings").count()
    matrix = base.select("id", F.pmod("id", F.lit(size)).cast("int").alias("_at")).join(
        _matrix(spark, folder).withColumnRenamed("id", "_at"), "_at"
    )
    codes = [LEZGIAN.code, NEW_CODE]
    merged, grown = vocab_plans.extend_vocabulary(base, learned, matrix.select("id", "vec"), UNK, codes)
    rows = cut_lineage(merged.join(grown, "id", "left"))
    kept = rows.join(base.select("id", "piece"), ["id", "piece"])
    return rows.agg(
        (F.max("id") + 1 - F.count(F.lit(1))).alias("gaps"),
        F.count_if(F.col("vec").isNull()).alias("without_vector"),
        F.count_if(F.col("piece") == NEW_CODE).alias("new_codes"),
        (F.count(F.lit(1)) - F.countDistinct("piece")).alias("repeated"),
    ).crossJoin(kept.agg(F.count(F.lit(1)).alias("base_kept")))


# --- inference -----------------------------------------------------------------------------


def reverser() -> translate.Translator:
    """A stand-in for a model: the words in reverse order."""
    return lambda texts, options: [" ".join(reversed(t.split(" "))) for t in texts]


def translate_texts(spark, folder):
    rows = translate.translate(table(spark, folder, "benchmark"), reverser)
    return rows.select("item_id", "translation")


def translate_split(spark, folder):
    rows = translate.translate_split(pairs(spark, folder), reverser)
    return rows.select("conv_id", "turn", "hyp", "ref")


def evaluate(spark, folder):
    return _rounded_scores(evaluation.evaluate(pairs(spark, folder), reverser))


QUERIES = {
    f.__name__: f
    for f in (
        char_counts,
        required_chars,
        parallel_pairs,
        read_parallel,
        write_splits,
        read_split,
        load_corpora,
        write_plain_text,
        write_vocab,
        write_embeddings,
        drop_missing,
        char_filter,
        normal_pieces,
        reserved_tokens,
        resolve_lang,
        lang_to_column,
        check_direction,
        normalize_punct,
        normalize_punct_pages,
        replace_nonprint,
        nfkc,
        preprocess,
        explode_chars,
        most_common,
        split_90_5_5,
        split_exact,
        with_row_idx,
        take_positional,
        epoch_shuffle,
        sample_with_replacement,
        sample_poisson,
        assign_batches,
        random_direction,
        fixed_direction,
        both_directions,
        add_special,
        truncate_ids,
        pad_batch,
        mask_labels,
        max_new_tokens,
        token_id,
        train_batch,
        test_batch,
        collect_batches,
        encode,
        decode,
        training_batches,
        drawn_batches,
        validation_batches,
        evaluation_batches,
        corpus_size,
        distinct_pieces,
        mean_loss_by_loader,
        macro_loss,
        best_checkpoints,
        checkpoint_name,
        embedding_mean,
        corpus_bleu,
        corpus_bleu_by_turn,
        corpus_chrf,
        metrics_row,
        word_counts,
        substring_seeds,
        learn_vocab,
        prep_corpus_for_vocab,
        merge_vocab,
        shift_scores,
        added_vocab,
        extend_codes,
        sorted_codes,
        init_embeddings,
        resize_embeddings,
        extend_vocabulary,
        translate_texts,
        translate_split,
        evaluate,
    )
}
