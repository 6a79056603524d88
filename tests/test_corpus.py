import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinloom.operators import ordering, split
from twinloom.sources import corpus, tables

PAIRS = [
    ('a "quoted", text', "two\nlines"),
    ("NA", "null"),
    (" padded ", "comma, here"),
    (None, "only lez"),
    ("only ru", None),
]


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame(PAIRS, "ru string, lez string")


def test_read_parallel_keeps_text_and_ignores_other_columns(spark, pairs, tmp_path):
    path = str(tmp_path / "raw")
    raw = pairs.select(F.lit(1).alias("n"), F.col("lez").alias("text_lez"), F.col("ru").alias("text_ru"))
    raw.write.options(**corpus.CSV_OPTIONS).csv(path)
    assert Counter(tuple(r) for r in corpus.read_parallel(spark, path).collect()) == Counter(PAIRS)


def test_missing_column_fails(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.createDataFrame([("a",)], "text_ru string").write.option("header", True).csv(path)
    with pytest.raises(ValueError, match="text_lez"):
        corpus.read_parallel(spark, path)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_splits_round_trip(spark, tmp_path, fmt):
    df = spark.range(400).select(F.concat(F.lit("r"), "id").alias("ru"), F.concat(F.lit("l"), "id").alias("lez"))
    labelled = split.split_90_5_5(df, "ru")
    path = str(tmp_path / "splits")
    corpus.write_splits(labelled, path, fmt)
    for name in corpus.SPLITS:
        want = {tuple(r) for r in labelled.where(F.col("split") == name).select("ru", "lez").collect()}
        assert {tuple(r) for r in corpus.read_split(spark, path, name, fmt).collect()} == want
    assert corpus.load_corpora(spark, path, fmt=fmt).count() == 400
    with pytest.raises(ValueError):
        corpus.read_split(spark, path, "dev")


def test_plain_text_is_one_line_per_text(spark, pairs, tmp_path):
    path = str(tmp_path / "plain")
    corpus.write_plain_text(pairs, "lez", path)
    lines = sorted(r.value for r in spark.read.text(path).collect())
    assert lines == sorted(["two lines", "null", "comma, here", "only lez"])


def test_tables_round_trip(spark, tmp_path):
    vocab = spark.createDataFrame([(1, "b", -1.0, 1), (0, "a", 0.0, 3)], "id int, piece string, score double, type int")
    tables.write_vocab(vocab, str(tmp_path / "v"))
    assert [r.piece for r in tables.read_vocab(spark, str(tmp_path / "v")).orderBy("id").collect()] == ["a", "b"]
    vectors = spark.createDataFrame([(0, [1.0, 2.0])], "id int, vec array<float>")
    tables.write_embeddings(vectors, str(tmp_path / "e"))
    assert tables.read_embeddings(spark, str(tmp_path / "e")).first().vec == [1.0, 2.0]


def test_row_idx_is_dense_and_ordered(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("k")).repartition(7)
    rows = ordering.with_row_idx(df, "k").collect()
    assert all(r.k == r.row_idx for r in rows) and len(rows) == 1000


def test_row_idx_with_a_third_of_equal_rows(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k")).repartition(8)
    rows = ordering.with_row_idx(df, "k").collect()
    assert sorted(r.row_idx for r in rows) == list(range(900))
    assert {r.row_idx for r in rows if r.k == -1} == set(range(300))


def test_row_idx_of_nothing(spark):
    assert ordering.with_row_idx(spark.range(0), "id").count() == 0
    assert ordering.with_row_idx(spark.createDataFrame([], "k long, t string"), "k").count() == 0


def wide(spark, keys):
    rows = [(None if k is None else float(k), f"text {n}", [n]) for n, k in enumerate(keys)]
    return spark.createDataFrame(rows, "k double, t string, a array<int>").repartition(5)


@pytest.mark.parametrize("sent", [0, 8 << 20])
def test_wide_rows_find_their_key(spark, monkeypatch, sent):
    monkeypatch.setattr(ordering, "SENT_BYTES", sent)
    keys = [(n * 37) % 500 for n in range(500)]
    rows = ordering.with_row_idx(wide(spark, keys), -F.col("k")).collect()
    assert [r.row_idx for r in rows] == [499 - int(r.k) for r in rows]
    assert {r.t: r.a for r in rows} == {f"text {n}": [n] for n in range(500)}


@pytest.mark.parametrize("sent", [0, 8 << 20])
def test_wide_rows_that_share_keys(spark, monkeypatch, sent):
    monkeypatch.setattr(ordering, "SENT_BYTES", sent)
    nan = float("nan")
    keys = [None, None, None, nan, nan, 0.0, -0.0, *[7.0] * 200, *[float(n) for n in range(100, 400)]]
    rows = ordering.with_row_idx(wide(spark, keys), "k").orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == list(range(len(keys)))
    assert {r.t for r in rows} == {f"text {n}" for n in range(len(keys))}
    order = [-1.0 if r.k is None else math.inf if math.isnan(r.k) else r.k for r in rows]
    assert order == sorted(order)


@pytest.mark.parametrize("sent", [0, 8 << 20])
def test_positions_neither_sort_nor_store_wide_rows(spark, monkeypatch, sent):
    monkeypatch.setattr(ordering, "SENT_BYTES", sent)
    stored = []
    cut = ordering.cut_lineage
    monkeypatch.setattr(ordering, "cut_lineage", lambda df: stored.append(df.schema) or cut(df))
    indexed = ordering.with_row_idx(wide(spark, range(300)), "k")
    indexed.collect()
    assert stored and all(isinstance(f.dataType, ordering.FIXED_WIDTH) for schema in stored for f in schema)
    plan = indexed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" not in plan and not re.search(r"Sort \[[^]]*\b(t|a)#", plan)
    moved = re.search(r"hashpartitioning\(.*_k0", plan)
    assert ("ShuffledHashJoin" in plan) == (sent == 0) and (sent == 0 or not moved)


def test_epoch_shuffle_is_a_repeatable_permutation(spark):
    df = spark.range(500)
    first = {r.id: r.row_idx for r in ordering.epoch_shuffle(df, "id", epoch=1).collect()}
    again = {r.id: r.row_idx for r in ordering.epoch_shuffle(df.repartition(3), "id", epoch=1).collect()}
    other = {r.id: r.row_idx for r in ordering.epoch_shuffle(df, "id", epoch=2).collect()}
    assert sorted(first.values()) == list(range(500))
    assert first == again and first != other


def test_draws(spark):
    indexed = ordering.with_row_idx(spark.range(50), "id")
    rows = ordering.draw_rows(indexed, 200).collect()
    assert sorted(r.draw for r in rows) == list(range(200))
    assert len({r.id for r in rows}) > 30 and max(Counter(r.id for r in rows).values()) > 1
    assert ordering.take_positional(indexed, 3, 7).count() == 2
    poisson = ordering.sample_with_replacement(spark.range(2000), 1.0, 1).count()
    assert 1700 < poisson < 2300


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 20, 137, 1000])
def test_exact_split_sizes(spark, n):
    sizes = Counter(r.split for r in split.split_exact(spark.range(n), "id").collect())
    assert (sizes["train"], sizes["val"], sizes["test"]) == split.split_sizes(n)


def test_exact_split_with_copies_and_nothing(spark):
    copies = spark.range(600).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"))
    sizes = Counter(r.split for r in split.split_exact(copies.repartition(5), "k").collect())
    assert (sizes["train"], sizes["val"], sizes["test"]) == split.split_sizes(600) == (540, 30, 30)
    assert split.split_exact(spark.range(0), "id").count() == 0


def test_hash_split_is_stable_under_appends(spark):
    few = {r.id: r.split for r in split.split_90_5_5(spark.range(300), "id").collect()}
    more = {r.id: r.split for r in split.split_90_5_5(spark.range(600), "id").collect()}
    assert all(more[k] == v for k, v in few.items())
