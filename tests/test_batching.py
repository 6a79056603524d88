import pytest
from pyspark.sql import functions as F

from twinloom.functions import tokens
from twinloom.operators import batching as B
from twinloom.plans import batches as plans


@pytest.fixture
def indexed(spark):
    rows = [(i, f"ru {i}", f"lez {i} x") for i in range(40)]
    return spark.createDataFrame(rows, "row_idx long, ru string, lez string")


def test_batches_are_consecutive(indexed):
    sizes = {r.batch_id: r["count"] for r in B.assign_batches(indexed).groupBy("batch_id").count().collect()}
    assert sizes == {0: 16, 1: 16, 2: 8}


def test_one_direction_per_batch(indexed):
    rows = B.random_direction(B.assign_batches(indexed, 2), seed=1).collect()
    by_batch = {}
    for r in rows:
        by_batch.setdefault(r.batch_id, set()).add((r.src_lang, r.tgt_lang))
        forward = r.src_lang == "rus_Cyrl"
        assert (r.src_text, r.tgt_text) == ((r.ru, r.lez) if forward else (r.lez, r.ru))
    assert all(len(d) == 1 for d in by_batch.values())
    assert len(set.union(*by_batch.values())) == 2


def test_fixed_and_both_directions(indexed):
    with pytest.raises(ValueError):
        B.fixed_direction(indexed, "rus_Cyrl", "rus_Cyrl")
    both = B.both_directions(indexed)
    assert both.count() == 80
    assert {(r.loader, r.src_lang) for r in both.collect()} == {(0, "rus_Cyrl"), (1, "lez_Cyrl")}


def test_padding(spark):
    rows = [(0, 0, [1, 2, 3]), (0, 1, [4]), (1, 2, [5, 6]), (2, 3, [])]
    df = spark.createDataFrame(rows, "batch_id long, row_idx long, ids array<int>")
    got = {r.row_idx: (r.ids, r.ids_mask, r.ids_len) for r in B.pad_batch(df, pad_id=9).collect()}
    assert got == {
        0: ([1, 2, 3], [1, 1, 1], 3),
        1: ([4, 9, 9], [1, 0, 0], 3),
        2: ([5, 6], [1, 1], 2),
        3: ([], [], 0),
    }


def test_token_arrays(spark):
    ids = F.array(*[F.lit(i) for i in range(10, 15)])
    row = spark.range(1).select(
        tokens.truncate_ids(ids, 5).alias("cut"),
        tokens.truncate_ids(ids, 1).alias("none"),
        tokens.add_special(ids, F.lit(7), F.lit(1)).alias("framed"),
        tokens.mask_labels(F.array(F.lit(3), F.lit(0)), 0).alias("masked"),
        tokens.max_new_tokens(F.lit(10)).alias("limit"),
    ).first()
    assert row.cut == [10, 11, 12] and row.none == []
    assert row.framed == [7, 10, 11, 12, 13, 14, 1]
    assert row.masked == [3, -100] and row.limit == 62


def encoded(spark):
    rows = [
        (0, 0, [10] * 200, [20], 3, 4, "t0", "rus_Cyrl", "lez_Cyrl"),
        (0, 1, [11], [21, 22], 3, 4, "t1", "rus_Cyrl", "lez_Cyrl"),
    ]
    schema = "batch_id long, row_idx long, x array<int>, y array<int>, src_id int, tgt_id int, tgt_text string, src_lang string, tgt_lang string"
    return spark.createDataFrame(rows, schema)


def test_train_batch(spark):
    rows = {r.row_idx: r for r in B.train_batch(encoded(spark), 0, 1).collect()}
    assert len(rows[0].x) == len(rows[1].x) == 128 and rows[0].x[-1] == 1
    assert rows[1].x[:4] == [3, 11, 1, 0] and sum(rows[1].x_mask) == 3
    assert rows[0].y == [4, 20, 1, -100] and rows[1].y == [4, 21, 22, 1]


def test_test_batch_keeps_inputs_whole(spark):
    rows = {r.row_idx: r for r in B.test_batch(encoded(spark), 0, 1).collect()}
    assert len(rows[0].x) == 202
    assert rows[1].forced_bos_token_id == 4
    assert rows[1].max_new_tokens == 32 + 3 * 202 and rows[1].num_beams == 4
    capped = B.test_batch(encoded(spark), 0, 1, max_input_length=10).first()
    assert len(capped.x) == 10


def test_collect_batches_keeps_row_order(spark):
    record = B.collect_batches(B.train_batch(encoded(spark), 0, 1)).first()
    assert [i.row_idx for i in record["items"]] == [0, 1]


@pytest.fixture
def vocab(spark):
    pieces = ["▁", *"ruleztx0123456789", "▁ru", "▁lez"]
    rows = [(0, "<pad>", 0.0, 3), (1, "</s>", 0.0, 3), (2, "<unk>", 0.0, 2)]
    rows += [(i + 5, p, -2.0 * (4 - len(p)) / 3 - 1, 1) for i, p in enumerate(pieces)]
    return spark.createDataFrame(rows, "id int, piece string, score double, type int")


LANG_IDS = {"rus_Cyrl": 3, "lez_Cyrl": 4}


def test_training_batches_end_to_end(spark, indexed, vocab):
    pairs = indexed.withColumnRenamed("row_idx", "key")
    rows = plans.training_batches(pairs, ["key"], vocab, LANG_IDS, 0, 1, 2, batch_size=8).collect()
    assert len(rows) == 40
    for r in rows:
        assert {r.x[0], r.y[0]} == {3, 4} and 1 in r.x and 1 in r.y
        assert len(r.x) == len(r.x_mask) and len(r.y) == len(r.y_mask)
    widths = {(r.batch_id, len(r.x), len(r.y)) for r in rows}
    assert len(widths) == 5


def test_validation_and_evaluation_batches(spark, indexed, vocab):
    rows = plans.validation_batches(indexed, vocab, LANG_IDS, 0, 1, 2).collect()
    assert len(rows) == 80
    assert {(r.loader, r.x[0]) for r in rows} == {(0, 3), (1, 4)}
    test = plans.evaluation_batches(indexed, "rus_Cyrl", "lez_Cyrl", vocab, LANG_IDS, 0, 1, 2).collect()
    assert len(test) == 40
    first = next(r for r in test if r.row_idx == 0)
    assert first.tgt_text == "lez 0 x" and first.forced_bos_token_id == 4
    assert first.max_new_tokens == 32 + 3 * len(first.x)


def test_large_vocabularies_are_joined(spark, indexed, vocab, monkeypatch):
    """The same ids, missing texts and repeated rows included, as where the vocabulary is sent."""
    texts = indexed.select("ru", "lez").unionByName(indexed.select("ru", "lez").limit(2))
    texts = texts.unionByName(texts.limit(1).select(F.lit(None).cast("string").alias("ru"), "lez"))
    columns = {"x": "ru", "y": "lez"}

    def found():
        return sorted((tuple(r) for r in plans.encode_texts(texts, columns, vocab, 2).select("ru", "lez", "x", "y").collect()), key=repr)

    want = found()
    monkeypatch.setattr(plans, "encode_columns", lambda *_: None)
    assert found() == want
