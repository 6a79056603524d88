import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinloom.operators import charstats, embeddings, vocabulary as V
from twinloom.plans import vocabulary as plans

SCHEMA = "id int, piece string, score double, type int"


@pytest.fixture
def base(spark):
    rows = [(0, "<pad>", 0.0, 3), (1, "a", -1.0, 1), (2, "b", -9.0, 1), (3, "c", -4.0, 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def new(spark):
    rows = [(0, "<s>", 0.0, 3), (1, "b", -0.5, 1), (2, "dd", -1.5, 1), (3, "e", -2.5, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_merge_appends_and_keeps_base_ids(base, new):
    rows = V.merge_vocab(base, new).orderBy("id").collect()
    assert [r.piece for r in rows] == ["<pad>", "a", "b", "c", "dd", "e"]
    assert [r.id for r in rows] == list(range(6))
    # The last base piece, not the lowest score, shifts the new ones.
    assert [r.score for r in rows[4:]] == [-5.5, -6.5]


def test_set_operations(spark, base, new):
    assert {r.piece for r in V.added_vocab(new, base).collect()} == {"<s>", "dd", "e"}
    assert V.normal_pieces(base).count() == 3
    assert V.distinct_pieces(base.unionByName(new)).count() == 7
    codes = V.extend_codes(
        spark.createDataFrame([("rus",), ("ace",)], "code string"), spark.createDataFrame([("lez",), ("rus",)], "code string")
    )
    assert [r.code for r in codes.collect()] == ["ace", "lez", "rus", "rus"]


def test_token_id_and_reserved(spark, base):
    tokens = spark.createDataFrame([("b",), ("zz",)], "piece string")
    got = {r.piece: r.token_id for r in V.token_id(tokens, base, unk_id=7).collect()}
    assert got == {"b": 2, "zz": 7}
    added = F.create_map(F.lit("0"), F.lit("x"), F.lit("7"), F.lit("y"))
    assert spark.range(1).select(V.reserved_tokens(added).alias("m")).first().m == {"0": "x"}


def test_char_statistics(spark):
    df = spark.createDataFrame([("aab b",), ("ab",), ("a c",)], "t string")
    counts = {r.ch: r.n for r in charstats.char_counts(df, "t").collect()}
    assert counts == {"a": 4, "b": 3, " ": 2, "c": 1}
    assert charstats.required_chars(df, "t").first()[0] == "ab"
    ties = spark.createDataFrame([("bababa cc cc",)], "t string")
    assert charstats.required_chars(ties, "t").first()[0] == "cab"


def test_mean_counts_repeats_and_falls_back(spark):
    matrix = spark.createDataFrame([(0, [1.0, 0.0]), (1, [4.0, 3.0]), (2, [9.0, 9.0])], "id int, vec array<float>")
    tokens = spark.createDataFrame([("x", [0, 1, 1]), ("empty", []), ("none", None)], "piece string, ids array<int>")
    got = {r.piece: r.vec for r in embeddings.init_embeddings(tokens, matrix, unk_id=2).collect()}
    assert got["x"] == pytest.approx([3.0, 2.0])
    assert got["empty"] == got["none"] == [9.0, 9.0]


def test_resize_matches_on_piece(spark):
    old = spark.createDataFrame([(0, "a", 0.0, 1), (1, "b", 0.0, 1)], SCHEMA)
    new = spark.createDataFrame([(0, "b", 0.0, 1), (1, "n", 0.0, 1), (2, "a", 0.0, 1)], SCHEMA)
    matrix = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "id int, vec array<float>")
    fresh = spark.createDataFrame([("n", [7.0])], "piece string, vec array<double>")
    got = {r.id: r.vec for r in embeddings.resize_embeddings(new, old, matrix, fresh).collect()}
    assert got == {0: [2.0], 1: [7.0], 2: [1.0]}


def test_new_codes_get_rows_and_vectors(spark, base, new):
    matrix = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "id int, vec array<float>")
    merged, grown = plans.extend_vocabulary(base, new, matrix, 0, ["ab_Cyrl", "a"])
    got = {r.piece: (r.id, r.type, r.vec) for r in merged.join(grown, "id").collect()}
    assert got["ab_Cyrl"][:2] == (6, V.CONTROL) and got["ab_Cyrl"][2] is not None
    assert len(got) == 7


def test_member_without_a_vector(spark):
    matrix = spark.createDataFrame([(0, [1.0]), (1, [3.0])], "id int, vec array<float>")
    members = spark.createDataFrame([("x", 0), ("x", 1), ("y", 5)], "piece string, id int")
    with pytest.raises(Exception, match="no vector for id 5"):
        embeddings.embedding_mean(members, matrix).collect()
    tokens = spark.createDataFrame([("y", [5, 0])], "piece string, ids array<int>")
    assert embeddings.init_embeddings(tokens, matrix, unk_id=1).first().vec == [2.0]


@pytest.mark.parametrize("held", [1, 500, 32 << 20])
def test_means_in_any_portions(spark, monkeypatch, held):
    """Whatever a task holds, sums are those of all members, missing keys among them."""
    monkeypatch.setattr(embeddings, "HELD_BYTES", held)
    draw = random.Random(held)
    vectors = {i: [draw.random() for _ in range(3)] for i in range(20)}
    matrix = spark.createDataFrame(list(vectors.items()), "id int, vec array<double>")
    pairs = [(draw.choice([None, "", "a", "b", "cc"]), draw.randrange(20)) for _ in range(400)]
    members = spark.createDataFrame(pairs, "piece string, id int").repartition(3)
    monkeypatch.setattr(embeddings, "_task_sums", _small_batches(embeddings._task_sums))
    monkeypatch.setattr(embeddings, "_sorted_sums", _small_batches(embeddings._sorted_sums))
    got = {r.piece: r.vec for r in embeddings.embedding_mean(members, matrix).collect()}
    assert set(got) == {k for k, _ in pairs}
    for key, mean in got.items():
        rows = [vectors[i] for k, i in pairs if k == key]
        assert mean == pytest.approx([sum(c) / len(rows) for c in zip(*rows, strict=True)])


def _small_batches(kernel):
    def run(batches):
        yield from kernel(b.slice(k, 7) for b in batches for k in range(0, b.num_rows, 7))

    return run


def test_vectors_of_different_lengths(spark):
    matrix = spark.createDataFrame([(0, [1.0]), (1, [3.0, 4.0])], "id int, vec array<float>")
    members = spark.createDataFrame([("x", 0), ("x", 1)], "piece string, id int")
    with pytest.raises(Exception, match="components"):
        embeddings.embedding_mean(members.coalesce(1), matrix).collect()


def test_character_counts_in_any_portions(spark, monkeypatch):
    monkeypatch.setattr(charstats, "COUNTED_TOGETHER", 5)
    draw = random.Random(1)
    texts = [None, "", "\x00\n", *("".join(draw.choice("abя日𝒳 ") for _ in range(draw.randint(0, 30))) for _ in range(50))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    got = {r.ch: r.n for r in charstats.char_counts(df, "t").collect()}
    assert got == Counter("".join(t or "" for t in texts))
    exploded = charstats.explode_chars(df, "t").groupBy("ch").count().collect()
    assert got == {r.ch: r["count"] for r in exploded}
    assert charstats.char_counts(df.limit(0), "t").collect() == []


def test_extended_vocabulary_gets_vectors(spark, base, new):
    matrix = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "id int, vec array<float>")
    merged, grown = plans.extend_vocabulary(base, new, matrix, unk_id=0)
    got = {r.piece: r.vec for r in merged.join(grown, "id").collect()}
    assert got["a"] == [1.0] and got["b"] == [2.0]
    assert got["dd"] == [0.0] and got["e"] == [0.0]  # unknown pieces
    assert len(got) == 6
