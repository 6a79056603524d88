import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinloom.llm import nearest as near
from twinloom.llm.queries import op12_nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, asks, k=5):
    """Exact neighbours ``{n: [(key, cosine), ...]}`` by row number, ties by key, missing keys last."""
    matrix = np.array([v for _, v in rows], dtype=np.float64)
    norms = np.sqrt((matrix**2).sum(axis=1))
    found = {}
    for n, (key, _) in enumerate(rows):
        if asks(key):
            score = (matrix * matrix[n]).sum(axis=1) / (norms * norms[n])
            others = [m for m in range(len(rows)) if m != n]
            others.sort(key=lambda m: (-score[m], rows[m][0] is None, rows[m][0] or 0))
            found[n] = [(rows[m][0], score[m]) for m in others[:k]]
    return found


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1) for k, v in rows], SCHEMA)


def cloud(seed, n, size, centres=40, spread=0.3):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(centres, size))
    made = middles[draw.integers(centres, size=n)] + spread * draw.normal(size=(n, size))
    return [(k, v.astype(np.float32).tolist()) for k, v in enumerate(made)]


def neighbours(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (repr(r["query_id"]), r["rank"])):
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return found


@pytest.mark.parametrize(("x", "directions", "want"), [(2.0, 2, 1 - math.exp(-1)), (15.507, 8, 0.95), (5.226, 12, 0.05)])
def test_chi_square(x, directions, want):
    assert near.chi_square(x, directions) == pytest.approx(want, abs=1e-4)
    assert near.chi_square_quantile(want, directions) == pytest.approx(x, abs=1e-2)


def test_cells_are_a_kd_tree():
    places = np.random.default_rng(1).normal(size=(4000, 6))
    axis, threshold = near.fit_splits(places[:1000], 4)
    cell = near.cell_of(places, axis, threshold)
    assert set(cell) == set(range(16)) and np.bincount(cell).min() > 100
    boxes = [(places[cell == c].min(axis=0), places[cell == c].max(axis=0)) for c in range(16)]
    for a in range(16):
        for b in range(a):
            apart = (boxes[a][0] >= boxes[b][1]) | (boxes[b][0] >= boxes[a][1])
            assert apart.any()


def test_leaves_hold_every_row_once():
    places = np.random.default_rng(2).normal(size=(777, 8))
    leaves = near.Leaves(np.concatenate([places, np.zeros((200, 8))]))
    assert sorted(leaves.rows(np.arange(len(leaves.begin)))) == list(range(977))
    assert len(leaves.begin) > 20


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 100)
    rows = cloud(3, 3_000, 24)
    want = by_hand(rows, lambda k: k % 50 == 0)
    found = neighbours(near.nearest(frame(spark, rows).repartition(5), F.col("vec_id") % 50 == 0))
    assert sorted(found) == sorted(want)
    met = 0
    for n, exact in want.items():
        assert [r for r, *_ in found[n]] == [1, 2, 3, 4, 5]
        scores = {k: s for k, s in exact}
        met += len({k for _, k, _ in found[n]} & set(scores))
        for _, k, s in found[n]:
            assert s == pytest.approx(scores.get(k, s), abs=1e-12)
        assert [s for *_, s in found[n]] == sorted((s for *_, s in found[n]), reverse=True)
    assert met >= 0.95 * 5 * len(want)


def test_near_queries_visit_few_rows():
    """Where neighbours are near, the test ends the search early."""
    rows = cloud(4, 2_000, 32, centres=100, spread=0.02)
    vectors = np.array([v for _, v in rows])
    places = near._unit(vectors) @ near.directions_of(32, 8, 1)
    block = near.Block(np.arange(2_000), np.arange(2_000), vectors, places)
    looked = []
    plain = block.leaves.rows
    block.leaves.rows = lambda leaves: looked.append(len(leaves)) or plain(leaves)
    distance = near.box_distances(places[:1], block.leaves.low, block.leaves.high)[0]
    best, _ = block.search(0, vectors[0], places[0], distance, -2.0, 5, near.chi_square_quantile(0.98, 8))
    assert len(best) == 5 and sum(looked) < 0.4 * len(block.leaves.begin)


def test_cells_blocks_and_chunks_do_not_matter(spark, monkeypatch):
    """With a certain test every neighbour is found, whatever the index looks like."""
    rows = cloud(5, 400, 8)
    want = by_hand(rows, lambda k: k % 10 == 0, 3)
    for block, together, first in ((2048, 4096, 4), (30, 7, 1)):
        monkeypatch.setattr(near, "BLOCK", block)
        monkeypatch.setattr(near, "QUERIES_TOGETHER", together)
        monkeypatch.setattr(near, "FIRST_CELLS", first)
        df = near.nearest(frame(spark, rows), F.col("vec_id") % 10 == 0, k=3, confidence=1 - 1e-12)
        found = neighbours(df)
        assert {n: [k for _, k, _ in f] for n, f in found.items()} == {n: [k for k, _ in w] for n, w in want.items()}


def test_equal_vectors(spark, monkeypatch):
    """A crowd of copies: the smallest keys come first, and crowds are cut into blocks."""
    monkeypatch.setattr(near, "BLOCK", 50)
    v = [float(np.float32(random.Random(6).gauss(0, 1))) for _ in range(16)]
    rows = [(k, v) for k in range(100, 700)] + cloud(7, 90, 16)
    rows += [(700, v), (700, v), (None, v), (None, [2 * x for x in v])]
    found = near.nearest(frame(spark, rows), F.col("vec_id").isin(100, 650, 700)).collect()
    per = {}
    for r in found:
        per.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(per[100]) == [(n + 1, 101 + n) for n in range(5)]
    assert sorted(per[650]) == [(n + 1, 100 + n) for n in range(5)]
    assert sorted(per[700]) == sorted(2 * [(n + 1, 100 + n) for n in range(5)])
    assert all(r["score"] == pytest.approx(1.0, abs=1e-12) for r in found)


def test_unusable_vectors_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (None, [1.0, 0.0]), (3, [-1e-30, 0.0]), (4, [0.0, 3e38])]
    bad = [(50, None), (100, [nan, 1.0]), (150, [inf, 1.0]), (200, [None, 1.0]), (250, [0.0, 0.0]), (300, []), (350, [1.0])]
    df = frame(spark, good + bad).selectExpr("*", "label as vector", "label as id", "label as cell", "label as q")
    found = neighbours(near.nearest(df, F.col("vec_id") % 50 == 0))
    root = math.sqrt(0.5)
    want = [(1, None, 1.0), (2, 1, root), (3, 4, 0.0), (4, 3, -1.0)]
    assert list(found) == [0]
    for (rank, key, score), (*expected, exact) in zip(found[0], want, strict=True):
        assert [rank, key] == expected and score == pytest.approx(exact, abs=1e-12)


def test_empty_tables(spark):
    for rows in ([], [(0, None)], [(0, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert near.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0).collect() == []


def test_directions_are_even(spark):
    with pytest.raises(ValueError):
        near.nearest(frame(spark, []), F.lit(True), directions=3)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_query_recall(spark, scale):
    folder = f"/root/testdata/{scale}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = by_hand(rows, lambda k: k % 50 == 0)
    found = neighbours(op12_nearest_neighbours(spark, folder))
    pairs = {(q, k) for q, f in found.items() for _, k, _ in f}
    exact = {(rows[n][0], k) for n, w in want.items() for k, _ in w}
    assert len(pairs) == len(exact) and len(pairs & exact) >= 0.9 * len(exact)
