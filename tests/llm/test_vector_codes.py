import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from twinloom.llm import vector_codes as codes
from twinloom.llm.queries import ORACLES, op13_vector_codes

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, parts, entries, rounds, scale):
    """Plain integer steps on ``(key, vector, label)``; returns rows ``(key, label, codes, error)`` and books."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-len(rows[0][1]) // parts)

    def cut(v):
        whole = [math.floor(scale * x) for x in v] + [0] * (parts * width - len(v))
        return [whole[k * width : (k + 1) * width] for k in range(parts)]

    cuts = [cut(v) for _, v, _ in rows]
    books = [[list(c[k]) for c in cuts[:entries]] for k in range(parts)]

    def nearest(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            shares = {}
            for c in cuts:
                shares.setdefault(nearest(c[k], books[k])[1], []).append(c[k])
            for n, share in shares.items():
                books[k][n] = [sum(x) // len(share) for x in zip(*share, strict=True)]
    found = []
    for (key, _, label), c in zip(rows, cuts, strict=True):
        best = [nearest(c[k], books[k]) for k in range(parts)]
        found.append((key, label, [n for _, n in best], sum(d for d, _ in best)))
    return found, books


def vectors(seed, n, size, spread=1.0, kinds=3):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(size)] for _ in range(kinds)]
    made = []
    for k in range(n):
        v = [float(np.float32(c + draw.gauss(0, spread))) for c in draw.choice(centres)]
        made.append((k, v, draw.choice([None, 1, 2])))
    return made


def as_rows(df):
    return sorted(((r["vec_id"], r["label"], list(r["codes"]), r["error"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("size", "bits"), [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(size, bits):
    axes = [np.arange(1 << bits)] * size
    grid = np.stack(np.meshgrid(*axes, indexing="ij"), axis=-1).reshape(-1, size)
    keys = codes.hilbert_keys(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize(("n", "width", "scale"), [(1, 4, 40), (33, 4, 5), (5_000, 4, 256), (900, 3, 2), (100, 1, 3), (400, 4, 1e9)])
def test_shortlists_lose_no_nearest_entry(n, width, scale):
    points = codes.integers(np.random.default_rng(n).normal(size=(n, 2 * width)), 2, scale)
    stored = codes._blocks(points)
    for k in range(2):
        part = {c: a[k] for c, a in stored.items()}
        book = points[k, :64].astype(np.int64)
        distance = ((points[k].astype(np.int64)[:, None] - book[None]) ** 2).sum(axis=2)
        code, error = codes.part_codes(part, book)
        assert code.tolist() == distance.argmin(axis=1).tolist()
        assert error.tolist() == distance.min(axis=1).tolist()
        count, total = codes.part_sums(part, book)
        assert count.tolist() == np.bincount(code, minlength=len(book)).tolist()
        for entry in range(len(book)):
            assert total[entry].tolist() == points[k][code == entry].astype(np.int64).sum(axis=0).tolist()
        near = codes.shortlists(part["low"], part["high"], book)
        for row, entry in zip(part["places"], code[part["places"]], strict=True):
            assert near[np.flatnonzero(part["places"] == row)[0] // codes.BLOCK, entry] if n < 200 else True


@pytest.mark.parametrize(("size", "parts", "entries", "rounds"), [(8, 2, 5, 2), (8, 4, 64, 3), (7, 3, 4, 1), (5, 5, 1, 0)])
def test_against_plain_steps(spark, size, parts, entries, rounds):
    rows = vectors(size, 150, size)
    rows += [rows[3], (4, rows[9][1], 2), (None, rows[5][1], None), (None, rows[6][1], 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found, books = codes.compress(df, keep=("label",), parts=parts, entries=entries, rounds=rounds, scale=16)
    want, want_books = by_hand(rows, parts, entries, rounds, 16)
    assert books.tolist() == want_books
    assert as_rows(found) == sorted(want, key=repr)


def test_groups_do_not_change_results(spark, monkeypatch):
    rows = vectors(1, 300, 8, spread=0.01)
    df = spark.createDataFrame(rows, SCHEMA)
    whole, books = codes.compress(df.coalesce(1), keep=("label",), parts=2, scale=1000)
    wide = as_rows(whole)
    monkeypatch.setattr(codes, "GROUP", 20)
    cut, more = codes.compress(df.repartition(5), keep=("label",), parts=2, scale=1000)
    assert as_rows(cut) == wide and more.tolist() == books.tolist()


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [float(k), 1.0, 2.0, -1.0], 1) for k in range(5)]
    bad = [(10, None, 1), (11, [1.0, None, 2.0, 3.0], 1), (12, [nan] * 4, 1), (13, [inf, 1.0, 1.0, 1.0], 1)]
    odd = [(14, [], 1), (15, [1.0], 1), (16, [1.0] * 8, 1)]
    df = spark.createDataFrame(good + bad + odd, SCHEMA).selectExpr("*", "label as vector", "label as k0", "vec_id as points")
    found, books = codes.compress(df, keep=("label",), parts=2, entries=3, scale=1)
    want, want_books = by_hand(good, 2, 3, 2, 1)
    assert as_rows(found) == sorted(want, key=repr) and books.tolist() == want_books


def test_largest_components(spark):
    rows = [(1, [3e38] * 64, 1), (2, [-3e38] * 64, 1), (3, [0.0] * 64, 1)]
    found, _ = codes.compress(spark.createDataFrame(rows, SCHEMA), keep=("label",), entries=1, rounds=0)
    errors = {r["vec_id"]: r["error"] for r in codes.total_errors(found).collect()}
    assert errors == {1: 0, 2: 64 * (2 << 27) ** 2, 3: 64 * (1 << 27) ** 2}


def test_label_errors(spark, monkeypatch):
    rows = [(k, [float(k), 0.0], label) for k, label in enumerate([None, 1, None, 2, 1, 2, None])]
    found, _ = codes.compress(spark.createDataFrame(rows, SCHEMA), keep=("label",), parts=1, entries=2, scale=1)
    errors = Counter()
    for r in found.collect():
        errors[r["label"]] += r["error"]
    for limit in (codes.SENT_BYTES, -1):
        monkeypatch.setattr(codes, "SENT_BYTES", limit)
        got = codes.total_errors(found).collect()
        assert len(got) == 7 and all(r["label_error"] == errors[r["label"]] for r in got)


def test_empty_table(spark):
    for rows in ([], [(1, None, 1)]):
        found, books = codes.compress(spark.createDataFrame(rows, SCHEMA), keep=("label",))
        assert codes.total_errors(found).collect() == [] and books.size == 0


def test_query_against_sql_on_awkward_rows(spark, tmp_path):
    nan = float("nan")
    rows = vectors(4, 200, 64, spread=0.2) + [(None, [0.5] * 64, None), (7, [0.25] * 64, 3), (300, None, 1), (301, [nan] * 64, 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = db.execute(ORACLES["op13_vector_codes"]).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in op13_vector_codes(spark, str(tmp_path)).collect())
    assert len(want) == 202
