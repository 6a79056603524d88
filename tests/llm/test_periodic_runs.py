import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from helpers import AWKWARD, documents, prose
from twinloom.llm import periodic_runs as runs
from twinloom.llm.queries import op11_periodic_runs

FOLDER = "/root/testdata/sf0.001"


def smallest_period(words):
    """By the failure function."""
    fail = [0] * (len(words) + 1)
    k = 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = fail[k]
        k += words[i] == words[k]
        fail[i + 1] = k
    return len(words) - fail[-1]


def by_hand(words, min_length=24, repeats=3):
    """Every maximal stretch of each period, kept if that is its smallest one."""
    found = []
    for p in range(1, len(words) // repeats + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            stretch = words[start : i + p]
            if len(stretch) >= max(min_length, repeats * p) and smallest_period(stretch) == p:
                found.append((start, len(stretch), p))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    dropped = {k for s, n, p in found for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in dropped)


def random_words(draw, longest):
    words = [draw.randrange(draw.choice([1, 2, 2, 3, 9])) for _ in range(draw.randint(0, longest))]
    for _ in range(draw.randint(0, 4)):
        if len(words) > 5:
            start, period = draw.randrange(len(words)), draw.randint(1, max(1, len(words) // 4))
            for i in range(start + period, min(len(words), start + draw.randint(1, 6) * period)):
                words[i] = words[i - period]
    return words


def test_cover_has_all_differences():
    differences = {(a - b) % runs.MODULUS for a in runs.COVER for b in runs.COVER}
    assert differences == set(range(runs.MODULUS))


def test_extensions_against_comparison():
    draw = random.Random(2)
    for _ in range(20):
        ids = np.array([*random_words(draw, 900), 99])
        found = runs.Extensions(ids)
        i = np.array([draw.randrange(len(ids)) for _ in range(200)])
        j = np.array([draw.randrange(len(ids)) for _ in range(200)])
        i, j = i[i != j], j[i != j]
        for a, b, length in zip(i, j, found.of(i, j), strict=True):
            n = 0
            while ids[a + n : a + n + 1].tolist() == ids[b + n : b + n + 1].tolist() and max(a, b) + n < len(ids):
                n += 1
            assert length == n


@pytest.mark.parametrize(("min_length", "repeats"), [(24, 3), (6, 2), (1, 2), (10, 4)])
def test_runs_against_definition(min_length, repeats):
    draw = random.Random(min_length)
    for _ in range(80):
        texts = [random_words(draw, 180) for _ in range(draw.randint(1, 5))]
        found = runs.find_runs([np.array(t, dtype=np.int64) for t in texts], min_length, repeats)
        assert [[tuple(r) for r in own.tolist()] for own in found] == [by_hand(t, min_length, repeats) for t in texts]


def test_long_text_and_many_places(monkeypatch):
    monkeypatch.setattr(runs, "PLACES", 50)
    words = [k % 700 for k in range(5_000)] + list(range(1000, 3000)) + [7] * 40
    found = runs.find_runs([np.array(words)], 24, 3)[0].tolist()
    assert found == [[0, 5000, 700], [7000, 40, 1]]


def test_operator_on_awkward_rows(spark):
    chorus = "la di da " * 12
    rows = [*AWKWARD, (20, "start " + chorus + "end"), (20, "start " + chorus + "end"), (21, "x " * 23), (22, "x " * 24)]
    docs = documents(spark, rows, clashes=True).selectExpr("*", "doc_id as runs", "lang as Collapsed")
    out = runs.periodic_runs(docs)
    assert out.columns == [c for c in docs.columns if c != "text"] + ["runs_", "collapsed_"]
    found = [(r["doc_id"], [tuple(x) for x in r["runs_"]], r["collapsed_"]) for r in out.collect()]
    want = []
    for doc_id, text, *_ in rows:
        words = (text or "").split()
        hits = by_hand(words) if len(words) < 200 else []
        want.append((doc_id, hits, collapsed(words, hits)))
    assert sorted(map(repr, found)) == sorted(map(repr, want))
    assert (20, [(1, 36, 3)], "start la di da end") in found
    assert (22, [(0, 24, 1)], "x") in found and (21, [], " ".join(["x"] * 23)) in found


def test_portions_do_not_change_results(spark, monkeypatch):
    texts = [("a b c " * k + prose(k)).encode() for k in range(30)]
    whole = runs._searched(texts, 24, 3)
    alone = [runs._searched([t], 24, 3) for t in texts]
    assert [r.tolist() for r in whole[0]] == [a[0][0].tolist() for a in alone]
    assert whole[1] == [a[1][0] for a in alone]


def test_empty_table(spark):
    assert runs.periodic_runs(documents(spark, [])).collect() == []


def test_a_run_repeats_at_least_twice(spark):
    with pytest.raises(ValueError):
        runs.periodic_runs(documents(spark, []), min_repeats=1)


def expected(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = by_hand(words)
    best = (None,) * 4
    for s, length, p in found:
        if best[0] is None or length * best[2] > best[1] * p:
            best = (s, length, p, 1000 * length // p)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    return (len(found), *best, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(words, found))))


def test_query_against_definition(spark):
    """Texts up to 1,500 words: the plain search is quadratic."""
    found = {r["doc_id"]: tuple(r)[1:] for r in op11_periodic_runs(spark, FOLDER).collect()}
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(found) == len(rows)
    short = [r for r in rows if len((r["text"] or "").split()) <= 1_500]
    assert len(short) > 0.9 * len(rows)
    for row in short:
        assert found[row["doc_id"]] == expected(row["doc_id"], row["text"])
    assert any(r[0] for r in found.values())
