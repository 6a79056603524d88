import random
from itertools import combinations

import pytest
import xxhash

from helpers import AWKWARD, documents, prose
from twinloom.llm.simhash import (
    RADIUS,
    covering_masks,
    drop_near_copies,
    fingerprint,
    fingerprint_links,
    near_groups,
)
from twinloom.llm.common import components

FOLDER = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def find(prints, radius=RADIUS):
    """Component of each number by comparing all pairs."""
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= radius:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {p: top(p) for p in prints}


def brute(rows):
    prints = [(i, slow_fingerprint(t)) for i, t, *_ in rows]
    roots = find({f for _, f in prints})
    least = {}
    for i, f in prints:
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    return sorted(((i, f"{f:016x}", least.get(roots[f])) for i, f in prints), key=repr)


def near_copies(n, seed=5, words=200):
    draw = random.Random(seed)
    base = prose(seed, words).split(" ")
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(k % 4):
            w[draw.randrange(len(w))] = f"new{k}"
        out.append((1000 + k, " ".join(w)))
    return out


def test_masks_cover_all_pairs():
    masks = covering_masks()
    assert len(masks) == 15
    draw = random.Random(1)
    for _ in range(3000):
        gap = sum(1 << b for b in draw.sample(range(64), 3))
        assert any(m & gap == 0 for m in masks)


def test_fingerprint():
    for _, text, *_ in AWKWARD:
        if text and len(text) > 50_000:
            continue
        assert fingerprint((text or "").encode()) & (2**64 - 1) == slow_fingerprint(text)


def test_groups(spark):
    rows = [r for r in AWKWARD if not r[1] or len(r[1]) < 50_000] + near_copies(60) + [(2000 + i, prose(i)) for i in range(40)]
    found = near_groups(documents(spark, rows, clashes=True))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, near_groups(docs).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("pairwise", [0, 3, 1000])
def test_large_buckets_lose_no_link(spark, pairwise):
    draw = random.Random(4)
    prints = set()
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(25):
            flips = draw.sample(range(64), draw.randint(0, 5))
            prints.add(centre ^ sum(1 << b for b in flips))
    signed = {p: p - 2**64 if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    roots = {r["node"]: r["root"] for r in components(fingerprint_links(df, pairwise=pairwise)).collect()}
    want = find(prints)
    by_want, by_got = {}, {}
    for p, s in signed.items():
        by_want.setdefault(want[p], set()).add(p)
        by_got.setdefault(roots.get(s, s), set()).add(p)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


def test_dropping(spark):
    rows = [r for r in AWKWARD if not r[1] or len(r[1]) < 50_000] + near_copies(30)
    docs = documents(spark, rows, clashes=True)
    found = drop_near_copies(docs)
    assert found.columns == docs.columns
    want = sorted({c for _, _, c in brute(rows)}, key=repr)
    assert sorted([r["doc_id"] for r in found.collect()], key=repr) == want


def test_empty(spark):
    assert near_groups(documents(spark, [])).count() == 0
    assert drop_near_copies(documents(spark, [])).count() == 0


def test_chain_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
