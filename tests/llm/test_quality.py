from collections import Counter

import numpy as np
import pytest

from helpers import AWKWARD, documents, labels, prose
from twinloom.llm.quality import BASE, Forest, judge, keep_good, repeated_words, rule_statistics


def slow_counts(text):
    text = text or ""
    for c in "\t\n\r\x0b\x0c":
        text = text.replace(c, " " if c != "\n" else "\n")
    words = [w for w in text.replace("\n", " ").split(" ") if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(covered)


def slow_dup_lines(text):
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


REPEATED = "a b c d e f a b c d e f a b c d e\nx y z\nx y z\n | # $\n\n\n"


def test_counts(spark):
    rows = [*AWKWARD, (20, REPEATED), (21, "é\u00a0è ü\u2003x \x1c y"), (22, "\r\n a \r\n a \r\n")]
    found = rule_statistics(documents(spark, rows, clashes=True)).select("doc_id", *BASE).collect()
    want = []
    for i, t, *_ in rows:
        n, chars, symbols, repeats = slow_counts(t)
        want.append((i, n, chars, symbols, slow_dup_lines(t), repeats))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_repeats():
    assert repeated_words("a a a a a a".encode().split()) == 6
    assert repeated_words("a b c d e".encode().split()) == 0


def good_and_bad(n=200):
    good = [(i, prose(i, 80)) for i in range(n)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(i, 80).split())) for i in range(n // 4)]
    marks = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad]
    return good, bad, marks


def test_forest_rejects_odd_rows(spark):
    good, bad, marks = good_and_bad()
    docs = documents(spark, good + bad, clashes=True)
    found = {r["doc_id"]: r["kept"] for r in judge(docs, labels(spark, marks)).collect()}
    assert sum(found[i] for i, _ in good) >= 0.98 * len(good)
    assert sum(found[i] for i, _ in bad) <= 0.1 * len(bad)
    kept = keep_good(docs, labels(spark, marks))
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {i for i, k in found.items() if k}


def test_repeated_lines_are_odd_whatever_the_labelled_bad_rows_are(spark):
    """Half of each text is menu lines between unique ones: no repeated window, capitals or symbols."""
    good, bad, marks = good_and_bad()
    menus = []
    for i in range(20):
        words = prose(500 + i, 80, 5000).replace("\n", " ").split()
        menus.append((2000 + i, "\n".join(f"{' '.join(words[k : k + 4])}\nread more" for k in range(0, 80, 4))))
    docs = documents(spark, good + bad + menus)
    found = {r["doc_id"]: r for r in judge(docs, labels(spark, marks)).collect()}
    assert not any(found[i]["base_failed"] for i, _ in menus)
    assert sum(found[i]["kept"] for i, _ in menus) <= 2
    assert sum(found[i]["kept"] for i, _ in good) >= 0.98 * len(good)


def test_fixed_rules_alone(spark):
    rows = [*AWKWARD, (20, REPEATED)]
    for marks in ([], [(6, 1, 0)], [(None, 0, None), (6, None, 1)]):
        for row in judge(documents(spark, rows), labels(spark, marks)).collect():
            failed = row["n_words"] < 10 or 100 * row["n_repeat_words"] > 20 * row["n_words"]
            assert (row["base_failed"], row["kept"]) == (failed, not failed)


def test_empty(spark):
    assert judge(documents(spark, []), labels(spark)).count() == 0
    assert keep_good(documents(spark, []), labels(spark)).count() == 0


def slow_score(forest, row):
    depths = []
    for t in range(len(forest.path)):
        node = 1
        for _ in range(forest.height):
            node = 2 * node + (row[forest.feature[t, node]] > forest.cut[t, node])
        depths.append(forest.path[t, node])
    return 2 ** (-np.mean(depths) / forest.unit)


def test_forest_scores():
    rows = np.random.default_rng(0).normal(size=(500, 3))
    rows[0] = 9
    forest = Forest(rows, trees=50, subsample=64)
    scores = forest.scores(rows)
    assert scores[0] == max(scores)
    assert scores[:20] == pytest.approx([slow_score(forest, r) for r in rows[:20]])
    assert (Forest(np.zeros((10, 2))).scores(np.zeros((3, 2))) <= 1).all()
