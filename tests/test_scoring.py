import math
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinloom.functions.ngrams import chrf_words, tokenize_13a
from twinloom.operators import scoring

PAIRS = [
    ("the cat sat on the mat .", "the cat sat on the mat ."),
    ("the the the the", "the cat is on the mat"),
    ('He said, "hi-there" (3.5%)!', 'He said: "hi there" (3,5 %)!'),
    ("Ягьуд галаз багъдиз атана.", "Ягьуд галаз багъдиз хтана."),
    ("short", "a much longer reference sentence &amp; more"),
    ("", "empty hypothesis"),
    ("empty reference", ""),
    ("line-\nbreak 1-2 a.b 3.", "linebreak 1 - 2 a. b 3 ."),
]


def tok13a(line):
    line = line.rstrip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        line = line.replace(a, b)
    line = f" {line} "
    symbols = set(string.punctuation) - set("',-.")
    line = "".join(f" {c} " if c in symbols or c == " " else c for c in line)
    line = re.sub(r"([^0-9])([.,])", r"\1 \2 ", line)
    line = re.sub(r"([.,])([^0-9])", r" \1 \2", line)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", line).split()


def grams(items, n):
    return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def bleu(pairs):
    correct, total, sys_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for hyp, ref in pairs:
        h, r = tok13a(hyp), tok13a(ref)
        sys_len, ref_len = sys_len + len(h), ref_len + len(r)
        for n in range(4):
            hc, rc = grams(h, n + 1), grams(r, n + 1)
            total[n] += sum(hc.values())
            correct[n] += sum((hc & rc).values())
    if not any(correct) or 0 in total:
        return 0.0
    halves, logs = 1.0, 0.0
    for c, t in zip(correct, total):
        if c == 0:
            halves *= 2
            logs += math.log(100 / (halves * t))
        else:
            logs += math.log(100 * c / t)
    return min(1.0, math.exp(1 - ref_len / sys_len)) * math.exp(logs / 4)


def split_words(line):
    out = []
    for w in line.split():
        if len(w) > 1 and w[-1] in string.punctuation:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in string.punctuation:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def chrf(pairs):
    stats = [[0, 0, 0] for _ in range(8)]
    for hyp, ref in pairs:
        sources = [("".join(hyp.split()), "".join(ref.split()), n) for n in range(1, 7)]
        sources += [(split_words(hyp), split_words(ref), n) for n in (1, 2)]
        for s, (h, r, n) in zip(stats, sources):
            hc, rc = grams(h, n), grams(r, n)
            s[0] += sum(hc.values()) if rc else 0
            s[1] += sum(rc.values())
            s[2] += sum((hc & rc).values())
    used = [s for s in stats if s[0] and s[1]]
    if not used:
        return 0.0
    p = sum(s[2] / s[0] for s in used) / len(used)
    r = sum(s[2] / s[1] for s in used) / len(used)
    return 100 * 5 * p * r / (4 * p + r) if p + r else 0.0


def frame(spark, pairs):
    return spark.createDataFrame([(i % 2, *p) for i, p in enumerate(pairs)], "g int, hyp string, ref string")


def test_tokenisers(spark):
    df = frame(spark, PAIRS)
    for r in df.select("hyp", tokenize_13a(F.col("hyp")).alias("t"), chrf_words(F.col("hyp")).alias("w")).collect():
        assert r.t == tok13a(r.hyp)
        assert r.w == split_words(r.hyp)


@pytest.mark.parametrize("pairs", [PAIRS, PAIRS[:1], PAIRS[1:2], PAIRS[5:6], PAIRS[6:7], PAIRS * 3 + PAIRS[:1] * 20])
def test_scores_match_brute_force(spark, pairs):
    row = scoring.metrics_row(frame(spark, pairs)).first()
    assert row.bleu == pytest.approx(bleu(pairs), abs=1e-9)
    assert row.chrf == pytest.approx(chrf(pairs), abs=1e-9)
    assert row.n == len(pairs)


def bleu_parts(pairs):
    """Precisions, brevity penalty and lengths, order by order."""
    matched, total = [0] * 4, [0] * 4
    hyps, refs = [tok13a(h) for h, _ in pairs], [tok13a(r) for _, r in pairs]
    for h, r in zip(hyps, refs, strict=True):
        for n in range(1, 5):
            grams = [Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (h, r)]
            matched[n - 1] += sum((grams[0] & grams[1]).values())
            total[n - 1] += sum(grams[0].values())
    hyp_len, ref_len = sum(map(len, hyps)), sum(map(len, refs))
    precisions, missed = [0.0] * 4, 0
    for n in range(4):
        if not any(matched) or not total[n]:
            break
        missed += matched[n] == 0
        precisions[n] = 100 * matched[n] / total[n] if matched[n] else 100 / (2**missed * total[n])
    penalty = 1.0 if hyp_len >= ref_len else math.exp(1 - ref_len / hyp_len) if hyp_len else 0.0
    return precisions, penalty, hyp_len, ref_len


@pytest.mark.parametrize("pairs", [PAIRS, PAIRS[:1], PAIRS[1:2], PAIRS * 2, [("", "a b")], [("a", "")], [("a b c", "a b c")], [("x y", "a b")]])
def test_score_parts(spark, pairs):
    row = scoring.metrics_row(frame(spark, pairs)).first()
    precisions, penalty, hyp_len, ref_len = bleu_parts(pairs)
    assert [row[f"precision_{n}"] for n in range(1, 5)] == pytest.approx(precisions)
    assert row.brevity_penalty == pytest.approx(penalty)
    assert (row.hyp_len, row.ref_len) == (hyp_len, ref_len)


def test_pairs_are_folded_and_dealt_out_once(spark):
    scores = scoring.metrics_row(frame(spark, PAIRS), "g")
    scores.collect()
    plan = scores._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    made = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "Reused" not in x]
    assert sum("_pair#" in x for x in made) == 1 and sum("hyp#" in x for x in made) == 1


def test_groups(spark):
    for r in scoring.metrics_row(frame(spark, PAIRS), "g").collect():
        assert r.bleu == pytest.approx(bleu(PAIRS[r.g :: 2]), abs=1e-9)
        assert r.chrf == pytest.approx(chrf(PAIRS[r.g :: 2]), abs=1e-9)


def test_identity_scores_full(spark):
    texts = [(t, t) for t in ("one two three four", "Ягьуд галаз багъдиз атана чна", "a b c d e.")]
    row = scoring.metrics_row(frame(spark, texts)).first()
    assert row.bleu == pytest.approx(100) and row.chrf == pytest.approx(100)


def test_no_pairs_and_nulls(spark):
    empty = spark.createDataFrame([], "g int, hyp string, ref string")
    row = scoring.metrics_row(empty).first()
    assert (row.bleu, row.chrf, row.n) == (0.0, 0.0, 0)
    some = spark.createDataFrame([(0, None, "x"), (0, "a b c d", "a b c d")], empty.schema)
    assert scoring.metrics_row(some).first().n == 1


def test_ngrams_are_not_shuffled(spark):
    pairs = frame(spark, PAIRS)
    plan = scoring.corpus_chrf(pairs)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "gram" in line]


def test_group_of_missing_keys_is_scored(spark):
    rows = [(None, "один два три четыре", "один два три четыре"), ("x", "a b c d", "a b c e")]
    df = spark.createDataFrame(rows, "g string, hyp string, ref string")
    found = {r.g: r.n for r in scoring.metrics_row(df, "g").collect()}
    assert found == {None: 1, "x": 1}
