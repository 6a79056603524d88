"""Kernels that work on a bounded portion at a time give what whole columns give."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinloom.functions import ngrams, text
from twinloom.functions.subwords import marked_words, script_runs
from twinloom.operators import lattice, matching, scoring, segment, unigram
from twinloom.operators.pieces import PieceTable

ODD = [
    None, "", " \t\n ", "plain words", 'He said "yes", then ".. no"  (  ok ) .', "12 % of 1 000 000", "a » b « c",
    "line\nbreak\ttab\x0bfeed\x00nul\x85next", "‘quoted’ … “text” — dash", "ﬁ ligature Å é ｆｕｌｌ", "​zero 힣 한", "５ % ٣ %",
    "''a`b´c", "nº 5, 3 ºC , x", "\U0001f600 emoji \U000e0001tag", '"..<b>" ,"', ") ;( :", " a　b ", "x\r\ny",
]


def odd_texts(n: int = 300) -> list[str | None]:
    draw = random.Random(5)
    signs = "ab ÄßЖж日9٣ %()\"'`.,:;!?…—«»„“”‘’ \t\n\r\x0b\x1c​́ﬁ½\U0001f600"
    return ODD + ["".join(draw.choices(signs, k=draw.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("lang", ["en", "de", "cs", "ru"])
@pytest.mark.parametrize("replace_by", [" ", "", "$\\1"])
def test_one_pass_does_what_the_three_steps_do(spark, lang, replace_by):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts())], "i int, t string")
    steps = text.nfkc(text.replace_nonprint(text.normalize_punct(F.col("t"), lang), replace_by))
    rows = df.select("t", steps.alias("want"), text.preprocess(F.col("t"), lang, replace_by).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_every_regex_rule_names_what_its_matches_hold():
    for lang in ("en", "de", "cs", "ru"):
        assert all(bool(r.needs) == r.regex for r in text.punct_rules(lang))


@pytest.mark.parametrize("prefix", [False, True])
def test_words_are_counted_as_columns_give_them(spark, monkeypatch, prefix):
    monkeypatch.setattr(unigram, "HELD_WORDS", 3)
    monkeypatch.setattr(unigram, "COUNTED_TOGETHER", 2)
    df = spark.createDataFrame([(t,) for t in odd_texts() * 2], "t string")
    marked = df.select(F.explode(marked_words(F.col("t"), prefix)).alias("w"))
    runs = marked.select(F.explode(script_runs(F.col("w"))).alias("w"))
    want = Counter(r.w for r in runs.collect())
    options = unigram.UnigramOptions(dummy_prefix=prefix)
    found = unigram.word_counts(df, "t", options).collect()
    assert len(found) == len(want) and {r.word: r.n for r in found} == dict(want)


def table_of(pieces: dict[str, float]) -> PieceTable:
    ids = pa.chunked_array([pa.array(range(10, 10 + len(pieces)), pa.int32())])
    return PieceTable.build(pa.chunked_array([list(pieces)]), pa.chunked_array([list(pieces.values())]), ids)


def test_words_are_segmented_once_and_in_small_portions(monkeypatch):
    seen, whole = [], PieceTable.segment

    def watched(self, words, unk_id, unknown_score):
        seen.append(words.to_pylist())
        return whole(self, words, unk_id, unknown_score)

    monkeypatch.setattr(PieceTable, "segment", watched)
    monkeypatch.setattr(segment, "SEGMENTED", 40)
    made = segment._Encoder(table_of({"▁a": -1.0, "b": -2.0, "ab": -1.5, "▁": -3.0}), 2, -20.0, True)
    words = [f"{'ab' * (i % 4)}{i}" for i in range(200)]
    first = made(pa.array([" ".join(words), None, "", " ".join(words[:9])], pa.string()))
    again = made(pa.array([" ".join(words)] * 2, pa.string()))
    assert max(sum(len(w.encode()) for w in part) for part in seen) <= 40
    assert Counter(w for part in seen for w in part) == Counter({f"▁{w}": 1 for w in words})
    assert again[0] == again[1] == first[0] and first[1].as_py() == first[2].as_py() == []
    # Begun anew, the ids are the same.
    monkeypatch.setattr(segment, "REMEMBERED", 10)
    assert made(pa.array([" ".join(words[:9])], pa.string()))[0] == first[3] and len(made.places) == 9


def shared(a: list, b: list, n: int) -> int:
    one, two = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (a, b))
    return (one & two).total()


@pytest.mark.parametrize("keys", [1 << 62, 1])
def test_matches_by_brute_force(monkeypatch, keys):
    """``keys`` of 1 numbers the n-grams anew in front of every order."""
    monkeypatch.setattr(matching, "KEYS", keys)
    draw = random.Random(1)
    pairs = [tuple("".join(draw.choices("ab日 \n.\U0001f600", k=draw.randrange(30))) for _ in range(2)) for _ in range(60)]
    left, right = [h for h, _ in pairs], [r for _, r in pairs]
    for items_of, listed, longest in (
        (matching.chars_of, lambda t: [*"".join(t.split())], 6),
        (matching.words_of, str.split, 4),
        (lambda ts: matching.words_of(ts, matching.cut_words), matching.cut_words, 2),
    ):
        items, sizes = items_of(left + right)
        found = matching.matched(items, sizes, longest)
        want = [[shared(listed(h), listed(r), n) for n in range(1, longest + 1)] for h, r in pairs]
        assert found.tolist() == want
    nothing = matching.matched(*matching.chars_of([]), 6)
    assert nothing.shape == (0, 6)


def test_words_are_cut_as_columns_cut_them(spark):
    texts = [t for t in odd_texts() if t is not None] + [". .. a. .a .a. -", "«x» x!"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", ngrams.chrf_words(F.col("t")).alias("w"), ngrams.drop_blanks(F.col("t")).alias("c")).collect()
    for r in rows:
        assert matching.cut_words(r.t) == r.w and "".join(r.t.split()) == r.c


def test_scores_hold_no_rows_of_ngrams(spark):
    """One row a pair: what a task holds does not grow with the n-grams of its pairs."""
    pairs = spark.createDataFrame([("a b c", "a b d", 1)], "hyp string, ref string, g int")
    plan = scoring.metrics_row(pairs, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "gram" not in plan


def test_levels_of_small_and_large_positions():
    draw = np.random.default_rng(3)
    for top in (5, 40_000):
        position = draw.integers(0, top, 500)
        levels = lattice._levels(position)
        assert [position[x[0]] for x in levels] == sorted(set(position.tolist()))
        assert all((np.diff(x) > 0).all() and len(set(position[x].tolist())) == 1 for x in levels)


def test_sums_of_pieces_come_in_blocks_from_few_tasks(spark, monkeypatch):
    """Each task hands on every piece it met, so there are no more tasks than run at a time."""
    words = spark.createDataFrame([(f"{'ab' * (i % 5)}c", i, 1 + i % 3) for i in range(60)], "word string, wid int, n int")
    pieces = spark.createDataFrame([(p, i) for i, p in enumerate(["a", "b", "c", "ab", "ba", "abab", "bc"])], "piece string, pid int")
    graphs = unigram.lattices(words.repartition(23), pieces, 8, "wid", "n").repartition(31)
    logp = np.log(np.array([0.2, 0.2, 0.2, 0.1, 0.1, 0.1, 0.1]))
    want = unigram.expected_counts(graphs, logp)
    made = []
    whole = type(graphs).mapInArrow
    monkeypatch.setattr(type(graphs), "mapInArrow", lambda self, *a: made.append(self.rdd.getNumPartitions()) or whole(self, *a))
    monkeypatch.setattr(unigram, "SUM_BLOCK", 3)
    found = unigram.expected_counts(graphs, logp)
    assert np.allclose(found, want) and max(made) <= spark.sparkContext.defaultParallelism
    # A word has as many uses of its last letter as it occurs, alone or in a longer piece.
    assert np.isclose(found[2] + found[6], sum(1 + i % 3 for i in range(60)))
