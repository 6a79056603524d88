import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinloom.operators import lattice, parts, pieces, segment, substrings, unigram


def by_hand(words, longest):
    """Substrings of ``(word, n)``: characters, and what occurs twice."""
    counts = Counter()
    for word, n in words:
        for s in range(len(word)):
            for e in range(s + 1, min(len(word), s + longest) + 1):
                counts[word[s:e]] += n
    return {(p, len(p), c) for p, c in counts.items() if len(p) == 1 or c > 1}


def random_words(seed, n=60, longest=40):
    draw = random.Random(seed)
    pool = ["".join(draw.choice("abc日") for _ in range(draw.randint(1, 9))) for _ in range(12)]
    made = {"".join(draw.choice(pool) for _ in range(draw.randint(1, 5)))[:longest] for _ in range(n)}
    return [(w, draw.choice([1, 1, 1, 2, 5])) for w in sorted(made)]


@pytest.mark.parametrize(("first", "longest"), [(1, 40), (2, 7), (3, 128), (8, 128), (8, 5), (4, 1)])
def test_levels_find_every_repeated_substring(spark, monkeypatch, first, longest):
    monkeypatch.setattr(substrings, "FIRST_LEVEL", first)
    words = random_words(first)
    df = spark.createDataFrame(words, "word string, n long")
    found = substrings.repeated_substrings(df, longest)
    assert found.columns == ["piece", "size", "freq"]
    assert Counter(map(tuple, found.collect())) == Counter(by_hand(words, longest))


def test_ranges_count_every_place_once(spark, monkeypatch):
    monkeypatch.setattr(parts, "RANGE", 7)
    words = [*random_words(5, 20, 60), ("ab" * 31, 1), ("𝒳日" * 20, 1), ("x" * 7, 1), ("y" * 8, 3)]
    df = spark.createDataFrame(words, "word string, n long")
    for longest in (1, 5, 7, 20):
        found = substrings.repeated_substrings(df, longest)
        assert Counter(map(tuple, found.collect())) == Counter(by_hand(words, longest))


def test_ranges_overlap_by_what_a_part_needs(spark, monkeypatch):
    monkeypatch.setattr(parts, "RANGE", 4)
    df = spark.createDataFrame([(1, "abcdefghij"), (2, "ab"), (3, "")], "i int, t string")
    rows = {(r.i, r["at"], r.t, r.own) for r in parts.text_ranges(df, "t", 3, "i").collect()}
    assert rows == {(1, 0, "abcdef", 4), (1, 4, "efghij", 4), (1, 8, "ij", 2), (2, 0, "ab", 2), (3, 0, "", 0)}


def test_nothing_to_count(spark):
    assert substrings.repeated_substrings(spark.createDataFrame([], "word string, n long"), 8).collect() == []


def test_an_unbroken_megabyte(spark):
    """No row grows with the word: ranges of it are counted, and islands shrink from level to level."""
    draw = random.Random(1)
    word = "".join(draw.choice("abcdefghij") for _ in range(1_000_000))
    copy = word[500_000:500_300]
    df = spark.createDataFrame([(word, 1), (copy + "!", 1)], "word string, n long")
    found = substrings.repeated_substrings(df, 128).cache()
    long = found.where("size > 16")
    # The copied stretch is all that repeats at length.
    assert long.count() == sum(300 - k + 1 for k in range(17, 129))
    assert long.agg(F.max("freq"), F.min("freq")).first() == (2, 2)
    some = found.where("size <= 3").select("piece", "freq").collect()
    assert len(some) == 10 + 100 + 1000 + 1
    for r in some[::97]:
        n = sum(word.startswith(r.piece, k) for k in range(len(word))) + copy.count(r.piece)
        assert r.freq == n or r.freq == n + (r.piece == "!")


def test_learning_cuts_words_longer_than_a_range(spark, monkeypatch):
    monkeypatch.setattr(parts, "RANGE", 50)
    draw = random.Random(2)
    word = "".join(draw.choice(["kala", "miru", "to"]) for _ in range(200))
    sizes, expected = [], unigram.expected_counts

    def noted(graphs, logp):
        sizes.append(graphs.agg(F.max("size")).first()[0])
        return expected(graphs, logp)

    monkeypatch.setattr(unigram, "expected_counts", noted)
    df = spark.createDataFrame([(word,)], "t string")
    rows = unigram.learn_vocab(df, "t", unigram.UnigramOptions(vocab_size=20, max_piece_length=8)).collect()
    assert len(rows) == 20 and all(r.piece in word and len(r.piece) <= 8 for r in rows if r.type == 1)
    assert set(sizes) == {50}


def test_table_and_joins_give_the_same_lattices(spark, monkeypatch):
    words = random_words(9)
    found = {p for p, _, _ in by_hand(words, 6)}
    known = spark.createDataFrame([(p, i) for i, p in enumerate(sorted(found))], "piece string, pid int")
    df = spark.createDataFrame(words, "word string, n long")
    sent = {(r.word, r.n): tuple(r)[2:] for r in unigram.lattices(df, known, 6, "word", "n").collect()}
    monkeypatch.setattr(unigram, "SENT_BYTES", 0)
    monkeypatch.setattr(parts, "RANGE", 5)
    joined = {(r.word, r.n): tuple(r)[2:] for r in unigram.lattices(df, known, 6, "word", "n").collect()}
    assert len(sent) == len(words) and sent == joined


# --- the compact table ---------------------------------------------------------------------


def table_of(rows):
    return pieces.PieceTable.build(
        pa.chunked_array([[p for p, *_ in rows]], pa.string()),
        pa.chunked_array([[s for _, s, _ in rows]], pa.float64()),
        pa.chunked_array([[i for *_, i in rows]], pa.int32()),
    )


def best_by_hand(word, known, unk_id, unknown):
    """Of equally good paths, that whose last piece is longest."""
    score, back = [0.0] + [-np.inf] * len(word), [None] * (len(word) + 1)
    for e in range(1, len(word) + 1):
        for s in range(e):
            found = known.get(word[s:e], (unknown, unk_id) if e == s + 1 else None)
            if found and score[s] + found[0] > score[e]:
                score[e], back[e] = score[s] + found[0], (s, found[1])
    ids, at = [], len(word)
    while at:
        at, i = back[at]
        ids.append(i)
    return ids[::-1]


@pytest.mark.parametrize("letters", ["ab", "abc", "аб日", "ab\x00é", "aé日𝒳"])
def test_segmentation_against_plain_search(letters):
    draw = random.Random(letters)
    for _ in range(15):
        longest = draw.choice([3, 6, 20])
        spelled = {"".join(draw.choice(letters) for _ in range(draw.randint(1, longest))) for _ in range(50)}
        rows = [(p, -float(draw.randint(1, 40)), 10 + i) for i, p in enumerate(spelled)]
        known = {p: (s, i) for p, s, i in rows}
        words = ["".join(draw.choice(letters + "z") for _ in range(draw.randint(0, 30))) for _ in range(40)]
        ids, n = table_of(rows).segment(pa.array(words), 2, -50.0)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [best_by_hand(w, known, 2, -50.0) for w in words]


def test_every_piece_of_a_word_is_found():
    draw = random.Random(8)
    spelled = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(1, 12))) for _ in range(150)})
    table = table_of([(p, 0.0, i) for i, p in enumerate(spelled)])
    words = ["".join(draw.choice("ab") for _ in range(draw.randint(0, 40))) for _ in range(30)]
    size, start, end, piece, owner = table.found(pa.array(words))
    assert size.tolist() == [len(w) for w in words]
    found = list(zip(owner.tolist(), end.tolist(), start.tolist(), table.id[piece].tolist(), strict=True))
    want = [
        (n, e, s, spelled.index(w[s:e]))
        for n, w in enumerate(words)
        for e in range(1, len(w) + 1)
        for s in range(e)
        if w[s:e] in spelled
    ]
    assert found == want


def test_of_equal_pieces_the_best_counts():
    table = table_of([("ab", -3.0, 1), ("a", -9.0, 4), ("ab", -2.0, 7), ("ab", -2.0, 5), ("b", -9.0, 6)])
    assert len(table) == 3
    assert table.segment(pa.array(["ab"]), 0, -50.0)[0].tolist() == [5]


def test_memory_of_a_table():
    """What is measured before sending is what a worker holds, and long pieces cost little more than their bytes."""
    draw = random.Random(4)
    for size, share in ((128, 3), (8, 8)):
        spelled = {"".join(draw.choice("abcdefghijklmnop") for _ in range(size)) for _ in range((256 << 10) // size)}
        table = table_of([(p, -1.0, i) for i, p in enumerate(spelled)])
        measured = sum(len(p) + pieces.BYTES_PER_PIECE for p in spelled)
        assert measured <= table.nbytes <= measured + 64
        assert table.nbytes <= share * sum(map(len, spelled))


def test_size_decides_between_sending_and_joining(spark):
    vocab = spark.createDataFrame([(0, "<s>", 0.0, 3), (1, "ab", -1.0, 1), (2, "c", -2.0, 1)], "id int, piece string, score double, type int")
    need = 3 + 2 * pieces.BYTES_PER_PIECE
    assert segment.shipped(vocab, need).num_rows == 2 and segment.shipped(vocab, need - 1) is None


def test_spelling_skips_what_it_lacks():
    spelling = pieces.Spelling.build(pa.chunked_array([[7, 3, 5]], pa.int32()), pa.chunked_array([["日", "ab", "c"]], pa.string()))
    lists = pa.array([[3, 7, 4, 5], [], None, [9, None], [5]], pa.list_(pa.int32()))
    assert spelling.texts(lists) == ["ab日c", "", "", "", "c"]


def test_levels_of_a_lattice_stay_sorted(spark):
    df = spark.createDataFrame([("abab", 1)], "word string, n long")
    known = spark.createDataFrame([("a", 0), ("b", 1), ("ab", 2), ("ba", 3)], "piece string, pid int")
    row = lattice.build_lattice(df, known, 4, "n").first()
    assert list(zip(row.e, row.s, row.pid, strict=True)) == [(1, 0, 0), (2, 0, 2), (2, 1, 1), (3, 1, 3), (3, 2, 0), (4, 2, 2), (4, 3, 1)]
