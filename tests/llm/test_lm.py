import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from helpers import AWKWARD, documents, prose
from twinloom.llm import lm
from twinloom.llm.queries import op6_lm_scoring

FOLDER = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    for c in "\t\n\r\x0b\x0c":
        text = (text or "").replace(c, " ")
    return [w for w in lower(text).split(" ") if w] + [None]


def base(rows, held):
    counts = Counter(t for i, x, *_ in rows if not held(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, x, *_ in rows:
        own = tokens(x)
        score = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)
        out.append((i, held(i), len(own), sum(counts[t] > 0 for t in own), n, round(score, 5)))
    return sorted(out, key=repr)


def test_base_counts(spark):
    def held(i):
        return i in (4, 7)

    docs = documents(spark, AWKWARD, clashes=True).withColumn("held_out", F.col("doc_id").isin(4, 7))
    found = lm.score_texts(docs.repartition(3)).collect()
    got = sorted(((*tuple(r)[:5], round(r["base_score"], 5)) for r in found), key=repr)
    assert got == base(AWKWARD, held)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_chunks_change_nothing(spark, monkeypatch):
    docs = documents(spark, [(i, prose(i)) for i in range(30)]).withColumn("held_out", F.col("doc_id") % 7 == 2)
    want = sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in lm.score_texts(docs).collect())
    monkeypatch.setattr(lm, "CHUNK_WORDS", 50)
    monkeypatch.setattr(lm, "WORDS_AT_ONCE", 16)
    found = sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in lm.score_texts(docs).collect())
    assert found == want


def model_of(counts):
    words = list(counts)
    n = np.array([counts[w] for w in words], float)
    bits = lm.Bits(words)
    zeros, ones = np.zeros(lm.STARTS[-1], np.float32), np.zeros(lm.STARTS[-1], np.float32)
    for slots in bits.slots:
        np.add.at(ones, slots, bits.bit * n[bits.word])
        np.add.at(zeros, slots, (1 - bits.bit) * n[bits.word])
    mixer = lm.Mixer()
    odds, gate = lm._inputs(bits, zeros, ones, True)
    for _ in range(5):
        mixer.learn(odds, gate, bits.bit, n[bits.word])
    return lm.Model(zeros, ones, mixer)


def test_probabilities_add_up():
    """Over all first bytes and what follows them, the chances of a token sum to at most one."""
    model = model_of({b"the": 50, b"then": 9, b"of": 20, b"": 10, b"a": 5})
    singles = [bytes([b]) for b in range(256) if b not in (0x20, *range(9, 14))]
    total = (10 ** model.log10_of([*singles, b""])).sum()
    known = (10 ** model.log10_of([b"the", b"then", b"of", b"", b"a"])).sum()
    assert total <= 1 + 1e-9 and 0.4 < known <= 1 + 1e-9


def test_bits_by_brute_force():
    """Slots depend on the bytes before in the word and the bits before in the byte, on nothing else."""
    words = [b"abcabc", b"abc", b"", "é".encode(), b"xabc"]
    bits = lm.Bits(words)
    at = 0
    seen = {}
    for w in words:
        spelled = w + b" " if w else b"\n"
        for i, byte in enumerate(spelled):
            for b in range(8):
                assert bits.bit[at] == byte >> (7 - b) & 1
                node = (1 << b) | byte >> (8 - b)
                for k in range(5):
                    context = (k, spelled[max(i - k - 1, 0) : i] if k < 4 else spelled[:i], min(i, k + 1) if k < 4 else i, node)
                    assert seen.setdefault(context, bits.slots[k][at]) == bits.slots[k][at]
                at += 1
    assert at == len(bits.bit)


def test_new_text_costs_few_bits(spark):
    """Letters drawn evenly from 26 and a blank would cost 4.75 bits each."""
    found = op6_lm_scoring(spark, FOLDER).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.avg("bits_per_byte")).first()
    assert found[2] < 3


def test_whole_table(spark):
    import zlib

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = sorted(((*tuple(r)[:5], round(r["base_score"], 5)) for r in op6_lm_scoring(spark, FOLDER).collect()), key=repr)
    want = base(rows, lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    assert [f[:5] for f in found] == [w[:5] for w in want]
    assert np.allclose([f[5] for f in found], [w[5] for w in want], atol=1e-3)


def test_nothing_to_learn_from_and_empty(spark):
    docs = documents(spark, [(1, "a b"), (2, None)]).withColumn("held_out", F.lit(True))
    assert {r["train_tokens"] for r in lm.score_texts(docs).collect()} == {0}
    assert lm.score_texts(documents(spark, []).withColumn("held_out", F.lit(False))).count() == 0


def test_order_of_words_does_not_matter():
    draw = random.Random(2)
    words = [w.encode() for w in set(prose(1, 200).split())]
    model = model_of(Counter(words))
    one = dict(zip(words, model.log10_of(words), strict=True))
    draw.shuffle(words)
    assert np.allclose([one[w] for w in words], model.log10_of(words))


def streams(texts):
    """For each byte of a text: its word, its place there, what stands before it, and itself."""
    for number, text in enumerate(texts):
        before = b" "
        for word in [t and t.encode() for t in tokens(text)]:
            spelled = word + b" " if word else b"\n"
            for place, byte in enumerate(spelled):
                yield number, spelled[:place], before, byte
                before += bytes([byte])


STREAMS = ["ab c d e fghijklm a", "", "a", "c d e fghijklm", "fghijklm ab", "é \x01 b"]


def test_heads_by_brute_force():
    """The first bytes of a word see the last bytes of the text, across blanks and short words."""
    places = {}
    run = np.array([places.setdefault(t and t.encode() or b"", len(places)) for x in STREAMS for t in tokens(x)])
    want = [[] for _ in range(lm.HEAD)]
    for _, inside, before, byte in streams(STREAMS):
        if len(inside) < lm.HEAD:
            last = int.from_bytes(before[-lm.BACK :], "big")
            want[len(inside)].append(len(inside) << 56 | last << 8 | byte)
    assert [h.tolist() for h in lm.heads_of(lm.Spelled(list(places)), run)] == want


def test_score_by_brute_force(spark, monkeypatch):
    """A score is the sum over all bytes of the text as a stream, whatever is scored once only."""
    kept = []
    learn = lm.learn
    monkeypatch.setattr(lm, "learn", lambda v: kept.append(learn(v)) or kept[-1])
    texts = [*STREAMS, *(prose(i) for i in range(20))]
    docs = documents(spark, list(enumerate(texts))).withColumn("held_out", F.col("doc_id") % 5 == 1)
    found = {r["doc_id"]: r["score"] for r in lm.score_texts(docs).collect()}
    slots, mixer = kept[0]
    rows = list(streams(texts))
    bits = lm.Bits.__new__(lm.Bits)
    prefix = [sum((b + 1) * pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i, b in enumerate(r[1])) % (1 << 64) for r in rows]
    bits._set(
        np.array([int.from_bytes(r[2][-lm.BACK :], "big") for r in rows], np.uint64),
        np.array([r[3] for r in rows], np.uint8),
        np.array([len(r[1]) for r in rows]),
        np.array(prefix, np.uint64),
        np.array([r[0] for r in rows]),
    )
    want = lm.Model(*slots.value, mixer)._gains(bits, len(texts))
    assert np.allclose([found[i] for i in range(len(texts))], want, rtol=1e-5)


def test_order_of_words_in_a_text_matters(spark):
    """Words that follow each other in the texts learned from cost less than the same ones in another order."""
    rows = [(i, "zebra quilt " * 20) for i in range(5)] + [(i, "quartz zone " * 20) for i in range(5, 10)]
    rows += [(20, "zebra quilt quartz zone"), (21, "quilt quartz zebra zone")]
    docs = documents(spark, rows).withColumn("held_out", F.col("doc_id") >= 20)
    found = {r["doc_id"]: r["score"] for r in lm.score_texts(docs).where("held_out").collect()}
    assert found[20] > found[21] + 0.1
