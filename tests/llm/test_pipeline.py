from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from helpers import AWKWARD, documents, labels, prose
from twinloom.llm import exact_dedup, mixing, quality, simhash

CLEAN = {n: prose(n, 120) for n in range(100, 130)}
LONG = prose(500, 4000)
ROWS = [
    *CLEAN.items(),
    # Equal but for blanks: the smaller id stays.
    (90, CLEAN[100].replace(" ", "  ")),
    (200, CLEAN[101].replace(" ", "\t")),
    # One word of thousands differs.
    (300, LONG),
    (301, LONG.replace(LONG.split()[2000], "otherwise", 1)),
    # A repeated row, the same id with another text, and rows without an id.
    (110, CLEAN[110]),
    (111, prose(111_000, 120)),
    (None, CLEAN[112]),
    (None, prose(999, 120)),
    (None, prose(999, 120)),
    # Rejected by the fixed rules.
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one two three"),
    (5, "the same six words again and " * 30),
]
GONE = {1, 2, 3, 4, 5}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    documents(spark, ROWS).write.parquet(f"{path}/documents.parquet")
    # Without bad rows only the fixed rules reject, which can be counted by hand.
    labels(spark, [(n, 1, int(n % 5 == 0)) for n in range(100, 130)]).write.parquet(f"{path}/labels.parquet")
    return str(path)


def kept(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def staged(spark, folder, name, docs):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, folder)


def test_stages_by_hand(spark, folder):
    docs = documents(spark, ROWS)
    good = staged(spark, folder, "quality rules", docs)
    want = Counter((i, t) for i, t in ROWS if i not in GONE)
    assert kept(good) == want and good.columns == docs.columns

    distinct = staged(spark, folder, "exact dedup", good)
    copies = {(100, CLEAN[100]), (200, ROWS[31][1]), (None, CLEAN[112])}
    want = Counter({row: 1 for row in want if row not in copies})
    assert kept(distinct) == want and distinct.columns == docs.columns

    apart = staged(spark, folder, "SimHash near-dedup", distinct)
    del want[301, ROWS[33][1]]
    assert kept(apart) == want and apart.columns == docs.columns

    mixed = staged(spark, folder, "mixing to target weights", apart)
    table = mixing.mixing_rates(apart, spark.read.parquet(f"{folder}/labels.parquet"))
    rates = {r["doc_id"]: r["rate"] for r in table.collect() if r["doc_id"] not in (None, 111)}
    times = kept(mixed)
    assert mixed.columns == docs.columns and set(times) <= set(want)
    for (doc_id, text), _ in want.items():
        if doc_id in rates:
            assert int(rates[doc_id]) <= times[doc_id, text] <= int(rates[doc_id]) + 1


def test_run_is_the_stages_in_order(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    docs = documents(spark, ROWS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    want = Counter((r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)) for r in docs.collect())
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "source", "lang", "n_tokens", "ids"]
    rows = found.collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)


def test_stages_stand_awkward_rows(spark, folder):
    docs = documents(spark, AWKWARD, clashes=True)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.collect() is not None
    assert kept(staged(spark, folder, "exact dedup", docs)) == Counter(
        {(1, None): 1, (3, " \t\n"): 1, (4, "one"): 1, (5, AWKWARD[4][1]): 1, (6, AWKWARD[5][1]): 1, (7, prose(7)): 1,
         (None, prose(9)): 1, AWKWARD[11]: 1}
    )
    tokens = corpus_pipeline.tokens(spark, docs, folder).collect()
    assert len(tokens) == len(AWKWARD)
    assert {r["doc_id"]: r["n_tokens"] for r in tokens if r["doc_id"] in (1, 2, 3)} == {1: 0, 2: 0, 3: 0}


def test_stages_of_an_empty_table(spark, folder):
    docs = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []


def test_kept_rows_are_those_of_the_operators(spark, folder):
    """Each stage keeps what its operator marks."""
    docs = documents(spark, [(n, t) for n, t in enumerate(t for _, t in ROWS)])
    judged = quality.judge(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("kept").collect()
    assert {r["doc_id"] for r in staged(spark, folder, "quality rules", docs).collect()} == {r["doc_id"] for r in judged}
    groups = exact_dedup.exact_groups(docs).where("kept").collect()
    assert {r["doc_id"] for r in staged(spark, folder, "exact dedup", docs).collect()} == {r["doc_id"] for r in groups}
    near = simhash.near_groups(docs).where("doc_id = component_id").collect()
    assert {r["doc_id"] for r in staged(spark, folder, "SimHash near-dedup", docs).collect()} == {r["doc_id"] for r in near}
