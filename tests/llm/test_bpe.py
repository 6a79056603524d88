import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helpers import AWKWARD, documents, prose
from twinloom.llm import bpe
from twinloom.llm.queries import op2_bpe, tokenizer_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return (
        len(ids),
        hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
        hashlib.sha256(decoded.encode()).hexdigest(),
    )


def strange_texts():
    draw = random.Random(3)
    ranges = [(32, 127), (0xA0, 0x250), (0x300, 0x360), (0x370, 0x500), (0x4E00, 0x4F00), (0x1F300, 0x1F600), (9, 33)]
    for _ in range(60):
        yield "".join(chr(draw.randrange(*draw.choice(ranges))) for _ in range(100))
    for _ in range(40):
        yield "".join(draw.choice("abn' <|endoftext>") for _ in range(100))


def test_digests_match_the_library(spark, library):
    rows = [*AWKWARD, *((100 + i, t) for i, t in enumerate(strange_texts()))]
    found = bpe.digests(documents(spark, rows, clashes=True), tokenizer_path()).collect()
    want = sorted((repr(i), *expected(library, t)) for i, t, *_ in rows)
    assert sorted((repr(r[0]), *r[1:]) for r in found) == want


def test_whole_table(spark, library):
    found = {r["doc_id"]: tuple(r)[1:] for r in op2_bpe(spark, FOLDER).collect()}
    for row in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        assert found[row["doc_id"]] == expected(library, row["text"])


def test_encode_keeps_columns_and_decodes(spark, library):
    docs = documents(spark, [(1, prose(1)), (2, None)], clashes=True)
    encoded = bpe.encode(docs, tokenizer_path())
    assert encoded.columns[: len(docs.columns)] == docs.columns
    ids = encoded.columns[-1]
    for row in bpe.decode(encoded, tokenizer_path(), ids).collect():
        want = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row[ids] == want
        assert row["decoded"] == library.decode(want, skip_special_tokens=False)


def test_empty_table(spark):
    assert bpe.digests(documents(spark, []), tokenizer_path()).count() == 0


def test_forgetting_changes_nothing(monkeypatch):
    import json

    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    spec = json.load(open(tokenizer_path()))
    small, large = bpe.WordBpe(spec), bpe.WordBpe(spec)
    texts = [prose(i) for i in range(10)]
    monkeypatch.setattr(bpe, "REMEMBERED", 10_000)
    want = [i.tolist() for i in large.encode_batch(texts)]
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    assert [small.encode_batch([t])[0].tolist() for t in texts] == want


def test_a_file_that_lacks_letters():
    """A word that the tokens of a file cannot spell is an error, and does not hang."""
    import json

    spec = json.load(open(tokenizer_path()))
    for gone in ("b</w>", "a", "q"):
        small = json.loads(json.dumps(spec))
        vocab = small["model"]["vocab"]
        small["model"]["vocab"] = {t: i for t, i in vocab.items() if t != gone and not (len(t) > 1 and gone[0] in t)}
        known = small["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in small["model"]["merges"]]
        small["model"]["merges"] = [m for m in pairs if m[0] in known and m[1] in known and m[0] + m[1] in known]
        model = bpe.WordBpe(small)
        with pytest.raises(ValueError, match="no encoding"):
            model.encode_words(["x" + gone[0] if gone.endswith("</w>") else gone + "x"])


def test_what_is_remembered_is_counted_in_bytes(monkeypatch):
    import json

    model = bpe.WordBpe(json.load(open(tokenizer_path())))
    monkeypatch.setattr(bpe, "REMEMBERED", 200_000)
    for k in range(30):
        model.encode_batch([prose(k, 300, 5_000), "x" * 5_000 + str(k)])
        entries = [*model.known.items(), *model.known_words.items()]
        assert model.held >= sum(len(a) + len(b) for a, b in entries)
        assert sum(len(a) + len(b) + bpe.ENTRY for a, b in entries) < 500_000
