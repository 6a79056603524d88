import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import AWKWARD, documents, prose
from twinloom.llm import exact_dedup
from twinloom.llm.exact_dedup import drop_copies, exact_groups


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    out = []
    for text, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, order[0], len(ids), n == 0, sha) for n, i in enumerate(order)]
    return sorted(out, key=repr)


COPIES = [(100 + i, "hot  copy\n here") for i in range(300)] + [(90, "hot copy here"), (91, " hot copy here")]


@pytest.mark.parametrize("digest", [F.xxhash64, lambda c: F.lit(1), lambda c: F.length(c)])
def test_groups(spark, digest):
    rows = AWKWARD + COPIES + [(500, "  "), (501, " "), (502, "\n")]
    found = exact_groups(documents(spark, rows, clashes=True).repartition(5), digest)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("digest", [F.xxhash64, lambda c: F.lit(1)])
@pytest.mark.parametrize("held", [1, 64 << 20])
def test_dropping(spark, monkeypatch, digest, held):
    monkeypatch.setattr(exact_dedup, "LOCAL_BYTES", held)
    rows = COPIES[::-1] + AWKWARD + [(i, prose(i)) for i in range(600, 640)]
    docs = documents(spark, rows, clashes=True).repartition(3)
    found = drop_copies(docs, digest)
    assert found.columns == docs.columns and found.schema == docs.schema
    want = sorted(((i, s) for i, _, _, kept, s in brute(rows) if kept), key=repr)
    got = [(r["doc_id"], hashlib.sha256(norm(r["text"]).encode()).hexdigest()) for r in found.collect()]
    assert sorted(got, key=repr) == want


def test_empty(spark):
    assert exact_groups(documents(spark, [])).count() == 0
    assert drop_copies(documents(spark, [])).count() == 0


def test_no_text_crosses_to_documents(spark):
    """The way back to the documents joins on digests, not on texts."""
    plan = exact_groups(documents(spark, AWKWARD))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
