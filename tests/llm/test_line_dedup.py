import random
import time
from pathlib import Path
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from helpers import AWKWARD, documents, prose
from twinloom.llm import crowds, line_dedup
from twinloom.llm.crowds import crowd_links, sketches
from twinloom.llm.line_dedup import BANDS, SHINGLE, band_keys, drop_lines, dropped_lines, similar_pairs
from twinloom.llm.queries import op3_line_dedup
from twinloom.storage import REMOVAL, checkpoint_dir, cut_lineage, shuffles_removed

FOLDER = "/root/testdata/sf0.001"


def shingles(line):
    """The line's shingles as texts; a shorter line is one."""
    return {line[i : i + SHINGLE] for i in range(max(len(line) - SHINGLE + 1, 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def lines_of(rows):
    """``((null id last, id, row number), place, line)`` of all lines with a word."""
    for n, (i, text, *_) in enumerate(rows):
        for place, line in enumerate((text or "").split("\n")):
            if line := line.strip(" \t\n\r\x0b\x0c"):
                yield (i is None, i or 0, n), place, line


def brute(rows, found_links=None):
    """Dropped places of each row by comparing all pairs of distinct lines."""
    placed = list(lines_of(rows))
    distinct = sorted({line for *_, line in placed})
    sets = {line: shingles(line) for line in distinct}
    root = {line: line for line in distinct}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(distinct, 2):
        small, large = sorted((len(sets[a]), len(sets[b])))
        if small >= 0.8 * large and jaccard(sets[a], sets[b]) >= 0.8:
            root[top(b)] = top(a)
    groups = defaultdict(list)
    for key, place, line in placed:
        groups[top(line)].append((key, place))
    gone = defaultdict(list)
    for members in groups.values():
        for key, place in sorted(members)[1:]:
            gone[key[2]].append(place)
    return sorted(((i, (t or "").count("\n") + 1 if t else 0, sorted(gone[n])) for n, (i, t, *_) in enumerate(rows)), key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_lines"], r["dropped"]) for r in df.collect()), key=repr)


def noisy(line, draw):
    words = line.split(" ")
    words[draw.randrange(len(words))] = "zz"
    return " ".join(words)


def corpus():
    draw = random.Random(1)
    base = [" ".join(prose(i, 30).split()) for i in range(6)]
    rows = []
    for i in range(40):
        own = [" ".join(prose(100 + i, 25).split()), "", draw.choice(base), noisy(draw.choice(base), draw)]
        draw.shuffle(own)
        rows.append((i, "\n".join(own)))
    return rows


def chains(n, length):
    """Chains of lines, each like the next one only, that all share a rare passage."""
    passage = " ".join(prose(77, 12, 90_000).split())
    rows = []
    for c in range(n):
        words = prose(2_000 + c, 40, 60_000).split()
        for _ in range(length):
            rows.append(f"{passage} {' '.join(words[:14])}")
            words = words[1:]
    random.Random(n).shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("held", [1, 2_000, 1_000_000])
@pytest.mark.parametrize("pairwise", [2, 32])
def test_links_survive_in_crowds(spark, monkeypatch, pairwise, held):
    """What bucket and crowd sizes lead to other ways changes no result: chains are found whole."""
    monkeypatch.setattr(line_dedup, "HELD", held)
    rows = chains(9, 4) if held == 1 else chains(12, 5)
    monkeypatch.setattr(line_dedup, "band_keys", lambda lines: np.zeros((len(lines), BANDS), np.int64))
    lines = documents(spark, rows).coalesce(1)
    assert result(dropped_lines(lines, pairwise=pairwise)) == brute(rows)


def test_pairs_are_compared_exactly():
    draw = random.Random(4)
    base = [" ".join(prose(i, draw.randint(1, 25)).split()) for i in range(30)] + ["", "a", "abc", "日本語のテキスト", "x" * 500]
    lines = base + [noisy(line, draw) for line in base]
    lines += [line + "!" for line in base]
    pairs = [(draw.choice(lines), draw.choice(lines)) for _ in range(400)] + list(zip(base + base, lines[len(base) :], strict=True))
    found = similar_pairs([a for a, _ in pairs], [b for _, b in pairs], 0.8)
    assert found.tolist() == [jaccard(shingles(a), shingles(b)) >= 0.8 for a, b in pairs]
    assert 15 < found.sum() < 200 and not len(similar_pairs([], [], 0.8))


def connected(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def random_sets(draw):
    templates = [[draw.randrange(1000) for _ in range(draw.randint(3, 40))] for _ in range(draw.randint(1, 4))]
    shared = [draw.randrange(1000) for _ in range(draw.randint(0, 40))]
    sets = []
    for _ in range(draw.randint(2, 60)):
        like = draw.choice(templates + sets[-3:])
        made = [x for x in like if draw.random() > 0.06] + [draw.randrange(1000) for _ in range(draw.randint(0, 3))]
        sets.append(sorted(set(made + draw.choice([[], shared])) or {1}))
    return sets


@pytest.mark.parametrize("similar", [0.5, 0.8, 0.95])
def test_crowds_connect_all_similar_sets(similar):
    draw = random.Random(similar)
    for _ in range(60):
        sets = random_sets(draw)
        n = len(sets)
        pairs = [(a, b) for a in range(n) for b in range(a) if jaccard(set(sets[a]), set(sets[b])) >= similar]
        want = connected(n, pairs)
        # Labels join what is connected, in part.
        label = np.array([1000 + want[i] if draw.random() < 0.4 else i for i in range(n)])
        known = [(a, b) for a in range(n) for b in range(a) if label[a] == label[b]]
        for pairwise in (2, 5, 32):
            for given, before in ((np.arange(n), []), (label, known)):
                links = crowd_links([np.array(s) for s in sets], given, similar, pairwise)
                assert all((max(p), min(p)) in pairs for p in links)
                assert connected(n, [*links, *before]) == want


def test_crowds_grow_without_pairs():
    """Thousands that share nearly all, a passage, or a template: far fewer sets are compared than pairs exist."""
    draw = np.random.default_rng(1)
    n = 3_000
    made = {
        "near": [np.append(np.arange(100), draw.integers(200, 10**5, 5)) for _ in range(n)],
        "template": [np.append(np.arange(100), draw.integers(200, 10**9, 16)) for _ in range(n)],
        "passage": [np.append(np.arange(10**6, 10**6 + 60), draw.zipf(1.3, 60) % 5000) for _ in range(n)],
        "chain": [np.arange(4 * i, 4 * i + 100) for i in range(n)],
    }
    groups = {"near": 1, "template": n, "passage": n, "chain": 1}
    for kind, sets in made.items():
        start = time.process_time()
        links = crowd_links([np.unique(s) for s in sets], np.arange(n), 0.8, 32)
        assert len(set(connected(n, links))) == groups[kind] and time.process_time() - start < 20


@pytest.mark.parametrize("similar", [0.5, 0.8, 0.95])
def test_crowds_are_split_without_loss(monkeypatch, similar):
    """Also where no crowd is compared pair by pair because of its size alone."""
    monkeypatch.setattr(crowds, "DIRECT", 0)
    monkeypatch.setattr(crowds, "PAIRS_AT_ONCE", 100)
    test_crowds_connect_all_similar_sets(similar)


def test_crowds_that_overlap_in_part_take_no_longer():
    """Lines that share a passage and common words in ever other mixtures: such a crowd once took minutes."""
    draw = np.random.default_rng(2)
    n = 2_500
    sets = [np.append(np.arange(10**6, 10**6 + 60), draw.zipf(1.3, 60) % 5000) for _ in range(n)]
    sets += [np.append(sets[i], 7 * 10**6) for i in range(0, n, 10)]
    start = time.process_time()
    links = crowd_links([np.unique(s) for s in sets], np.arange(len(sets)), 0.8, 32)
    took = time.process_time() - start
    groups = connected(len(sets), links)
    assert all(groups[n + k] == groups[10 * k] for k in range(n // 10)) and took < 10


def test_sketches_differ_no_more_than_sets():
    """So no similar pair is left out by them, whatever the sizes."""
    draw = random.Random(9)
    sets = [np.array(sorted({draw.getrandbits(62) for _ in range(draw.choice([1, 3, 40, 700]))}), np.int64) for _ in range(30)]
    sets += [np.unique(np.append(s[: len(s) - len(s) // 9], draw.getrandbits(62))) for s in sets]
    sketch = sketches(np.concatenate(sets), np.array([len(s) for s in sets]))
    for a, b in combinations(range(len(sets)), 2):
        bits = int(np.bitwise_count(sketch[:, a] ^ sketch[:, b]).sum())
        assert bits <= len(np.setxor1d(sets[a], sets[b]))


@pytest.mark.parametrize("pairwise", [2, 32])
def test_all_similar_lines_are_found(spark, pairwise):
    rows = corpus() + [r for r in AWKWARD if r[0] != 6]
    docs = documents(spark, rows, clashes=True).coalesce(1)
    assert result(dropped_lines(docs, pairwise=pairwise)) == brute(rows)


def test_whole_table(spark):
    """Nothing is dropped but what comparing all pairs drops, and at least 99 in 100 of that."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(80)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = result(dropped_lines(documents(spark, rows).coalesce(1)))
    want = brute(rows)
    ours = {(i, p) for i, _, places in got for p in places}
    theirs = {(i, p) for i, _, places in want for p in places}
    assert ours <= theirs and len(ours) >= 0.99 * len(theirs)


def test_query_counts(spark):
    found = op3_line_dedup(spark, FOLDER).collect()
    assert len(found) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r["n_dropped"] == len(r["dropped"]) <= r["n_lines"] for r in found)


def test_texts(spark):
    rows = [(1, "keep this line here\n\nand this other one"), (2, "keep this line here\nnew text"), (3, None)]
    found = {r["doc_id"]: r["text"] for r in drop_lines(documents(spark, rows)).collect()}
    assert found == {1: rows[0][1], 2: "new text", 3: None}


def test_texts_with_missing_and_repeated_ids(spark):
    rows = [(1, "one line of this text\nold words again"), (1, "old words again\nother words"), (None, "old words again\nz"), (None, None)]
    docs = documents(spark, rows, clashes=True).coalesce(1)
    found = drop_lines(docs)
    assert found.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in found.collect()), key=repr)
    want = [(1, rows[0][1]), (1, "other words"), (None, "z"), (None, None)]
    assert got == sorted(((i, t, len(r[1] or "")) for (i, t), r in zip(want, rows, strict=True)), key=repr)


def test_shared_passages_are_not_all_pairs(spark, monkeypatch):
    """Unlike lines that share a passage meet in large buckets; few of their pairs are compared."""
    passage = " ".join(prose(1, 30, 5000).split())
    rows = [(i, f"{passage} {' '.join(prose(1000 + i, 14, 50000).split())}") for i in range(150)]
    rows += [(200 + i, rows[i][1] + "x") for i in range(0, 150, 10)]
    similar, compared = line_dedup._similar, []

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(line_dedup, "_similar", counted)
    assert result(dropped_lines(documents(spark, rows).coalesce(1), pairwise=8)) == brute(rows)
    assert sum(compared) < len(rows) * 12


def test_recall_of_bands():
    """Lines at the threshold share a band about as often as the formula says."""
    draw = random.Random(5)
    hits = trials = 0
    for seed in range(300):
        words = prose(seed, 40).split()
        other = list(words)
        other[draw.randrange(len(words))] = "q"
        a, b = " ".join(words), " ".join(other)
        if 0.8 <= jaccard(shingles(a), shingles(b)) < 0.95:
            trials += 1
            hits += (band_keys([a]) == band_keys([b])).any()
    assert trials > 50 and hits >= 0.98 * trials


def test_keys_depend_on_the_line_alone():
    lines = ["short", "x", "exactly8", "a longer line of text", "日本語のテキストです"]
    together = band_keys(lines)
    assert together.shape == (len(lines), BANDS)
    for i, line in enumerate(lines):
        assert (band_keys([line])[0] == together[i]).all()


def test_forgetting_and_empty(spark, monkeypatch):
    rows = corpus()
    want = result(dropped_lines(documents(spark, rows).coalesce(1)))
    monkeypatch.setattr(line_dedup, "REMEMBERED", 3)
    assert result(dropped_lines(documents(spark, rows).coalesce(1))) == want
    assert dropped_lines(documents(spark, [])).count() == 0


def test_large_crowds_store_little(spark, monkeypatch):
    """A crowd too large for one task: what is stored follows its text, not its lines times their shingles."""
    passage = " ".join(prose(3, 30, 90_000).split())
    rows = [(i, f"{passage} {' '.join(prose(5_000 + i, 20, 400).split())}") for i in range(60)]
    rows += [(500 + i, noisy(rows[i][1], random.Random(i))) for i in range(0, 60, 5)]
    text = sum(len(t) for _, t in rows)

    def one_bucket(lines):
        keys = np.array([[hash((line, b)) for b in range(BANDS)] for line in lines], np.int64)
        keys[:, 0] = 7
        return keys

    folder, stored = Path(checkpoint_dir(spark).removeprefix("file:")), []

    def weighed(df):
        before = set(folder.iterdir())
        done = cut_lineage(df)
        stored.append(sum(p.stat().st_size for new in set(folder.iterdir()) - before for p in new.rglob("part-*")))
        return done

    monkeypatch.setattr(line_dedup, "band_keys", one_bucket)
    monkeypatch.setattr(line_dedup, "HELD", text // 4)
    monkeypatch.setattr(line_dedup, "cut_lineage", weighed)
    assert result(dropped_lines(documents(spark, rows).coalesce(1))) == brute(rows)
    assert 0 < max(stored) < 6 * text


@pytest.mark.parametrize("similar", [0.5, 0.8, 0.95])
def test_blocks_connect_what_crowds_do(similar):
    """Inside one side and across two sides together all similar sets are linked."""
    draw = random.Random(similar)
    for _ in range(30):
        sets = [np.array(s) for s in random_sets(draw)]
        n, size = len(sets), np.array([len(s) for s in sets])
        side = np.array([draw.randrange(2) for _ in range(n)])
        links = crowds.cross_links(sets, np.arange(n), side, similar, size)
        assert all(side[a] != side[b] and jaccard(set(sets[a]), set(sets[b])) >= similar for a, b in links)
        for own in (0, 1):
            at = np.flatnonzero(side == own)
            if len(at):
                found = crowd_links([sets[k] for k in at], np.arange(len(at)), similar, 32, size[at])
                links += [(at[a], at[b]) for a, b in found]
        pairs = [(a, b) for a in range(n) for b in range(a) if jaccard(set(sets[a]), set(sets[b])) >= similar]
        assert connected(n, links) == connected(n, pairs)


def test_buckets_go_on_in_the_next_batch():
    draw = random.Random(3)
    pairs = sorted((draw.choice([-5, -1, 0, 3, 8, draw.getrandbits(40)]), draw.getrandbits(50)) for _ in range(120))
    groups = defaultdict(list)
    for key, short in pairs:
        groups[key].append(short)
    for rows in (1, 7, 1000):
        cut = [pairs[i : i + rows] for i in range(0, len(pairs), rows)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*b, strict=True)], ["key", "short"]) for b in cut]
        found = [r for b in line_dedup._buckets(batches, 4) for r in b.to_pylist()]
        members = defaultdict(list)
        for r in found:
            assert 0 < len(r["members"]) <= 4 and r["first"] == groups[r["key"]][0] and r["many"] == (len(groups[r["key"]]) > 4)
            members[r["key"]] += r["members"]
        assert members == {k: v for k, v in groups.items() if len(v) > 1}
    assert [b.num_rows for b in line_dedup._buckets([], 4)] == []


def test_shuffle_files_go_when_a_step_is_done(spark):
    """They are not left to the driver's garbage collection; the query hands on DataFrames that are as before."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = manager.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(REMOVAL, None)
    with shuffles_removed(spark):
        kept = cut_lineage(spark.range(1_000).selectExpr("id % 7 AS k").groupBy("k").count())
    assert spark.conf.get(REMOVAL, None) == setting and kept.count() == 7
    found = dropped_lines(documents(spark, corpus()))
    end = time.time() + 20
    while time.time() < end and len(shuffled() - before) > 30:
        time.sleep(0.2)
    # Those of ``kept.count()`` above, and of nothing that was a step only.
    assert len(shuffled() - before) <= 30 and spark.conf.get(REMOVAL, None) == setting
    assert result(found) == result(found)
