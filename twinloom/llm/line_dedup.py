"""Fuzzy line deduplication by MinHash.

Lines are compared by their sets of eight-character shingles. Signatures of MinHash in bands find
candidates, exact Jaccard similarity decides, components of similar lines are found by
distributed union, and the first line of each component stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import reduce
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinloom.llm.common import columns_of, components, fresh, slices
from twinloom.llm.crowds import SLACK, cross_links, crowd_links, differing, sketches
from twinloom.storage import cut_lineage, fan_out, scratch_path, shuffles_removed

SHINGLE = 8
SIMILAR = 0.8
# Eight bands of three: a pair at the threshold is found with probability 0.997.
BANDS, ROWS = 8, 3
# Buckets up to this size are compared pair by pair; larger ones go by ``_crowd_links``.
PAIRWISE = 32
BLANKS = " \t\n\r\x0b\x0c"
# Bits of the sieve that keeps most other lines' texts from being moved: 16 MB.
SIEVE_BITS = 1 << 27
# Lines whose signature a task remembers having sent.
REMEMBERED = 1_000_000
# Crowds up to so many times ``PAIRWISE`` are compared pair by pair as well, in one product.
CROWD_SHARE = 16
# Characters of a crowd that one task works on.
HELD = 2_000_000
# Characters that a line of a larger crowd counts at least: two blocks of a crowd have few enough lines to compare all pairs.
COUNTED = 256
# The side of a member that is compared with all others.
BOTH = -1
KEYS = [f"b{i}" for i in range(BANDS)]

_DRAW = np.random.default_rng(42)
_FACTORS = _DRAW.integers(1 << 31, size=BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _DRAW.integers(1 << 32, size=BANDS * ROWS, dtype=np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, line after line, and how many each line has."""
    padded = [line.ljust(SHINGLE, "\0") for line in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.array([len(p) for p in padded])
    factor, reach = 0x100000001B3, 1
    rolled = codes
    while reach < SHINGLE:
        later, rolled = rolled[reach:], rolled[:-reach] * np.uint64(factor)
        rolled += later
        factor, reach = factor * factor % (1 << 64), 2 * reach
    # Windows that reach into the next line are no shingles.
    inside = np.ones(len(codes), dtype=bool)
    inside[np.cumsum(sizes)[:, None] - np.arange(1, SHINGLE)] = False
    mixed = rolled[inside[: len(rolled)]]
    mixed ^= mixed >> np.uint64(31)
    mixed *= _MIX
    return mixed, sizes - SHINGLE + 1


def band_keys(lines: list[str]) -> np.ndarray:
    """One row of band keys for each line. Lines with equal shingles have equal keys."""
    mixed, counts = shingle_codes(lines)
    begin = np.cumsum(counts) - counts
    base = (mixed >> np.uint64(32)).astype(np.uint32)
    drawn = np.empty_like(base)
    keys = np.empty((len(lines), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(lines), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            np.multiply(base, _FACTORS[k], out=drawn)
            np.add(drawn, _OFFSETS[k], out=drawn)
            key = (key ^ np.minimum.reduceat(drawn, begin)) * _MIX
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys.view(np.int64)


def line_id(line: str) -> bytes:
    """128 bits that stand for the whole line."""
    return hashlib.blake2b(line.encode(), digest_size=16).digest()


def text_lines(text: str) -> list[tuple[int, str]]:
    """Numbered lines without outer blanks; those without a word are left out."""
    return [(i, line) for i, raw in enumerate(text.split("\n")) if (line := raw.strip(BLANKS))]


SCAN = "row long, doc_id {}, n_lines int, place int, line binary, " + ", ".join(f"{k} long" for k in KEYS)


def _scanned(batches: Iterable[pa.RecordBatch]):
    """A row for each document, and one for each line that has a word; band keys are sent once.

    Documents are numbered unless a third column does that.
    """
    base, number = TaskContext.get().partitionId() << 40, count()
    sent: set[bytes] = set()
    names = [part.split()[0] for part in SCAN.split(", ")]
    for batch in slices(batches, 200):
        size = batch.num_rows
        given = batch.num_columns > 2
        rows = batch.column(2) if given else pa.array([base + next(number) for _ in range(size)], pa.int64())
        texts = [t or "" for t in batch.column(1).to_pylist()]
        totals = pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int32())
        empty = [pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary()), *[pa.nulls(size, pa.int64())] * BANDS]
        yield pa.RecordBatch.from_arrays([rows, batch.column(0), totals, *empty], names)
        found = [(r, i, line) for r, text in enumerate(texts) for i, line in text_lines(text)]
        if not found:
            continue
        owner, places, lines = zip(*found, strict=True)
        ids = [line_id(line) for line in lines]
        fresh = {i: n for n, i in enumerate(ids) if i not in sent}
        if len(sent) + len(fresh) > REMEMBERED:
            sent = set()
        sent |= fresh.keys()
        chosen = sorted(fresh.values())
        keys = np.zeros((len(ids), BANDS), np.int64)
        if chosen:
            keys[chosen] = band_keys([lines[n] for n in chosen])
        missing = np.ones(len(ids), bool)
        missing[chosen] = False
        columns = [pa.array(keys[:, b], mask=missing) for b in range(BANDS)]
        owner = pa.array(owner, pa.int32())
        head = [rows.take(owner), batch.column(0).take(owner), pa.nulls(len(ids), pa.int32())]
        yield pa.RecordBatch.from_arrays([*head, pa.array(places, pa.int32()), pa.array(ids), *columns], names)


def short_id(line: bytes) -> int:
    """The first half of a line's id, as a signed number."""
    return int.from_bytes(line[:8], "big", signed=True)


def _line_texts(batches: Iterable[pa.RecordBatch], sieve):
    """Lines whose bit is set; a set bit may be another line's, which a join sorts out."""
    bits = sieve.value
    for batch in slices(batches, 500):
        lines = list({line for text in batch.column(0).to_pylist() for _, line in text_lines(text or "")})
        ids = [line_id(line) for line in lines]
        places = np.array([short_id(i) for i in ids], np.int64) & (SIEVE_BITS - 1)
        chosen = np.flatnonzero(bits[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)) if ids else []
        columns = ([ids[n] for n in chosen], [short_id(ids[n]) for n in chosen], [lines[n] for n in chosen])
        kinds = (pa.binary(), pa.int64(), pa.string())
        made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(made, ["line", "short", "content"])


def _sieve(wanted: DataFrame) -> np.ndarray:
    """A bit for each wanted line. Its size is fixed: with very many lines it lets all through."""
    place = F.col("short").bitwiseAND(F.lit(SIEVE_BITS - 1))
    bit = F.expr("shiftleft(1L, CAST(short & 63 AS INT))")
    words = wanted.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(SIEVE_BITS >> 6, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits.view(np.uint64)


def similar_pairs(a: list[str], b: list[str], similar: float) -> np.ndarray:
    """Which pairs of lines are similar by their shingles; each distinct line is cut once."""
    place: dict[str, int] = {}
    pairs = [(place.setdefault(x, len(place)), place.setdefault(y, len(place))) for x, y in zip(a, b, strict=True)]
    result = np.zeros(len(pairs), dtype=bool)
    if not pairs:
        return result
    sets = _line_sets(list(place))
    sizes = np.array([len(own) for own in sets])
    sketch = sketches(np.concatenate(sets), sizes)
    one, other = np.array(pairs).T
    bits = np.bitwise_count(sketch[:, one] ^ sketch[:, other]).sum(axis=0, dtype=np.int64)
    for n in np.flatnonzero(bits <= differing(similar) * (sizes[one] + sizes[other]) + SLACK).tolist():
        x, y = pairs[n]
        small, large = sorted((sets[x], sets[y]), key=len)
        # Sets of very different size can't be similar.
        if len(small) >= similar * len(large) - SLACK:
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            shared = int((large[at] == small).sum())
            result[n] = shared >= similar * (len(small) + len(large) - shared) - SLACK
    return result


def _line_sets(lines: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each line."""
    if not lines:
        return []
    codes, counts = shingle_codes(lines)
    ends = np.cumsum(counts)
    # Sorted where they lie: for arrays this small ``np.unique`` takes several times as long.
    for start, end in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        codes[start:end].sort()
    first = np.append(True, codes[1:] != codes[:-1])
    first[ends[:-1]] = True
    begin = np.append(0, np.cumsum(np.add.reduceat(first, ends - counts, dtype=np.int64))).tolist()
    codes = codes[first]
    return [codes[start:end] for start, end in zip(begin, begin[1:], strict=False)]


def _verified(batches: Iterable[pa.RecordBatch], similar: float):
    for batch in slices(batches, 2000):
        if batch.num_rows:
            keep = similar_pairs(batch.column(2).to_pylist(), batch.column(3).to_pylist(), similar)
            yield batch.filter(pa.array(keep)).select(["a", "b", "sa", "sb"])


def _similar(pairs: DataFrame, contents: DataFrame, similar: float) -> DataFrame:
    """Links ``(a, b)`` of lines, from pairs of short ids, where the lines are similar."""
    a = contents.select(F.col("short").alias("sa"), F.col("line").alias("a"), F.col("content").alias("ta"))
    b = contents.select(F.col("short").alias("sb"), F.col("line").alias("b"), F.col("content").alias("tb"))
    both = pairs.join(a, "sa").join(b, "sb").select("a", "b", "ta", "tb", "sa", "sb")
    return both.mapInArrow(lambda x: _verified(x, similar), "a binary, b binary, sa long, sb long")


BUCKET = "key long, first long, many boolean, members array<long>"


def _buckets(batches: Iterable[pa.RecordBatch], pairwise: int):
    """Keys that several lines have, from ordered pairs of key and line; beyond ``pairwise`` lines in portions of so many."""
    key = short = np.empty(0, np.int64)
    for batch in chain(batches, [None]):
        if batch is not None:
            key, short = np.append(key, batch.column(0).to_numpy()), np.append(short, batch.column(1).to_numpy())
        if not len(key):
            continue
        # The last key may go on in the next batch.
        stop = len(key) if batch is None else np.searchsorted(key, key[-1])
        own, lines = key[:stop], short[:stop]
        key, short = key[stop:], short[stop:]
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1])[:stop])
        sizes = np.diff(np.append(begin, stop))
        n, first = np.repeat(sizes, sizes), np.repeat(lines[begin], sizes)
        place = np.arange(stop) - np.repeat(begin, sizes)
        starts, shared = (n > 1) & (place % pairwise == 0), n > 1
        offsets = pa.array(np.append(np.flatnonzero(starts[shared]), np.count_nonzero(shared)), pa.int32())
        members = pa.ListArray.from_arrays(offsets, pa.array(lines[shared]))
        columns = [pa.array(own[starts]), pa.array(first[starts]), pa.array((n > pairwise)[starts]), members]
        yield pa.RecordBatch.from_arrays(columns, ["key", "first", "many", "members"])


MEMBER = "crowd long, short long, label long, side int, size long, codes array<long>"


def _coded(batches: Iterable[pa.RecordBatch]):
    """Members with the shingle hashes of their text."""
    for batch in slices(batches, 500):
        sets = _line_sets(batch.column("content").to_pylist())
        counts = np.array([len(own) for own in sets], dtype=np.int64)
        offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
        codes = np.concatenate([np.empty(0, np.uint64), *sets])
        lists = pa.ListArray.from_arrays(offsets, pa.array(codes.view(np.int64)))
        names = ["crowd", "short", "label", "side"]
        kept = [batch.column(c) for c in names]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), lists], [*names, "size", "codes"])


def _sized(batches: Iterable[pa.RecordBatch]):
    """Rows with the number of distinct shingles of their text."""
    for batch in slices(batches, 500):
        sizes = [len(own) for own in _line_sets(batch.column("content").to_pylist())]
        yield batch.append_column("size", pa.array(sizes, pa.int64()))


def _linked_crowds(batches: Iterable[pa.RecordBatch], similar: float, pairwise: int):
    """Links ``(sa, sb)`` inside crowds, whose members come one after the other."""
    held: list[tuple[np.ndarray, ...]] = []

    def linked() -> pa.RecordBatch:
        _, short, label, side, size = (np.concatenate(c) for c in list(zip(*held, strict=True))[:5])
        codes = [own for *_, lists in held for own in lists]
        if (side == BOTH).all():
            found = crowd_links(codes, label, similar, CROWD_SHARE * pairwise, size)
        else:
            found = cross_links(codes, label, side, similar, size)
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        ends = np.sort(short[pairs], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["sa", "sb"])

    for batch in slices(batches, 500):
        if not batch.num_rows:
            continue
        numbers = [batch.column(c).to_numpy() for c in ("crowd", "short", "label", "side", "size")]
        lists = batch.column("codes")
        ends = np.cumsum(lists.value_lengths().to_numpy())
        codes = np.split(lists.flatten().to_numpy(), ends[:-1])
        cuts = np.flatnonzero(np.diff(numbers[0])) + 1
        for start, stop in zip(np.append(0, cuts), np.append(cuts, batch.num_rows), strict=True):
            if held and held[-1][0][0] != numbers[0][start]:
                yield linked()
                held = []
            held.append((*(x[start:stop] for x in numbers), codes[start:stop]))
    if held:
        yield linked()


def _blocks(rows: DataFrame, similar: float) -> DataFrame:
    """Members of crowds too large for one task as pairs of blocks, each such pair a crowd of its own.

    Blocks are of lines of about the same size, so many pairs of them have none that are similar. Lines
    like the first are connected already, and their blocks are compared with those of other lines only.
    """
    whole = max(HELD // 2, 1)
    kept = "crowd long, short long, label long, like boolean, content string, size long"
    sized = cut_lineage(rows.select("crowd", "short", "label", "like", "content").mapInArrow(_sized, kept))
    sized = sized.withColumn("weight", F.greatest(F.length("content"), F.lit(COUNTED)))
    weights = sized.groupBy("crowd", "like", "size").agg(F.sum("weight").alias("all"))
    before = Window.partitionBy("crowd", "like").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    weights = weights.withColumn("begin", F.coalesce(F.sum("all").over(before), F.lit(0)))
    share = F.pmod(F.xxhash64("short"), F.lit(1 << 20)) / (1 << 20)
    block = F.floor((F.col("begin") + share * F.col("all")) / whole)
    placed = sized.join(weights, ["crowd", "like", "size"]).withColumn("block", block)
    blocks = placed.groupBy("crowd", "like", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    blocks = cut_lineage(blocks.select("crowd", F.struct("like", "block").alias("at"), "low", "high"))
    others = blocks.select("crowd", *[F.col(c).alias(f"{c}_") for c in ("at", "low", "high")])
    comparable = (F.col("high") >= similar * F.col("low_") - SLACK) & (F.col("high_") >= similar * F.col("low") - SLACK)
    pairs = blocks.join(others, "crowd").where(F.col("at") <= F.col("at_"))
    pairs = pairs.where(comparable & ~(F.col("at.like") & F.col("at_.like")))
    one = F.struct("at", F.when(F.col("at") == F.col("at_"), F.lit(BOTH)).otherwise(0).alias("side"))
    other = F.struct(F.col("at_").alias("at"), F.lit(1).alias("side"))
    both = F.when(F.col("at") == F.col("at_"), F.array(one)).otherwise(F.array(one, other))
    pairs = pairs.select("crowd", F.xxhash64("crowd", "at", "at_").alias("pair"), F.explode(both).alias("of"))
    pairs = pairs.select("crowd", "pair", "of.at.like", "of.at.block", "of.side")
    found = placed.join(pairs, ["crowd", "like", "block"])
    return found.select(F.col("pair").alias("crowd"), "short", "label", "side", "content")


def _split(rows: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """Links ``(sa, sb)`` and smaller crowds of crowds too large for one task: a step of ``crowd_links``.

    Tokens are counted by crowd, with partial sums inside tasks, and a member gathers only its own.
    """
    sizes = rows.groupBy("crowd").agg(F.count("*").alias("m"), F.min(F.struct("size", "short", "label")).alias("lead"))
    tokens = rows.select("crowd", "short", F.explode("codes").alias("token"))
    counts = tokens.groupBy("crowd", "token").agg(F.count("*").alias("c"))
    counted = cut_lineage(counts.join(sizes.select("crowd", "m"), "crowd"))
    shared = counted.groupBy("crowd").agg(F.count_if(F.col("c") == F.col("m")).alias("all"))
    known = rows.join(sizes, "crowd").join(shared, "crowd")
    near = F.col("all") >= similar * (F.col("size") + F.col("lead.size") - F.col("all")) - SLACK
    known = known.withColumn("near", near)
    stars = known.where("near and short <> lead.short").select(
        F.least("short", "lead.short").alias("sa"), F.greatest("short", "lead.short").alias("sb")
    )
    ordered = F.sort_array(F.collect_list(F.struct("c", "token")))
    sorted_ = tokens.join(counted, ["crowd", "token"]).groupBy("crowd", "short").agg(ordered.alias("o"))
    label = F.when(F.col("near"), F.col("lead.label")).otherwise(F.col("label")).alias("label")
    first = F.size("o") - F.ceil(similar * F.col("size") - SLACK).cast("int") + 1
    members = known.select("crowd", "short", label, "size", "m").join(sorted_, ["crowd", "short"])
    members = cut_lineage(members.where(first > 0).withColumn("first", first))
    places = members.select("crowd", "short", "label", "m", F.posexplode(F.slice("o", F.lit(1), F.col("first"))).alias("at", "t"))
    sub = F.xxhash64("crowd", "t.token").alias("sub")
    places = places.where("t.c > 1 and t.c < m").select("crowd", "short", "label", "at", sub, F.col("t").alias("token"))
    # Of tokens with the same members only the first one can be the first that two of them share.
    members_of = F.struct(F.count("*"), F.bit_xor(F.xxhash64("short")), F.min("short"), F.max("short"))
    parts = places.groupBy("crowd", "sub", "token").agg(
        members_of.alias("who"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    first_of = parts.where("low <> high").groupBy("crowd", "who").agg(F.min(F.struct("token", "sub")).alias("of"))
    chosen = places.join(first_of.select(F.col("of.sub").alias("sub")), "sub", "left_semi").select("crowd", "short", "at", "sub")
    rest = F.slice(F.col("o")["token"], F.col("at") + 1, F.size("o"))
    smaller = chosen.join(members, ["crowd", "short"]).select(F.col("sub").alias("crowd"), "short", "label", "size", rest.alias("codes"))
    return stars, smaller


def _crowd_links(members: DataFrame, contents: DataFrame, similar: float, pairwise: int) -> DataFrame:
    """Links ``(sa, sb)`` that connect the similar lines of each crowd of ``(crowd, short, label, like)``.

    A crowd of up to ``HELD`` characters is worked on in one task. Larger ones are compared by pairs of
    blocks, or, if they have so many blocks of short lines that less is moved in this way, split.
    """
    texts = contents.select("short", "content", F.length("content").alias("chars"))
    weighed = members.join(texts.select("short", "chars"), "short")
    weights = weighed.groupBy("crowd").agg(
        F.count("*").alias("m"), F.sum("chars").alias("chars"), F.sum(F.greatest("chars", F.lit(COUNTED))).alias("weight")
    )
    # A text is moved once for each block; split, once for each of its shingles or so.
    way = F.expr(f"CASE WHEN chars <= {HELD} THEN 0 WHEN weight / {max(HELD // 2, 1)} <= chars / m THEN 1 ELSE 2 END")
    weights = cut_lineage(weights.select("crowd", way.alias("way")))
    placed = members.join(weights, "crowd").join(texts.select("short", "content"), "short")
    ways = {r["way"] for r in weights.select("way").distinct().collect()}
    whole = placed.where("way = 0").select("crowd", "short", "label", F.lit(BOTH).alias("side"), "content")
    if 1 in ways:
        whole = whole.unionByName(_blocks(placed.where("way = 1"), similar))
    near = fan_out(whole, "crowd").sortWithinPartitions("crowd")
    links = "sa long, sb long"
    found = [cut_lineage(near.mapInArrow(lambda b: _linked_crowds(_coded(b), similar, pairwise), links))]
    if 2 not in ways:
        return found[0]
    side = F.lit(BOTH).alias("side")
    rows = cut_lineage(placed.where("way = 2").select("crowd", "short", "label", side, "content").mapInArrow(_coded, MEMBER))
    while not rows.isEmpty():
        stars, smaller = _split(rows, similar)
        found.append(cut_lineage(stars))
        smaller = cut_lineage(smaller.select("crowd", "short", "label", side, "size", "codes"))
        sizes = smaller.groupBy("crowd").agg(F.sum(F.size("codes")).alias("codes_"))
        sized = smaller.join(sizes, "crowd")
        near = fan_out(sized.where(F.col("codes_") <= HELD).drop("codes_"), "crowd").sortWithinPartitions("crowd")
        found.append(cut_lineage(near.mapInArrow(lambda b: _linked_crowds(b, similar, pairwise), links)))
        rows = cut_lineage(sized.where(F.col("codes_") > HELD).drop("codes_"))
    return reduce(DataFrame.unionByName, found)


def similar_links(docs: DataFrame, lines: DataFrame, similar: float = SIMILAR, pairwise: int = PAIRWISE) -> DataFrame:
    """Links ``(a, b)`` of line ids that connect all similar lines sharing a band.

    ``lines`` has ``short`` and the band keys of each distinct line. In buckets of up to
    ``pairwise`` lines all pairs are compared. In a larger one every line is compared with the
    first, and those like it are connected. A bucket in which others remain is a crowd, whose members
    like the first share a label. Half of a line's id stands for it until its text is at hand.
    """
    placed = lines.select(F.explode(F.array(*KEYS)).alias("key"), "short")
    # One exchange and one sort bring the lines of a key together; most keys end there, with a single line.
    ordered = fan_out(placed, "key").sortWithinPartitions("key", "short")
    shared = cut_lineage(ordered.mapInArrow(lambda b: _buckets(b, pairwise), BUCKET))
    few = shared.where("not many").select("members", F.explode("members").alias("sa"))
    small = few.select("sa", F.explode("members").alias("sb")).where("sa < sb")
    many = shared.where("many").select("key", "first", F.explode("members").alias("short"))
    starred = many.where("short <> first").select(F.col("first").alias("sa"), F.col("short").alias("sb"))
    wanted = shared.select(F.explode("members").alias("short")).distinct()
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(wanted))
    found = docs.select("text").mapInArrow(lambda b: _line_texts(b, sieve), "line binary, short long, content string")
    # Equal lines have the same half of an id, by which the join has brought them together.
    contents = cut_lineage(found.join(wanted, "short", "left_semi").dropDuplicates(["short", "line"]))
    links = cut_lineage(_similar(small.unionByName(starred).distinct(), contents, similar))
    like = links.select(F.col("sa").alias("first"), F.col("sb").alias("short"), F.lit(True).alias("like"))
    labelled = many.join(like.distinct(), ["first", "short"], "left")
    alike = F.coalesce("like", F.col("short") == F.col("first"))
    label = F.when(alike, F.col("first")).otherwise(F.col("short"))
    crowds = cut_lineage(labelled.select(F.col("key").alias("crowd"), "short", label.alias("label"), alike.alias("like")))
    mixed = crowds.groupBy("crowd").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    members = cut_lineage(crowds.join(mixed.select("crowd"), "crowd", "left_semi"))
    if members.isEmpty():
        return links.select("a", "b")
    more = _similar(_crowd_links(members, contents, similar, pairwise).distinct(), contents, similar)
    return links.unionByName(cut_lineage(more)).select("a", "b")


def dropped_lines(docs: DataFrame, similar: float = SIMILAR, pairwise: int = PAIRWISE) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, dropped`` (line numbers from 0).

    Of each component of similar or equal lines, over all documents, the one first by
    ``doc_id`` and line number stays. Lines without a word always stay. A missing or empty text
    has no lines. Repeated rows are documents of their own; a missing ``doc_id`` comes last; an
    empty table gives no rows. Other columns are not read.
    """
    return _dropped(docs.select("doc_id", "text"), similar, pairwise).drop("row")


def _rooted(source: DataFrame, similar: float, pairwise: int) -> tuple[str, DataFrame]:
    """Where the scanned documents are, and ``(row, doc_id, place, root)`` of lines that are not the only one of their component."""
    spark = source.sparkSession
    path = scratch_path(spark, "lines")
    schema = SCAN.format(source.schema["doc_id"].dataType.simpleString())
    source.mapInArrow(_scanned, schema).write.parquet(path)
    placed = spark.read.parquet(path).where("line is not null")
    short = F.conv(F.substring(F.hex("line"), 1, 16), 16, -10).cast("long").alias("short")
    distinct = placed.groupBy("line").agg(F.count("*").alias("n"), *[F.max(k).alias(k) for k in KEYS])
    # Parquet keeps these, the largest of what is stored, small.
    stored = scratch_path(spark, "distinct-lines")
    distinct.select("line", short, "n", *KEYS).write.parquet(stored)
    lines = spark.read.parquet(stored)
    roots = components(similar_links(source, lines.select("short", *KEYS), similar, pairwise))
    known = lines.select("line", "n").join(roots.withColumnRenamed("node", "line"), "line", "left")
    # A line that occurs once and is like no other stays, without more to be done.
    shared = known.where("n > 1 or root is not null").select("line", F.coalesce("root", "line").alias("root"))
    return path, cut_lineage(placed.select("row", "doc_id", "place", "line").join(shared, "line"))


def _dropped(source: DataFrame, similar: float, pairwise: int) -> DataFrame:
    """``dropped_lines`` of ``(doc_id, text)``, or of ``(doc_id, text, row)``, and the ``row``."""
    spark = source.sparkSession
    with shuffles_removed(spark):
        path, rooted = _rooted(source, similar, pairwise)
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "place")).alias("first"))
    kept = first.select(F.col("first.row").alias("row"), F.col("first.place").alias("place"))
    gone = rooted.join(kept, ["row", "place"], "left_anti").groupBy("row").agg(
        F.sort_array(F.collect_list("place")).alias("dropped")
    )
    scan = spark.read.parquet(path)
    documents = scan.where("line is null").select("row", "doc_id", "n_lines")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return documents.join(gone, "row", "left").select(
        "row", "doc_id", "n_lines", F.size(dropped).alias("n_dropped"), dropped.alias("dropped")
    )


def drop_lines(docs: DataFrame, similar: float = SIMILAR, pairwise: int = PAIRWISE) -> DataFrame:
    """The rows of ``docs`` with the dropped lines taken out of ``text``, other columns unchanged.

    Rows are numbered and stored first, so missing and repeated ids are documents of their own.
    """
    row, gone = fresh(docs, "_row"), fresh(docs, "_dropped")
    stored = cut_lineage(docs.select(*columns_of(docs), F.monotonically_increasing_id().alias(row)))
    found = _dropped(stored.select("doc_id", "text", row), similar, pairwise)
    found = found.select(F.col("row").alias(row), F.col("dropped").alias(gone))
    left = F.filter(F.split(F.col("text"), "\n"), lambda _, i: ~F.array_contains(gone, i))
    joined = stored.join(found, row).withColumn("text", F.array_join(left, "\n"))
    return joined.select(*columns_of(docs))
