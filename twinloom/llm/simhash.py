"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the XXH64 of all word shingles. For radius r, bit i gets
a random vector m(i) of r + 1 bits, and every nonzero v of r + 1 bits is a table that keeps the
bits with <m(i), v> = 1. Any r bits leave some v orthogonal to all their vectors, so two
fingerprints that differ in at most r bits agree on all kept bits of some table: no pair within
the radius is lost.
"""

from __future__ import annotations

import random
from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinloom.llm.common import columns_of, components, fresh, give_back, utf8
from twinloom.storage import cut_lineage

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
# Buckets up to this size are compared pair by pair, which is at most half of it for each row;
# larger ones take ``_links_by_neighbours``, which is exact as well.
PAIRWISE = 64
# Hashes whose bits are counted at once.
COUNTED = 1 << 16


def fingerprint(text: bytes) -> int:
    """Signed 64-bit SimHash of the text's word shingles; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)))
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for start in range(0, len(shingles), COUNTED):
        hashes = b"".join([digest(s, SEED) for s in shingles[start : start + COUNTED]])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, BITS // 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big", signed=True)


def _with_fingerprints(batches: Iterable[pa.RecordBatch], text_at: int, name: str, keep: list[int]):
    for batch in batches:
        made = pa.array([fingerprint(t) for t in utf8(batch.column(text_at))], pa.int64())
        names = [batch.schema.names[i] for i in keep]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [made], [*names, name])
        give_back()


def _fingerprinted(docs: DataFrame, name: str, *columns: str) -> DataFrame:
    """``columns`` of the documents and their fingerprint under ``name``."""
    source = docs.select(*("`" + c + "`" for c in columns)) if "text" in columns else docs.select(*columns, "text")
    text_at = source.columns.index("text")
    keep = [source.columns.index(c) for c in columns]
    schema = source.select(*("`" + c + "`" for c in columns)).schema.add(name, "long")
    return source.mapInArrow(lambda batches: _with_fingerprints(batches, text_at, name, keep), schema)


def covering_masks(radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """One unsigned bit mask for each table."""
    draw = random.Random(seed)
    # Nonzero vectors, dealt evenly, so that every table keeps about half of the bits.
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(BITS)]
    draw.shuffle(vectors)
    tables = range(1, 2 ** (radius + 1))
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in tables]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _links_by_neighbours(members: DataFrame, masks: list[int]) -> DataFrame:
    """Links inside large buckets, in rows that grow with the members and not with their pairs.

    Two fingerprints are within three bits exactly if some z is within two bits of one and within
    one bit of the other. Each member names its z's among the bits that its table leaves out. All
    members at a z are linked through the smallest one that is within one bit: it is within three
    bits of each.
    """
    spark = members.sparkSession
    flips = []
    for t, mask in enumerate(masks):
        free = [1 << i for i in range(BITS) if not mask >> i & 1]
        flips += [(t, 0, True)] + [(t, _signed(a), True) for a in free]
        flips += [(t, _signed(a | b), False) for a, b in combinations(free, 2)]
    # 2^(r+1) - 1 tables with about 500 flips each, whatever the input.
    moves = spark.createDataFrame(flips, "t int, flip long, near boolean")
    named = members.join(F.broadcast(moves), "t").select(
        F.col("fp").bitwiseXOR(F.col("flip")).alias("z"), "fp", "near"
    ).distinct()
    centre = named.groupBy("z").agg(
        F.min(F.when(F.col("near"), F.col("fp"))).alias("b"), F.count("*").alias("n")
    )
    centre = centre.where("b is not null and n > 1")
    return named.join(centre, "z").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """Links ``(a, b)`` between distinct ``fp`` that connect what is within ``radius`` bits."""
    masks = covering_masks(radius)
    keys = [
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for t, m in enumerate(masks)
    ]
    placed = prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key")
    sizes = placed.groupBy("t", "key").count().where("count > 1")
    shared = cut_lineage(placed.join(sizes, ["t", "key"]))
    few = shared.where(F.col("count") <= pairwise).select("t", "key", "fp")
    other = few.withColumnRenamed("fp", "fp2")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2")))
    pairs = few.join(other, ["t", "key"]).where((F.col("fp") < F.col("fp2")) & (apart <= radius))
    links = pairs.select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    many = shared.where(F.col("count") > pairwise).select("t", "fp")
    if radius != RADIUS:
        raise ValueError("the way through neighbours is worked out for three bits")
    return links.unionByName(_links_by_neighbours(many, masks))


def _grouped(prints: DataFrame) -> DataFrame:
    """``(fp, keep)``: for each fingerprint the first ``(doc_id, fp)`` of its component."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    roots = components(fingerprint_links(nodes.select("fp")))
    known = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = cut_lineage(known.select("fp", "doc_id", F.coalesce("root", "fp").alias("root")))
    first = rooted.groupBy("root").agg(F.min(order).alias("keep"))
    return rooted.select("fp", "root").join(first, "root").select("fp", "keep")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    Texts without words, or missing, have fingerprint zero and are linked like any other. A
    missing ``doc_id`` never becomes a ``component_id`` unless the component has no other.
    Repeated rows stay repeated; an empty table gives no rows; other columns are not read.
    """
    prints = cut_lineage(_fingerprinted(docs, "fp", "doc_id"))
    groups = _grouped(prints)
    return prints.join(groups, "fp").select(
        "doc_id", hex_of(F.col("fp")).alias("fingerprint"), F.col("keep.doc_id").alias("component_id")
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, all columns unchanged: one for each component, of the smallest id.

    Rows without words are one component. Of rows that share id and fingerprint one stays, and a row
    without an id only where its component has no other. An empty table gives no rows.
    """
    fp, keep = fresh(docs, "_fp"), fresh(docs, "_keep")
    prints = cut_lineage(_fingerprinted(docs, "fp", "doc_id"))
    winners = _grouped(prints).select("keep").distinct().select(
        F.col("keep.doc_id").alias(f"{keep}_id"), F.col("keep.fp").alias(f"{keep}_fp")
    )
    rows = _fingerprinted(docs, fp, *docs.columns)
    same = F.col("doc_id").eqNullSafe(F.col(f"{keep}_id")) & (F.col(fp) == F.col(f"{keep}_fp"))
    # Rows that share id and fingerprint: any fixed order will do.
    order = Window.partitionBy(f"{keep}_id", f"{keep}_fp").orderBy(F.xxhash64(*columns_of(docs)))
    place = fresh(docs, "_place")
    stay = rows.join(winners, same).withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return stay.select(columns_of(docs))
