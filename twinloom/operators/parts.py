"""Exploding texts into all their short parts.

A part is cut in two steps: first the longest part from every position, taken from an array,
where a position is found in constant time; then its beginnings. Cutting each part out of the
text itself would walk the text from its start every time. Texts of any length come in ranges
first, so that no row grows with its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.functions.text import chars

# Characters of a range.
RANGE = 1024


def _tails(items: Column, longest: int, starts: Column | None = None) -> Column:
    number = F.size(items) if starts is None else starts
    places = F.when(number > 0, F.sequence(F.lit(1), number))
    return F.transform(places, lambda i: F.slice(items, i, longest))


def cut(text: Column, size: int | None = None) -> Column:
    """Consecutive parts of ``size`` characters, ``RANGE`` unless given; the last one may be shorter."""
    size = size or RANGE
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(parts)


def text_ranges(df: DataFrame, text: str, longest: int, *keep: str) -> DataFrame:
    """``(*keep, at, text, own)``: ranges of each text from character ``at`` on.

    A part of at most ``longest`` characters lies wholly in the range it begins in. ``own`` of a
    range's places belong to it; from the rest on, the next range goes on.
    """
    size = max(RANGE, longest)
    parts = df.select(*keep, cut(F.col(text), size).alias("_parts"))
    following = F.concat(F.slice("_parts", F.lit(2), F.greatest(F.size("_parts") - 1, F.lit(0))), F.array(F.lit("")))
    paired = F.transform(
        F.arrays_zip(F.col("_parts").alias("own"), following.alias("next")),
        lambda x, i: F.struct(
            (i * size).alias("at"),
            F.concat(x["own"], F.left(x["next"], F.lit(longest - 1))).alias(text),
            F.length(x["own"]).alias("own"),
        ),
    )
    return parts.select(*keep, F.inline(paired))


def explode_substrings(
    df: DataFrame, text: str, longest: int, *keep: str, shortest: int = 1, starts: str | None = None
) -> DataFrame:
    """``(*keep, s, e, piece)`` for every ``text[s:e]`` of ``shortest`` to ``longest`` characters.

    ``starts`` names a column with the number of places to begin at, if not all.
    """
    begins = [F.col(starts).alias("_starts")] if starts else []
    spelled = df.select(*keep, *begins, chars(F.col(text)).alias("_letters"))
    number = F.size("_letters") - (shortest - 1)
    number = F.least(number, F.col("_starts")) if starts else number
    tails = F.transform(_tails(F.col("_letters"), longest, number), lambda t: F.array_join(t, ""))
    placed = spelled.select(*keep, F.posexplode(tails).alias("s", "_tail"))
    lengths = F.explode(F.sequence(F.lit(shortest), F.length("_tail"))).alias("_k")
    sized = placed.select(*keep, "s", "_tail", lengths)
    return sized.select(
        *keep, "s", (F.col("s") + F.col("_k")).alias("e"), F.left("_tail", "_k").alias("piece")
    )
