"""Repeated substrings of counted words, mined in levels.

A substring that occurs twice has only parts that occur twice. Short substrings are counted first.
Longer ones are then looked for only where all windows of the length reached so far are repeated: such
windows, side by side, form islands of a text, and the next level counts inside islands. Lengths double
from level to level. A word that occurs more than once is repeated all over and needs no islands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinloom.operators.parts import explode_substrings, text_ranges
from twinloom.storage import cut_lineage, fan_out

# Lengths that are counted without looking for islands.
FIRST_LEVEL = 8


def _islands(once: DataFrame, repeated: DataFrame, size: int) -> DataFrame:
    """``(text, own, rid)``: the stretches of ``once`` whose windows of ``size`` are all in ``repeated``.

    Only stretches of two windows or more hold a longer substring.
    """
    windows = explode_substrings(once, "text", size, "rid", shortest=size)
    kept = windows.join(repeated.select("piece"), "piece", "left_semi").select("rid", "s")
    rank = F.row_number().over(Window.partitionBy("rid").orderBy("s"))
    grouped = kept.withColumn("_side", F.col("s") - rank).groupBy("rid", "_side")
    stretches = grouped.agg(F.min("s").alias("_from"), F.count("*").alias("_n")).where("_n > 1")
    placed = stretches.join(once.select("rid", "text", "own"), "rid").where("own > _from")
    part = F.substring("text", F.col("_from") + 1, (F.col("_n") - 1 + size).cast("int"))
    return placed.select(part.alias("text"), (F.col("own") - F.col("_from")).alias("own"))


def repeated_substrings(words: DataFrame, longest: int) -> DataFrame:
    """``(piece, size, freq)`` from ``words(word, n)``: all characters, and what occurs twice or more.

    ``freq`` counts a word's substrings ``n`` times. Words of any length are cut into overlapping ranges,
    and a level's rows grow with the text times the level's lengths at most.
    """
    ranges = text_ranges(words.withColumnRenamed("word", "text"), "text", longest, "n").drop("at")
    ranges = cut_lineage(fan_out(ranges, "text").withColumn("rid", F.monotonically_increasing_id()))
    often, once = ranges.where("n > 1"), ranges.where("n = 1")
    found: list[DataFrame] = []
    done = 0
    while done < longest:
        size = min(max(FIRST_LEVEL, 2 * done), longest)
        texts = often.unionByName(once)
        parts = explode_substrings(texts, "text", size, "n", shortest=done + 1, starts="own")
        counts = parts.groupBy("piece", (F.col("e") - F.col("s")).alias("size")).agg(F.sum("n").alias("freq"))
        found.append(cut_lineage(counts.where("size = 1 or freq > 1")))
        border = found[-1].where(F.col("size") == size)
        if size < longest:
            if border.isEmpty():
                break
            islands = fan_out(_islands(once, border, size), "text").withColumn("n", F.lit(1).cast("long"))
            once = cut_lineage(islands.withColumn("rid", F.monotonically_increasing_id()))
        done = size
    return reduce(DataFrame.unionByName, found)
