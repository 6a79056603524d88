"""Corpus BLEU and chrF++ over a table of (hyp, ref) pairs.

Counts of a pair depend on its texts alone. Equal pairs are therefore folded into one row
with a multiplicity first, and distinct pairs are then spread by a content hash. N-grams are
matched inside that partitioning, some pairs at a time, so a task holds the n-grams of a bounded
portion of text and none is ever shuffled; only sums of a few numbers per order leave a task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.functions.ngrams import ngram_count, spaced_13a
from twinloom.operators.matching import chars_of, cut_words, match_batches, words_of
from twinloom.storage import fan_out

# Fixed values.
BLEU_ORDER = 4
CHAR_ORDER = 6
WORD_ORDER = 2
BETA = 2

def _distinct_pairs(pairs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``(*by, hyp, ref, copies, _pair)`` without null texts, hash-partitioned by ``_pair``."""
    known = pairs.na.drop(subset=["hyp", "ref"]).select(*by, "hyp", "ref")
    folded = known.groupBy(*by, "hyp", "ref").agg(F.count(F.lit(1)).alias("copies"))
    # The lengths keep ("ab", "c") and ("a", "bc") apart.
    content = F.concat_ws("|", F.length("hyp"), F.length("ref"), *by, "hyp", "ref")
    return fan_out(folded.withColumn("_pair", F.unhex(F.md5(content))), "_pair")


def _matched(distinct: DataFrame, by: tuple[str, ...], kinds: dict[str, tuple]) -> DataFrame:
    """``(*by, copies)`` of every pair, and what ``match_batches`` finds in it."""
    keep = [*by, "copies"]
    schema = T.StructType([distinct.schema[c] for c in keep])
    for kind in kinds:
        schema.add(f"{kind}_h", T.IntegerType()).add(f"{kind}_r", T.IntegerType()).add(f"{kind}_m", T.ArrayType(T.LongType()))
    return distinct.mapInArrow(lambda b: match_batches(b, keep, kinds), schema)


def _orders(kind: str, max_n: int) -> list[Column]:
    """Per-order n-gram totals and matches of one pair; a reference without n-grams voids the hypothesis."""
    hyp, ref, matched = (F.col(f"{kind}_{c}") for c in "hrm")
    rows = []
    for n in range(1, max_n + 1):
        in_ref = ngram_count(ref, n)
        rows.append(
            F.struct(
                F.lit(kind).alias("kind"),
                F.lit(n).alias("n"),
                F.when(in_ref > 0, ngram_count(hyp, n)).otherwise(0).alias("in_hyp"),
                ngram_count(hyp, n).alias("all_hyp"),
                in_ref.alias("in_ref"),
                matched[n - 1].alias("matched"),
            )
        )
    return rows


def _totals(pairs: DataFrame, by: tuple[str, ...], orders: list[Column], **sums: str) -> DataFrame:
    """``(*by, kind, n)`` with sums of the named numbers over all pairs, and ``pairs``."""
    rows = pairs.select(*by, "copies", F.inline(F.array(*orders)))
    wanted = [F.sum(F.col(c) * F.col("copies")).alias(name) for name, c in sums.items()]
    return rows.groupBy(*by, "kind", "n").agg(*wanted, F.sum("copies").alias("pairs"))


def bleu_statistics(distinct: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``(*by, n, total, in_ref, matched, pairs)`` per n-gram order, from folded pairs."""
    spaced = distinct.select(*by, "copies", spaced_13a(F.col("hyp")).alias("h"), spaced_13a(F.col("ref")).alias("r"))
    pairs = _matched(spaced, by, {"word": ("h", "r", words_of, BLEU_ORDER)})
    return _totals(pairs, by, _orders("word", BLEU_ORDER), total="all_hyp", in_ref="in_ref", matched="matched").drop("kind")


def corpus_bleu(pairs: DataFrame, *by: str) -> DataFrame:
    """Corpus BLEU with exponential smoothing, one row per group: ``(*by, bleu)``."""
    return _bleu(_distinct_pairs(pairs, by), by).select(*by, "bleu")


def _bleu(distinct: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``(*by, bleu, precision_1, ..., brevity_penalty, hyp_len, ref_len, pairs)``.

    Precisions are percentages, smoothed where no n-gram of an order matches. All are 0 if nothing
    matches, as is that of an order without n-grams.
    """
    stats = bleu_statistics(distinct, by)

    def at(name: str, n: int) -> Column:
        return F.max(F.when(F.col("n") == n, F.col(name)))

    names = [(name, n) for name in ("matched", "total") for n in range(1, BLEU_ORDER + 1)]
    sizes = (("total", "hyp_len"), ("in_ref", "ref_len"), ("pairs", "pairs"))
    lengths = [F.coalesce(at(x, 1), F.lit(0)).alias(y) for x, y in sizes]
    wide = stats.groupBy(*by).agg(*[at(x, n).alias(f"{x}_{n}") for x, n in names], *lengths)

    log_sum, missed, parts = F.lit(0.0), F.lit(0), []
    any_match = sum((F.col(f"matched_{n}") for n in range(1, BLEU_ORDER + 1)), F.lit(0)) > 0
    for n in range(1, BLEU_ORDER + 1):
        matched, total = F.col(f"matched_{n}"), F.col(f"total_{n}")
        missed = missed + F.when((matched == 0) & (total > 0), 1).otherwise(0)
        precision = F.when(matched > 0, 100 * matched / total).when(
            total > 0, 100 / (F.pow(F.lit(2.0), missed) * total)
        )
        log_sum = log_sum + F.log(precision)
        parts.append(F.coalesce(F.when(any_match, precision), F.lit(0.0)).alias(f"precision_{n}"))
    hyp, ref = F.col("hyp_len"), F.col("ref_len")
    brevity = F.when(hyp >= ref, 1.0).when(hyp == 0, 0.0).otherwise(F.exp(1 - ref / hyp))
    # An order without n-grams makes its precision 0, and so the whole score.
    score = F.when(any_match, brevity * F.exp(log_sum / BLEU_ORDER))
    whole = F.coalesce(score, F.lit(0.0)).alias("bleu")
    return wide.select(*by, whole, *parts, brevity.alias("brevity_penalty"), "hyp_len", "ref_len", "pairs")


def chrf_statistics(distinct: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``(*by, kind, n, in_hyp, in_ref, matched, pairs)`` per character and word order, from folded pairs."""
    kinds = {
        "char": ("hyp", "ref", chars_of, CHAR_ORDER),
        "word": ("hyp", "ref", lambda texts: words_of(texts, cut_words), WORD_ORDER),
    }
    pairs = _matched(distinct.select(*by, "copies", "hyp", "ref"), by, kinds)
    orders = [*_orders("char", CHAR_ORDER), *_orders("word", WORD_ORDER)]
    return _totals(pairs, by, orders, in_hyp="in_hyp", in_ref="in_ref", matched="matched")


def corpus_chrf(pairs: DataFrame, *by: str) -> DataFrame:
    """chrF++ (six character orders, two word orders, beta 2): ``(*by, chrf)``."""
    return _chrf(_distinct_pairs(pairs, by), by)


def _chrf(distinct: DataFrame, by: tuple[str, ...]) -> DataFrame:
    stats = chrf_statistics(distinct, by)
    scored = (F.col("in_hyp") > 0) & (F.col("in_ref") > 0)
    means = stats.groupBy(*by).agg(
        F.avg(F.when(scored, F.col("matched") / F.col("in_hyp"))).alias("p"),
        F.avg(F.when(scored, F.col("matched") / F.col("in_ref"))).alias("r"),
    )
    p, r, factor = F.col("p"), F.col("r"), BETA**2
    score = F.when(p + r > 0, 100 * (1 + factor) * p * r / (factor * p + r))
    return means.select(*by, F.coalesce(score, F.lit(0.0)).alias("chrf"))


def metrics_row(pairs: DataFrame, *by: str) -> DataFrame:
    """Both scores with their parts: one row, or one per group, a group of missing keys among them.

    ``(*by, bleu, precision_1, ..., brevity_penalty, hyp_len, ref_len, chrf, n)``, where ``n`` counts
    pairs. These are folded and dealt out once: both scores read the same exchange.
    """
    distinct = _distinct_pairs(pairs, by)
    bleu, chrf = _bleu(distinct, by), _chrf(distinct, by)
    both = _join_groups(bleu, chrf, by) if by else bleu.crossJoin(chrf)
    return both.select(*(c for c in both.columns if c != "pairs"), F.col("pairs").alias("n"))


def _join_groups(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Join on group keys, where missing equals missing."""
    named = right.withColumnsRenamed({c: f"_{c}" for c in by})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return left.join(named, same).drop(*[f"_{c}" for c in by])
