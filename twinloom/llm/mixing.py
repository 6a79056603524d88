"""Mixing by soft membership: domain posteriors, then rates whose expected token totals match.

A multinomial word classifier, fitted on a bounded sample of labelled rows, gives each document
a posterior over domains. Nonnegative rates r solve min |sum_i r_i n_i p_i - T|^2, in the measure
that makes all domains equally steep, by projected gradient steps from r = 1, where n are tokens, p posteriors and T the wanted totals. A step of a
document depends on its posterior only, so rows with equal (rounded) posteriors are added up once
and each step is one small aggregate. All of it is DataFrame functions.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.llm.common import BLANKS, columns_of, fresh
from twinloom.storage import cut_lineage

DOMAINS = ("clean", "low", "toxic")
# Wanted shares of all tokens.
TARGETS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}
# Labelled rows that the classifier is fitted on, at most about this many.
TRAIN_ROWS = 10_000
BUCKETS = 1 << 13
# Words added to each domain in the shares that they have in all of them.
LEAN = 4.0 * BUCKETS
# A longer text counts as so many words of its mean evidence, so that posteriors stay soft.
EVIDENCE = 40.0
# Posteriors are rounded to steps of 1 / GRID.
GRID = 200
STEPS = 60
# Steps without progress before it is given up.
PATIENCE = 10
TOLERANCE = 1e-4


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic > 0, 2).when(quality <= 0, 1).when(quality > 0, 0)


def _words(text: Column) -> Column:
    """Words between blanks; a text without any gives one empty word."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), BLANKS)


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _numbers(values: list[float]) -> Column:
    """A constant array; folded once when the plan is made."""
    return F.split(F.lit(",".join(f"{v:.4f}" for v in values)), ",").cast("array<double>")


class Classifier:
    """Log weights of each bucket and domain, and log priors."""

    def __init__(self, counts: dict[tuple[int, int], int], rows: dict[int, int]):
        present = [d for d in range(len(DOMAINS)) if rows.get(d)]
        total = sum(rows.values())
        self.prior = [math.log(rows[d] / total) if d in present else -math.inf for d in range(len(DOMAINS))]
        self.present = present
        pooled = [0] * BUCKETS
        sums = [0] * len(DOMAINS)
        for (d, b), n in counts.items():
            pooled[b] += n
            sums[d] += n
        share = [(n + 1) / (sum(sums) + BUCKETS) for n in pooled]
        # Rare buckets lean towards the share they have in all domains.
        self.weights = [
            [math.log((counts.get((d, b), 0) + LEAN * share[b]) / (sums[d] + LEAN)) for b in range(BUCKETS)]
            for d in range(len(DOMAINS))
        ]

    def add_posteriors(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with the rounded posteriors of ``text``, in whole numbers of 1 / GRID.

        Unfitted, all of it is the first domain's. The sums over words are a column of their own
        first, as each domain's share reads all of them.
        """
        if len(self.present) < 2:
            only = self.present[0] if self.present else 0
            return df.withColumn(name, F.array(*[F.lit(GRID if d == only else 0) for d in range(len(DOMAINS))]))
        base, others = self.present[0], self.present[1:]
        odds = [
            _numbers([a - b for a, b in zip(self.weights[d], self.weights[base], strict=True)]) for d in others
        ]
        # The last entry counts the words.
        sums = F.aggregate(
            F.transform(_words(F.col("text")), _bucket),
            F.array(*[F.lit(0.0)] * (len(others) + 1)),
            lambda acc, b: F.array(
                *[F.get(acc, i) + F.get(o, b) for i, o in enumerate(odds)], F.get(acc, len(others)) + 1
            ),
        )
        evidence, parts = fresh(df, "_evidence"), fresh(df, "_parts")
        scale = EVIDENCE / F.greatest(F.get(evidence, F.lit(len(others))), F.lit(EVIDENCE))
        logs = [F.get(evidence, F.lit(i)) * scale + (self.prior[d] - self.prior[base]) for i, d in enumerate(others)]
        chances = F.array(F.lit(1.0), *[F.exp(F.least(x, F.lit(50.0))) for x in logs])
        total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
        shares = {
            d: F.floor(F.get(parts, F.lit(i + 1)) / total * GRID + 0.5).cast("int") for i, d in enumerate(others)
        }
        shares[base] = F.greatest(F.lit(GRID) - sum(shares.values(), F.lit(0)), F.lit(0))
        rounded = F.array(*[shares.get(d, F.lit(0)).cast("int") for d in range(len(DOMAINS))])
        staged = df.withColumn(evidence, sums).withColumn(parts, chances)
        return staged.withColumn(name, rounded).drop(evidence, parts)


def fit_classifier(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Classifier:
    """Counts of hashed words by domain, over a sample of labelled rows chosen by hash of the id."""
    known = labels.select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("domain"))
    known = known.where("doc_id is not null and domain is not null")
    total = known.count()
    if total > rows:
        known = known.where(F.xxhash64("doc_id") / F.lit(2.0**64) + F.lit(0.5) <= rows / total)
    # About ``rows`` rows of two numbers, whatever the size of the tables.
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    words = chosen.select("domain", F.explode(_words(F.col("text"))).alias("word")).where("word <> ''")
    found = words.groupBy("domain", _bucket(F.col("word")).alias("bucket")).count()
    counts = {(r["domain"], r["bucket"]): r["count"] for r in found.collect()}
    sizes = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    return Classifier(counts, sizes if counts else {})


class Rates:
    """The gradient steps found; ``replayed`` repeats them for a posterior."""

    def __init__(self, steps: list[tuple[float, ...]], gap: float = 0.0):
        self.steps, self.gap = steps, gap

    def replayed(self, p: str, state: str = "r") -> Column:
        """For the posterior in column ``p``: ``r``, its rate, or ``y``, where the next gradient
        is taken. The steps are a constant, so the plan does not grow with them."""
        if not self.steps:
            return F.lit(1.0)
        names = [*(f"g{d}" for d in range(len(DOMAINS))), "b"]
        steps = json.dumps([dict(zip(names, step, strict=True)) for step in self.steps])
        kind = "array<struct<{}>>".format(",".join(f"{n}:double" for n in names))
        moved = " + ".join(f"get(`{p}`, {d}) * s.g{d}" for d in range(len(DOMAINS)))
        r = f"greatest(acc.y - ({moved}) / {GRID}, 0D)"
        return F.expr(
            f"aggregate(from_json('{steps}', '{kind}'), named_struct('r', 1D, 'y', 1D), (acc, s) -> "
            f"named_struct('r', {r}, 'y', {r} + s.b * ({r} - acc.r))).{state}"
        )


def fit_rates(groups: DataFrame, targets: dict[str, float], steps: int = STEPS) -> Rates:
    """Accelerated projected gradient over ``(p, n)``: distinct posteriors and their tokens.

    Each step is one aggregate over at most as many rows as the posterior grid has points, and
    brings one sum for each domain to the driver. It ends when the targets are met, or when
    steps stop helping, as with a target for a domain that no document belongs to.
    """
    groups = cut_lineage(groups)
    total = groups.agg(F.sum("n")).first()[0] or 0
    if not total:
        return Rates([])
    want = [targets.get(d, 0.0) for d in DOMAINS]
    # Gaps are weighed by the inverse of sum n p p' / total: in that measure all directions have
    # curvature one, so steps of length one are safe and few are needed.
    size = range(len(DOMAINS))
    second = groups.selectExpr(*[f"sum(n * p[{i}] * p[{j}]) / {GRID * GRID}D" for i in size for j in size]).first()
    weigh = np.linalg.pinv(np.reshape(second, (len(DOMAINS), -1)) / total, rcond=1e-6)
    rates, momentum, before, best, since = Rates([]), 1.0, math.inf, math.inf, 0
    while len(rates.steps) < steps and since < PATIENCE:
        placed = groups.select("p", "n", rates.replayed("p", "y").alias("y"))
        at = placed.selectExpr(*[f"sum(y * n * p[{d}]) / {GRID}" for d in size]).first()
        gaps = np.array(at) / total - want
        gap = float(np.abs(gaps).max())
        if gap < TOLERANCE:
            break
        best, since = (gap, 0) if gap < 0.98 * best else (best, since + 1)
        # Momentum starts anew where it has carried too far.
        momentum = 1.0 if gap > before else momentum
        following, before = (1 + math.sqrt(1 + 4 * momentum**2)) / 2, gap
        rates = Rates([*rates.steps, (*(weigh @ gaps).tolist(), (momentum - 1) / following)], gap)
        momentum = following
    return rates


def _measured(docs: DataFrame, model: Classifier) -> DataFrame:
    words = F.filter(_words(F.col("text")), lambda w: w != "")
    source = docs.select("doc_id", "text", F.size(words).cast("long").alias("n_tokens"))
    return model.add_posteriors(source, "p").drop("text")


def _rate_table(measured: DataFrame, targets: dict[str, float]) -> DataFrame:
    """``(p, rate)`` of each distinct posterior: at most as many rows as the grid has points."""
    groups = cut_lineage(measured.groupBy("p").agg(F.sum("n_tokens").alias("n")))
    return cut_lineage(groups.select("p", fit_rates(groups, targets).replayed("p").alias("rate")))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, p_<domain>..., rate``.

    A missing or empty text has no tokens, its posterior is that of one empty word. Repeated rows
    get equal rates. Without labels every rate moves the first domain only; an empty table gives
    no rows.
    """
    measured = cut_lineage(_measured(docs, fit_classifier(docs, labels)))
    rates = _rate_table(measured, targets)
    shares = [(F.get("p", F.lit(i)) / GRID).alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    # The table of rates has at most (GRID + 1) (GRID + 2) / 2 rows.
    placed = measured.join(F.broadcast(rates), "p")
    return placed.select("doc_id", "n_tokens", *shares, F.round("rate", 6).alias("rate"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``docs`` with each row as often as its rate says, all columns unchanged.

    A row appears floor(rate) times, and once more if the hash of its id and text falls below the
    rest, so the expected token totals are those of the rates, and a rerun makes the same choice.
    Equal rows get the same number of copies each. A missing or empty text has no tokens, and the
    posterior of one empty word. Without labels every rate moves the first domain only; an empty
    table gives no rows.
    """
    model = fit_classifier(docs, labels)
    rates = _rate_table(_measured(docs, model), targets)
    copies, rate, p = (fresh(docs, c) for c in ("_copies", "_rate", "_posterior"))
    known = rates.select(F.col("p").alias(p), F.col("rate").alias(rate))
    rows = model.add_posteriors(docs, p).join(F.broadcast(known), p)
    drawn = F.xxhash64("doc_id", "text") / F.lit(2.0**64) + F.lit(0.5)
    times = F.floor(F.col(rate)) + (drawn < F.col(rate) - F.floor(F.col(rate))).cast("long")
    repeated = rows.select(*columns_of(docs), F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias(copies))
    return repeated.select(columns_of(docs))
