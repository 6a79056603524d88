"""Translate a split and score it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from twinloom.operators.scoring import metrics_row
from twinloom.operators.translate import TranslateOptions, Translator, translate_split
from twinloom.storage import cut_lineage


def evaluate(
    pairs: DataFrame,
    factory: Callable[[], Translator],
    options: TranslateOptions | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Scores of a split with their parts, as ``metrics_row`` gives them.

    Translation is the expensive step, and both scores read its result, so that is stored.
    """
    translated = translate_split(pairs, factory, options).select(*by, "hyp", "ref")
    return metrics_row(cut_lineage(translated), *by)
