"""Batch inference with a user-supplied translator."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from types import ModuleType
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.functions.languages import LEZGIAN, RUSSIAN, code_of, column_of
from twinloom.functions.text import preprocess
from twinloom.functions.tokens import (
    NEW_TOKENS_BASE,
    NEW_TOKENS_PER_INPUT,
    TRANSLATE_MAX_LENGTH,
)

# The options travel inside the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class TranslateOptions:
    """Generation settings handed to the translator; ``extra`` passes through untouched."""

    src_lang: str = LEZGIAN.code
    tgt_lang: str = RUSSIAN.code
    a: float = NEW_TOKENS_BASE
    b: float = NEW_TOKENS_PER_INPUT
    max_input_length: int = TRANSLATE_MAX_LENGTH
    num_beams: int = 1
    extra: dict[str, Any] = field(default_factory=dict)


    def __post_init__(self):
        """Languages may be given by name or by code."""
        for side in ("src_lang", "tgt_lang"):
            object.__setattr__(self, side, code_of(getattr(self, side)))


Translator = Callable[[list[str], TranslateOptions], list[str]]


def _loaded(made_by: bytes) -> Translator:
    """The translator of a pickled factory, made once per Python worker and kept until another.

    It is kept in a module of its own, as this one may travel by value, anew with each task.
    """
    kept = sys.modules.setdefault("twinloom_translator", ModuleType("twinloom_translator")).__dict__
    if kept.get("made_by") != made_by:
        kept.update(made_by=made_by, translator=cloudpickle.loads(made_by)())
    return kept["translator"]


def translate(
    df: DataFrame,
    factory: Callable[[], Translator],
    options: TranslateOptions | None = None,
    text: str = "text",
    out: str = "translation",
) -> DataFrame:
    """Add ``out``, the translation of ``text``.

    ``factory`` runs once per Python worker, which lives through many tasks. Batches
    stream through the task; ``spark.sql.execution.arrow.maxRecordsPerBatch`` sets their size.
    Missing texts stay missing and never reach the translator.
    """
    settings = options or TranslateOptions()
    made_by = cloudpickle.dumps(factory)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        translator = None
        for batch in batches:
            translator = translator or _loaded(made_by)
            source = batch.column(text).to_pylist()
            todo = [i for i, value in enumerate(source) if value is not None]
            answers = translator([source[i] for i in todo], settings)
            if len(answers) != len(todo):
                raise ValueError(f"{len(todo)} texts in, {len(answers)} translations out")
            result: list[str | None] = [None] * len(source)
            for i, answer in zip(todo, answers):
                result[i] = answer
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(result, pa.string())], [*batch.schema.names, out]
            )

    return df.mapInArrow(run, schema)


def translate_list(
    spark, sentences: list[str], factory: Callable[[], Translator], options: TranslateOptions | None = None
) -> DataFrame:
    rows = [(i, s) for i, s in enumerate(sentences)]
    return translate(spark.createDataFrame(rows, "id long, text string"), factory, options)


def translate_split(
    pairs: DataFrame, factory: Callable[[], Translator], options: TranslateOptions | None = None
) -> DataFrame:
    """Add ``hyp`` and ``ref`` to every pair of a split; pairs with a missing side are dropped.

    The translator gets the normalised source, and ``ref`` is the normalised target.
    """
    settings = options or TranslateOptions(src_lang=RUSSIAN.code, tgt_lang=LEZGIAN.code)
    source, target = column_of(settings.src_lang), column_of(settings.tgt_lang)
    known = pairs.na.drop(subset=[source, target])
    ready = known.withColumns({"_source": preprocess(F.col(source)), "ref": preprocess(F.col(target))})
    return translate(ready, factory, settings, text="_source", out="hyp").drop("_source")
