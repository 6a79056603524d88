"""Language registry and translation directions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Language(NamedTuple):
    name: str
    code: str
    column: str


# Display name, language code and text column.
RUSSIAN = Language("Русский", "rus_Cyrl", "ru")
LEZGIAN = Language("Лезги чlал", "lez_Cyrl", "lez")
LANGUAGES = (RUSSIAN, LEZGIAN)


def resolve_lang(name: Column) -> Column:
    """Display name to code; anything else passes through."""
    pairs = [F.lit(part) for lang in LANGUAGES for part in (lang.name, lang.code)]
    return F.coalesce(F.create_map(*pairs)[name], name)


def code_of(name: str) -> str:
    """Code of a display name known while planning; anything else passes through."""
    return next((lang.code for lang in LANGUAGES if lang.name == name), name)


def column_of(name: str) -> str:
    """Text column of a language, given by code or display name while planning."""
    for lang in LANGUAGES:
        if lang.code == code_of(name):
            return lang.column
    raise KeyError(name)


def text_in(code: Column) -> Column:
    """Text of the language whose code is in ``code``; null for unknown codes."""
    first, *rest = LANGUAGES
    chosen = F.when(code == first.code, F.col(first.column))
    for lang in rest:
        chosen = chosen.when(code == lang.code, F.col(lang.column))
    return chosen


def check_direction(src: str, tgt: str) -> tuple[Language, Language]:
    """Validate a direction known while planning."""
    for pair in (LANGUAGES, LANGUAGES[::-1]):
        if (pair[0].code, pair[1].code) == (src, tgt):
            return pair
    raise ValueError(f"not a supported direction: {src} -> {tgt}")


def assert_direction(src: Column, tgt: Column) -> Column:
    """``src>tgt`` label of a per-row direction; the job fails on an unsupported one."""
    label = F.concat_ws(">", src, tgt)
    valid = [f"{a.code}>{b.code}" for a, b in (LANGUAGES, LANGUAGES[::-1])]
    problem = F.concat(F.lit("not a supported direction: "), label)
    return F.when(label.isin(valid), label).otherwise(F.raise_error(problem).cast("string"))
