"""Text normalisation as native column expressions.

Each step is a column expression of its own: punctuation and non-printing characters in
whole-stage codegen, the Unicode compatibility step in Arrow batches. ``preprocess`` makes all
three in one pass over an Arrow batch, from the same rules, and looks for a rule's pattern only in
texts that hold the characters which it cannot do without.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache, reduce
from typing import NamedTuple
from unicodedata import category, combining, decomposition, normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The kernels travel inside the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NBSP = "\u00a0"


class Rule(NamedTuple):
    """One substitution; ``regex`` rules use Java pattern syntax and ``$n`` groups."""

    find: str
    put: str
    regex: bool = False
    needs: str = ""  # every match of a regex rule holds this


# The Moses punctuation-normalisation rules, in application order.
# Runs of blanks are matched as " {2,}", which leaves single blanks untouched.
# \p{Nd} is the Unicode decimal-digit class that "\d" means in Python.
SPACING_RULES = (
    Rule("\r", ""),
    Rule("(", " ("),
    Rule(")", ") "),
    Rule(" {2,}", " ", regex=True, needs="  "),
    Rule(r"\) ([.!:?;,])", ")$1", regex=True, needs=") "),
    Rule("( ", "("),
    Rule(" )", ")"),
    Rule(r"(\p{Nd}) %", "$1%", regex=True, needs=" %"),
    Rule(" :", ":"),
    Rule(" ;", ";"),
)
BACKTICK_RULES = (
    Rule("`", "'"),
    Rule("''", ' " '),
)
QUOTE_AND_DASH_RULES = (
    Rule("„", '"'),
    Rule("“", '"'),
    Rule("”", '"'),
    Rule("–", "-"),
    Rule("—", " - "),
    Rule(" {2,}", " ", regex=True, needs="  "),
    Rule("´", "'"),
    # A quote between two letters and a quote elsewhere both become an apostrophe.
    Rule("‘", "'"),
    Rule("‚", "'"),
    Rule("’", "'"),
    Rule("''", '"'),
    Rule("…", "..."),
)
FRENCH_QUOTE_RULES = (
    Rule(f"{NBSP}«{NBSP}", '"'),
    Rule(f"«{NBSP}", '"'),
    Rule("«", '"'),
    Rule(f"{NBSP}»{NBSP}", '"'),
    Rule(f"{NBSP}»", '"'),
    Rule("»", '"'),
)
PSEUDO_SPACE_RULES = (
    Rule(f"{NBSP}%", "%"),
    Rule(f"nº{NBSP}", "nº "),
    Rule(f"{NBSP}:", ":"),
    Rule(f"{NBSP}ºC", " ºC"),
    Rule(f"{NBSP}cm", " cm"),
    Rule(f"{NBSP}?", "?"),
    Rule(f"{NBSP}!", "!"),
    Rule(f"{NBSP};", ";"),
    Rule(f",{NBSP}", ", "),
    Rule(" {2,}", " ", regex=True, needs="  "),
)
QUOTE_COMMA_RULES = {
    "en": (Rule(r'"([,.]+)', '$1"', regex=True, needs='"'),),
    **dict.fromkeys(
        ("de", "es", "fr"),
        (
            Rule(',"', '",'),
            Rule(r'(\.+)"(\s*[^<])', '"$1$2', regex=True, needs='."'),
        ),
    ),
}
DIGIT_GROUP_RULES = {
    **dict.fromkeys(
        ("de", "es", "cz", "cs", "fr"),
        (Rule(rf"(\p{{Nd}}){NBSP}(\p{{Nd}})", "$1,$2", regex=True, needs=NBSP),),
    ),
}
DIGIT_GROUP_DEFAULT = (Rule(rf"(\p{{Nd}}){NBSP}(\p{{Nd}})", "$1.$2", regex=True, needs=NBSP),)

# The characters Python's str.strip() and str.split() treat as blank.
PY_WHITESPACE = "".join(
    map(
        chr,
        (
            *range(0x09, 0x0E),
            *range(0x1C, 0x21),
            0x85,
            0xA0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
        ),
    )
)
PY_WHITESPACE_CLASS = f"[{PY_WHITESPACE}]"


def punct_rules(lang: str = "en") -> tuple[Rule, ...]:
    """The rule sequence for one language; unknown languages get the common rules."""
    return (
        *SPACING_RULES,
        *BACKTICK_RULES,
        *QUOTE_AND_DASH_RULES,
        *FRENCH_QUOTE_RULES,
        *PSEUDO_SPACE_RULES,
        *QUOTE_COMMA_RULES.get(lang, ()),
        *DIGIT_GROUP_RULES.get(lang, DIGIT_GROUP_DEFAULT),
    )


def _substitute(text: Column, rule: Rule) -> Column:
    if rule.regex:
        return F.regexp_replace(text, rule.find, rule.put)
    return F.replace(text, F.lit(rule.find), F.lit(rule.put))


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode blanks."""
    return F.btrim(text, F.lit(PY_WHITESPACE))


def normalize_punct(text: Column, lang: str = "en") -> Column:
    """Moses-style punctuation normalisation."""
    return strip(reduce(_substitute, punct_rules(lang), text))


def replace_nonprint(text: Column, replace_by: str = " ") -> Column:
    """Replace every control, format, private-use and unassigned character.

    Category membership follows this Python's Unicode tables.
    """
    quoted = re.sub(r"([\\$])", r"\\\1", replace_by)
    return F.regexp_replace(text, nonprint_pattern(), quoted)


@lru_cache(maxsize=1)
def nonprint_pattern() -> str:
    """What the JVM's older tables call non-printing, without what has been assigned since.

    The first part decides for nearly every character, so the long list is hardly read.
    """
    printing = [category(chr(c))[0] != "C" for c in range(0x110000)]
    edges = [c for c in range(0x110000) if printing[c] != (c > 0 and printing[c - 1])]
    ranges = zip(edges[::2], [*edges[1::2], 0x110000], strict=False)
    listed = "".join(rf"\x{{{a:x}}}-\x{{{b - 1:x}}}" for a, b in ranges)
    return rf"[\p{{C}}&&[^{listed}]]"


# Bytes of text whose code points are looked at together.
CHECKED_TOGETHER = 4 << 20

# Hangul vowels and final consonants, which join the letter before by rule, not by table.
HANGUL_PARTS = (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))


@lru_cache(maxsize=1)
def unsettled_points() -> np.ndarray:
    """Code points with which a text may change by NFKC.

    Such a character changes by itself, takes part in the order of marks, or can join the character
    before. A text without any is normalised as it stands.
    """
    found = set(HANGUL_PARTS)
    for point in (*range(0xD800), *range(0xE000, 0x110000)):
        char = chr(point)
        parts = decomposition(char)
        if combining(char) or (parts and normalize("NFKC", char) != char):
            found.add(point)
        if parts and parts[0] != "<":
            found.update(int(p, 16) for p in parts.split()[1:])
    return np.array(sorted(found), dtype=np.int32)


def unsettled_rows(text: pa.Array, points: np.ndarray) -> np.ndarray:
    """Rows of a string array that hold one of the code points."""
    table = np.zeros(0x110000, dtype=bool)
    table[points] = True
    return flagged_rows(text, table)


def flagged_rows(text: pa.Array, table: np.ndarray) -> np.ndarray:
    """Rows of a string array that hold a code point which ``table`` marks."""
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    found, start = [np.empty(0, dtype=np.int64)], 0
    while start < len(text):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHECKED_TOGETHER, side="right")) - 1)
        raw = memoryview(data)[offsets[start] : offsets[stop]] if data is not None else b""
        flagged = table[np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32)]
        if flagged.any():
            # The byte that each character begins at tells its row.
            begins = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[flagged] + offsets[start]
            found.append(np.searchsorted(offsets, begins, side="right") - 1)
        start = stop
    return np.unique(np.concatenate(found))


def composed(text: pa.Array, points: np.ndarray) -> pa.Array:
    """NFKC of a string array; only texts with one of the code points are normalised one by one."""
    text = text.cast(pa.string())
    if pc.all(pc.string_is_ascii(text)).as_py() is not False:
        return text
    rows = unsettled_rows(text, points)
    if not len(rows):
        return text
    changed = [normalize("NFKC", t) for t in text.take(pa.array(rows)).to_pylist()]
    mask = np.zeros(len(text), dtype=bool)
    mask[rows] = True
    return pc.replace_with_mask(text, pa.array(mask), pa.array(changed, pa.string()))


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition, one Arrow batch at a time."""
    points = unsettled_points()

    @F.arrow_udf(T.StringType())
    def compose(texts: pa.Array) -> pa.Array:
        return composed(texts, points)

    return compose(text)


class Cleaner:
    """Punctuation, non-printing characters and compatibility forms of a whole Arrow array.

    Python patterns spell what the rules say in Java's; blanks in a rule are those of ASCII.
    """

    def __init__(self, rules: list[tuple], nonprint: str, flags: np.ndarray, replace_by: str):
        self.rules, self.nonprint, self.flags, self.replace_by = rules, nonprint, flags, replace_by

    def punctuated(self, text: str) -> str:
        for needed, pattern, put in self.rules:
            if needed in text:
                text = pattern.sub(put, text) if pattern else text.replace(needed, put)
        return text.strip()

    def settled(self, text: str) -> str:
        return normalize("NFKC", re.sub(self.nonprint, lambda _: self.replace_by, text))

    def __call__(self, texts: pa.Array) -> pa.Array:
        """Missing texts stay missing."""
        made = []
        for text in texts.to_pylist():
            if text is not None:
                text = self.punctuated(text)
                # The non-printing characters that texts are full of.
                if self.replace_by.isprintable():
                    text = text.replace("\n", self.replace_by).replace("\t", self.replace_by)
            made.append(text)
        clean = pa.array(made, pa.string())
        rows = flagged_rows(clean, np.unpackbits(self.flags).view(bool))
        if not len(rows):
            return clean
        for row in rows.tolist():
            made[row] = self.settled(made[row])
        return pa.array(made, pa.string())


def cleaner(lang: str = "en", replace_by: str = " ") -> Cleaner:
    """What ``preprocess`` does, for use inside tasks; tables are made here and sent along."""
    rules = [
        (r.needs, re.compile(_python_pattern(r.find)), re.sub(r"\$(\d)", r"\\\1", r.put)) if r.regex else (r.find, None, r.put)
        for r in punct_rules(lang)
    ]
    return Cleaner(rules, *_nonprint(), replace_by)


def _python_pattern(java: str) -> str:
    return java.replace(r"\p{Nd}", r"\d").replace(r"\s", r"[ \t\n\x0b\f\r]")


@lru_cache(maxsize=1)
def _nonprint() -> tuple[str, np.ndarray]:
    """A pattern of the non-printing characters; as bits, these and the points that NFKC may change."""
    hidden = np.array([category(chr(c))[0] == "C" for c in range(0x110000)])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hidden, [False]])))
    listed = "".join(rf"\U{a:08x}-\U{b - 1:08x}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    flagged = hidden.copy()
    flagged[unsettled_points()] = True
    return f"[{listed}]", np.packbits(flagged)


def preprocess(text: Column, lang: str = "en", replace_by: str = " ") -> Column:
    """Punctuation, then non-printing characters, then compatibility forms, one Arrow batch at a time."""
    clean = cleaner(lang, replace_by)

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return clean(texts.cast(pa.string()))

    return run(text)


def collapse_blanks(text: Column) -> Column:
    """Trim and reduce every run of blanks to one space."""
    return F.btrim(F.regexp_replace(text, PY_WHITESPACE_CLASS + "+", " "))


def chars(text: Column) -> Column:
    """Array of code points; empty text gives an empty array."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def words(text: Column) -> Column:
    """Array of blank-separated words; blank text gives an empty array."""
    flat = collapse_blanks(text)
    return F.filter(F.split(flat, " "), lambda w: w != "")
