"""Tokenisers and n-gram counts of the translation scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinloom.functions.text import PY_WHITESPACE, PY_WHITESPACE_CLASS, words

# The "13a" tokeniser.
UNESCAPE = (
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
)
TOKENIZE_13A = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([.,])", "$1 $2 "),
    (r"([.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)
ASCII_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def spaced_13a(text: Column) -> Column:
    """The text with blanks between its tokens."""
    trimmed = F.rtrim(text, F.lit(PY_WHITESPACE))
    plain = reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), UNESCAPE, trimmed)
    padded = F.concat(F.lit(" "), plain, F.lit(" "))
    return reduce(lambda c, r: F.regexp_replace(c, *r), TOKENIZE_13A, padded)


def tokenize_13a(text: Column) -> Column:
    """Tokens of the default BLEU tokeniser."""
    return words(spaced_13a(text))


def chrf_words(text: Column) -> Column:
    """Words with one trailing, else one leading, punctuation mark split off."""

    def cut(word: Column) -> Column:
        size = F.length(word)
        last, first = F.substring(word, -1, 1), F.substring(word, 1, 1)
        return (
            F.when(size == 1, F.array(word))
            .when(F.position(last, F.lit(ASCII_PUNCT)) > 0, F.array(word.substr(F.lit(1), size - 1), last))
            .when(
                F.position(first, F.lit(ASCII_PUNCT)) > 0,
                F.array(first, word.substr(F.lit(2), size - 1)),
            )
            .otherwise(F.array(word))
        )

    return F.flatten(F.transform(words(text), cut))


def drop_blanks(text: Column) -> Column:
    return F.regexp_replace(text, PY_WHITESPACE_CLASS + "+", "")


def ngram_count(size: Column, n: int) -> Column:
    """How many n-grams a list or text of this size has."""
    return F.greatest(size - n + 1, F.lit(0))
