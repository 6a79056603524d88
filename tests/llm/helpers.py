"""Small tables with the awkward cases that every operator must stand."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use themselves.
CLASHES = ["norm", "digest", "_salt", "_digest", "_norm", "_place", "fp", "_fp", "_keep", "_copies", "_rate", "ids", "n", "p"]


def documents(spark, rows, clashes: bool = False):
    """Rows of ``(doc_id, text)`` or ``(doc_id, text, lang)``."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
    schema = SCHEMA + "".join(f", `{c}` string" for c in CLASHES) if clashes else SCHEMA
    return spark.createDataFrame([(*r, *["x"] * len(CLASHES)) if clashes else r for r in full], schema)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def prose(seed: int, words: int = 60, vocabulary: int = 500) -> str:
    draw = random.Random(seed)
    pool = random.Random(7)
    spelled = ["".join(pool.choice("abcdefghijklmnoprstuvw") for _ in range(pool.randint(2, 8))) for _ in range(vocabulary)]
    out = []
    for i in range(words):
        out.append(draw.choice(spelled))
        if i % 12 == 11:
            out[-1] += ".\n" if draw.random() < 0.3 else "."
    return " ".join(out)


AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one"),
    (5, "x" * 20_000),
    (6, prose(6, 30_000)),
    (7, prose(7)),
    (7, prose(7)),
    (8, prose(7)),
    (None, prose(9)),
    (None, None),
    (10, "Ünïcödé 日本語 \U0001f916 é <|endoftext|> don't 12"),
]


def rows_of(df):
    return [tuple(r) for r in df.collect()]
