"""Deterministic pseudo-randomness: every choice is a hash of keys.

A retried or re-read task makes the same choices again, which ``rand()`` does not
promise. md5 keeps the choices reproducible in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hashed(hex_digits: int, parts: tuple[Column | str | int, ...]) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    joined = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, hex_digits), 16, 10).cast("bigint")


def hash32(*parts: Column | str | int) -> Column:
    """Uniform integer in [0, 2**32) from the "|"-joined parts."""
    return _hashed(8, parts)


def hash60(*parts: Column | str | int) -> Column:
    """Uniform integer in [0, 2**60): wide enough to draw from any number of rows."""
    return _hashed(15, parts)
