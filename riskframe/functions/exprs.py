"""Small column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: str | Column) -> Column:
    """Numeric value of a column; text that is no number and NaN become null."""
    v = col(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def day(c: str | Column) -> Column:
    """Date value of a column; text that is no date becomes null."""
    return col(c).try_cast("date")


def clip(c: str | Column, low=None, high=None) -> Column:
    """Bound a value; null passes through."""
    c = col(c)
    out = c
    if high is not None:
        out = F.when(c > F.lit(high), F.lit(high)).otherwise(out)
    if low is not None:
        out = F.when(c < F.lit(low), F.lit(low)).otherwise(out)
    return out


def at_least(c: str | Column, low: float) -> Column:
    """max(c, low), null staying null (``greatest`` would skip it)."""
    c = col(c).cast("double")
    return F.when(c.isNotNull(), F.greatest(c, F.lit(float(low))))


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    """n / d, null where d is zero or null."""
    return F.when(denominator != 0, numerator / denominator)


def record_key(columns: Sequence[str]) -> Column:
    """Key columns as text joined by '|'; a missing part is spelled 'nan'."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])


def hash_order(columns: Sequence[str], seed: int) -> Column:
    """Pseudo-random, reproducible sort value per row."""
    return F.xxhash64(*[F.col(c) for c in columns], F.lit(seed))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def compact(items: Sequence[Column]) -> Column:
    """Array of the non-null items, in the given order."""
    return F.array_compact(F.array(*items))


def number_text(c: str | Column) -> Column:
    """A double as text without exponent (12345678.5, not 1.23456785E7)."""
    v = col(c).cast("double")
    plain = v.cast("string")
    wide = F.regexp_replace(v.cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(F.abs(v) < 1e7, plain).otherwise(wide)
