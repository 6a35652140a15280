"""Registering a query with its check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registered.inputs import Inputs, with_inputs

QUERIES: dict[str, Callable] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Decorator: ``fn(inputs)`` becomes a query of (spark, folder)."""

    def add(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            CHECKS[name] = with_inputs(sql)
        return fn

    return add


def r(c: str | Column, places: int = 6) -> Column:
    """Rounded for comparison, keeping the name of a plain column."""
    out = F.round(F.col(c) if isinstance(c, str) else c, places)
    return out.alias(c) if isinstance(c, str) else out


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All double columns rounded for comparison."""
    return df.select(*[r(c, places) if t == "double" else F.col(c) for c, t in df.dtypes])


def R(expr: str, places: int = 6) -> str:  # noqa: N802
    """The same rounding in the check SQL; adding 0 turns -0.0 into 0.0."""
    return f"(round(cast({expr} as double), {places}) + 0)"
