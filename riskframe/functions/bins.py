"""Binning expressions.  Which side of a bin is closed is always an argument:
bands and quantile bins are right-closed, histogram and display bins left-closed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.functions.exprs import col


def bin_index(c: str | Column, inner_edges: Sequence[float], closed: str) -> Column:
    """0-based bin of a value between inner edges e1 < e2 < ...; the outer bins
    are open-ended.  Null stays null."""
    c = col(c)
    if closed not in ("left", "right"):
        raise ValueError("closed must be 'left' or 'right'")
    if not inner_edges:
        return F.when(c.isNotNull(), F.lit(0))
    expr = F.when(c.isNull(), F.lit(None).cast("int"))
    for i, edge in enumerate(inner_edges):
        inside = c <= F.lit(edge) if closed == "right" else c < F.lit(edge)
        expr = expr.when(inside, F.lit(i))
    return expr.otherwise(F.lit(len(inner_edges)))


def band(c: str | Column, inner_edges: Sequence[float], labels: Sequence[str], closed: str) -> Column:
    """Label of the bin a value falls into; null stays null."""
    if len(labels) != len(inner_edges) + 1:
        raise ValueError("need one label more than inner edges")
    c = col(c)
    if not inner_edges:
        return F.when(c.isNotNull(), F.lit(labels[0]))
    expr = F.when(c.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(inner_edges, labels):
        inside = c <= F.lit(edge) if closed == "right" else c < F.lit(edge)
        expr = expr.when(inside, F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def distinct_edges(edges: Sequence[float]) -> list[float]:
    """Ascending edges without repeats."""
    return sorted(set(float(e) for e in edges))


def open_ended(edges: Sequence[float]) -> list[float]:
    """Distinct edges with the outer two replaced by -inf and +inf; a constant
    column (one distinct edge) still gives one bin over everything."""
    e = distinct_edges(edges)
    if len(e) < 2:
        return [float("-inf"), float("inf")]
    return [float("-inf"), *e[1:-1], float("inf")]


def histogram_bin(c: str | Column, low: float, high: float, n_bins: int) -> Column:
    """0-based equal-width bin, left-closed, the last bin closed on both sides."""
    c = col(c).cast("double")
    if high <= low:
        return F.when(c.isNotNull(), F.lit(0))
    width = (high - low) / n_bins
    raw = F.floor((c - F.lit(low)) / F.lit(width)).cast("int")
    return F.least(F.greatest(raw, F.lit(0)), F.lit(n_bins - 1))


def indexed_bin(index: Column, value: Column, edges: Sequence[Sequence[float]], closed: str) -> Column:
    """0-based bin of a long-form value by the inner edges of its feature number.
    One small expression for any number of features, where a CASE chain per
    feature would outgrow a compiled method."""
    table = F.array(*[F.array(*[F.lit(float(e)) for e in es]).cast("array<double>") for es in edges])
    below = (lambda e: e < value) if closed == "right" else (lambda e: e <= value)
    return F.when(value.isNotNull(), F.size(F.filter(F.get(table, index), below)))
