"""Exact linear-interpolation quantiles of whole columns.

Columns with few distinct values (checked first) use the built-in exact
``percentile``.  Above that the maps of values of all partitions would meet in one
task, so a sketch brackets every wanted quantile, rows outside the brackets only add
to a few counters, and the distinct values inside are ranked with distributed running sums.  The ranks are verified
against exact counts; a bracket that missed its rank falls back to the whole
column, so the result is exact either way.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.bins import indexed_bin
from riskframe.functions.exprs import number
from riskframe.operators.ordered import running_sums

# Up to about this many distinct values the built-in exact percentile is used, however
# many rows there are: each partition hands its map of values to one task.
SMALL_COLUMN = 500
# Relative rank error of the sketch is 1 / ACCURACY; brackets reach 3 / ACCURACY around a quantile.
ACCURACY = 2_000
# Up to so many brackets of all columns are tested by plain comparisons before a value becomes a row.
MOST_TESTS = 64


def _merge(intervals: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[list[float]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _inside(value: Column, brackets: Sequence[tuple[float, float]]) -> Column:
    return reduce(or_, [(value >= F.lit(a)) & (value <= F.lit(b)) for a, b in brackets])


def _ranked(df, brackets: dict[str, list[tuple[float, float]]], wanted: dict[str, set[int]], rows_per_task):
    """Values at 0-based ranks; second result lists columns whose bracket missed.
    Zone 2*i+1 is bracket i.  Values outside of all brackets are only counted, column by
    column, and don't become rows."""
    names = list(brackets)
    below = df.agg(*[F.count_if(F.col(c) < F.lit(a)).alias(f"b_{i}_{j}") for i, c in enumerate(names) for j, (a, _) in enumerate(brackets[c])]).first()
    short = sum(map(len, brackets.values())) <= MOST_TESTS
    items = [F.struct(F.lit(i).alias("i"), F.col(c).alias("value")) for i, c in enumerate(names)]
    if short:
        items = [F.when(_inside(F.col(c), brackets[c]), item) for c, item in zip(names, items)]
    long = df.select(F.explode(F.array_compact(F.array(*items))).alias("s")).select("s.*").where("value is not null")
    zone = indexed_bin(F.col("i"), F.col("value"), [[a for a, _ in brackets[c]] for c in names], "left") + indexed_bin(
        F.col("i"), F.col("value"), [[b for _, b in brackets[c]] for c in names], "right")
    counts = long.withColumn("zone", zone).where("zone % 2 = 1").groupBy("i", "zone", "value").agg(F.count("*").alias("n"))
    label = F.get(F.array(*[F.lit(c) for c in names]), F.col("i"))
    counts = counts.select(label.alias("feature"), "zone", "value", "n")
    ranked = running_sums(counts, ["value"], ["n"], ["feature", "zone"], rows_per_task)
    inside = {(r.feature, r.zone): r.n for r in ranked.groupBy("feature", "zone").agg(F.sum("n").alias("n")).collect()}
    targets, missed = [], []
    for i, (c, ranks) in enumerate(wanted.items()):
        for rank in ranks:
            places = ((2 * j + 1, rank - below[f"b_{i}_{j}"]) for j in range(len(brackets[c])))
            hit = next(((z, local) for z, local in places if 0 <= local < inside.get((c, z), 0)), None)
            if hit is None:
                missed.append(c)
                break
            targets.append((c, hit[0], rank, hit[1]))
    found: dict[str, dict[int, float]] = {}
    if targets:
        wanted_rows = df.sparkSession.createDataFrame(targets, "feature string, zone int, rank long, local long")
        hit = ranked.join(F.broadcast(wanted_rows), ["feature", "zone"]).where(
            (F.col("local") < F.col("cum_n")) & (F.col("local") >= F.col("cum_n") - F.col("n"))
        )
        for r in hit.select("feature", "rank", "value").collect():
            found.setdefault(r.feature, {})[r.rank] = r.value
    return found, missed


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    small_column: int | None = None,
    rows_per_task: int | None = None,
) -> dict[str, list[float] | None]:
    """Exact quantiles per column as fitted state on the driver (k x m numbers).
    A column without values maps to None."""
    small_column = SMALL_COLUMN if small_column is None else small_column
    cols = list(columns)
    data = df.select(*[number(c).alias(c) for c in cols])
    head = data.agg(
        *[F.count(c).alias(f"n_{i}") for i, c in enumerate(cols)],
        *[F.approx_count_distinct(c).alias(f"d_{i}") for i, c in enumerate(cols)],
    ).first()
    n = {c: head[f"n_{i}"] for i, c in enumerate(cols)}
    distinct = {c: head[f"d_{i}"] for i, c in enumerate(cols)}
    out: dict[str, list[float] | None] = {c: None for c in cols}
    small = [c for c in cols if n[c] and distinct[c] <= small_column]
    if small:
        row = data.agg(*[
            F.percentile(c, F.array(*[F.lit(float(p)) for p in probs])).alias(f"q_{i}") for i, c in enumerate(small)
        ]).first()
        out.update({c: list(row[f"q_{i}"]) for i, c in enumerate(small)})
    large = [c for c in cols if n[c] and distinct[c] > small_column]
    if large:
        m = len(probs)
        wanted = {c: {r for p in probs for r in (math.floor((n[c] - 1) * p), math.ceil((n[c] - 1) * p))} for c in large}
        margin = 3.0 / ACCURACY
        around = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
        sketch = data.agg(
            *[F.percentile_approx(c, around, ACCURACY).alias(f"a_{i}") for i, c in enumerate(large)]
        ).first()
        edges = {c: sketch[f"a_{i}"] for i, c in enumerate(large)}
        brackets = {c: _merge([(edges[c][j], edges[c][m + j]) for j in range(m)]) for c in large}
        found, missed = _ranked(data, brackets, wanted, rows_per_task)
        if missed:
            everything = {c: [(float("-inf"), float("inf"))] for c in missed}
            again, _ = _ranked(data, everything, {c: wanted[c] for c in missed}, rows_per_task)
            found.update(again)
        for c in large:
            qs = []
            for p in probs:
                pos = (n[c] - 1) * p
                lo, hi = math.floor(pos), math.ceil(pos)
                a, b = found[c][lo], found[c][hi]
                qs.append(a if a == b else a + (b - a) * (pos - lo))
            out[c] = qs
    return out
