"""Train/validation/test split in time order, stratified folds, exact seeded samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.config import TRAIN_FRACTION, VAL_FRACTION
from riskframe.functions.exprs import hash_order
from riskframe.operators.ordered import positions


def temporal_split(
    loans: DataFrame, date: str = "application_date", key: str = "loan_id",
    train_fraction: float = TRAIN_FRACTION, val_fraction: float = VAL_FRACTION, rows_per_task: int | None = None,
) -> DataFrame:
    """(key, date, position, split): oldest first, ties by key, cut at rounded shares."""
    ranked = positions(loans.select(key, F.to_date(date).alias(date)), [date, key], rows_per_task=rows_per_task)
    n = ranked.count()
    train_end, val_end = round(n * train_fraction), round(n * (train_fraction + val_fraction))
    split = F.when(F.col("position") <= train_end, "train").when(F.col("position") <= val_end, "val").otherwise("test")
    return ranked.withColumn("split", split)


def split_ranges(splits: DataFrame, date: str = "application_date") -> DataFrame:
    """First date, last date and size per split."""
    return splits.groupBy("split").agg(
        F.min(date).alias("min_date"), F.max(date).alias("max_date"), F.count("*").alias("n_loans"))


def stratified_folds(df: DataFrame, label: str, key: Sequence[str], k: int = 5, seed: int = 42, rows_per_task: int | None = None) -> DataFrame:
    """(key..., label, fold): fold sizes differ by at most one row within each class."""
    ranked = positions(
        df.select(*key, label).withColumn("_h", hash_order(key, seed)), ["_h", *key], [label], rows_per_task)
    return ranked.select(*key, label, ((F.col("position") - 1) % k).cast("int").alias("fold"))


def exact_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42, rows_per_task: int | None = None) -> DataFrame:
    """Exactly min(n, rows) rows, the same ones for the same seed."""
    ranked = positions(df.select(*key).withColumn("_h", hash_order(key, seed)), ["_h", *key], rows_per_task=rows_per_task)
    return df.join(ranked.where(F.col("position") <= n).select(*key), list(key), "left_semi")


def class_sizes(df: DataFrame, label: str) -> dict:
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def stratified_sample(df: DataFrame, label: str, key: Sequence[str], n: int, seed: int = 42, rows_per_task: int | None = None) -> DataFrame:
    """n rows with class shares kept (largest remainders get the spare rows)."""
    sizes = class_sizes(df, label)
    total = sum(sizes.values())
    if n >= total:
        return df
    share = {c: n * m / total for c, m in sizes.items()}
    quota = {c: int(s) for c, s in share.items()}
    for c in sorted(share, key=lambda c: (quota[c] - share[c], str(c)))[: n - sum(quota.values())]:
        quota[c] += 1
    return _class_heads(df, label, key, quota, seed, rows_per_task)


def undersample(df: DataFrame, label: str, key: Sequence[str], seed: int = 42, rows_per_task: int | None = None) -> DataFrame:
    """Every class reduced to the size of the smallest."""
    sizes = class_sizes(df, label)
    small = min(sizes.values())
    return _class_heads(df, label, key, {c: small for c in sizes}, seed, rows_per_task)


def _class_heads(df, label, key, quota, seed, rows_per_task):
    ranked = positions(
        df.select(*key, label).withColumn("_h", hash_order(key, seed)), ["_h", *key], [label], rows_per_task)
    keep = None
    for c, m in quota.items():
        test = (F.col(label) == F.lit(c)) & (F.col("position") <= m)
        keep = test if keep is None else keep | test
    return df.join(ranked.where(keep).select(*key), list(key), "left_semi")


def disjoint_pools(df: DataFrame, key: Sequence[str], rates: dict[str, float], seed: int = 42, rows_per_task: int | None = None) -> DataFrame:
    """(key..., pool): disjoint random pools of round(n * rate) rows each; the rest null."""
    ranked = positions(df.select(*key).withColumn("_h", hash_order(key, seed)), ["_h", *key], rows_per_task=rows_per_task)
    n = ranked.count()
    pool, start = F.lit(None).cast("string"), 0
    for name, rate in rates.items():
        end = start + round(n * rate)
        pool = F.when((F.col("position") > start) & (F.col("position") <= end), F.lit(name)).otherwise(pool)
        start = end
    return ranked.select(*key, pool.alias("pool"))


def nudge_repeated_dates(df: DataFrame, key: str, date: str, order_by: Sequence[str], direction: int = 1) -> DataFrame:
    """Move repeated dates of a key by whole days until all are distinct; returns
    the rows with ``date`` replaced.

    In the direction of movement the k-th row of a key ends on
    max(own date, previous final date + 1), i.e. k plus the running maximum of
    (date - k).  Runs of a key that cannot touch are independent windows: they
    are cut where the count of rows so far leaves a gap in the days.
    """
    from pyspark.sql import Window

    sign = 1 if direction > 0 else -1
    n_day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date")) * sign
    per_day = df.groupBy(key, n_day.alias("_d")).agg(F.count("*").alias("_c"))
    by_day = Window.partitionBy(key).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    # First free day after each day's rows, from per-day counts only (one row per date).
    upto = per_day.withColumn("_cum", F.sum("_c").over(by_day))
    first = F.max(F.col("_d") - (F.col("_cum") - F.col("_c"))).over(by_day)
    start = upto.withColumn("_start", first + F.col("_cum") - F.col("_c")).select(key, "_d", "_start")
    within = positions(df.withColumn("_d", n_day), list(order_by), [key, "_d"])
    moved = within.join(start, [key, "_d"])
    new_day = F.date_add(F.lit("1970-01-01").cast("date"), ((F.col("_start") + F.col("position") - 1) * sign).cast("int"))
    return moved.withColumn(date, new_day).select(*df.columns)


def calibrate_intercept(df: DataFrame, logit: str, target_rate: float, low: float = -15.0, high: float = 15.0, tol: float = 1e-5, max_iter: int = 100) -> float:
    """Intercept at which the mean of sigmoid(logit + intercept) hits the target.
    Each step is one aggregate that evaluates several candidates at once."""
    grid = 16
    x = F.col(logit).cast("double")
    for _ in range(max_iter):
        points = [low + (high - low) * i / grid for i in range(grid + 1)]
        row = df.agg(*[F.avg(1.0 / (1.0 + F.exp(-(x + F.lit(b))))).alias(f"r_{i}") for i, b in enumerate(points)]).first()
        rates = list(row)
        best = min(range(grid + 1), key=lambda i: abs(rates[i] - target_rate))
        if abs(rates[best] - target_rate) < tol:
            return points[best]
        i = max([i for i in range(grid) if rates[i] <= target_rate], default=0)
        low, high = points[i], points[i + 1]
    return (low + high) / 2
