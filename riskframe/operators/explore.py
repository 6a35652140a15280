"""Exploratory statistics: rates, summaries, deciles, WOE/IV, correlations, months.

All statistics over many columns run in long form, so k columns cost one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.config import IV_BANDS, LOW_CARDINALITY
from riskframe.functions.bins import distinct_edges, histogram_bin, indexed_bin
from riskframe.functions.exprs import number
from riskframe.functions.pvalues import correlation_p
from riskframe.operators.features import _corr
from riskframe.operators.quantiles import quantiles


def default_rate_summary(df: DataFrame, target: str) -> DataFrame:
    """n, n_default, n_non_default, default_rate."""
    y = F.col(target).cast("int")
    out = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(y), F.lit(0)).cast("long").alias("n_default"))
    return out.select(
        "n", "n_default", (F.col("n") - F.col("n_default")).alias("n_non_default"),
        F.when(F.col("n") > 0, F.col("n_default") / F.col("n")).alias("default_rate"),
    )


def numeric_summary(df: DataFrame, columns: Sequence[str], skew_threshold: float = 1.0) -> DataFrame:
    """Count, spread, quartiles, skew and excess kurtosis per column."""
    q = quantiles(df, columns, [0.25, 0.5, 0.75])
    items = []
    for c in columns:
        v = number(c)
        n = F.count(v)
        quart = q[c] or [None, None, None]
        skew = F.when((n > 2) & (F.max(v) > F.min(v)), F.skewness(v))
        items.append(F.struct(
            F.lit(c).alias("feature"), n.alias("n"), (F.count("*") - n).alias("n_missing"), F.avg(v).alias("mean"),
            F.when(n > 1, F.stddev_samp(v)).alias("std"), F.min(v).alias("min"),
            F.lit(quart[0]).cast("double").alias("p25"), F.lit(quart[1]).cast("double").alias("median"),
            F.lit(quart[2]).cast("double").alias("p75"), F.max(v).alias("max"),
            skew.alias("skew"), F.when((n > 2) & (F.max(v) > F.min(v)), F.kurtosis(v)).alias("kurtosis"),
            F.coalesce(F.abs(skew) > skew_threshold, F.lit(False)).alias("log_transform_flag"),
        ))
    return df.agg(F.array(*items).alias("a")).select(F.inline("a"))


def _long(df: DataFrame, columns: Sequence[str], keep: Sequence[Column] = ()) -> DataFrame:
    """(feature, value as text) rows of several columns."""
    items = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(*keep, F.explode(F.array(*items)).alias("s")).select("*", "s.*").drop("s")


def categorical_frequency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and percentage per value of each column, nulls counted."""
    counts = _long(df, columns).groupBy("feature", "value").agg(F.count("*").alias("count"))
    total = df.agg(F.count("*")).scalar()
    return counts.withColumn("pct", F.bround(F.col("count") / total * 100, 2)).orderBy(
        "feature", F.desc("count"), "value")


def decile_counts(df: DataFrame, columns: Sequence[str], target: str, n_bins: int = 10) -> DataFrame:
    """feature, decile, min_value, max_value, n, n_default, default_rate for
    quantile bins; repeated edges merge bins, a constant column is one bin."""
    edges = quantiles(df, columns, [i / n_bins for i in range(n_bins + 1)])
    items = [F.struct(F.lit(i).alias("i"), F.lit(c).alias("feature"), number(c).alias("value")) for i, c in enumerate(columns)]
    rows = df.select(F.col(target).cast("int").alias("y"), F.explode(F.array(*items)).alias("s")).select("y", "s.*")
    inner = [distinct_edges(edges[c] or [])[1:-1] for c in columns]
    bins = indexed_bin(F.col("i"), F.col("value"), inner, "right")
    grouped = rows.where("value is not null").groupBy("feature", bins.alias("bin")).agg(
        F.count("*").alias("n"), F.sum("y").cast("long").alias("n_default"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
    )
    # At most n_bins rows per feature.
    decile = F.row_number().over(Window.partitionBy("feature").orderBy("bin"))
    return grouped.select(
        "feature", decile.alias("decile"), "min_value", "max_value", "n", "n_default",
        (F.col("n_default") / F.col("n")).alias("default_rate"),
    )


def default_rate_by_band(df: DataFrame, band: str, target: str, order: Sequence[str] | None = None) -> DataFrame:
    """n, n_default, default_rate per band, in the given or alphabetical order."""
    y = F.col(target).cast("int")
    out = df.where(F.col(band).isNotNull()).groupBy(band).agg(
        F.count(y).alias("n"), F.sum(y).cast("long").alias("n_default"))
    out = out.withColumn("default_rate", F.when(F.col("n") > 0, F.col("n_default") / F.col("n")))
    if order is None:
        return out.orderBy(F.col(band).cast("string"))
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(band).cast("string"))
    return out.orderBy(F.when(place > 0, place).asc_nulls_last())


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature_a, feature_b, n, r of every ordered pair over the rows that have both.

    Each partition multiplies its rows, as matrices, once: k x k sums come out of it,
    however many rows it has, and they add up.  Values are centred first, so that
    sums of squares keep their digits.  r is null where either side is constant."""
    cols = list(columns)
    data = df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(cols)])
    means = data.agg(*[F.coalesce(F.avg(F.when(F.abs(c) < float("inf"), F.col(c))), F.lit(0.0)) for c in data.columns]).first()
    centre, k = list(means), len(cols)

    # A nested function travels with its code, so executors need no copy of this package.
    def gram(batches):
        import numpy as np
        import pyarrow as pa

        sums = np.zeros((4, k, k))
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        rows = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                rows += part.num_rows
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns]).astype(float)
                has = ~np.isnan(x)
                x = np.where(has, x - centre, 0.0)
                m = has.astype(float)
                sums += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
                for j in range(k):
                    both = has & has[:, j:j + 1]
                    low[:, j] = np.minimum(low[:, j], np.where(both, x, np.inf).min(axis=0))
                    high[:, j] = np.maximum(high[:, j], np.where(both, x, -np.inf).max(axis=0))
        if rows:
            i, j = np.divmod(np.arange(k * k), k)
            values = [i, j, *(s.ravel() for s in sums), low.ravel(), high.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["i", "j", "n", "x", "xx", "xy", "low", "high"])

    parts = data.mapInArrow(gram, "i long, j long, n double, x double, xx double, xy double, low double, high double")
    total = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "xx", "xy")], F.min("low").alias("low"), F.max("high").alias("high"))
    other = total.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("x").alias("y"), F.col("xx").alias("yy"), F.col("low").alias("y_low"), F.col("high").alias("y_high"))
    n, spread = F.col("n"), lambda a, aa: F.col(aa) - F.col(a) * F.col(a) / F.col("n")
    varies = (F.col("high") > F.col("low")) & (F.col("y_high") > F.col("y_low"))
    r = F.when(varies, (F.col("xy") - F.col("x") * F.col("y") / n) / F.sqrt(spread("x", "xx") * spread("y", "yy")))
    label = F.array(*[F.lit(c) for c in cols])
    return total.join(other, ["i", "j"]).select(
        "i", "j", F.get(label, F.col("i").cast("int")).alias("feature_a"), F.get(label, F.col("j").cast("int")).alias("feature_b"), n.cast("long").alias("n"), r.alias("r"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations in long form, i < j."""
    return pair_moments(df, columns).where("i < j").select("feature_a", "feature_b", "r")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per feature, one column per feature."""
    pairs = pair_moments(df, columns)
    return pairs.groupBy(F.col("feature_a").alias("feature")).pivot("feature_b", list(columns)).agg(F.first("r"))


def high_correlation_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.8) -> DataFrame:
    return correlations(df, columns).where(F.abs("r") > threshold).orderBy(F.desc(F.abs("r")))


def point_biserial(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Correlation of each column with a 0/1 target and its p-value, strongest first."""
    y = F.col(target).cast("double")
    items = []
    for c in columns:
        both = F.when(number(c).isNotNull() & y.isNotNull(), F.lit(1))
        n = F.count(both)
        items.append(F.struct(
            F.lit(c).alias("feature"), n.alias("n"), F.when(n >= 3, _corr(number(c), y)).alias("point_biserial_r")))
    rows = df.agg(F.array(*items).alias("a")).select(F.inline("a")).collect()  # one row per feature
    out = [(r.feature, r.point_biserial_r, correlation_p(r.point_biserial_r, r.n)) for r in rows]
    return df.sparkSession.createDataFrame(out, "feature string, point_biserial_r double, p_value double").orderBy(
        F.desc(F.abs("point_biserial_r")))


def woe(bins: DataFrame) -> DataFrame:
    """Add ``woe`` and ``iv_part`` to bin counts (feature, n, n_default); an empty
    class in a bin counts as half a case."""
    e = F.when(F.col("n_default") == 0, F.lit(0.5)).otherwise(F.col("n_default").cast("double"))
    ne_raw = F.col("n") - F.col("n_default")
    ne = F.when(ne_raw == 0, F.lit(0.5)).otherwise(ne_raw.cast("double"))
    cases = bins.withColumns({"_e": e, "_ne": ne})
    totals = cases.groupBy("feature").agg(F.sum("_e").alias("_te"), F.sum("_ne").alias("_tne"))
    joined = cases.join(totals, "feature")
    good, bad = F.col("_ne") / F.col("_tne"), F.col("_e") / F.col("_te")
    return joined.withColumn("woe", F.ln(good / bad)).withColumn("iv_part", (good - bad) * F.col("woe")).drop(
        "_e", "_ne", "_te", "_tne")


def value_counts_by_target(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """feature, value, n, n_default per distinct value, nulls dropped."""
    rows = _long(df, columns, [F.col(target).cast("int").alias("y")]).where("value is not null")
    return rows.groupBy("feature", "value").agg(F.count("y").alias("n"), F.sum("y").cast("long").alias("n_default"))


def woe_iv_categorical(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    bins = value_counts_by_target(df, columns, target)
    return woe(bins).withColumn("default_rate", F.col("n_default") / F.col("n"))


def woe_iv_numeric(df: DataFrame, columns: Sequence[str], target: str, n_bins: int = 10) -> DataFrame:
    return woe(decile_counts(df, columns, target, n_bins))


def interpret_iv(iv: Column) -> Column:
    expr = None
    for upper, label in IV_BANDS:
        if upper is not None:
            expr = F.when(iv < upper, label) if expr is None else expr.when(iv < upper, label)
    return expr.otherwise(IV_BANDS[-1][1])


def low_cardinality(df: DataFrame, columns: Sequence[str], limit: int = LOW_CARDINALITY) -> list[str]:
    """Columns with at most ``limit`` distinct values.  The sketch rules out the
    clearly larger ones; only the rest is counted exactly, so those sets are small."""
    near = df.agg(*[F.approx_count_distinct(number(c), 0.02).alias(f"d_{i}") for i, c in enumerate(columns)]).first()
    maybe = [c for i, c in enumerate(columns) if near[f"d_{i}"] <= 2 * limit]
    if not maybe:
        return []
    exact = _long(df, maybe).where("value is not null").groupBy("feature").agg(F.count_distinct("value").alias("d"))
    few = {r.feature for r in exact.collect() if r.d <= limit}
    # A column without any value has no row above and zero distinct values.
    absent = {c for i, c in enumerate(columns) if near[f"d_{i}"] == 0}
    return [c for c in columns if c in few or c in absent]


def iv_table(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, n_bins: int = 10) -> DataFrame:
    """Information value per feature, strongest first.  A numeric column with few
    distinct values is binned by value, because its deciles would collapse."""
    few = low_cardinality(df, numeric) if numeric else []
    many = [c for c in numeric if c not in few]
    parts = []
    if few or categorical:
        parts.append(woe_iv_categorical(df, [*few, *categorical], target).select("feature", "iv_part"))
    if many:
        parts.append(woe_iv_numeric(df, many, target, n_bins).select("feature", "iv_part"))
    iv = reduce(DataFrame.unionByName, parts).groupBy("feature").agg(F.sum("iv_part").alias("iv"))
    kind = F.when(F.col("feature").isin(list(numeric)), "numeric").otherwise("categorical")
    return iv.select("feature", kind.alias("type"), "iv", interpret_iv(F.col("iv")).alias("interpretation")).orderBy(
        F.desc("iv"), "feature")


def monthly_rates(df: DataFrame, date: str, target: str) -> DataFrame:
    """Volume and default rate per calendar month."""
    y = F.col(target).cast("int")
    out = df.groupBy(F.date_format(F.to_date(date), "yyyy-MM").alias("month")).agg(
        F.count(y).alias("n"), F.sum(y).cast("long").alias("n_default"))
    return out.withColumn("default_rate", F.when(F.col("n") > 0, F.col("n_default") / F.col("n"))).orderBy("month")


def regime_shift(monthly: DataFrame, z_threshold: float = 2.0) -> DataFrame:
    """One row: mean and std of the monthly rate and the months beyond z_threshold."""
    mean = monthly.agg(F.avg("default_rate")).scalar()
    std = monthly.agg(F.coalesce(F.stddev_samp("default_rate"), F.lit(0.0))).scalar()
    rate = F.col("default_rate")
    far = (std > 0) & (F.abs(rate - mean) > std * z_threshold)
    return monthly.agg(
        F.avg(rate).alias("mean_default_rate"), F.coalesce(F.stddev_samp(rate), F.lit(0.0)).alias("std_default_rate"),
        # One entry per month at most.
        F.sort_array(F.collect_list(F.when(far, F.col("month")))).alias("flagged_months"),
    ).withColumn("regime_shift_detected", F.size("flagged_months") > 0)


def benchmarks(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict[str, dict]:
    """Median per numeric and most frequent value per categorical column (ties: smallest)."""
    out: dict[str, dict] = {}
    if numeric:
        out.update({c: {"median": q[0] if q else None} for c, q in quantiles(df, numeric, [0.5]).items()})
    if categorical:
        counts = _long(df, categorical).where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
        top = counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
        out.update({r.feature: {"mode": r["mode"]} for r in top.collect()})
    return out


def histogram(df: DataFrame, column: str, n_bins: int) -> DataFrame:
    """Equal-width bins from minimum to maximum, empty bins included."""
    v = number(column)
    low, high = df.agg(F.min(v), F.max(v)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_start double, bin_end double, n long")
    if high == low:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / n_bins
    counts = df.where(v.isNotNull()).groupBy(histogram_bin(v, low, high, n_bins).alias("bin")).agg(F.count("*").alias("n"))
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counts, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("bin_start"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("bin_end"), F.coalesce("n", F.lit(0)).alias("n"),
    ).orderBy("bin")


def ordered_counts(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Counts per category in a fixed order, absent ones as 0."""
    wanted = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(order)], f"place int, {column} string")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return wanted.join(counts, column, "left").select("place", column, F.coalesce("n", F.lit(0)).alias("n")).orderBy("place")
