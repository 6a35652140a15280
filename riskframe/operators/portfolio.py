"""Operational and portfolio views of the prediction log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.config import (
    AGE_DISPLAY_CUTS,
    AGE_DISPLAY_LABELS,
    HIGH_RISK,
    INCOME_DISPLAY_CUTS,
    INCOME_DISPLAY_LABELS,
)
from riskframe.functions.bins import band
from riskframe.operators.quantiles import quantiles


def age_display_band(c="age"):
    return band(c, AGE_DISPLAY_CUTS, AGE_DISPLAY_LABELS, closed="left")


def income_display_band(c="annual_income"):
    return band(c, INCOME_DISPLAY_CUTS, INCOME_DISPLAY_LABELS, closed="left")


def in_window(predictions: DataFrame, start, end, model_id: str | None = None) -> DataFrame:
    """Predictions made from start 00:00 to the end of day ``end``."""
    day = F.col("created_at")
    inside = (day >= F.lit(str(start)).cast("timestamp_ntz")) & (day < F.date_add(F.lit(str(end)).cast("date"), 1).cast("timestamp_ntz"))
    out = predictions.where(inside)
    return out if model_id is None else out.where(F.col("model_id") == model_id)


def operational_aggregates() -> list:
    """Volume, decision mix, score and risk aggregates (shared with the stream)."""
    n = F.count("*")

    def share(cond):
        return F.when(n > 0, F.count_if(cond) / n)

    r = F.col("recommendation")
    return [
        n.cast("double").alias("prediction_volume"),
        share(r == "APPROVE").alias("approve_rate"), share(r == "REVIEW").alias("review_rate"),
        share(r == "REJECT").alias("reject_rate"), F.avg("credit_score").alias("avg_credit_score"),
        F.avg("default_probability").alias("avg_default_probability"),
        share(F.col("risk_category").isin(HIGH_RISK)).alias("high_risk_share"),
    ]


def operational_metrics(predictions: DataFrame) -> DataFrame:
    """One row of operational metrics; an empty log gives volume 0 and nulls."""
    q = quantiles(predictions, ["latency_ms"], [0.95])["latency_ms"]
    return predictions.agg(*operational_aggregates()).withColumn(
        "latency_p95_ms", F.lit(q[0] if q else None).cast("double"))


def kpis(predictions: DataFrame, threshold: float) -> DataFrame:
    n, r = F.count("*"), F.col("recommendation")
    high = F.count_if(F.col("risk_category").isin(HIGH_RISK))
    return predictions.agg(
        n.alias("total"), F.count_if(r == "APPROVE").alias("approved"), F.count_if(r == "REVIEW").alias("review"),
        F.count_if(r == "REJECT").alias("rejected"), (F.count_if(r == "APPROVE") / n).alias("approved_share"),
        (F.count_if(r == "REVIEW") / n).alias("review_share"), (F.count_if(r == "REJECT") / n).alias("rejected_share"),
        F.avg("credit_score").alias("avg_score"), F.avg("default_probability").alias("avg_default_probability"),
        (high / n).alias("high_risk_share"),
        F.avg((F.col("default_probability") >= threshold).cast("double")).alias("predicted_default_rate"),
    )


def daily_series(predictions: DataFrame, threshold: float) -> DataFrame:
    return predictions.groupBy(F.to_date("created_at").alias("date")).agg(
        F.count("*").alias("n"),
        F.avg((F.col("default_probability") >= threshold).cast("double")).alias("default_rate"),
    ).orderBy("date")


def segment_rates(predictions: DataFrame, threshold: float) -> DataFrame:
    """Predicted default rate by loan type, employment, income band and age band,
    all in one job; rows without the segment value are left out."""
    items = [
        F.struct(F.lit("loan_type").alias("segment"), F.col("loan_type").alias("value")),
        F.struct(F.lit("employment_type").alias("segment"), F.col("employment_type").alias("value")),
        F.struct(F.lit("income_band").alias("segment"), income_display_band().alias("value")),
        F.struct(F.lit("age_band").alias("segment"), age_display_band().alias("value")),
    ]
    flag = (F.col("default_probability") >= threshold).cast("double").alias("flag")
    long = predictions.select(flag, F.explode(F.array(*items)).alias("s")).select("flag", "s.*").where("value is not null")
    return long.groupBy("segment", "value").agg(F.avg("flag").alias("predicted_default_rate"))


def approval_rate(predictions: DataFrame, by: str = "loan_type") -> DataFrame:
    return predictions.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.avg((F.col("recommendation") == "APPROVE").cast("double")).alias("approval_rate")).orderBy(by)


def segment_table(predictions: DataFrame, dimensions: Sequence[str], threshold: float) -> DataFrame:
    """n, averages and rates (4 places) per value of every dimension, largest first."""
    items = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]
    long = predictions.select(
        "credit_score", "default_probability", (F.col("recommendation") == "APPROVE").alias("ok"),
        F.explode(F.array(*items)).alias("s"),
    ).select("*", "s.*").drop("s").where("value is not null")
    return long.groupBy("dimension", "value").agg(
        F.count("*").alias("n"), F.bround(F.avg("credit_score"), 4).alias("avg_score"),
        F.bround(F.avg("default_probability"), 4).alias("avg_default_probability"),
        F.bround(F.avg((F.col("default_probability") >= threshold).cast("double")), 4).alias("predicted_default_rate"),
        F.bround(F.avg(F.col("ok").cast("double")), 4).alias("approval_rate"),
    ).orderBy("dimension", F.desc("n"), "value")


def page(predictions: DataFrame, filters: dict, page: int = 1, page_size: int = 20, date_from=None, date_to=None) -> tuple[DataFrame, DataFrame]:
    """(rows of one page, newest first; one row with the total number of matches)."""
    out = predictions
    if date_from is not None:
        out = out.where(F.col("created_at") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to is not None:
        out = out.where(F.col("created_at") <= F.lit(date_to).cast("timestamp_ntz"))
    for c, v in filters.items():
        if v is not None:
            out = out.where(F.col(c) == F.lit(v))
    rows = out.orderBy(F.desc("created_at"), F.desc("prediction_id")).offset((page - 1) * page_size).limit(page_size)
    return rows, out.agg(F.count("*").alias("total"))


def any_of_filter(df: DataFrame, choices: dict[str, Sequence[str]]) -> DataFrame:
    """Rows whose column is among the chosen values; an empty choice does not filter."""
    for c, values in choices.items():
        if values:
            df = df.where(F.col(c).isin(list(values)))
    return df


def search(df: DataFrame, pattern: str, columns: Sequence[str]) -> DataFrame:
    """Rows where any column matches the pattern, case ignored; the pattern is a regular expression."""
    if not pattern:
        return df
    hit = F.lit(False)
    for c in columns:
        if c in df.columns:
            hit = hit | F.coalesce(F.col(c).cast("string").rlike(f"(?i){pattern}"), F.lit(False))
    return df.where(hit)


def newest(df: DataFrame, by: str, n: int = 2000, tie_break: Sequence[str] = ()) -> DataFrame:
    """The n newest rows for a report page."""
    return df.orderBy(F.desc(by), *tie_break).limit(n)


def pivot_mean(df: DataFrame, rows: str, columns: str, value: str, labels: Sequence | None = None) -> DataFrame:
    """Mean of a value by row and column label."""
    return df.groupBy(rows).pivot(columns, list(labels) if labels else None).agg(F.avg(value))


def pivot_sum(df: DataFrame, rows: str, columns: str, value: str, labels: Sequence | None = None) -> DataFrame:
    """Sum of a value by row and column label, absent cells 0."""
    return df.groupBy(rows).pivot(columns, list(labels) if labels else None).agg(F.sum(value)).na.fill(0)


def metric_history(metrics: DataFrame, model_id: str) -> DataFrame:
    """Stored metrics of one model, newest first."""
    return metrics.where(F.col("model_id") == model_id).orderBy(F.desc("created_at"), "metric_name")


def issue_trend_total(trend: DataFrame) -> DataFrame:
    return trend.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_issues"))
