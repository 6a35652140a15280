"""Joins of the credit tables: point-in-time, label lookup, window reduction, latest row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.config import CREDIT_COLUMNS, CUSTOMER_COLUMNS, FINANCIAL_COLUMNS, LOAN_COLUMNS, MERGED_COLUMNS
from riskframe.operators.features import assert_no_leakage
from riskframe.operators.ordered import materialize

Tables = dict[str, DataFrame]


def asof_times(
    probes: DataFrame,
    snapshots: dict[str, DataFrame],
    by: str,
    at: str,
    slice_unit: str | None = None,
) -> DataFrame:
    """For every distinct (by, at) of ``probes`` the latest time <= at at which
    each snapshot table has a row: columns by, at and one per snapshot name.

    Snapshot tables have columns (by, at).  Only distinct (by, at) pairs travel,
    combined before the shuffle, so a key with very many rows costs one row per
    distinct time.  With dates that is at most a few thousand per key; for finer
    times give ``slice_unit`` ('day', 'month'): each key is then cut into time
    slices and only one carried value per slice crosses slices.
    """
    names = list(snapshots)
    tagged = [probes.select(by, at, F.lit(True).alias("_probe"), *[F.lit(False).alias(f"_in_{n}") for n in names])]
    tagged += [
        s.select(by, at, F.lit(False).alias("_probe"), *[F.lit(n == m).alias(f"_in_{n}") for n in names])
        for m, s in snapshots.items()
    ]
    points = (
        reduce(DataFrame.unionByName, tagged).where(F.col(by).isNotNull() & F.col(at).isNotNull())
        .groupBy(by, at).agg(F.max("_probe").alias("_probe"), *[F.max(f"_in_{n}").alias(f"_in_{n}") for n in names])
    )
    seen = {n: F.when(F.col(f"_in_{n}"), F.col(at)) for n in names}
    if slice_unit is None:
        w = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        out = points.select(by, at, "_probe", *[F.max(seen[n]).over(w).alias(n) for n in names])
        return out.where("_probe").drop("_probe")

    sliced = points.withColumn("_slice", F.date_trunc(slice_unit, at))
    carry_over = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sliced.groupBy(by, "_slice").agg(*[F.max(seen[n]).alias(f"_m_{n}") for n in names]).select(
        by, "_slice", *[F.max(f"_m_{n}").over(carry_over).alias(f"_c_{n}") for n in names]
    )
    inside = Window.partitionBy(by, "_slice").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select(by, at, "_slice", "_probe", *[F.max(seen[n]).over(inside).alias(n) for n in names])
    return local.where("_probe").join(carried, [by, "_slice"]).select(
        by, at, *[F.coalesce(n, f"_c_{n}").alias(n) for n in names]
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: str,
    left_on: str,
    right_on: str,
    payload: Sequence[str],
    matched_as: str,
    tie_break: Sequence[str] = (),
    slice_unit: str | None = None,
) -> DataFrame:
    """Left rows with the payload of the latest right row whose time is <= theirs;
    no such row gives nulls.  Several right rows of one key and time need
    ``tie_break``: the last one in that order is taken."""
    if tie_break:
        last = F.max_by(F.struct(*payload), F.struct(*tie_break)).alias("_p")
        right = right.groupBy(by, right_on).agg(last).select(by, right_on, "_p.*")
    at = F.col(left_on).alias("_at")
    times = asof_times(left.select(by, at), {"_hit": right.select(by, F.col(right_on).alias("_at"))}, by, "_at", slice_unit)
    found = times.join(
        right.select(by, F.col(right_on).alias("_hit"), *payload), [by, "_hit"], "left"
    ).withColumnRenamed("_hit", matched_as)
    keyed = left.withColumn("_at", F.col(left_on))
    return keyed.join(found, [by, "_at"], "left").select(*left.columns, matched_as, *payload)


def point_in_time_join(customers, loans, financial, credit) -> DataFrame:
    """One row per loan with customer fields and the latest financial and credit
    snapshot dated on or before the application; 36 fixed columns."""
    loans = loans.select(*LOAN_COLUMNS).withColumn("application_date", F.to_date("application_date"))
    financial = financial.select(*FINANCIAL_COLUMNS).withColumn("as_of_date", F.to_date("as_of_date"))
    credit = credit.select(*CREDIT_COLUMNS).withColumn("as_of_date", F.to_date("as_of_date"))
    at = "application_date"
    times = asof_times(
        loans.select("customer_id", at),
        {
            "financial_as_of_date": financial.select("customer_id", F.col("as_of_date").alias(at)),
            "credit_as_of_date": credit.select("customer_id", F.col("as_of_date").alias(at)),
        },
        "customer_id", at,
    )
    merged = (
        loans.join(customers.select(*CUSTOMER_COLUMNS), "customer_id", "left")
        .join(times, ["customer_id", at], "left")
        .join(financial.withColumnRenamed("as_of_date", "financial_as_of_date"),
              ["customer_id", "financial_as_of_date"], "left")
        .join(credit.withColumnRenamed("as_of_date", "credit_as_of_date"),
              ["customer_id", "credit_as_of_date"], "left")
    )
    assert_no_leakage(merged.columns)
    return merged.select(*MERGED_COLUMNS)


def align_target(merged: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Add ``default_12m`` by loan_id; a loan without outcome is an error, raised
    by the job that meets it."""
    labels = outcomes.select("loan_id", F.col("default_12m").cast("int").alias("_y"))
    missing = F.raise_error(F.concat(F.lit("No outcome found for loan_id "), F.col("loan_id").cast("string")))
    return merged.join(labels, "loan_id", "left").withColumn(
        "default_12m", F.when(F.col("_y").isNull(), missing.cast("int")).otherwise(F.col("_y"))
    ).drop("_y")


def filter_tables(tables: Tables, loan_ids: DataFrame) -> Tables:
    """All tables reduced to the given loans (column loan_id) and their customers.  The
    customers are written out, as three tables are reduced to them."""
    loans = tables["loan_applications"].join(loan_ids.select("loan_id").distinct(), "loan_id", "left_semi")
    customers = materialize(loans.select("customer_id").distinct())
    out = {"loan_applications": loans}
    for t in ("customers", "financial_profiles", "credit_history"):
        out[t] = tables[t].join(customers, "customer_id", "left_semi")
    out["loan_outcomes"] = tables["loan_outcomes"].join(loan_ids.select("loan_id").distinct(), "loan_id", "left_semi")
    return out


def window_tables(tables: Tables, start, end) -> Tables:
    """All tables reduced to loans applied for within [start, end]."""
    day = F.to_date("application_date")
    loans = tables["loan_applications"].where((day >= F.lit(start)) & (day <= F.lit(end)))
    return filter_tables({**tables, "loan_applications": loans}, loans.select("loan_id"))


def matured_predictions(predictions: DataFrame, outcomes: DataFrame, model_id: str, start, end) -> DataFrame:
    """Predictions of a model whose outcome was observed within [start, end]."""
    seen = outcomes.where(
        (F.col("outcome_observed_date") >= F.lit(start)) & (F.col("outcome_observed_date") <= F.lit(end))
    ).select("loan_id", "default_12m", "outcome_observed_date")
    return predictions.where(F.col("model_id") == model_id).join(seen, "loan_id").select(
        "loan_id", "default_probability", "credit_score", "risk_category", "recommendation",
        "latency_ms", "created_at", "default_12m", "outcome_observed_date",
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Newest row per key, as an aggregate that combines before the shuffle."""
    newest = F.max_by(F.struct(*df.columns), F.struct(*order_by)).alias("r")
    return df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(newest).select("r.*")


def application_view(loans: DataFrame, predictions: DataFrame, registry: DataFrame) -> DataFrame:
    """Every loan with its newest prediction and that model's version, or nulls."""
    newest = latest_per_key(predictions, ["loan_id"], ["created_at", "prediction_id"]).select(
        "loan_id", "prediction_id", "model_id", "default_probability", "credit_score", "risk_category",
        "recommendation", F.col("created_at").alias("scored_at"),
    )
    versions = registry.select("model_id", "model_version")
    return loans.join(newest, "loan_id", "left").join(versions, "model_id", "left").withColumn(
        "default_probability", F.bround("default_probability", 4)
    )


def intake_split(applications: DataFrame) -> Tables:
    """Flat application rows as customer, loan, financial and credit rows; the
    snapshots are dated on the application date."""
    as_of = F.col("application_date").alias("as_of_date")
    return {
        "customers": applications.select(
            *CUSTOMER_COLUMNS[:9], "monthly_income", "city_tier"),
        "loan_applications": applications.select(*LOAN_COLUMNS, F.lit("PENDING").alias("status")),
        "financial_profiles": applications.select("customer_id", as_of, *FINANCIAL_COLUMNS[2:]),
        "credit_history": applications.select("customer_id", as_of, *CREDIT_COLUMNS[2:6], "credit_utilization", *CREDIT_COLUMNS[6:]),
    }


def map_parameter(column: str, mapping: dict, default=None):
    """Parameter of a category from a small literal map."""
    expr = None
    for key, value in mapping.items():
        test = F.col(column) == F.lit(key)
        expr = F.when(test, F.lit(value)) if expr is None else expr.when(test, F.lit(value))
    return expr.otherwise(F.lit(default))
