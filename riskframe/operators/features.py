"""Row-local ratio and behavioural features, bands, and leakage guards."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.config import (
    FORBIDDEN_FEATURES,
    FORBIDDEN_PATTERNS,
    QUANTILE_LABELS,
    UTILIZATION_CUTS,
    UTILIZATION_LABELS,
)
from riskframe.functions.bins import band, distinct_edges
from riskframe.functions.exprs import at_least, clip, number
from riskframe.operators.quantiles import quantiles


class LeakageError(ValueError):
    """A column that only exists after the decision reached feature code."""


def assert_no_leakage(columns: Iterable[str]) -> None:
    bad = sorted(
        c for c in set(columns)
        if c in FORBIDDEN_FEATURES or any(re.search(p, c) for p in FORBIDDEN_PATTERNS)
    )
    if bad:
        raise LeakageError(f"columns known only after the decision: {bad}")


def safe_divide(n: Column, d: Column, cap: float, floor: float = 0.0) -> Column:
    """n / d within [floor, cap]; d <= 0 or a null on either side gives cap."""
    raw = F.coalesce(F.when(d > 0, n / d), F.lit(float(cap)))
    return F.least(F.greatest(raw, F.lit(float(floor))), F.lit(float(cap)))


def proposed_emi(amount: Column, annual_rate: Column, months: Column) -> Column:
    """Annuity instalment; no interest: amount / months; no term: the amount; never null."""
    rate = clip(annual_rate, low=0.0) / 12.0 / 100.0
    growth = F.pow(F.lit(1.0) + rate, months)
    # Rates this close to zero count as no interest.
    flat = F.abs(rate) <= 1e-8
    emi = (
        F.when(months <= 0, amount)
        .when(months.isNull(), amount)
        .when(flat, amount / months)
        .when(growth - 1.0 != 0, amount * rate * growth / (growth - 1.0))
    )
    finite = ~F.isnan(emi) & (F.abs(emi) != float("inf"))
    return F.coalesce(F.when(finite, emi), F.lit(0.0))


def ratio_features(df: DataFrame) -> DataFrame:
    """Append the 11 ratio features."""
    v = {c: number(c) for c in (
        "loan_amount", "interest_rate", "loan_tenure_months", "monthly_emi", "monthly_expenses", "monthly_income",
        "total_outstanding", "total_credit_limit", "annual_income", "savings_balance", "total_assets", "total_liabilities",
    )}
    df = df.withColumn("proposed_emi", proposed_emi(v["loan_amount"], v["interest_rate"], v["loan_tenure_months"]))
    emi, spend, income = v["monthly_emi"], v["monthly_expenses"], v["monthly_income"]
    return df.withColumns({
        "dti": safe_divide(emi + spend, income, 5.0),
        "emi_to_income": safe_divide(emi, income, 2.0),
        "credit_utilization": safe_divide(v["total_outstanding"], v["total_credit_limit"], 2.0),
        "loan_to_income": safe_divide(v["loan_amount"], v["annual_income"], 10.0),
        "post_loan_dti": safe_divide(emi + F.col("proposed_emi") + spend, income, 5.0),
        "savings_to_income": safe_divide(v["savings_balance"], income, 50.0),
        "net_worth": v["total_assets"] - v["total_liabilities"],
        "leverage_ratio": v["total_liabilities"] / at_least(v["total_assets"], 1.0),
        "disposable_income": income - spend - emi,
        "months_of_runway": v["savings_balance"] / at_least(spend, 1.0),
    })


def behavioural_features(df: DataFrame) -> DataFrame:
    """Append the seven behavioural ratios."""
    accounts, active, closed = number("num_credit_accounts"), number("active_loans"), number("closed_loans")
    years = number("credit_history_months") / 12.0
    dependents = number("dependents") + 1.0
    return df.withColumns({
        "credit_history_years": years,
        "delinquency_rate": (number("late_payments_12m") + number("missed_payments_12m")) / at_least(accounts, 1.0),
        "has_prior_default": F.coalesce(number("previous_defaults") > 0, F.lit(False)).cast("int"),
        "accounts_per_year": accounts / at_least(years, 0.5),
        "active_loan_ratio": active / at_least(active + closed, 1.0),
        "employment_stability": number("employment_years") / at_least(number("age") - 18.0, 1.0),
        "income_per_dependent": F.when(dependents != 0, number("monthly_income") / dependents),
    })


def utilization_band(c: str | Column = "credit_utilization") -> Column:
    return F.coalesce(band(c, UTILIZATION_CUTS, UTILIZATION_LABELS, closed="right"), F.lit("nan"))


BANDED = {"age_band": "age", "tenure_band": "employment_years", "income_band": "annual_income"}


def fit_bands(train: DataFrame, columns: dict[str, str] = BANDED, n_bins: int = 5) -> dict[str, list[float]]:
    """Distinct quantile edges per band column, from training rows."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    q = quantiles(train, list(columns.values()), probs)
    return {name: distinct_edges(q[c] or []) for name, c in columns.items()}


def quantile_band(c: str | Column, edges: Sequence[float], labels: Sequence[str] = QUANTILE_LABELS) -> Column:
    """Q1..Qk by fitted edges, right-closed, outer bins open.  A missing value, or
    a column that was constant when fitted, gives the text 'nan'."""
    inner = list(edges)[1:-1]
    if len(edges) < 2:
        return F.lit("nan")
    return F.coalesce(band(c, inner, list(labels)[: len(inner) + 1], closed="right"), F.lit("nan"))


def add_bands(df: DataFrame, edges: dict[str, list[float]], columns: dict[str, str] = BANDED) -> DataFrame:
    bands = {name: quantile_band(number(c), edges[name]) for name, c in columns.items()}
    return df.withColumns({"utilization_band": utilization_band(), **bands})


def target_correlation(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Pearson correlation of every column with the target, in one job."""
    y = number(target)
    items = [F.struct(F.lit(c).alias("feature"), _corr(number(c), y).alias("r")) for c in columns]
    return df.agg(F.array(*items).alias("a")).select(F.inline("a"))


def _corr(x: Column, y: Column) -> Column:
    """Pearson r over rows where both are present; null when either is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    # From moments, because ``corr`` itself raises on a constant column.
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    varies = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y)) & (spread > 0)
    return F.when(varies, F.covar_pop(x, y) / spread)


def correlation_offenders(df: DataFrame, columns: Sequence[str], target: str, threshold: float = 0.95) -> DataFrame:
    """Features so close to the target that they are probably leakage."""
    return target_correlation(df, columns, target).where(F.abs("r") > threshold)
