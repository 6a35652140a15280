"""Loading tables under NOT NULL, CHECK, key and foreign-key constraints.

Every rejected row goes to an issue table with the first constraint it broke.
Parents are loaded before children, so a rejected parent rejects its children.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.config import KEY_COLUMNS
from riskframe.functions.exprs import record_key


@dataclass(frozen=True)
class TableConstraints:
    table: str
    not_null: Sequence[str] = ()
    checks: dict[str, str] = field(default_factory=dict)  # name -> SQL condition; null passes
    key: Sequence[str] = ()
    key_name: str = "unique"
    # column -> (parent table, parent column)
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    # Columns that number the rows in load order; the first row of a key is kept.
    order_by: Sequence[str] = ()


@dataclass
class LoadResult:
    tables: dict[str, DataFrame]
    issues: DataFrame
    summary: DataFrame


def _first_break(c: TableConstraints):
    tests = [F.when(F.col(x).isNull(), F.lit(f"not_null_violation:{x}")) for x in c.not_null]
    tests += [F.when(~F.expr(cond), F.lit(name)) for name, cond in c.checks.items()]
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def _mark(df: DataFrame, c: TableConstraints, loaded: dict[str, DataFrame]) -> DataFrame:
    """The table with ``_rule``, the constraint a row broke (null: accepted)."""
    cols = df.columns
    df = df.withColumn("_rule", _first_break(c))
    for column, (parent, parent_column) in c.references.items():
        known = loaded[parent].select(F.col(parent_column).alias("_p")).distinct()
        df = df.join(known, F.col(column) == F.col("_p"), "left").withColumn(
            "_rule", F.coalesce("_rule", F.when(F.col("_p").isNull(), F.lit(f"foreign_key:{column}")))
        ).drop("_p")
    if c.key:
        if not c.order_by:
            raise ValueError(f"{c.table}: a key needs order_by to say which row comes first")
        order = F.struct(*c.order_by)
        # Combines before the shuffle: a heavy key is one row per task.  Only repeated
        # keys are joined back.
        first = (
            df.where("_rule is null").groupBy(*[F.col(k).alias(f"_k_{k}") for k in c.key])
            .agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        )
        same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k_{k}") for k in c.key])
        later = order > F.col("_first")
        df = df.join(first, same, "left").withColumn("_rule", F.coalesce("_rule", F.when(later, F.lit(c.key_name))))
    return df.select(*cols, "_rule")


def load_constrained(tables: dict[str, DataFrame], constraints: Sequence[TableConstraints]) -> LoadResult:
    """Apply constraints in the given (parents first) order."""
    loaded, issues, counts = {}, [], []
    for c in constraints:
        df = tables[c.table]
        marked = _mark(df, c, loaded)
        loaded[c.table] = marked.where("_rule is null").drop("_rule")
        issues.append(marked.where("_rule is not null").select(
            F.lit(c.table).alias("table_name"), record_key(KEY_COLUMNS.get(c.table, list(c.key))).alias("record_key"),
            F.col("_rule").alias("rule_name"), F.lit("ERROR").alias("severity"),
            F.concat(F.lit("violates "), F.col("_rule")).alias("detail"),
        ))
        counts.append(marked.agg(
            F.count("*").alias("attempted"), F.count_if(F.col("_rule").isNull()).alias("inserted"),
            F.count_if(F.col("_rule").isNotNull()).alias("quarantined"),
        ).select(F.lit(c.table).alias("table_name"), "attempted", "inserted", "quarantined"))
    return LoadResult(loaded, reduce(DataFrame.unionByName, issues), reduce(DataFrame.unionByName, counts))


# Constraints of the five credit tables, parents first.
NOT_NULL = {
    "customers": ["customer_id", "age", "gender", "marital_status", "dependents", "education",
                  "employment_type", "employment_years", "annual_income", "monthly_income", "city_tier"],
    "loan_applications": ["loan_id", "customer_id", "loan_type", "loan_amount", "loan_tenure_months",
                          "interest_rate", "loan_purpose", "application_date", "status"],
    "financial_profiles": ["customer_id", "as_of_date", "monthly_income", "monthly_expenses",
                           "existing_loan_count", "existing_loan_amount", "monthly_emi", "savings_balance",
                           "total_assets", "total_liabilities"],
    "credit_history": ["customer_id", "as_of_date", "credit_history_months", "num_credit_accounts",
                       "total_credit_limit", "total_outstanding", "credit_utilization", "previous_defaults",
                       "late_payments_12m", "missed_payments_12m", "active_loans", "closed_loans"],
    "loan_outcomes": ["loan_id", "default_12m", "outcome_observed_date"],
}
CHECKS = {
    "customers": {
        "customers_age_check": "age between 18 and 100",
        "customers_annual_income_check": "annual_income >= 0",
        "customers_dependents_check": "dependents >= 0",
        "customers_employment_years_check": "employment_years >= 0",
        "customers_monthly_income_check": "monthly_income >= 0",
    },
    "loan_applications": {
        "loan_applications_interest_rate_check": "interest_rate >= 0",
        "loan_applications_loan_amount_check": "loan_amount > 0",
        "loan_applications_loan_tenure_months_check": "loan_tenure_months > 0",
        "loan_applications_loan_type_check":
            "loan_type in ('PERSONAL', 'HOME', 'AUTO', 'EDUCATION', 'BUSINESS', 'CREDIT_CARD')",
    },
    "financial_profiles": {},
    "credit_history": {"credit_history_credit_utilization_check": "credit_utilization between 0 and 2"},
    "loan_outcomes": {"loan_outcomes_default_12m_check": "default_12m in (0, 1)"},
}
UNIQUE_NAMES = {
    "customers": "customers_pkey",
    "loan_applications": "loan_applications_pkey",
    "financial_profiles": "financial_profiles_customer_id_as_of_date_key",
    "credit_history": "credit_history_customer_id_as_of_date_key",
    "loan_outcomes": "loan_outcomes_pkey",
}
PARENTS = {
    "loan_applications": {"customer_id": ("customers", "customer_id")},
    "financial_profiles": {"customer_id": ("customers", "customer_id")},
    "credit_history": {"customer_id": ("customers", "customer_id")},
    "loan_outcomes": {"loan_id": ("loan_applications", "loan_id")},
}


def credit_constraints(order_by: dict[str, Sequence[str]]) -> list[TableConstraints]:
    """Constraints of the credit tables; ``order_by`` numbers each table's rows."""
    return [
        TableConstraints(
            t, NOT_NULL[t], CHECKS[t], KEY_COLUMNS[t], UNIQUE_NAMES[t], PARENTS.get(t, {}), order_by[t],
        )
        for t in NOT_NULL
    ]
