"""Validation rules.

A row rule is a list of nullable detail expressions over one table, so all row
rules of a table run in one pass.  A set rule needs other rows or tables and
returns its own violations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.config import KEY_COLUMNS
from riskframe.functions.exprs import number, number_text, record_key

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class RowRule:
    name: str
    severity: str
    table: str
    details: Callable[[DataFrame], list[Column]]


@dataclass(frozen=True)
class SetRule:
    name: str
    severity: str
    table: str
    check: Callable[[Tables], DataFrame | None]


def keyed(df: DataFrame, table: str, detail: Column) -> DataFrame:
    """Violations of a set rule: key and detail of each offending row."""
    return df.select(record_key(KEY_COLUMNS[table]).alias("record_key"), detail.alias("detail"))


def _shown(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return number_text(c) if kind in ("double", "float") else F.col(c).cast("string")


def _bound(b) -> str:
    return "None" if b is None else str(b)


def _outside(v: Column, low, high) -> Column:
    tests = ([v < F.lit(low)] if low is not None else []) + ([v > F.lit(high)] if high is not None else [])
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _moment(c: str) -> Column:
    return F.col(c).try_cast("timestamp_ntz")


def missing_value(table: str, column: str, threshold: float = 0.0, severity: str = "WARNING"):
    name = f"missing_value:{table}.{column}"
    detail = f"{column} is missing"
    if threshold <= 0:
        # "more than 0 % missing" holds whenever one row is missing.
        return RowRule(
            name, severity, table,
            lambda df: [F.when(F.col(column).isNull(), F.lit(detail))] if column in df.columns else [])

    def check(tables: Tables):
        df = tables.get(table)
        if df is None or column not in df.columns:
            return None
        share = df.select(F.avg(F.col(column).isNull().cast("double"))).scalar()
        return keyed(df.where(F.col(column).isNull() & (share > F.lit(threshold))), table, F.lit(detail))

    return SetRule(name, severity, table, check)


def duplicate_record(table: str, keys: list[str] | None = None, exact: bool = False, severity: str = "ERROR"):
    kind = "exact-row" if exact else "+".join(keys or [])

    def check(tables: Tables):
        df = tables.get(table)
        if df is None:
            return None
        on = df.columns if exact else keys
        # Counts combine before the shuffle, so a heavy key costs one row per task.
        repeated = df.groupBy(*on).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
        repeated = repeated.select(*[F.col(c).alias(f"_k_{c}") for c in on])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in on])
        return keyed(df.join(repeated, same, "left_semi"), table, F.lit(f"duplicate record ({kind})"))

    return SetRule(f"duplicate_record:{table}:{kind}", severity, table, check)


def numeric_range(table: str, column: str, min=None, max=None, severity: str = "WARNING"):  # noqa: A002
    def details(df):
        if column not in df.columns:
            return []
        text = F.concat(F.lit(f"{column}="), _shown(df, column), F.lit(f" outside [{_bound(min)}, {_bound(max)}]"))
        return [F.when(_outside(number(column), min, max), text)]

    return RowRule(f"numeric_range:{table}.{column}", severity, table, details)


def negative_financial(table: str, columns: list[str], severity: str = "ERROR"):
    def details(df):
        return [
            F.when(number(c) < 0, F.concat(F.lit(f"{c}="), _shown(df, c), F.lit(" is negative")))
            for c in columns if c in df.columns
        ]

    return RowRule(f"negative_financial:{table}", severity, table, details)


def impossible_age(table: str = "customers", column: str = "age", min=18, max=100, severity: str = "ERROR"):  # noqa: A002
    def details(df):
        text = F.concat(F.lit("age="), _shown(df, column), F.lit(f" outside [{min}, {max}]"))
        return [F.when(_outside(number(column), min, max), text)]

    return RowRule("impossible_age", severity, table, details)


def invalid_date(table, columns, order_pairs=None, allow_future=False, severity="ERROR", as_of: date | None = None):
    def details(df):
        today = F.current_date() if as_of is None else F.lit(as_of)
        out = []
        for c in columns:
            if c not in df.columns:
                continue
            parsed = _moment(c)
            out.append(F.when(parsed.isNull() & F.col(c).isNotNull(), F.lit(f"{c} is unparseable")))
            if not allow_future:
                text = F.concat(F.lit(f"{c}="), parsed.cast("date").cast("string"), F.lit(" is in the future"))
                out.append(F.when(parsed > today.cast("timestamp_ntz"), text))
        for before, after in order_pairs or []:
            if before in df.columns and after in df.columns:
                b, a = _moment(before), _moment(after)
                text = F.concat(
                    F.lit(f"{after}="), a.cast("date").cast("string"),
                    F.lit(f" is before {before}="), b.cast("date").cast("string"),
                )
                out.append(F.when(a < b, text))
        return out

    return RowRule(f"invalid_date:{table}", severity, table, details)


def credit_utilization(table="credit_history", min=0.0, max=1.5, outstanding_over_limit_margin=1.5, severity="ERROR"):  # noqa: A002
    def details(df):
        util, owed, limit = number("credit_utilization"), number("total_outstanding"), number("total_credit_limit")
        parts = F.concat_ws(
            "; ",
            F.when(_outside(util, min, max), F.concat(
                F.lit("credit_utilization="), number_text(util), F.lit(f" outside [{min}, {max}]"))),
            F.when(owed > limit * outstanding_over_limit_margin, F.concat(
                F.lit("total_outstanding="), number_text(owed), F.lit(" > total_credit_limit="), number_text(limit),
                F.lit(f" * {outstanding_over_limit_margin}"))),
        )
        return [F.when(parts != "", parts)]

    return RowRule("credit_utilization", severity, table, details)


def income_consistency(
    table="customers", annual_income_column="annual_income", monthly_income_column="monthly_income",
    tolerance_fraction=0.1, severity="ERROR",
):
    def details(df):
        annual, monthly = number(annual_income_column), number(monthly_income_column)
        text = F.concat(
            F.lit(f"{annual_income_column}="), number_text(annual),
            F.lit(f" vs 12*{monthly_income_column}="), number_text(monthly * 12),
        )
        return [F.when(F.abs(annual - monthly * 12) > F.abs(annual) * tolerance_fraction, text)]

    return RowRule("income_consistency", severity, table, details)


def expense_consistency(table="financial_profiles", income_multiple=1.5, severity="WARNING"):
    def details(df):
        spend, emi, income = number("monthly_expenses"), number("monthly_emi"), number("monthly_income")
        text = F.concat(
            F.lit("monthly_expenses="), number_text(spend), F.lit(" + monthly_emi="), number_text(emi),
            F.lit(" > monthly_income="), number_text(income), F.lit(f" * {income_multiple}"),
        )
        return [F.when(spend + emi > income * income_multiple, text)]

    return RowRule("expense_consistency", severity, table, details)


def orphan_record(child_table: str, parent_table: str, key: str, severity: str = "ERROR"):
    def check(tables: Tables):
        child, parent = tables.get(child_table), tables.get(parent_table)
        if child is None or parent is None:
            return None
        known = parent.select(F.coalesce(F.col(key).cast("string"), F.lit("nan")).alias("_known")).distinct()
        text = F.coalesce(F.col(key).cast("string"), F.lit("nan"))
        bad = child.withColumn("_text", text).join(known, F.col("_text") == F.col("_known"), "left_anti")
        return keyed(bad, child_table, F.concat(F.lit(f"{key}="), F.col("_text"), F.lit(f" has no matching {parent_table} row")))

    return SetRule(f"orphan_record:{child_table}->{parent_table}", severity, child_table, check)


def employment_plausibility(table="customers", min_working_age=16, severity="WARNING"):
    def details(df):
        age, years = number("age"), number("employment_years")
        text = F.concat(
            F.lit("employment_years="), _shown(df, "employment_years"), F.lit(" > age="), _shown(df, "age"),
            F.lit(f" - {min_working_age}"),
        )
        return [F.when(years > age - min_working_age, text)]

    return RowRule("employment_plausibility", severity, table, details)


def temporal_leakage(snapshot_table: str, loan_table: str = "loan_applications", severity: str = "ERROR"):
    def check(tables: Tables):
        snaps, loans = tables.get(snapshot_table), tables.get(loan_table)
        if snaps is None or loans is None:
            return None
        latest = loans.groupBy("customer_id").agg(F.max(_moment("application_date")).alias("_latest"))
        late = snaps.join(latest, "customer_id").where(_moment("as_of_date") > F.col("_latest"))
        text = F.concat(
            F.lit("as_of_date="), _moment("as_of_date").cast("date").cast("string"),
            F.lit(" later than every application_date ("), F.col("_latest").cast("date").cast("string"),
            F.lit(") for "), F.col("customer_id").cast("string"),
        )
        return keyed(late, snapshot_table, text)

    return SetRule(f"temporal_leakage:{snapshot_table}", severity, snapshot_table, check)


# -- request rules: accepted values, bounds and cross-field checks of one flat table --

def request_problems(enums: dict, bounds: dict, lengths: dict | None = None, cross_fields: bool = True) -> list[Column]:
    """Nullable problem texts of a scoring request row; a required field that is
    null is a problem as well."""
    out = [F.when(F.col(c).isNull() | ~F.col(c).isin(values), F.lit(f"{c}: not an accepted value")) for c, values in enums.items()]
    for c, (ge, gt, le) in bounds.items():
        v = number(c)
        wrong = v.isNull()
        if ge is not None:
            wrong = wrong | (v < F.lit(ge))
        if gt is not None:
            wrong = wrong | (v <= F.lit(gt))
        if le is not None:
            wrong = wrong | (v > F.lit(le))
        out.append(F.when(wrong, F.lit(f"{c}: out of bounds")))
    for c, (low, high) in (lengths or {}).items():
        n = F.length(F.col(c))
        wrong = (n < low) | (n > high)
        out.append(F.when(wrong if low == 0 else F.col(c).isNull() | wrong, F.lit(f"{c}: length out of bounds")))
    if cross_fields:
        out += cross_field_problems()
    return out


def cross_field_problems() -> list[Column]:
    """Consistency of the fields of one request; income within 5 %, unlike the 10 % of the table rule."""
    annual, monthly = number("annual_income"), number("monthly_income")
    return [
        F.when(
            F.abs(annual - monthly * 12.0) > annual * 0.05,
            F.lit("annual_income is inconsistent with monthly_income (must be within 5% of 12 * monthly_income)"),
        ),
        F.when(number("employment_years") > number("age") - 16, F.lit("employment_years cannot exceed age - 16")),
        F.when(
            number("total_outstanding") > number("total_credit_limit") * 1.5,
            F.lit("total_outstanding cannot exceed 1.5x total_credit_limit"),
        ),
        F.when(
            number("monthly_expenses") + number("monthly_emi") > monthly * 2,
            F.lit("monthly_expenses + monthly_emi cannot exceed 2x monthly_income"),
        ),
    ]


# Rule kinds in the order they are built; a mapping with a single entry is one rule.
KINDS = {
    "missing_value": missing_value,
    "duplicate_record": duplicate_record,
    "numeric_range": numeric_range,
    "negative_financial": negative_financial,
    "impossible_age": impossible_age,
    "invalid_date": invalid_date,
    "credit_utilization": credit_utilization,
    "income_consistency": income_consistency,
    "expense_consistency": expense_consistency,
    "orphan_record": orphan_record,
    "employment_plausibility": employment_plausibility,
    "temporal_leakage": temporal_leakage,
}


def build_rules(config: dict, as_of: date | None = None) -> list[RowRule | SetRule]:
    """Rules of a declarative config: kind -> one entry or a list of entries.
    ``as_of`` is "today" for the future-date check."""
    rules = []
    for kind, make in KINDS.items():
        entries = config.get(kind, [])
        for entry in [entries] if isinstance(entries, dict) else entries:
            extra = {"as_of": as_of} if kind == "invalid_date" else {}
            rules.append(make(**entry, **extra))
    return rules
