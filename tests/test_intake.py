"""Applications become rows of four tables together or not at all."""

import pytest
from pyspark.sql import functions as F

from riskframe.sources import intake

ORDER = ["application_date", "loan_id"]


def applications(spark, *rows):
    """(loan, customer, age) and what else an application needs."""
    df = spark.createDataFrame(list(rows), "loan_id string, customer_id string, age int")
    text = {c: F.lit("x") for c in ("gender", "marital_status", "education", "employment_type", "city_tier", "loan_purpose")}
    ones = ("dependents", "loan_tenure_months", "existing_loan_count", "credit_history_months", "num_credit_accounts", "previous_defaults", "late_payments_12m",
            "missed_payments_12m", "active_loans", "closed_loans")
    reals = ("employment_years", "annual_income", "monthly_income", "loan_amount", "interest_rate", "monthly_expenses", "existing_loan_amount", "monthly_emi",
             "savings_balance", "total_assets", "total_liabilities", "total_credit_limit", "total_outstanding", "credit_utilization")
    day = F.lit("2024-01-01").cast("date")
    return df.withColumns({**text, **{c: F.lit(1) for c in ones}, **{c: F.lit(1.0) for c in reals}, "loan_type": F.lit("HOME"), "application_date": day, "decision_date": day, "extra": F.lit("?")})


def stored(spark, root):
    tables = intake.read_tables(spark, root)
    return {t: sorted(r[0] for r in df.select("loan_id" if t == "loan_applications" else "customer_id").collect()) for t, df in tables.items()}


def test_rejected_applications_leave_no_row(spark, tmp_path):
    root = str(tmp_path)
    assert intake.read_tables(spark, root) is None
    # C3 can't have L1, which is C1's; C2's second application goes, so that L4 is free for C4.
    done = intake.take_in(spark, root, applications(spark, ("L1", "C1", 30), ("L1", "C3", 30), ("L2", "C2", 30), ("L4", "C2", 30), ("L4", "C4", 30), ("L5", "C5", 7), ("L6", None, 30)), [*ORDER, "customer_id"])
    assert done.stored == 3 and stored(spark, root) == {
        "customers": ["C1", "C2", "C4"], "loan_applications": ["L1", "L2", "L4"], "financial_profiles": ["C1", "C2", "C4"], "credit_history": ["C1", "C2", "C4"]}
    assert sorted((r.loan_id, r.rule_name) for r in done.issues.collect()) == [
        ("L1", "loan_applications_pkey"), ("L4", "customers_pkey"), ("L5", "customers_age_check"), ("L6", "not_null_violation:customers.customer_id")]
    again = intake.take_in(spark, root, applications(spark, ("L7", "C1", 30), ("L2", "C8", 30), ("L9", "C9", 30)), ORDER)
    assert again.number == 2 and stored(spark, root)["loan_applications"] == ["L1", "L2", "L4", "L9"]
    assert sorted((r.loan_id, r.rule_name) for r in again.issues.collect()) == [("L2", "loan_applications_pkey"), ("L7", "customers_pkey")]
    assert intake.take_in(spark, root, applications(spark, ("L0", "C0", 3)).limit(0), ORDER).stored == 0
    assert stored(spark, root)["customers"] == ["C1", "C2", "C4", "C9"]


def test_an_intake_that_dies_stores_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    intake.take_in(spark, root, applications(spark, ("L1", "C1", 30)), ORDER)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(intake, "_commit", die)
        with pytest.raises(RuntimeError):
            intake.take_in(spark, root, applications(spark, ("L2", "C2", 30)), ORDER)
    assert stored(spark, root)["customers"] == ["C1"]
    assert intake.take_in(spark, root, applications(spark, ("L2", "C2", 30)), ORDER).stored == 1


def test_two_writers_conflict(spark, tmp_path, monkeypatch):
    """The second of two intakes that began from the same state is refused, and can run again."""
    root, commit = str(tmp_path), intake._commit

    def overtaken(spark, root, number, folder):
        monkeypatch.setattr(intake, "_commit", commit)
        intake.take_in(spark, root, applications(spark, ("L1", "C1", 30)), ORDER)
        commit(spark, root, number, folder)

    monkeypatch.setattr(intake, "_commit", overtaken)
    with pytest.raises(intake.IntakeConflict):
        intake.take_in(spark, root, applications(spark, ("L2", "C1", 30)), ORDER)
    assert stored(spark, root) == {"customers": ["C1"], "loan_applications": ["L1"], "financial_profiles": ["C1"], "credit_history": ["C1"]}
    assert intake.take_in(spark, root, applications(spark, ("L2", "C1", 30)), ORDER).stored == 0
