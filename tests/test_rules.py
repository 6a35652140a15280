"""One small table per rule, with the number of violations known."""

from datetime import date

import pytest

from riskframe.config import RULES
from riskframe.operators import constraints, engine, rules


def found(spark, rule, **tables):
    return engine.violations(tables, [rule]).collect()


def test_missing_value(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 100.0), ("b", "2024-01-01", None), ("c", "2024-01-01", None)],
                               "customer_id string, as_of_date string, total_assets double")
    rows = found(spark, rules.missing_value("financial_profiles", "total_assets"), financial_profiles=df)
    assert sorted(r.record_key for r in rows) == ["b|2024-01-01", "c|2024-01-01"]
    four = spark.createDataFrame([(str(i), None if i == 0 else 1.0) for i in range(4)], "customer_id string, age double")
    assert not found(spark, rules.missing_value("customers", "age", 0.5), customers=four)


def test_duplicate_key_and_exact(spark):
    df = spark.createDataFrame([("C1", 1), ("C1", 2), ("C2", 3)], "customer_id string, age int")
    rows = found(spark, rules.duplicate_record("customers", ["customer_id"]), customers=df)
    assert [r.record_key for r in rows] == ["C1", "C1"]
    assert not found(spark, rules.duplicate_record("customers", exact=True), customers=df)
    again = df.unionAll(df.where("age = 1"))
    assert len(found(spark, rules.duplicate_record("customers", exact=True), customers=again)) == 2
    nulls = spark.createDataFrame([(None, 1), (None, 1)], "customer_id string, age int")
    assert len(found(spark, rules.duplicate_record("customers", ["customer_id"]), customers=nulls)) == 2


def test_ranges(spark):
    df = spark.createDataFrame([("a", -1, 10, -100.0, 50.0), ("b", 5, 30, 200.0, -20.0), ("c", 15, 150, 1.0, 1.0)],
                               "customer_id string, dependents int, age int, annual_income double, monthly_income double")
    assert len(found(spark, rules.numeric_range("customers", "dependents", 0, 10), customers=df)) == 2
    assert len(found(spark, rules.negative_financial("customers", ["annual_income", "monthly_income"]), customers=df)) == 2
    ages = found(spark, rules.impossible_age(), customers=df)
    assert sorted(r.detail for r in ages) == ["age=10 outside [18, 100]", "age=150 outside [18, 100]"]


def test_unparseable_number_is_no_violation(spark):
    df = spark.createDataFrame([("a", "abc"), ("b", "12")], "customer_id string, dependents string")
    assert [r.record_key for r in found(spark, rules.numeric_range("customers", "dependents", 0, 10), customers=df)] == ["b"]


def test_dates(spark):
    df = spark.createDataFrame(
        [("L1", "2024-01-01", "2024-01-05"), ("L2", "2024-02-10", "2024-02-01"), ("L3", "2099-01-01", "2099-01-02"), ("L4", "not-a-date", "2024-01-01")],
        "loan_id string, application_date string, decision_date string")
    rule = rules.invalid_date("loan_applications", ["application_date", "decision_date"], [["application_date", "decision_date"]], as_of=date(2024, 6, 1))
    assert len(found(spark, rule, loan_applications=df)) == 4


def test_credit_utilization(spark):
    df = spark.createDataFrame([("a", "d", 0.5, 500.0, 1000.0), ("b", "d", 1.8, 900.0, 1000.0), ("c", "d", 0.3, 2000.0, 1000.0)],
                               "customer_id string, as_of_date string, credit_utilization double, total_outstanding double, total_credit_limit double")
    rows = {r.record_key: r.detail for r in found(spark, rules.credit_utilization(), credit_history=df)}
    assert rows == {"b|d": "credit_utilization=1.8 outside [0.0, 1.5]", "c|d": "total_outstanding=2000.0 > total_credit_limit=1000.0 * 1.5"}


def test_consistency(spark):
    df = spark.createDataFrame([("a", 120000.0, 10000.0), ("b", 120000.0, 5000.0)], "customer_id string, annual_income double, monthly_income double")
    assert [r.record_key for r in found(spark, rules.income_consistency(), customers=df)] == ["b"]
    fp = spark.createDataFrame([("a", "d", 3000.0, 1000.0, 4000.0), ("b", "d", 5000.0, 3000.0, 4000.0)],
                               "customer_id string, as_of_date string, monthly_expenses double, monthly_emi double, monthly_income double")
    assert [r.record_key for r in found(spark, rules.expense_consistency(), financial_profiles=fp)] == ["b|d"]
    emp = spark.createDataFrame([("a", 30, 10.0), ("b", 20, 10.0)], "customer_id string, age int, employment_years double")
    assert [r.record_key for r in found(spark, rules.employment_plausibility(), customers=emp)] == ["b"]


def test_orphan_and_leakage(spark):
    parents = spark.createDataFrame([("C1",), ("C2",)], "customer_id string")
    child = spark.createDataFrame([("L1", "C1"), ("L2", "C3")], "loan_id string, customer_id string")
    assert [r.record_key for r in found(spark, rules.orphan_record("loan_applications", "customers", "customer_id"), loan_applications=child, customers=parents)] == ["L2"]
    loans = spark.createDataFrame([("L1", "C1", "2024-01-01"), ("L2", "C1", "2024-03-01")], "loan_id string, customer_id string, application_date string")
    snaps = spark.createDataFrame([("C1", "2024-02-01"), ("C1", "2024-05-01")], "customer_id string, as_of_date string")
    rows = found(spark, rules.temporal_leakage("financial_profiles"), financial_profiles=snaps, loan_applications=loans)
    assert [r.record_key for r in rows] == ["C1|2024-05-01"]


def test_default_config_builds_every_rule():
    names = [r.name for r in rules.build_rules(RULES)]
    assert len(names) == len(set(names)) == 32


def test_row_rules_run_in_one_pass(spark, inputs):
    """All row rules of a table read it once, without a shuffle."""
    made = [r for r in rules.build_rules(RULES, date(2001, 1, 1)) if isinstance(r, rules.RowRule) and r.table == "customers"]
    plan = engine.row_violations(inputs["customers"], "customers", made)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_load_constraints(spark):
    parents = spark.createDataFrame([("a", 1, 30), ("a", 2, 31), ("b", 3, 10), ("c", 4, None)], "k string, n int, age int")
    kids = spark.createDataFrame([("x", "a", 1), ("y", "b", 2), ("z", "q", 3)], "id string, k string, n int")
    made = [
        constraints.TableConstraints("p", ["age"], {"p_age_check": "age between 18 and 100"}, ["k"], "p_pkey", {}, ["n"]),
        constraints.TableConstraints("c", [], {}, ["id"], "c_pkey", {"k": ("p", "k")}, ["n"]),
    ]
    out = constraints.load_constrained({"p": parents, "c": kids}, made)
    assert [r.id for r in out.tables["c"].collect()] == ["x"]
    assert sorted((r.table_name, r.rule_name) for r in out.issues.collect()) == [
        ("c", "foreign_key:k"), ("c", "foreign_key:k"), ("p", "not_null_violation:age"), ("p", "p_age_check"), ("p", "p_pkey")]


def test_key_needs_an_order(spark):
    df = spark.createDataFrame([("a",)], "k string")
    with pytest.raises(ValueError):
        constraints.load_constrained({"t": df}, [constraints.TableConstraints("t", key=["k"])])


def test_error_keys_are_found_without_findings(spark):
    """The keys are those of the findings, but no finding becomes a row for them."""
    from pyspark.sql import functions as F

    rows = [("a", 10, 1.0), ("a", 30, 2.0), ("b", 30, -1.0), ("b", 30, -1.0), (None, 17, 1.0), ("c", None, None), ("d", 40, 5.0)]
    tables = {"customers": spark.createDataFrame(rows, "customer_id string, age int, annual_income double")}
    checked = [
        rules.impossible_age(), rules.negative_financial("customers", ["annual_income", "monthly_income"]),
        rules.missing_value("customers", "annual_income", 0.0, "WARNING"), rules.duplicate_record("customers", ["customer_id"]),
    ]
    run = engine.run(tables, checked)
    found = run.violations.where((F.col("severity") == "ERROR") & (F.col("table") == "customers"))
    keys = run.error_keys("customers")
    assert {r[0] for r in keys.collect()} == {r.record_key for r in found.collect()} == {"a", "b", "nan"}
    assert "Generate" not in keys._jdf.queryExecution().optimizedPlan().toString()
    assert engine.run(tables, []).error_keys("customers").isEmpty()
