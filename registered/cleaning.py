"""Cleaning of the derived credit tables, fitted on the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.base import R, query, r, rounded
from registered.validation import AS_OF
from riskframe.config import CLEANING, RULES
from riskframe.operators import cleaning, rules

ORDER = {"customers": ["row_no"], "loan_applications": ["row_no"]}


def tables(t):
    return t.credit(customers="customers_loaded", loan_applications="loans_loaded")


def state(t):
    return cleaning.fit(tables(t), CLEANING, ORDER)


_DEDUP = """
    with dc as (select * exclude (k) from (select *, row_number() over (partition by customer_id order by row_no desc) as k from {customers_loaded}) where k = 1),
    dl as (select * exclude (k) from (select *, row_number() over (partition by loan_id order by row_no desc) as k from {loans_loaded}) where k = 1),
    cc as (select customer_id, row_no, least(greatest(age, 18), 100) as age, gender, marital_status, dependents, education, employment_type, employment_years,
             case when annual_income < 0 then 0.0 else annual_income end as annual_income,
             case when monthly_income < 0 then 0.0 else monthly_income end as monthly_income, city_tier from dc),
    bounds as (select quantile_cont(annual_income, [0.01, 0.5, 0.99]) as a, quantile_cont(monthly_income, [0.01, 0.5, 0.99]) as m,
             quantile_cont(employment_years, 0.5) as e from cc),
    lb as (select quantile_cont(loan_amount, [0.01, 0.99]) as l from dl)
"""
_REPAIRED = _DEDUP + """,
    rc as (select customer_id, age, coalesce(gender, 'UNKNOWN') as gender, coalesce(marital_status, 'UNKNOWN') as marital_status,
        coalesce(case when annual_income is not null then least(greatest(annual_income, a[1]), a[3]) end, a[2]) as annual_income, annual_income is null as annual_income_was_missing,
        coalesce(case when monthly_income is not null then least(greatest(monthly_income, m[1]), m[3]) end, m[2]) as monthly_income,
        coalesce(employment_years, e) as employment_years, employment_years is null as employment_years_was_missing, dependents, city_tier from cc, bounds)
"""


@query("clean_dedup", _DEDUP + "select customer_id, age, row_no from dc")
def dedup(t):
    return cleaning.dedup(t["customers_loaded"], ["customer_id"], ["row_no"]).select("customer_id", "age", "row_no")


@query("clean_clip", _DEDUP + f"select customer_id, age, {R('annual_income')} as annual_income, {R('monthly_income')} as monthly_income from cc")
def clip(t):
    out = cleaning.clip_columns(cleaning.dedup(t["customers_loaded"], ["customer_id"], ["row_no"]), CLEANING["clip"]["customers"])
    return out.select("customer_id", "age", r("annual_income"), r("monthly_income"))


@query("clean_clip_counts", """
    select 'age' as "column", count(*) filter (where age < 18) as n_clipped_low, count(*) filter (where age > 100) as n_clipped_high from {customers_loaded}
    union all select 'annual_income', count(*) filter (where annual_income < 0), 0 from {customers_loaded}
    union all select 'monthly_income', count(*) filter (where monthly_income < 0), 0 from {customers_loaded}
""")
def clip_counts(t):
    return cleaning.clip_counts(t["customers_loaded"], CLEANING["clip"]["customers"])


@query("clean_fit_state", _DEDUP + f"""
    select 'median' as kind, 'annual_income' as "column", {R('a[2]')} as value from bounds union all select 'median', 'monthly_income', {R('m[2]')} from bounds
    union all select 'median', 'employment_years', {R('e')} from bounds union all select 'p01', 'annual_income', {R('a[1]')} from bounds
    union all select 'p99', 'annual_income', {R('a[3]')} from bounds union all select 'p01', 'loan_amount', {R('l[1]')} from lb
    union all select 'p99', 'loan_amount', {R('l[2]')} from lb
""")
def fit_state(t):
    s = state(t)
    rows = [("median", c, v) for c, v in s.medians["customers"].items()]
    for table, c in (("customers", "annual_income"), ("loan_applications", "loan_amount")):
        rows += [("p01", c, s.winsor[table][c][0]), ("p99", c, s.winsor[table][c][1])]
    return rounded(t.spark.createDataFrame(rows, "kind string, `column` string, value double"))


@query("clean_repair_customers", _REPAIRED + f"""
    select customer_id, age, gender, marital_status, {R('annual_income')} as annual_income, annual_income_was_missing,
           {R('monthly_income')} as monthly_income, employment_years, employment_years_was_missing from rc
""")
def repair(t):
    out = cleaning.repair(tables(t), state(t), CLEANING, ORDER)["customers"]
    return out.select("customer_id", "age", "gender", "marital_status", r("annual_income"), "annual_income_was_missing",
                      r("monthly_income"), "employment_years", "employment_years_was_missing")


def cleaned(t):
    return cleaning.apply(tables(t), state(t), CLEANING, ORDER, rules.build_rules(RULES, as_of=AS_OF))


_CLEAN = _REPAIRED + """,
    bad_c as (select customer_id from rc where abs(annual_income - 12 * monthly_income) > 0.1 * abs(annual_income)),
    ok_c as (select customer_id from rc where customer_id not in (select customer_id from bad_c)),
    bad_l as (select loan_id from dl where application_date > date '2001-01-01' or decision_date > date '2001-01-01' or decision_date < application_date
        or customer_id not in (select customer_id from rc)),
    ok_l as (select loan_id from dl where loan_id not in (select loan_id from bad_l) and customer_id in (select customer_id from ok_c))
"""


@query("clean_quarantine_customers", _CLEAN + "select customer_id from ok_c")
def quarantine(t):
    return cleaned(t).tables["customers"].select("customer_id")


@query("clean_cascade_loans", _CLEAN + "select loan_id from ok_l")
def cascade(t):
    return cleaned(t).tables["loan_applications"].select("loan_id")


@query("clean_cascade_outcomes", _CLEAN + "select loan_id from {loan_outcomes} where loan_id in (select loan_id from ok_l)")
def cascade_outcomes(t):
    return cleaned(t).tables["loan_outcomes"].select("loan_id")


@query("clean_issue_records", _CLEAN + """
    select 'customers' as table_name, customer_id as record_key, 'cleaning:structural_quarantine' as rule_name, 'ERROR' as severity from bad_c
    union all select 'loan_applications', loan_id, 'cleaning:structural_quarantine', 'ERROR' from bad_l
""")
def issue_records(t):
    return cleaned(t).quarantine_issues().where(F.col("table_name").isin("customers", "loan_applications")).drop("detail")


@query("clean_report", _CLEAN + """
    select 'customers' as "table", 'dedup' as step, cast(null as string) as "column", (select count(*) from {customers_loaded}) - (select count(*) from dc) as n
    union all select 'loan_applications', 'dedup', null, (select count(*) from {loans_loaded}) - (select count(*) from dl)
    union all select 'customers', 'quarantine', null, (select count(*) from bad_c)
    union all select 'loan_applications', 'quarantine', null, (select count(*) from bad_l)
    union all select 'customers', 'impute', 'annual_income', (select count(*) from cc where annual_income is null)
    union all select 'customers', 'impute', 'marital_status', (select count(*) from cc where marital_status is null)
    union all select 'customers', 'clip_low', 'age', (select count(*) from dc where age < 18)
    union all select 'customers', 'winsorize_high', 'annual_income', (select count(*) from cc, bounds where annual_income > a[3])
""")
def report(t):
    raw = tables(t)
    s = state(t)
    result = cleaning.apply(raw, s, CLEANING, ORDER, rules.build_rules(RULES, as_of=AS_OF))
    out = cleaning.report(raw, s, CLEANING, ORDER, result)
    wanted = F.col("step").isin("dedup", "quarantine") | F.concat_ws(":", "step", "column").isin(
        "impute:annual_income", "impute:marital_status", "clip_low:age", "winsorize_high:annual_income")
    return out.where(F.col("table").isin("customers", "loan_applications") & wanted)
