"""Rules, rule engine and constraint-checked load over the derived credit tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from registered.base import R, query, r, rounded
from registered.inputs import MERGED
from riskframe.config import (
    MONITORING,
    REQUEST_BOUNDS,
    REQUEST_ENUMS,
    REQUEST_LENGTHS,
    RULES,
    SCORING_BOUNDS,
    SCORING_ENUMS,
)
from riskframe.functions.exprs import compact
from riskframe.operators import constraints, engine, joins, rules
from riskframe.operators.ordered import join_slices, passing

AS_OF = date(2001, 1, 1)


def one(rule):
    """Violations of a single rule."""
    return lambda t: engine.violations(t.derived(), [rule])


def check(table: str, key: str, rule: str, severity: str, where: str, detail: str, source: str | None = None) -> str:
    return f"""
        select '{table}' as "table", {key} as record_key, '{rule}' as rule_name, '{severity}' as severity, {detail} as detail
        from {source or '{' + table + '}'} where {where}
    """


SNAP = "customer_id || '|' || cast(as_of_date as string)"

query("rule_missing_value", check(
    "customers", "customer_id", "missing_value:customers.annual_income", "ERROR", "annual_income is null",
    "'annual_income is missing'"))(one(rules.missing_value("customers", "annual_income", 0.0, "ERROR")))

query("rule_missing_value_threshold", """
    select 'customers' as "table", customer_id as record_key, 'missing_value:customers.marital_status' as rule_name,
           'WARNING' as severity, 'marital_status is missing' as detail
    from {customers}
    where marital_status is null
      and (select avg(case when marital_status is null then 1.0 else 0.0 end) from {customers}) > 0.15
""")(one(rules.missing_value("customers", "marital_status", 0.15)))

query("rule_missing_value_below_threshold", """
    select 'customers' as "table", customer_id as record_key, 'missing_value:customers.employment_years' as rule_name,
           'WARNING' as severity, 'employment_years is missing' as detail
    from {customers}
    where employment_years is null
      and (select avg(case when employment_years is null then 1.0 else 0.0 end) from {customers}) > 0.5
""")(one(rules.missing_value("customers", "employment_years", 0.5)))

query("rule_duplicate_key", """
    select 'customers' as "table", customer_id as record_key, 'duplicate_record:customers:customer_id' as rule_name,
           'ERROR' as severity, 'duplicate record (customer_id)' as detail
    from (select customer_id, count(*) over (partition by customer_id) as n from {customers}) where n > 1
""")(one(rules.duplicate_record("customers", ["customer_id"])))

query("rule_duplicate_exact", """
    select 'customers' as "table", customer_id as record_key, 'duplicate_record:customers:exact-row' as rule_name,
           'WARNING' as severity, 'duplicate record (exact-row)' as detail
    from (select customer_id, count(*) over (partition by customer_id, age, gender, marital_status, dependents,
            education, employment_type, employment_years, annual_income, monthly_income, city_tier) as n
          from {customers}) where n > 1
""")(one(rules.duplicate_record("customers", exact=True, severity="WARNING")))

query("rule_numeric_range", check(
    "loan_applications", "loan_id", "numeric_range:loan_applications.loan_tenure_months", "WARNING",
    "loan_tenure_months < 1 or loan_tenure_months > 600",
    "'loan_tenure_months=' || cast(loan_tenure_months as string) || ' outside [1, 600]'",
))(one(rules.numeric_range("loan_applications", "loan_tenure_months", 1, 600)))


@query("rule_negative_financial", """
    select 'financial_profiles' as "table", customer_id || '|' || cast(as_of_date as string) as record_key,
           'negative_financial:financial_profiles' as rule_name, c as "column"
    from (select customer_id, as_of_date, 'savings_balance' as c, savings_balance as v from {financial_profiles}
          union all select customer_id, as_of_date, 'monthly_income', monthly_income from {financial_profiles}
          union all select customer_id, as_of_date, 'total_assets', total_assets from {financial_profiles})
    where v < 0
""")
def negative_financial(t):
    found = one(rules.negative_financial("financial_profiles", ["savings_balance", "monthly_income", "total_assets"]))(t)
    return found.select("table", "record_key", "rule_name", F.split("detail", "=")[0].alias("column"))


query("rule_impossible_age", check(
    "customers", "customer_id", "impossible_age", "ERROR", "age < 18 or age > 100",
    "'age=' || cast(age as string) || ' outside [18, 100]'"))(one(rules.impossible_age()))

query("rule_invalid_date", """
    select 'loan_applications' as "table", loan_id as record_key, 'invalid_date:loan_applications' as rule_name, 'ERROR' as severity, detail
    from (select loan_id, 'application_date=' || cast(application_date as string) || ' is in the future' as detail
          from {loan_applications} where application_date > date '2001-01-01'
          union all
          select loan_id, 'decision_date=' || cast(decision_date as string) || ' is in the future'
          from {loan_applications} where decision_date > date '2001-01-01'
          union all
          select loan_id, 'decision_date=' || cast(decision_date as string) || ' is before application_date=' || cast(application_date as string)
          from {loan_applications} where decision_date < application_date)
""")(one(rules.invalid_date(
    "loan_applications", ["application_date", "decision_date"], [["application_date", "decision_date"]], as_of=AS_OF)))


@query("rule_unparseable_date", """
    select cast(event_id as string) as record_key, 'ts_text is unparseable' as detail
    from {events} where event_type = 'error'
""")
def unparseable_date(t):
    df = t["events"].select(
        F.col("event_id").cast("string").alias("loan_id"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("not-a-date "), F.col("event_type")))
        .otherwise(F.col("ts").cast("string")).alias("ts_text"),
    )
    rule = rules.invalid_date("loan_applications", ["ts_text"], as_of=date(2030, 1, 1))
    return engine.violations({"loan_applications": df}, [rule]).select("record_key", "detail")


@query("rule_credit_utilization", f"""
    select {SNAP} as record_key,
           (credit_utilization < 0 or credit_utilization > 1.5) as out_of_range,
           total_outstanding > total_credit_limit * 1.5 as over_limit
    from {{credit_history}}
    where credit_utilization < 0 or credit_utilization > 1.5 or total_outstanding > total_credit_limit * 1.5
""")
def utilization(t):
    found = one(rules.credit_utilization())(t)
    return found.select("record_key", F.col("detail").contains("credit_utilization=").alias("out_of_range"),
                        F.col("detail").contains("total_outstanding=").alias("over_limit"))


@query("rule_income_consistency", """
    select customer_id as record_key, 'income_consistency' as rule_name, 'ERROR' as severity from {customers}
    where abs(annual_income - 12 * monthly_income) > 0.1 * abs(annual_income)
""")
def income_consistency(t):
    return one(rules.income_consistency())(t).select("record_key", "rule_name", "severity")


@query("rule_expense_consistency", f"""
    select {SNAP} as record_key, 'expense_consistency' as rule_name, 'WARNING' as severity from {{financial_profiles}}
    where monthly_expenses + monthly_emi > monthly_income * 1.5
""")
def expense_consistency(t):
    return one(rules.expense_consistency())(t).select("record_key", "rule_name", "severity")


query("rule_orphan_record", """
    select 'loan_applications' as "table", loan_id as record_key, 'orphan_record:loan_applications->customers' as rule_name,
           'ERROR' as severity, 'customer_id=' || customer_id || ' has no matching customers row' as detail
    from {loan_applications} l where not exists (select 1 from {customers} c where c.customer_id = l.customer_id)
""")(one(rules.orphan_record("loan_applications", "customers", "customer_id")))


@query("rule_employment_plausibility", """
    select customer_id as record_key, 'employment_plausibility' as rule_name from {customers} where employment_years > age - 16
""")
def employment(t):
    return one(rules.employment_plausibility())(t).select("record_key", "rule_name")


query("rule_temporal_leakage", f"""
    select 'financial_profiles' as "table", {SNAP} as record_key, 'temporal_leakage:financial_profiles' as rule_name,
           'ERROR' as severity, 'as_of_date=' || cast(as_of_date as string) || ' later than every application_date (' ||
           cast(latest as string) || ') for ' || customer_id as detail
    from {{financial_profiles}} join (select customer_id, max(application_date) as latest from {{loan_applications}} group by 1) using (customer_id)
    where as_of_date > latest
""")(one(rules.temporal_leakage("financial_profiles")))

# -- requests: one flat row per loan with its customer and latest snapshots ---------

FLAT = f"select * exclude (bureau), total_outstanding / total_credit_limit as credit_utilization from ({MERGED})"


def flat(*tables):
    """Loan, customer and latest snapshots in one row, as a scoring request has it."""
    merged = joins.point_in_time_join(*tables)
    return merged.withColumn("credit_utilization", F.col("total_outstanding") / F.col("total_credit_limit"))


def _bounds_sql(enums, bounds, lengths, cross) -> str:
    parts = []
    for c, values in enums.items():
        parts.append(f"case when {c} is null or {c} not in ({', '.join(repr(v) for v in values)}) then '{c}: not an accepted value' end")
    for c, (ge, gt, le) in bounds.items():
        tests = [f"{c} is null"]
        tests += [f"{c} < {ge}"] if ge is not None else []
        tests += [f"{c} <= {gt}"] if gt is not None else []
        tests += [f"{c} > {le}"] if le is not None else []
        parts.append(f"case when {' or '.join(tests)} then '{c}: out of bounds' end")
    for c, (low, high) in lengths.items():
        test = f"length({c}) < {low} or length({c}) > {high}"
        parts.append(f"case when {test if low == 0 else f'{c} is null or ' + test} then '{c}: length out of bounds' end")
    if cross:
        parts += [
            "case when abs(annual_income - 12 * monthly_income) > 0.05 * annual_income then "
            "'annual_income is inconsistent with monthly_income (must be within 5% of 12 * monthly_income)' end",
            "case when employment_years > age - 16 then 'employment_years cannot exceed age - 16' end",
            "case when total_outstanding > total_credit_limit * 1.5 then 'total_outstanding cannot exceed 1.5x total_credit_limit' end",
            "case when monthly_expenses + monthly_emi > monthly_income * 2 then 'monthly_expenses + monthly_emi cannot exceed 2x monthly_income' end",
        ]
    return f"""
        with flat as ({FLAT})
        select problem, count(*) as n from (select unnest([{', '.join(parts)}]) as problem from flat)
        where problem is not null group by problem
    """


def _request(enums, bounds, lengths, cross):
    def fn(t):
        problems = F.explode(compact(rules.request_problems(enums, bounds, lengths, cross))).alias("problem")
        parts = []
        for part in t.credit_slices():
            rows = flat(*(part[n] for n in ("customers", "loan_applications", "financial_profiles", "credit_history")))
            parts.append(rows.select(problems).groupBy("problem").agg(F.count("*").alias("n")))
        if len(parts) == 1:
            return parts[0]
        with passing(t.spark) as keep:
            return join_slices(parts, keep).groupBy("problem").agg(F.sum("n").alias("n"))

    return fn


query("request_enums", _bounds_sql(REQUEST_ENUMS, {}, {}, False))(_request(REQUEST_ENUMS, {}, None, False))
query("request_bounds", _bounds_sql({}, REQUEST_BOUNDS, REQUEST_LENGTHS, False))(_request({}, REQUEST_BOUNDS, REQUEST_LENGTHS, False))
query("request_cross_fields", _bounds_sql({}, {}, {}, True))(_request({}, {}, None, True))
query("scoring_input_bounds", _bounds_sql(SCORING_ENUMS, SCORING_BOUNDS, {}, False))(_request(SCORING_ENUMS, SCORING_BOUNDS, None, False))

# -- engine -------------------------------------------------------------------------

_ALL = f"""
    select 'financial_profiles' as t, {SNAP} as k, 'missing_value:financial_profiles.total_assets' as rule, 'WARNING' as s from {{financial_profiles}} where total_assets is null
    union all select 'customers', customer_id, 'missing_value:customers.annual_income', 'ERROR' from {{customers}} where annual_income is null
    union all select 'customers', customer_id, 'missing_value:customers.monthly_income', 'ERROR' from {{customers}} where monthly_income is null
    union all select 'customers', customer_id, 'missing_value:customers.age', 'ERROR' from {{customers}} where age is null
    union all select 'customers', customer_id, 'duplicate_record:customers:customer_id', 'ERROR' from (select customer_id, count(*) over (partition by customer_id) as n from {{customers}}) where n > 1
    union all select 'loan_applications', loan_id, 'duplicate_record:loan_applications:loan_id', 'ERROR' from (select loan_id, count(*) over (partition by loan_id) as n from {{loan_applications}}) where n > 1
    union all select 'customers', customer_id, 'duplicate_record:customers:exact-row', 'WARNING' from (select customer_id, count(*) over (partition by customer_id, age) as n from {{customers}}) where n > 1
    union all select 'customers', customer_id, 'numeric_range:customers.dependents', 'WARNING' from {{customers}} where dependents < 0 or dependents > 10
    union all select 'customers', customer_id, 'numeric_range:customers.city_tier', 'WARNING' from {{customers}} where city_tier < 1 or city_tier > 3
    union all select 'loan_applications', loan_id, 'numeric_range:loan_applications.loan_tenure_months', 'WARNING' from {{loan_applications}} where loan_tenure_months < 1 or loan_tenure_months > 600
    union all select 'loan_applications', loan_id, 'numeric_range:loan_applications.interest_rate', 'WARNING' from {{loan_applications}} where interest_rate < 0 or interest_rate > 40
    union all select 'credit_history', {SNAP}, 'numeric_range:credit_history.credit_history_months', 'WARNING' from {{credit_history}} where credit_history_months < 0 or credit_history_months > 600
    union all select 'credit_history', {SNAP}, 'numeric_range:credit_history.num_credit_accounts', 'WARNING' from {{credit_history}} where num_credit_accounts < 0 or num_credit_accounts > 50
    union all select 'customers', customer_id, 'negative_financial:customers', 'ERROR' from {{customers}} where annual_income < 0
    union all select 'customers', customer_id, 'negative_financial:customers', 'ERROR' from {{customers}} where monthly_income < 0
    union all select 'financial_profiles', {SNAP}, 'negative_financial:financial_profiles', 'ERROR' from {{financial_profiles}} where savings_balance < 0
    union all select 'customers', customer_id, 'impossible_age', 'ERROR' from {{customers}} where age < 18 or age > 100
    union all select 'loan_applications', loan_id, 'invalid_date:loan_applications', 'ERROR' from {{loan_applications}} where application_date > date '2001-01-01'
    union all select 'loan_applications', loan_id, 'invalid_date:loan_applications', 'ERROR' from {{loan_applications}} where decision_date > date '2001-01-01'
    union all select 'loan_applications', loan_id, 'invalid_date:loan_applications', 'ERROR' from {{loan_applications}} where decision_date < application_date
    union all select 'loan_outcomes', loan_id, 'invalid_date:loan_outcomes', 'WARNING' from {{loan_outcomes}} where outcome_observed_date > date '2001-01-01'
    union all select 'financial_profiles', {SNAP}, 'invalid_date:financial_profiles', 'WARNING' from {{financial_profiles}} where as_of_date > date '2001-01-01'
    union all select 'credit_history', {SNAP}, 'invalid_date:credit_history', 'WARNING' from {{credit_history}} where as_of_date > date '2001-01-01'
    union all select 'credit_history', {SNAP}, 'credit_utilization', 'ERROR' from {{credit_history}} where credit_utilization < 0 or credit_utilization > 1.5 or total_outstanding > total_credit_limit * 1.5
    union all select 'customers', customer_id, 'income_consistency', 'ERROR' from {{customers}} where abs(annual_income - 12 * monthly_income) > 0.1 * abs(annual_income)
    union all select 'financial_profiles', {SNAP}, 'expense_consistency', 'WARNING' from {{financial_profiles}} where monthly_expenses + monthly_emi > monthly_income * 1.5
    union all select 'loan_applications', loan_id, 'orphan_record:loan_applications->customers', 'ERROR' from {{loan_applications}} l where not exists (select 1 from {{customers}} c where c.customer_id = l.customer_id)
    union all select 'financial_profiles', {SNAP}, 'orphan_record:financial_profiles->customers', 'ERROR' from {{financial_profiles}} l where not exists (select 1 from {{customers}} c where c.customer_id = l.customer_id)
    union all select 'credit_history', {SNAP}, 'orphan_record:credit_history->customers', 'ERROR' from {{credit_history}} l where not exists (select 1 from {{customers}} c where c.customer_id = l.customer_id)
    union all select 'loan_outcomes', loan_id, 'orphan_record:loan_outcomes->loan_applications', 'ERROR' from {{loan_outcomes}} l where not exists (select 1 from {{loan_applications}} c where c.loan_id = l.loan_id)
    union all select 'customers', customer_id, 'employment_plausibility', 'WARNING' from {{customers}} where employment_years > age - 16
    union all select 'financial_profiles', {SNAP}, 'temporal_leakage:financial_profiles', 'ERROR' from {{financial_profiles}} join (select customer_id, max(application_date) as latest from {{loan_applications}} group by 1) using (customer_id) where as_of_date > latest
    union all select 'credit_history', {SNAP}, 'temporal_leakage:credit_history', 'ERROR' from {{credit_history}} join (select customer_id, max(application_date) as latest from {{loan_applications}} group by 1) using (customer_id) where as_of_date > latest
"""
_SIZES = """
    select 'customers' as t, count(*) as n from {customers} union all select 'loan_applications', count(*) from {loan_applications}
    union all select 'financial_profiles', count(*) from {financial_profiles} union all select 'credit_history', count(*) from {credit_history}
    union all select 'loan_outcomes', count(*) from {loan_outcomes}
"""


def full_run(t):
    return engine.run(t.credit(), rules.build_rules(RULES, as_of=AS_OF))


@query("engine_violations", f'with v as ({_ALL}) select t as "table", k as record_key, rule as rule_name, s as severity from v')
def engine_violations(t):
    return full_run(t).violations.drop("detail")


@query("engine_rule_counts", f'with v as ({_ALL}) select rule as rule_name, s as severity, t as "table", count(*) as count from v group by 1, 2, 3')
def engine_rule_counts(t):
    return full_run(t).rule_counts()


@query("engine_pct_of_rows", f"""
    with v as ({_ALL}), sizes as ({_SIZES}), c as (select rule, s, t, count(*) as n from v group by 1, 2, 3)
    select rule as rule_name, s as severity, c.t as "table", c.n as count, {R('100.0 * c.n / sizes.n')} as pct_of_rows from c join sizes on c.t = sizes.t
""")
def engine_pct(t):
    return rounded(full_run(t).counts_with_share())


@query("engine_quarantine_flags", f"""
    with v as ({_ALL}), bad as (select distinct k from v where s = 'ERROR' and t = 'loan_applications')
    select loan_id, loan_amount, bad.k is not null as is_quarantined from {{loan_applications}} left join bad on bad.k = loan_id
""")
def engine_flags(t):
    run = engine.run(t.derived(), rules.build_rules(RULES, as_of=AS_OF))
    return run.flagged("loan_applications").select("loan_id", "loan_amount", "is_quarantined")


@query("engine_split", f"""
    with v as ({_ALL}), bad as (select distinct k from v where s = 'ERROR' and t = 'customers')
    select customer_id, age, case when bad.k is null then 'clean' else 'quarantined' end as part
    from {{customers}} left join bad on bad.k = customer_id
""")
def engine_split(t):
    run = full_run(t)
    clean = run.clean("customers").select("customer_id", "age", F.lit("clean").alias("part"))
    return clean.unionByName(run.quarantined("customers").select("customer_id", "age", F.lit("quarantined").alias("part")))


@query("engine_summary", f"""
    with v as ({_ALL}), sizes as ({_SIZES}), rows as (
        select 'customers' as t, customer_id as k from {{customers}} union all select 'loan_applications', loan_id from {{loan_applications}}
        union all select 'financial_profiles', {SNAP} from {{financial_profiles}} union all select 'credit_history', {SNAP} from {{credit_history}}
        union all select 'loan_outcomes', loan_id from {{loan_outcomes}}),
    bad as (select distinct t, k from v where s = 'ERROR'),
    q as (select rows.t, count(*) as n from rows join bad on rows.t = bad.t and rows.k = bad.k group by 1)
    select sizes.t as "table", sizes.n as rows_in, coalesce(q.n, 0) as rows_quarantined, sizes.n - coalesce(q.n, 0) as rows_out
    from sizes left join q on q.t = sizes.t
""")
def engine_summary(t):
    return full_run(t).summary()


@query("engine_passed", f"with v as ({_ALL}) select count(*) filter (where s = 'ERROR') = 0 as passed from v")
def engine_passed(t):
    return t.spark.createDataFrame([(full_run(t).passed(),)], "passed boolean")


@query("engine_examples", f"""
    with v as ({_ALL}) select s as severity, t as "table", k as record_key, rule as rule_name from v
    order by severity, "table", record_key, rule_name limit 20
""")
def engine_examples(t):
    return full_run(t).examples(20).select("severity", "table", "record_key", "rule_name")


@query("engine_numeric_summary", f"""
    select 'annual_income' as feature, count(annual_income) as count, {R('avg(annual_income)')} as mean, {R('stddev_samp(annual_income)')} as std,
           {R('min(annual_income)')} as min, {R('quantile_cont(annual_income, 0.5)')} as median, {R('max(annual_income)')} as max from {{customers}}
    union all
    select 'age', count(age), {R('avg(age)')}, {R('stddev_samp(age)')}, {R('min(age)')}, {R('quantile_cont(age, 0.5)')}, {R('max(age)')} from {{customers}}
""")
def engine_numeric_summary(t):
    return rounded(engine.numeric_report(t["customers"], ["annual_income", "age"]))


@query("engine_violation_rate", f"""
    with v as ({_ALL}), sizes as ({_SIZES}), x as (select (select count(distinct k) from v) as flagged_keys, (select cast(sum(n) as bigint) from sizes) as total_rows)
    select flagged_keys, total_rows, {R('cast(flagged_keys as double) / total_rows')} as violation_rate,
           case when cast(flagged_keys as double) / total_rows >= 0.05 then 'ALERT' when cast(flagged_keys as double) / total_rows >= 0.02 then 'WARNING' else 'OK' end as status
    from x
""")
def engine_violation_rate(t):
    rate = full_run(t).violation_rate()
    status = engine.rate_status(F.col("violation_rate"), MONITORING["violation_rate_warning"], MONITORING["violation_rate_alert"])
    return rate.select("flagged_keys", "total_rows", r("violation_rate"), status.alias("status"))


_ISSUES = """
    select 'row_rule:' || event_type as rule_name, case when event_type = 'error' then 'ERROR' else 'WARNING' end as severity,
           ts as detected_at from {events}
"""


@query("quality_trend", f"""
    with i as ({_ISSUES}) select rule_name, severity, cast(detected_at as date) as day, count(*) as n from i
    where cast(detected_at as date) >= date '2024-01-10' group by 1, 2, 3
""")
def quality_trend(t):
    return engine.rule_violation_trend(t.sql(_ISSUES), date(2024, 1, 10))


# -- constraint-checked load -----------------------------------------------------------

ORDER = {
    "customers": ["row_no"], "loan_applications": ["row_no"], "financial_profiles": ["as_of_date"],
    "credit_history": ["as_of_date"], "loan_outcomes": ["loan_id"],
}


def load(t):
    tables = t.credit(customers="customers_loaded", loan_applications="loans_loaded")
    return constraints.load_constrained(tables, constraints.credit_constraints(ORDER))


_LOAD = """
    with c1 as (select *, case
            when age is null then 'not_null_violation:age' when gender is null then 'not_null_violation:gender'
            when marital_status is null then 'not_null_violation:marital_status'
            when employment_years is null then 'not_null_violation:employment_years'
            when annual_income is null then 'not_null_violation:annual_income'
            when not (age between 18 and 100) then 'customers_age_check'
            when annual_income < 0 then 'customers_annual_income_check'
            when dependents < 0 then 'customers_dependents_check'
            when employment_years < 0 then 'customers_employment_years_check'
            when monthly_income < 0 then 'customers_monthly_income_check' end as broke from {customers_loaded}),
    c2 as (select *, min(case when broke is null then row_no end) over (partition by customer_id) as first_no from c1),
    c as (select customer_id, coalesce(broke, case when row_no > first_no then 'customers_pkey' end) as rule from c2),
    ok_c as (select distinct customer_id from c where rule is null),
    l1 as (select *, case when loan_purpose is null then 'not_null_violation:loan_purpose'
            when interest_rate < 0 then 'loan_applications_interest_rate_check'
            when not loan_amount > 0 then 'loan_applications_loan_amount_check'
            when not loan_tenure_months > 0 then 'loan_applications_loan_tenure_months_check'
            when not exists (select 1 from ok_c where ok_c.customer_id = {loans_loaded}.customer_id) then 'foreign_key:customer_id' end as broke
        from {loans_loaded}),
    l2 as (select *, min(case when broke is null then row_no end) over (partition by loan_id) as first_no from l1),
    l as (select loan_id, coalesce(broke, case when row_no > first_no then 'loan_applications_pkey' end) as rule from l2),
    ok_l as (select distinct loan_id from l where rule is null),
    f as (select customer_id || '|' || cast(as_of_date as string) as k, case when total_assets is null then 'not_null_violation:total_assets'
            when not exists (select 1 from ok_c where ok_c.customer_id = {financial_profiles}.customer_id) then 'foreign_key:customer_id' end as rule
        from {financial_profiles}),
    h as (select customer_id || '|' || cast(as_of_date as string) as k, case when not (credit_utilization between 0 and 2) then 'credit_history_credit_utilization_check'
            when not exists (select 1 from ok_c where ok_c.customer_id = {credit_history}.customer_id) then 'foreign_key:customer_id' end as rule
        from {credit_history}),
    o as (select loan_id, case when not exists (select 1 from ok_l where ok_l.loan_id = {loan_outcomes}.loan_id) then 'foreign_key:loan_id' end as rule from {loan_outcomes}),
    everything as (select 'customers' as t, customer_id as k, rule from c union all select 'loan_applications', loan_id, rule from l
        union all select 'financial_profiles', k, rule from f union all select 'credit_history', k, rule from h union all select 'loan_outcomes', loan_id, rule from o)
"""


@query("load_issues", _LOAD + "select t as table_name, k as record_key, rule as rule_name, 'ERROR' as severity, 'violates ' || rule as detail from everything where rule is not null")
def load_issues(t):
    return load(t).issues


@query("load_summary", _LOAD + """
    select t as table_name, count(*) as attempted, count(*) filter (where rule is null) as inserted, count(*) filter (where rule is not null) as quarantined
    from everything group by t""")
def load_summary(t):
    return load(t).summary


@query("load_accepted_loans", _LOAD + "select loan_id from l where rule is null")
def load_accepted(t):
    return load(t).tables["loan_applications"].select("loan_id")
