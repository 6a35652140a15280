"""Joins, splits and features over the derived credit tables."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from registered.base import R, query, r, rounded
from registered.inputs import MERGED
from riskframe.config import MERGED_COLUMNS, ORDINAL_ORDER
from riskframe.operators import encode, features, joins, portfolio, split
from riskframe.operators.constraints import CHECKS, NOT_NULL
from riskframe.operators.ordered import join_slices, materialize, passing, shared_dir
from riskframe.sources import intake as intake_tables

_COLS = ", ".join(MERGED_COLUMNS)


def merged(t):
    c = t.credit()
    return joins.point_in_time_join(c["customers"], c["loan_applications"], c["financial_profiles"], c["credit_history"])


@query("point_in_time_join", f"select {_COLS} from ({MERGED})")
def point_in_time(t):
    return merged(t)


# Finer times than dates: each user's last error at or before every event.
@query("asof_join_events", """
    with e as (select user_id, ts as error_ts, value as error_value from {events} where event_type = 'error')
    select a.event_id, a.user_id, e.error_ts, e.error_value
    from {events} a asof left join e on a.user_id = e.user_id and a.ts >= e.error_ts
""")
def asof_events(t):
    errors = t["events"].where("event_type = 'error'").select("user_id", F.col("ts").alias("error_at"), F.col("value").alias("error_value"))
    return joins.asof_join(
        t["events"].select("event_id", "user_id", "ts"), errors, "user_id", "ts", "error_at", ["error_value"], "error_ts",
        slice_unit="day",
    ).select("event_id", "user_id", "error_ts", "error_value")


@query("customer_left_join", """
    select loan_id, l.customer_id, age, education from {loan_applications} l left join {customers} c on l.customer_id = c.customer_id
""")
def customer_join(t):
    return t["loan_applications"].join(t["customers"], "customer_id", "left").select("loan_id", "customer_id", "age", "education")


@query("align_target", """
    select l.loan_id, l.loan_amount, o.default_12m from {loan_applications} l join {loan_outcomes} o on l.loan_id = o.loan_id
""")
def align(t):
    return joins.align_target(t["loan_applications"].select("loan_id", "loan_amount"), t["loan_outcomes"])


@query("filter_tables", """
    with l as (select loan_id, customer_id from {loan_applications} where loan_type = 'HOME'), c as (select distinct customer_id from l)
    select 'loan_applications' as "table", count(*) as n from l
    union all select 'customers', count(*) from {customers} where customer_id in (select customer_id from c)
    union all select 'financial_profiles', count(*) from {financial_profiles} where customer_id in (select customer_id from c)
    union all select 'credit_history', count(*) from {credit_history} where customer_id in (select customer_id from c)
    union all select 'loan_outcomes', count(*) from {loan_outcomes} where loan_id in (select loan_id from l)
""")
def filter_tables(t):
    ids = t["loan_applications"].where("loan_type = 'HOME'").select("loan_id")
    return _sizes(joins.filter_tables(t.credit(), ids))


def _sizes(tables):
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "n") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("window_tables", """
    with l as (select loan_id, customer_id from {loan_applications} where application_date between date '1997-03-01' and date '1998-02-28'),
    c as (select distinct customer_id from l)
    select 'loan_applications' as "table", count(*) as n from l
    union all select 'customers', count(*) from {customers} where customer_id in (select customer_id from c)
    union all select 'financial_profiles', count(*) from {financial_profiles} where customer_id in (select customer_id from c)
    union all select 'credit_history', count(*) from {credit_history} where customer_id in (select customer_id from c)
    union all select 'loan_outcomes', count(*) from {loan_outcomes} where loan_id in (select loan_id from l)
""")
def window_tables(t):
    return _sizes(joins.window_tables(t.credit(), date(1997, 3, 1), date(1998, 2, 28)))


@query("matured_predictions", """
    select p.loan_id, default_probability, credit_score, risk_category, recommendation, latency_ms, created_at, default_12m, outcome_observed_date
    from {predictions} p join {loan_outcomes} o on p.loan_id = o.loan_id
    where model_id = 'm1' and outcome_observed_date between date '1998-01-01' and date '1999-12-31'
""")
def matured(t):
    return joins.matured_predictions(t["predictions"], t["loan_outcomes"], "m1", date(1998, 1, 1), date(1999, 12, 31))


@query("latest_prediction", """
    select customer_id, prediction_id, created_at from (
        select *, row_number() over (partition by customer_id order by created_at desc, prediction_id desc) as k from {predictions}) where k = 1
""")
def latest(t):
    return joins.latest_per_key(t["predictions"], ["customer_id"], ["created_at", "prediction_id"]).select("customer_id", "prediction_id", "created_at")


_REGISTRY = [("m1", "1.0.0"), ("m2", "1.1.0")]


@query("application_view", f"""
    with newest as (select * from (select *, row_number() over (partition by loan_id order by created_at desc, prediction_id desc) as k from {{predictions}}) where k = 1),
    reg(model_id, model_version) as (values ('m1', '1.0.0'), ('m2', '1.1.0'))
    select l.loan_id, l.status, p.prediction_id, p.credit_score, p.recommendation, reg.model_version, round_even(p.default_probability, 4) as default_probability
    from {{loan_applications}} l left join newest p on p.loan_id = l.loan_id left join reg on reg.model_id = p.model_id
""")
def app_view(t):
    registry = t.spark.createDataFrame(_REGISTRY, "model_id string, model_version string")
    return joins.application_view(t["loan_applications"], t["predictions"], registry).select(
        "loan_id", "status", "prediction_id", "credit_score", "recommendation", "model_version", "default_probability")


@query("intake_split", f"""
    with a as (select *, total_outstanding / total_credit_limit as credit_utilization from ({MERGED}))
    select 'customers' as "table", customer_id as key, annual_income as v from a union all select 'loan_applications', loan_id, loan_amount from a
    union all select 'financial_profiles', customer_id || '|' || cast(application_date as string), monthly_expenses from a
    union all select 'credit_history', customer_id || '|' || cast(application_date as string), total_outstanding from a
""")
def intake(t):
    a = merged(t).withColumn("credit_utilization", F.col("total_outstanding") / F.col("total_credit_limit"))
    return _intake_rows(joins.intake_split(a))


def _intake_rows(parts):
    snap = F.concat_ws("|", "customer_id", F.col("as_of_date").cast("string"))

    def show(name, key, v):
        return parts[name].select(F.lit(name).alias("table"), key.alias("key"), F.col(v).alias("v"))

    return (
        show("customers", F.col("customer_id"), "annual_income").unionByName(show("loan_applications", F.col("loan_id"), "loan_amount"))
        .unionByName(show("financial_profiles", snap, "monthly_expenses")).unionByName(show("credit_history", snap, "total_outstanding"))
    )


def _valid() -> str:
    """Every not-null and check constraint of an application's four rows, as SQL."""
    tests = [f"{c} is not null" for t in intake_tables.TABLES for c in NOT_NULL[t] if c not in ("status", "as_of_date")]
    return " and ".join(tests + [f"({c})" for t in intake_tables.TABLES for c in CHECKS[t].values()])


@query("intake_commit", f"""
    with a as (select *, total_outstanding / total_credit_limit as credit_utilization from ({MERGED})),
    r as (select *, row_number() over (partition by customer_id order by (application_date >= date '1998-01-01')::int, application_date, loan_id, loan_amount, age) as nth from a where {_valid()}),
    k as (select * from r where nth = 1)
    select 'customers' as "table", customer_id as key, annual_income as v from k union all select 'loan_applications', loan_id, loan_amount from k
    union all select 'financial_profiles', customer_id || '|' || cast(application_date as string), monthly_expenses from k
    union all select 'credit_history', customer_id || '|' || cast(application_date as string), total_outstanding from k
""")
def intake_commit(t):
    """Two intakes, older applications first; a customer can apply once."""
    root = f"{shared_dir(t.spark)}/intake-{uuid.uuid4().hex}"
    old = F.col("application_date") < F.lit("1998-01-01").cast("date")
    with passing(t.spark):
        names = ("customers", "loan_applications", "financial_profiles", "credit_history")
        parts = [joins.point_in_time_join(*(part[n] for n in names)) for part in t.credit_slices()]
        a = join_slices([p.withColumn("credit_utilization", F.col("total_outstanding") / F.col("total_credit_limit")) for p in parts], materialize)
        for part in (a.where(old), a.where(~old)):
            intake_tables.take_in(t.spark, root, part, ["application_date", "loan_id", "loan_amount", "age"])
    return _intake_rows(intake_tables.read_tables(t.spark, root))


@query("map_parameter", """
    select loan_id, case when loan_type = 'HOME' then 8.5 when loan_type = 'AUTO' then 9.5 else 12.0 end as base_rate from {loan_applications}
""")
def map_parameter(t):
    return t["loan_applications"].select("loan_id", joins.map_parameter("loan_type", {"HOME": 8.5, "AUTO": 9.5}, 12.0).alias("base_rate"))


# -- features -------------------------------------------------------------------------

def _safe(n, d, cap):
    return f"least(greatest(case when {d} > 0 and {n} is not null then ({n}) / {d} else {cap}.0 end, 0.0), {cap}.0)"


_EMI = """case when loan_tenure_months <= 0 then loan_amount
    when abs(interest_rate / 12.0 / 100.0) <= 1e-8 then loan_amount / loan_tenure_months
    else loan_amount * (interest_rate / 12.0 / 100.0) * pow(1 + interest_rate / 12.0 / 100.0, loan_tenure_months)
         / (pow(1 + interest_rate / 12.0 / 100.0, loan_tenure_months) - 1) end"""

_RATIOS = f"""
    select loan_id, age, {R('e', 4)} as proposed_emi, {R(_safe('monthly_emi + monthly_expenses', 'monthly_income', 5))} as dti,
        {R(_safe('monthly_emi', 'monthly_income', 2))} as emi_to_income, {R(_safe('total_outstanding', 'total_credit_limit', 2))} as credit_utilization,
        {R(_safe('loan_amount', 'annual_income', 10))} as loan_to_income, {R(_safe('monthly_emi + e + monthly_expenses', 'monthly_income', 5))} as post_loan_dti,
        {R(_safe('savings_balance', 'monthly_income', 50))} as savings_to_income, {R('total_assets - total_liabilities')} as net_worth,
        {R('total_liabilities / case when total_assets is not null then greatest(total_assets, 1.0) end')} as leverage_ratio,
        {R('monthly_income - monthly_expenses - monthly_emi')} as disposable_income,
        {R('savings_balance / case when monthly_expenses is not null then greatest(monthly_expenses, 1.0) end')} as months_of_runway
    from (select *, {_EMI} as e from ({MERGED}))
"""


@query("ratio_features", _RATIOS)
def ratios(t):
    out = features.ratio_features(merged(t))
    names = ["dti", "emi_to_income", "credit_utilization", "loan_to_income", "post_loan_dti", "savings_to_income",
             "net_worth", "leverage_ratio", "disposable_income", "months_of_runway"]
    return out.select("loan_id", "age", r("proposed_emi", 4), *[r(c) for c in names])


def _floor(c, low):
    return f"case when {c} is not null then greatest(cast({c} as double), {low}) end"


@query("behavioural_features", f"""
    select loan_id, age, {R('credit_history_months / 12.0')} as credit_history_years,
        {R(f"(late_payments_12m + missed_payments_12m) / {_floor('num_credit_accounts', 1.0)}")} as delinquency_rate,
        case when previous_defaults > 0 then 1 else 0 end as has_prior_default,
        {R(f"num_credit_accounts / {_floor('(credit_history_months / 12.0)', 0.5)}")} as accounts_per_year,
        {R(f"active_loans / {_floor('(active_loans + closed_loans)', 1.0)}")} as active_loan_ratio,
        {R(f"employment_years / {_floor('(age - 18)', 1.0)}")} as employment_stability,
        {R('monthly_income / (dependents + 1.0)')} as income_per_dependent
    from ({MERGED})
""")
def behavioural(t):
    out = features.behavioural_features(merged(t))
    return out.select("loan_id", "age", r("credit_history_years"), r("delinquency_rate"), "has_prior_default", r("accounts_per_year"),
                      r("active_loan_ratio"), r("employment_stability"), r("income_per_dependent"))


@query("utilization_band", """
    select customer_id, as_of_date, case when credit_utilization is null then 'nan' when credit_utilization <= 0.3 then '0-30' when credit_utilization <= 0.5 then '30-50'
        when credit_utilization <= 0.7 then '50-70' when credit_utilization <= 0.9 then '70-90' else '90+' end as band from {credit_history}
""")
def utilization(t):
    return t["credit_history"].select("customer_id", "as_of_date", features.utilization_band().alias("band"))


@query("quantile_edges", f"""
    select 'age' as name, i, {R('quantile_cont(age, p)')} as edge from {{customers}}, (select unnest(range(6)) as i) x, lateral (select i / 5.0 as p) y group by i, p
""".replace("quantile_cont(age, p)", "q[i + 1]").replace(
    "from {customers}, (select unnest(range(6)) as i) x, lateral (select i / 5.0 as p) y group by i, p",
    "from (select quantile_cont(age, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) as q from {customers}), (select unnest(range(6)) as i)"))
def quantile_edges(t):
    edges = features.fit_bands(t["customers"], {"age": "age"})["age"]
    return t.spark.createDataFrame([("age", i, round(e, 6)) for i, e in enumerate(edges)], "name string, i long, edge double")


_BANDS = """
    with q as (select quantile_cont(age, [0.2, 0.4, 0.6, 0.8]) as a, quantile_cont(employment_years, [0.2, 0.4, 0.6, 0.8]) as e,
                      quantile_cont(annual_income, [0.2, 0.4, 0.6, 0.8]) as m from {customers})
    select customer_id, age, {A} as age_band, {E} as tenure_band, {M} as income_band from {customers}, q
"""


def _band_sql(c, q):
    return (f"case when {c} is null then 'nan' when {c} <= {q}[1] then 'Q1' when {c} <= {q}[2] then 'Q2' when {c} <= {q}[3] then 'Q3' "
            f"when {c} <= {q}[4] then 'Q4' else 'Q5' end")


@query("quantile_bands", _BANDS.replace("{A}", _band_sql("age", "q.a")).replace("{E}", _band_sql("employment_years", "q.e"))
       .replace("{M}", _band_sql("annual_income", "q.m")))
def quantile_bands(t):
    c = t["customers"]
    edges = features.fit_bands(c)
    return c.select("customer_id", "age", *[features.quantile_band(F.col(src).cast("double"), edges[b]).alias(b) for b, src in features.BANDED.items()])


@query("display_bands", """
    select customer_id, age, case when age < 26 then '18-25' when age < 36 then '26-35' when age < 46 then '36-45' when age < 56 then '46-55'
        when age < 66 then '56-65' when age is not null then '66+' end as age_band,
        case when annual_income < 300000 then '<3L' when annual_income < 600000 then '3-6L' when annual_income < 1000000 then '6-10L'
        when annual_income < 2000000 then '10-20L' when annual_income is not null then '20L+' end as income_band from {customers}
""")
def display_bands(t):
    return t["customers"].select("customer_id", "age", portfolio.age_display_band().alias("age_band"), portfolio.income_display_band().alias("income_band"))


@query("impute_and_scale", f"""
    with m as (select quantile_cont(annual_income, 0.5) as med from {{customers}}),
    x as (select customer_id, age, coalesce(annual_income, med) as v from {{customers}}, m),
    s as (select avg(v) as mean, stddev_pop(v) as std from x)
    select customer_id, age, {R('(v - mean) / std')} as annual_income from x, s
""")
def impute_scale(t):
    c = t["customers"]
    state = encode.fit(c, ["annual_income"], [], [])
    return encode.transform(c.select("customer_id", F.col("age").alias("years"), "annual_income"), state, ["customer_id", "years"]).select(
        "customer_id", F.col("years").alias("age"), r("annual_income"))


@query("one_hot", """
    with n as (select count(*) as total from {loan_applications}),
    x as (select loan_id, loan_amount, coalesce(loan_purpose, 'UNKNOWN') as v from {loan_applications}),
    freq as (select v, count(*) >= 0.105 * (select total from n) as kept from x group by v)
    select loan_id, loan_amount, case when kept then 'loan_purpose_' || x.v else 'loan_purpose_infrequent' end as hot,
        cast(1 as double) as total
    from x join freq on x.v = freq.v
""")
def one_hot(t):
    """Which column of each row is 1, and the sum of all its columns."""
    loans = t["loan_applications"]
    return _hot(loans, encode.fit(loans, [], ["loan_purpose"], [], min_frequency=0.105), ["loan_id", "loan_amount"])


def _hot(df, state, keep):
    names = state.names()
    wide = encode.transform(df, state, keep)
    total = sum((F.col(c) for c in names), F.lit(0.0))
    hot = F.concat_ws(",", *[F.when(F.col(c) == 1.0, F.lit(c)) for c in names])
    return wide.select(*keep, hot.alias("hot"), total.alias("total"))


@query("one_hot_many_levels", """
    with n as (select count(*) as total from {orders}),
    old as (select cast(o_custkey as string) as v, count(*) as n from {orders} where o_orderdate < date '2000-01-01' group by 1),
    kept as (select v from old where n >= 0.0013 * (select sum(n) from old))
    select o_orderkey, case when c.v in (select v from kept) then 'o_custkey_' || c.v when c.v in (select v from old) then 'o_custkey_infrequent' else '' end as hot,
        cast(case when c.v in (select v from old) then 1 else 0 end as double) as total
    from (select o_orderkey, cast(o_custkey as string) as v from {orders}) c
""")
def one_hot_many_levels(t):
    """Nearly as many levels as rows: some kept, most infrequent, some never seen in training."""
    orders = t["orders"]
    state = encode.fit(orders.where(F.col("o_orderdate") < F.lit("2000-01-01").cast("date")), [], ["o_custkey"], [], min_frequency=0.0013)
    return _hot(orders, state, ["o_orderkey"])


@query("ordinal_code", """
    select customer_id, as_of_date, cast(case when credit_utilization <= 0.3 then 0 when credit_utilization <= 0.5 then 1
        when credit_utilization <= 0.7 then 2 when credit_utilization <= 0.9 then 3 when credit_utilization is not null then 4 else -1 end as double) as code from {credit_history}
""")
def ordinal(t):
    band = features.utilization_band()
    return t["credit_history"].select("customer_id", "as_of_date", encode.ordinal_code(band, ORDINAL_ORDER["utilization_band"], None).alias("code"))


@query("target_correlation", f"""
    select 'price' as feature, {R('corr(price, y)')} as r from {{feature_rows}} union all select 'quantity', {R('corr(quantity, y)')} from {{feature_rows}}
    union all select 'mostly_zero', {R('corr(mostly_zero, y)')} from {{feature_rows}} union all select 'discount', {R('corr(discount, y)')} from {{feature_rows}}
""")
def target_correlation(t):
    return rounded(features.target_correlation(t["feature_rows"], ["price", "quantity", "mostly_zero", "discount"], "y"))


@query("leakage_correlation", f"""
    select feature, {R('r')} as r from (select 'quantity' as feature, corr(quantity, y) as r from {{feature_rows}} union all select 'price', corr(price, y) from {{feature_rows}}) where abs(r) > 0.8
""")
def leakage_correlation(t):
    return rounded(features.correlation_offenders(t["feature_rows"], ["quantity", "price"], "y", 0.8))


# -- splits and ordered samples ---------------------------------------------------------

_SPLIT = """
    with p as (select o_orderkey, d, row_number() over (order by d, o_orderkey) as position, count(*) over () as n from {scored_loans}),
    s as (select *, case when position <= round_even(n * 0.7, 0) then 'train' when position <= round_even(n * (0.7 + 0.15), 0) then 'val' else 'test' end as split from p)
"""


def _split(t):
    return split.temporal_split(t["scored_loans"], "d", "o_orderkey")


@query("temporal_split", _SPLIT + "select o_orderkey, position, split from s")
def temporal_split(t):
    return _split(t).select("o_orderkey", "position", "split")


@query("split_ranges", _SPLIT + "select split, min(d) as min_date, max(d) as max_date, count(*) as n_loans from s group by split")
def split_ranges(t):
    return split.split_ranges(_split(t), "d")


@query("stratified_folds", """
    with c as (select y, count(*) as n from {scored_loans} group by y)
    select y, fold, cast(n // 5 + case when fold < n % 5 then 1 else 0 end as bigint) as n from c, (select cast(unnest(range(5)) as int) as fold)
""")
def folds(t):
    return split.stratified_folds(t["scored_loans"], "y", ["o_orderkey"]).groupBy("y", "fold").agg(F.count("*").alias("n"))


@query("undersample", """
    with c as (select y, count(*) as n from {scored_loans} group by y) select y, (select min(n) from c) as n from c
""")
def undersample(t):
    return split.undersample(t["scored_loans"], "y", ["o_orderkey"]).groupBy("y").agg(F.count("*").alias("n"))


@query("stratified_sample", """
    with c as (select y, count(*) as m, sum(count(*)) over () as total from {scored_loans} group by y),
    q as (select y, 200.0 * m / total as share, floor(200.0 * m / total) as quota from c),
    k as (select *, row_number() over (order by quota - share, y) as place, cast(200 - sum(quota) over () as bigint) as spare from q)
    select y, cast(quota + case when place <= spare then 1 else 0 end as bigint) as n from k
""")
def stratified_sample(t):
    return split.stratified_sample(t["scored_loans"], "y", ["o_orderkey"], 200).groupBy("y").agg(F.count("*").alias("n"))


@query("exact_sample", "select least(500, count(*)) as n, count(*) as total from {scored_loans}")
def exact_sample(t):
    s = split.exact_sample(t["scored_loans"], ["o_orderkey"], 500)
    return s.agg(F.count_distinct("o_orderkey").alias("n")).withColumn("total", t["scored_loans"].agg(F.count("*")).scalar())


@query("disjoint_pools", """
    select pool, n from (select 'a' as pool, cast(round_even(count(*) * 0.05, 0) as bigint) as n from {scored_loans}
    union all select 'b', cast(round_even(count(*) * 0.11, 0) as bigint) from {scored_loans})
""")
def pools(t):
    return split.disjoint_pools(t["scored_loans"], ["o_orderkey"], {"a": 0.05, "b": 0.11}).where("pool is not null").groupBy("pool").agg(F.count("*").alias("n"))


_NUDGE = """
    with b as (select user_id, event_id, cast(ts as date) as d, row_number() over (partition by user_id order by cast(ts as date), event_id) - 1 as k from {events}),
    m as (select *, max(datediff('day', date '1970-01-01', d) - k) over (partition by user_id order by k) + k as day_no from b)
"""


@query("nudge_repeated_dates", _NUDGE + "select event_id, user_id, date '1970-01-01' + cast(day_no as int) as d from m")
def nudge(t):
    e = t["events"].select("event_id", "user_id", F.col("ts").cast("date").alias("d"))
    return split.nudge_repeated_dates(e, "user_id", "d", ["event_id"])


@query("calibrated_intercept", """
    select count(*) as n, true as hit from {scored_loans}
""")
def intercept(t):
    df = t["scored_loans"].select((F.col("p") * 6 - 3).alias("x"))
    b = split.calibrate_intercept(df, "x", 0.2)
    rate = F.avg(1.0 / (1.0 + F.exp(-(F.col("x") + b))))
    return df.agg(F.count("*").alias("n"), (F.abs(rate - 0.2) < 1e-4).alias("hit"))


@query("group_max_to_rows", "select loan_id, loan_amount, max(application_date) over (partition by customer_id) as last_application from {loan_applications}")
def group_max(t):
    loans = t["loan_applications"]
    last = loans.groupBy("customer_id").agg(F.max("application_date").alias("last_application"))
    return loans.join(last, "customer_id", "left").select("loan_id", "loan_amount", "last_application")
