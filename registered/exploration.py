"""Exploratory statistics and portfolio views."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.base import R, query, rounded
from riskframe.config import HIGH_RISK
from riskframe.operators import explore, portfolio

NUM = ["price", "discount", "tax", "quantity", "mostly_zero"]
CAT = ["flag", "state"]
THRESHOLD = 0.25


@query("default_rate_summary", f"""
    select count(*) as n, cast(sum(y) as bigint) as n_default, count(*) - cast(sum(y) as bigint) as n_non_default, {R('avg(y)')} as default_rate from {{feature_rows}}
""")
def default_rate_summary(t):
    return rounded(explore.default_rate_summary(t["feature_rows"], "y"))


def _summary_sql(c):
    # Population skew and excess kurtosis from central moments.
    return f"""
        select '{c}' as feature, count(v) as n, count(*) - count(v) as n_missing, {R('avg(v)')} as mean, {R('stddev_samp(v)')} as std, {R('min(v)')} as min,
            {R('quantile_cont(v, 0.25)')} as p25, {R('quantile_cont(v, 0.5)')} as median, {R('quantile_cont(v, 0.75)')} as p75, {R('max(v)')} as max,
            {R('avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5)', 5)} as skew, {R('avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2) - 3', 5)} as kurtosis,
            abs(avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5)) > 1 as log_transform_flag
        from (select cast({c} as double) as v, avg(cast({c} as double)) over () as m from {{feature_rows}})
    """


@query("numeric_summary", " union all ".join(_summary_sql(c) for c in NUM))
def numeric_summary(t):
    out = explore.numeric_summary(t["feature_rows"], NUM)
    return rounded(out.withColumns({"skew": F.round("skew", 5), "kurtosis": F.round("kurtosis", 5)}))


@query("categorical_frequency", """
    select 'flag' as feature, flag as value, count(*) as count, round_even(100.0 * count(*) / (select count(*) from {feature_rows}), 2) as pct from {feature_rows} group by flag
    union all select 'state', state, count(*), round_even(100.0 * count(*) / (select count(*) from {feature_rows}), 2) from {feature_rows} group by state
""")
def categorical_frequency(t):
    return explore.categorical_frequency(t["feature_rows"], CAT)


def _decile_cte(c):
    # Edges equal to the minimum are repeats of the outer edge and bound no bin.
    tests = " ".join(f"when v <= q[{i}] and q[{i}] > lo then {i}" for i in range(1, 10))
    return f"""
        select '{c}' as feature, b, count(*) as n, cast(sum(y) as bigint) as n_default, min(v) as min_value, max(v) as max_value
        from (select y, v, case {tests} else 10 end as b
              from (select y, cast({c} as double) as v from {{feature_rows}}) x,
                   (select quantile_cont(cast({c} as double), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q, min(cast({c} as double)) as lo from {{feature_rows}}) e
              where v is not null) group by b
    """


_DECILES = "with d as (" + " union all ".join(_decile_cte(c) for c in NUM) + ")"


@query("default_rate_by_decile", _DECILES + f"""
    select feature, cast(row_number() over (partition by feature order by b) as int) as decile, {R('min_value')} as min_value, {R('max_value')} as max_value,
        n, n_default, {R('cast(n_default as double) / n')} as default_rate from d
""")
def deciles(t):
    return rounded(explore.decile_counts(t["feature_rows"], NUM, "y"))


@query("default_rate_by_band", f"""
    select flag, count(y) as n, cast(sum(y) as bigint) as n_default, {R('avg(y)')} as default_rate from {{feature_rows}} group by flag
""")
def by_band(t):
    return rounded(explore.default_rate_by_band(t["feature_rows"], "flag", "y", ["N", "A", "R"]))


_PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1:]]


@query("correlation_matrix", "with " + " union all ".join(
    f"select '{a}' as fa, '{b}' as fb, corr({a}, {b}) as v from {{feature_rows}}" for a, b in [*_PAIRS, *[(b, a) for a, b in _PAIRS], *[(c, c) for c in NUM]]
).join(("c as (", ")")) + "select fa as feature, " + ", ".join(f"{R(f'max(case when fb = {chr(39)}{c}{chr(39)} then v end)')} as {c}" for c in NUM) + " from c group by fa")
def correlation_matrix(t):
    return rounded(explore.correlation_matrix(t["feature_rows"], NUM))


@query("high_correlation_pairs", "select feature_a, feature_b, " + R("v") + " as r from (" + " union all ".join(
    f"select '{a}' as feature_a, '{b}' as feature_b, corr({a}, {b}) as v from {{feature_rows}}" for a, b in [*_PAIRS, *[(c, "y") for c in NUM]]) + ") where abs(v) > 0.5")
def high_pairs(t):
    return rounded(explore.high_correlation_pairs(t["feature_rows"], [*NUM, "y"], 0.5))


@query("point_biserial", " union all ".join(
    f"select '{c}' as feature, {R(f'corr(y, {c})')} as point_biserial_r from {{feature_rows}}" for c in NUM))
def point_biserial(t):
    return rounded(explore.point_biserial(t["feature_rows"], NUM, "y").drop("p_value"))


@query("point_biserial_p_value")
def point_biserial_p(t):
    return explore.point_biserial(t["feature_rows"], NUM, "y")


_CAT_BINS = """
    select 'flag' as feature, flag as value, count(y) as n, cast(sum(y) as bigint) as n_default from {feature_rows} group by flag
    union all select 'state', state, count(y), cast(sum(y) as bigint) from {feature_rows} group by state
"""
_WOE = """
    e as (select *, case when n_default = 0 then 0.5 else cast(n_default as double) end as ev, case when n = n_default then 0.5 else cast(n - n_default as double) end as ne from b),
    w as (select *, ev / sum(ev) over (partition by feature) as de, ne / sum(ne) over (partition by feature) as dn from e)
"""


@query("woe_iv_categorical", f"""
    with b as ({_CAT_BINS}), {_WOE}
    select feature, value, n, n_default, {R('cast(n_default as double) / n')} as default_rate, {R('ln(dn / de)')} as woe, {R('(dn - de) * ln(dn / de)')} as iv_part from w
""")
def woe_categorical(t):
    return rounded(explore.woe_iv_categorical(t["feature_rows"], CAT, "y"))


@query("woe_iv_numeric", _DECILES + f""", b as (select * from d), {_WOE}
    select feature, cast(row_number() over (partition by feature order by b) as int) as decile, n, n_default, {R('ln(dn / de)')} as woe, {R('(dn - de) * ln(dn / de)')} as iv_part from w
""")
def woe_numeric(t):
    return rounded(explore.woe_iv_numeric(t["feature_rows"], NUM, "y").select("feature", "decile", "n", "n_default", "woe", "iv_part"))


_IV = _DECILES + """, b as (
    select feature, cast(b as string) as value, n, n_default from d where feature in ('price', 'quantity')
    union all select 'discount', cast(discount as string), count(y), cast(sum(y) as bigint) from {feature_rows} where discount is not null group by discount
    union all select 'tax', cast(tax as string), count(y), cast(sum(y) as bigint) from {feature_rows} group by tax
    union all select 'mostly_zero', cast(mostly_zero as string), count(y), cast(sum(y) as bigint) from {feature_rows} group by mostly_zero
    union all """ + _CAT_BINS + "), " + _WOE + """, iv as (select feature, sum((dn - de) * ln(dn / de)) as v from w group by feature)
    select feature, case when feature in ('flag', 'state') then 'categorical' else 'numeric' end as type, """ + R("v") + """ as iv,
        case when v < 0.02 then 'useless' when v < 0.1 then 'weak' when v < 0.3 then 'medium' when v < 0.5 then 'strong'
             else 'suspiciously strong - investigate for leakage' end as interpretation from iv
"""


@query("iv_table", _IV)
def iv_table(t):
    return rounded(explore.iv_table(t["feature_rows"], NUM, CAT, "y"))


_MONTHLY = "select strftime(shipped, '%Y-%m') as month, count(y) as n, cast(sum(y) as bigint) as n_default, avg(y) as rate from {feature_rows} group by 1"


@query("monthly_rates", f"with m as ({_MONTHLY}) select month, n, n_default, {R('rate')} as default_rate from m")
def monthly(t):
    return rounded(explore.monthly_rates(t["feature_rows"], "shipped", "y"))


@query("regime_shift", f"""
    with m as ({_MONTHLY}), s as (select avg(rate) as a, coalesce(stddev_samp(rate), 0) as sd from m)
    select {R('any_value(a)')} as mean_default_rate, {R('any_value(sd)')} as std_default_rate,
        coalesce(list(month order by month) filter (where sd > 0 and abs(rate - a) > 2 * sd), []) as flagged_months,
        count(*) filter (where sd > 0 and abs(rate - a) > 2 * sd) > 0 as regime_shift_detected from m, s
""")
def regime(t):
    return rounded(explore.regime_shift(explore.monthly_rates(t["feature_rows"], "shipped", "y")))


@query("portfolio_benchmarks", f"""
    select 'price' as feature, {R('quantile_cont(price, 0.5)')} as median, cast(null as string) as mode from {{feature_rows}}
    union all select 'discount', {R('quantile_cont(discount, 0.5)')}, null from {{feature_rows}}
    union all select 'flag', null, (select flag from {{feature_rows}} group by flag order by count(*) desc, flag limit 1)
    union all select 'state', null, (select state from {{feature_rows}} group by state order by count(*) desc, state limit 1)
""")
def portfolio_benchmarks(t):
    b = explore.benchmarks(t["feature_rows"], ["price", "discount"], CAT)
    rows = [(k, None if "median" not in v else round(v["median"], 6), v.get("mode")) for k, v in b.items()]
    return t.spark.createDataFrame(rows, "feature string, median double, mode string")


@query("score_histogram", f"""
    with m as (select min(credit_score) as lo, max(credit_score) as hi from {{predictions}}),
    h as (select least(cast(floor((credit_score - lo) / (cast(hi - lo as double) / 30)) as int), 29) as bin, count(*) as n from {{predictions}}, m group by 1)
    select b.bin, {R('lo + b.bin * (cast(hi - lo as double) / 30)')} as bin_start, {R('lo + (b.bin + 1) * (cast(hi - lo as double) / 30)')} as bin_end, coalesce(h.n, 0) as n
    from (select cast(unnest(range(30)) as int) as bin) b left join h on h.bin = b.bin, m
""")
def histogram(t):
    return rounded(explore.histogram(t["predictions"], "credit_score", 30))


@query("ordered_counts", """
    select place, c as risk_category, count(p.risk_category) as n from (values (0, 'VERY_LOW'), (1, 'LOW'), (2, 'MODERATE'), (3, 'HIGH'), (4, 'VERY_HIGH'), (5, 'UNRATED')) o(place, c)
    left join {predictions} p on p.risk_category = c group by place, c
""")
def ordered_counts(t):
    return explore.ordered_counts(t["predictions"], "risk_category", ["VERY_LOW", "LOW", "MODERATE", "HIGH", "VERY_HIGH", "UNRATED"])


# -- prediction log -----------------------------------------------------------------

_OPS = f"""
    cast(count(*) as double) as prediction_volume, {R("avg(case when recommendation = 'APPROVE' then 1.0 else 0.0 end)")} as approve_rate,
    {R("avg(case when recommendation = 'REVIEW' then 1.0 else 0.0 end)")} as review_rate, {R("avg(case when recommendation = 'REJECT' then 1.0 else 0.0 end)")} as reject_rate,
    {R('avg(credit_score)')} as avg_credit_score, {R('avg(default_probability)')} as avg_default_probability,
    {R("avg(case when risk_category in ('HIGH', 'VERY_HIGH') then 1.0 else 0.0 end)")} as high_risk_share, {R('quantile_cont(latency_ms, 0.95)')} as latency_p95_ms
"""


@query("operational_metrics", f"select {_OPS} from {{predictions}} where model_id = 'm1' and cast(created_at as date) between date '2024-01-05' and date '2024-01-20'")
def operational(t):
    return rounded(portfolio.operational_metrics(portfolio.in_window(t["predictions"], "2024-01-05", "2024-01-20", "m1")))


@query("operational_metrics_empty", """
    select 0.0::double as prediction_volume, null as approve_rate, null as review_rate, null as reject_rate, null as avg_credit_score,
        null as avg_default_probability, null as high_risk_share, null as latency_p95_ms
    from (select count(*) as n from {predictions} where cast(created_at as date) > date '2030-01-01') where n = 0
""")
def operational_empty(t):
    return rounded(portfolio.operational_metrics(portfolio.in_window(t["predictions"], "2030-01-01", "2030-02-01")))


@query("portfolio_kpis", f"""
    select count(*) as total, count(*) filter (where recommendation = 'APPROVE') as approved, count(*) filter (where recommendation = 'REVIEW') as review,
        count(*) filter (where recommendation = 'REJECT') as rejected, {R("avg(case when recommendation = 'APPROVE' then 1.0 else 0.0 end)")} as approved_share,
        {R("avg(case when recommendation = 'REVIEW' then 1.0 else 0.0 end)")} as review_share, {R("avg(case when recommendation = 'REJECT' then 1.0 else 0.0 end)")} as rejected_share,
        {R('avg(credit_score)')} as avg_score, {R('avg(default_probability)')} as avg_default_probability,
        {R("avg(case when risk_category in ('HIGH', 'VERY_HIGH') then 1.0 else 0.0 end)")} as high_risk_share,
        {R('avg(case when default_probability >= 0.25 then 1.0 else 0.0 end)')} as predicted_default_rate from {{predictions}}
""")
def kpis(t):
    return rounded(portfolio.kpis(t["predictions"], THRESHOLD))


@query("daily_series", f"""
    select cast(created_at as date) as date, count(*) as n, {R('avg(case when default_probability >= 0.25 then 1.0 else 0.0 end)')} as default_rate from {{predictions}} group by 1
""")
def daily(t):
    return rounded(portfolio.daily_series(t["predictions"], THRESHOLD))


_AGE = "case when age < 26 then '18-25' when age < 36 then '26-35' when age < 46 then '36-45' when age < 56 then '46-55' when age < 66 then '56-65' else '66+' end"
_INC = "case when annual_income < 300000 then '<3L' when annual_income < 600000 then '3-6L' when annual_income < 1000000 then '6-10L' when annual_income < 2000000 then '10-20L' else '20L+' end"


@query("segment_rates", f"""
    with x as (select case when default_probability >= 0.25 then 1.0 else 0.0 end as f, * from {{predictions}}),
    s as (select 'loan_type' as segment, loan_type as value, f from x union all select 'employment_type', employment_type, f from x
        union all select 'income_band', {_INC}, f from x where annual_income is not null union all select 'age_band', {_AGE}, f from x where age is not null)
    select segment, value, {R('avg(f)')} as predicted_default_rate from s where value is not null group by 1, 2
""")
def segment_rates(t):
    return rounded(portfolio.segment_rates(t["predictions"], THRESHOLD))


@query("approval_rate", f"""
    select loan_type, {R("avg(case when recommendation = 'APPROVE' then 1.0 else 0.0 end)")} as approval_rate from {{predictions}} where loan_type is not null group by 1
""")
def approval(t):
    return rounded(portfolio.approval_rate(t["predictions"]))


_DIMS = ["loan_type", "risk_category", "recommendation", "employment_type"]


@query("segment_table", " union all ".join(f"""
    select '{d}' as dimension, {d} as value, count(*) as n, round_even(avg(credit_score), 4) as avg_score, round_even(avg(default_probability), 4) as avg_default_probability,
        round_even(avg(case when default_probability >= 0.25 then 1.0::double else 0.0 end), 4) as predicted_default_rate,
        round_even(avg(case when recommendation = 'APPROVE' then 1.0::double else 0.0 end), 4) as approval_rate
    from {{predictions}} where {d} is not null group by {d}""" for d in _DIMS))
def segment_table(t):
    return portfolio.segment_table(t["predictions"], _DIMS, THRESHOLD)


@query("prediction_page", """
    select prediction_id, created_at, risk_category from {predictions} where risk_category = 'HIGH' and created_at >= timestamp '2024-01-03'
    order by created_at desc, prediction_id desc limit 20 offset 20
""")
def page(t):
    rows, _ = portfolio.page(t["predictions"], {"risk_category": "HIGH"}, 2, 20, date_from="2024-01-03 00:00:00")
    return rows.select("prediction_id", "created_at", "risk_category")


@query("prediction_page_total", "select count(*) as total from {predictions} where recommendation = 'REVIEW' and model_id = 'm1'")
def page_total(t):
    return portfolio.page(t["predictions"], {"recommendation": "REVIEW", "model_id": "m1", "loan_type": None})[1]


@query("any_of_filter", "select prediction_id from {predictions} where loan_type in ('HOME', 'AUTO') and risk_category in ('HIGH', 'VERY_HIGH')")
def any_of(t):
    out = portfolio.any_of_filter(t["predictions"], {"loan_type": ["HOME", "AUTO"], "risk_category": HIGH_RISK, "recommendation": []})
    return out.select("prediction_id")


@query("search", "select prediction_id from {predictions} where regexp_matches(loan_id, '(?i)1[0-3]7') or regexp_matches(risk_category, '(?i)1[0-3]7')")
def search(t):
    return portfolio.search(t["predictions"], "1[0-3]7", ["loan_id", "risk_category"]).select("prediction_id")


@query("newest_rows", "select prediction_id, created_at from {predictions} order by created_at desc, prediction_id limit 2000")
def newest(t):
    return portfolio.newest(t["predictions"], "created_at", 2000, ["prediction_id"]).select("prediction_id", "created_at")


@query("pivot_metric_by_window", f"""
    select cast(created_at as date) as window_end, {R("avg(case when model_id = 'm1' then default_probability end)")} as m1, {R("avg(case when model_id = 'm2' then default_probability end)")} as m2
    from {{predictions}} group by 1
""")
def pivot_metric(t):
    df = t["predictions"].withColumn("window_end", F.to_date("created_at"))
    return rounded(portfolio.pivot_mean(df, "window_end", "model_id", "default_probability", ["m1", "m2"]))


@query("pivot_violations_by_day", """
    select cast(created_at as date) as day, count(*) filter (where risk_category = 'HIGH') as "HIGH", count(*) filter (where risk_category = 'NONE') as "NONE" from {predictions} group by 1
""")
def pivot_violations(t):
    df = t["predictions"].groupBy(F.to_date("created_at").alias("day"), "risk_category").agg(F.count("*").alias("n"))
    return portfolio.pivot_sum(df, "day", "risk_category", "n", ["HIGH", "NONE"])


@query("metric_history", "select prediction_id, model_id as metric_name, created_at from {predictions} where model_id = 'm2'")
def metric_history(t):
    df = t["predictions"].withColumn("metric_name", F.col("model_id"))
    return portfolio.metric_history(df, "m2").select("prediction_id", "metric_name", "created_at")


@query("issue_trend_total", "select cast(count(*) as bigint) as total_issues from {events} where ts >= timestamp '2024-01-20'")
def issue_total(t):
    trend = t["events"].where("ts >= timestamp '2024-01-20'").groupBy("event_type").agg(F.count("*").alias("n"))
    return portfolio.issue_trend_total(trend)
