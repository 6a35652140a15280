"""Scoring, decisions, drift, decay and alerts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from registered.base import R, query, r, rounded
from registered.features import merged
from riskframe.config import MONITORING
from riskframe.functions import display
from riskframe.operators import drift, features, monitor, portfolio, score

# -- score, band, decision ---------------------------------------------------------------

_FACTOR = "(40.0::double / ln(2.0::double))"
_OFFSET = f"(600.0::double - {_FACTOR} * ln(20.0::double))"


def _score_sql(p):
    q = f"least(greatest({p}, 1e-9), 1 - 1e-9)"
    return f"cast(round_even(least(greatest({_OFFSET} + {_FACTOR} * ln((1 - {q}) / {q}), 300), 900), 0) as int)"


@query("probability_to_score", f"select o_orderkey, {_score_sql('p')} as score from {{scored_loans}}")
def to_score(t):
    return t["scored_loans"].select("o_orderkey", score.probability_to_score("p").alias("score"))


@query("score_to_probability", f"""
    select prediction_id, {R(f'1 / (1 + exp((credit_score - {_OFFSET}) / {_FACTOR}))', 9)} as p from {{predictions}}
""")
def to_probability(t):
    return t["predictions"].select("prediction_id", r(score.score_to_probability("credit_score"), 9).alias("p"))


_BAND_SQL = "case when {s} >= 750 then 'VERY_LOW' when {s} >= 700 then 'LOW' when {s} >= 650 then 'MODERATE' when {s} >= 550 then 'HIGH' else 'VERY_HIGH' end"


@query("risk_band", f"select prediction_id, {_BAND_SQL.format(s='credit_score')} as band from {{predictions}}")
def risk_band(t):
    score.check_bands()
    return t["predictions"].select("prediction_id", score.categorize("credit_score").alias("band"))


# Applicants: the per-loan frame with its ratios and a probability from the loan's own terms.
def applicants(t):
    df = features.ratio_features(merged(t)).withColumn("p", F.col("interest_rate") / 60.0 * F.col("interest_rate") / 60.0)
    return df.withColumn("credit_score", score.probability_to_score("p")).select(
        "loan_id", "age", "p", "credit_score", *score.REQUIRED)


_APPLY = f"""
    with f as (select m.*, e as proposed_emi, {{DTI}} as post_loan_dti, {{UTIL}} as credit_utilization, {{LTI}} as loan_to_income,
          monthly_income - monthly_expenses - monthly_emi as disposable_income, interest_rate / 60.0 * interest_rate / 60.0 as p
          from (select *, {{EMI}} as e from ({{M}})) m),
    s as (select *, case when p is not null then {_score_sql('p')} end as credit_score,
            concat_ws(',', case when previous_defaults is null then 'previous_defaults' end, case when post_loan_dti is null then 'post_loan_dti' end,
              case when credit_utilization is null then 'credit_utilization' end, case when employment_years is null then 'employment_years' end,
              case when loan_to_income is null then 'loan_to_income' end, case when credit_history_months is null then 'credit_history_months' end,
              case when disposable_income is null then 'disposable_income' end) as lacking from f),
    h as (select *, (case when previous_defaults >= 2 then 1 else 0 end) + (case when post_loan_dti > 0.6 then 1 else 0 end)
            + (case when credit_utilization > 0.95 then 1 else 0 end) + (case when employment_years < 0.5 and loan_to_income > 5 then 1 else 0 end)
            + (case when p > 0.3 then 1 else 0 end) + (case when credit_score <= 549 then 1 else 0 end) as n_reject,
          (case when credit_history_months < 12 then 1 else 0 end) + (case when post_loan_dti between 0.45 and 0.6 then 1 else 0 end)
            + (case when disposable_income < 5000 then 1 else 0 end) as n_soft,
          p < 0.1 and credit_score >= 700 as ok from s)
"""


def _apply_sql(tail: str) -> str:
    from registered.features import _EMI, _safe
    from registered.inputs import MERGED

    text = _APPLY.replace("{DTI}", _safe("monthly_emi + e + monthly_expenses", "monthly_income", 5))
    text = text.replace("{UTIL}", _safe("total_outstanding", "total_credit_limit", 2)).replace("{LTI}", _safe("loan_amount", "annual_income", 10))
    return text.replace("{EMI}", _EMI).replace("{M}", MERGED) + tail


@query("hard_fails", _apply_sql("select loan_id, age, coalesce(previous_defaults >= 2, false) as defaults, coalesce(post_loan_dti > 0.6, false) as dti, coalesce(credit_utilization > 0.95, false) as util, coalesce(employment_years < 0.5 and loan_to_income > 5, false) as thin from h"))
def hard_fails(t):
    names = ("defaults", "dti", "util", "thin")
    return applicants(t).select("loan_id", "age", *[c.isNotNull().alias(n) for n, c in zip(names, score.hard_fails())])


@query("soft_flags", _apply_sql("select loan_id, age, coalesce(credit_history_months < 12, false) as thin_file, coalesce(post_loan_dti between 0.45 and 0.6, false) as elevated, coalesce(disposable_income < 5000, false) as low_income from h"))
def soft_flags(t):
    names = ("thin_file", "elevated", "low_income")
    return applicants(t).select("loan_id", "age", *[c.isNotNull().alias(n) for n, c in zip(names, score.soft_flags())])


@query("recommend", _apply_sql("""
    select loan_id, age, credit_score, case when lacking = '' then 'scored' else 'missing:' || lacking end as status,
        case when lacking <> '' then null when n_reject > 0 then 'REJECT' when n_soft > 0 then 'REVIEW' when ok then 'APPROVE' else 'REVIEW' end as recommendation,
        cast(case when lacking <> '' then null when n_reject > 0 then n_reject when n_soft > 0 then n_soft else 1 end as int) as n_rules,
        case when lacking <> '' then null when n_reject > 0 then 'Rejected' when n_soft > 0 then 'Referred for review' when ok then 'Approved' else 'Referred for review' end as lead from h"""))
def recommend(t):
    out = score.recommend(applicants(t), "p", "credit_score", 0.1, missing="mark")
    rules = F.when(F.col("triggered_rules").isNotNull(), F.size("triggered_rules"))
    return out.select("loan_id", "age", "credit_score", "status", "recommendation", rules.alias("n_rules"), F.split("reason", ":")[0].alias("lead"))


@query("recommend_reasons")
def recommend_reasons(t):
    return score.recommend(applicants(t), "p", "credit_score", 0.1, missing="mark").select("loan_id", "status", "recommendation", "triggered_rules", "reason")


@query("display_values", """
    with x as (select prediction_id, cast(round_even(annual_income, 0) as bigint) as a, cast(round_even(default_probability * 1000, 0) as bigint) as m,
        coalesce(employment_type, '--') as kind from {predictions})
    select prediction_id, '₹' || case when a >= 1000000 then cast(a // 1000000 as string) || ',' || lpad(cast(a // 1000 % 1000 as string), 3, '0') || ',' || lpad(cast(a % 1000 as string), 3, '0')
        when a >= 1000 then cast(a // 1000 as string) || ',' || lpad(cast(a % 1000 as string), 3, '0') else cast(a as string) end as income,
        cast(m // 10 as string) || '.' || cast(m % 10 as string) || '%' as pct, kind from x
""")
def display_values(t):
    return t["predictions"].select("prediction_id", display.currency("annual_income").alias("income"),
                                   display.percentage("default_probability").alias("pct"), F.coalesce("employment_type", F.lit("--")).alias("kind"))


# -- drift ----------------------------------------------------------------------------------

NUM = ["o_totalprice", "o_custkey"]
SPLIT_DAY = "1998-01-01"


def halves(t):
    o = t["orders"]
    cut = F.lit(SPLIT_DAY).cast("timestamp_ntz")
    return o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut)


_B = "(select * from {orders} where o_orderdate < timestamp '1998-01-01')"
_C = "(select * from {orders} where o_orderdate >= timestamp '1998-01-01')"
_QS = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"


@query("decile_edges", " union all ".join(
    f"select '{c}' as feature, cast(i as int) as i, {R('q[i + 1]')} as edge from (select quantile_cont(cast({c} as double), {_QS}) as q from {_B}), (select unnest(range(1, 10)) as i)" for c in NUM))
def decile_edges(t):
    edges = drift.decile_edges(halves(t)[0], NUM)
    rows = [(c, i, round(e, 6)) for c, es in edges.items() for i, e in enumerate(es) if abs(e) != float("inf")]
    return t.spark.createDataFrame(rows, "feature string, i int, edge double")


@query("baseline_profile", " union all ".join(
    f"select '{c}' as feature, {R(f'avg({c})', 4)} as mean, {R(f'stddev_pop({c})', 4)} as std, {R(f'min({c})', 4)} as min, {R(f'max({c})', 4)} as max, count(*) as n_rows from {_B}" for c in NUM))
def baseline_profile(t):
    b, _ = base(t)
    rows = [(c, round(p["mean"], 4), round(p["std"], 4), round(float(p["min"]), 4), round(float(p["max"]), 4), b.n_rows) for c, p in b.numeric.items()]
    return t.spark.createDataFrame(rows, "feature string, mean double, std double, min double, max double, n_rows long")


def base(t):
    before, _ = halves(t)
    before = before.withColumns({"y": (F.col("o_orderstatus") == "F").cast("int"), "p": F.col("o_totalprice") / (F.col("o_totalprice") + 200000)})
    return drift.build_baseline(before, "y", "p", NUM, ["o_orderpriority", "o_orderstatus"], ["o_orderkey"], "m1")


def _psi_counts(c):
    tests = " ".join(f"when v < e[{i}] then {i - 1}" for i in range(1, 10))
    return f"""
        select '{c}' as feature, case {tests} else 9 end as bin, count(*) as n
        from (select cast({c} as double) as v from {_C}) x, (select quantile_cont(cast({c} as double), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from {_B}) q group by 2
    """


_PSI = "with k as (" + " union all ".join(_psi_counts(c) for c in NUM) + """),
    g as (select f.feature, b.bin, coalesce(k.n, 0) / sum(coalesce(cast(k.n as double), 0)) over (partition by f.feature) as a
          from (select distinct feature from k) f, (select unnest(range(10)) as bin) b left join k on k.feature = f.feature and k.bin = b.bin),
    p as (select feature, sum((greatest(a, 1e-6) - 0.1) * ln(greatest(a, 1e-6) / 0.1)) as v from g group by feature)
"""


@query("numeric_psi", _PSI + f"select feature, {R('v')} as psi, case when v >= 0.25 then 'DRIFT' when v >= 0.1 then 'WARNING' else 'OK' end as status from p")
def numeric_psi(t):
    before, after = halves(t)
    psi = drift.numeric_psi(after, drift.decile_edges(before, NUM))
    return psi.select("feature", r("psi"), drift.psi_status(F.col("psi")).alias("status"))


@query("psi_self_observed", f"""
    select 'mostly_zero' as feature, {R('0.0 * count(*)')} as psi from {{feature_rows}}
""")
def psi_self_observed(t):
    df = t["feature_rows"].select("mostly_zero")
    edges = drift.decile_edges(df, ["mostly_zero"])
    return rounded(drift.numeric_psi(df, edges, drift.observed_shares(df, edges)))


_CATS = f"""
    with b as (select 'o_orderpriority' as feature, o_orderpriority as value, count(*) / (select cast(count(*) as double) from {_B}) as e from {_B} group by o_orderpriority
        union all select 'kind', case when o_orderstatus = 'P' then 'F' else o_orderstatus end, count(*) / (select cast(count(*) as double) from {_B}) from {_B} group by 2),
    c as (select 'o_orderpriority' as feature, o_orderpriority as value, count(*) as n from {_C} group by o_orderpriority
        union all select 'kind', o_orderstatus, count(*) from {_C} group by 2),
    j as (select feature, value, coalesce(e, 0) as e, coalesce(n, 0) as n, b.e is null as is_new, sum(coalesce(n, 0)) over (partition by feature) as total
          from b full join c using (feature, value))
"""


def cats(t):
    before, after = halves(t)
    known = before.select("o_orderpriority", F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus")).alias("kind"))
    n = known.count()
    shares: dict = {"o_orderpriority": {}, "kind": {}}
    for row in drift.category_counts(known, ["o_orderpriority", "kind"]).collect():
        shares[row.feature][row.value] = row.n / n
    return shares, after.withColumn("kind", F.col("o_orderstatus"))


@query("categorical_psi", _CATS + f"""
    select feature, {R('sum((greatest(n / total, 1e-6) - greatest(e, 1e-6)) * ln(greatest(n / total, 1e-6) / greatest(e, 1e-6)))')} as psi,
        count(*) filter (where is_new) as n_new, first(value order by n desc, value) filter (where is_new) as new_example from j group by feature
""")
def categorical_psi(t):
    shares, now = cats(t)
    return rounded(drift.categorical_psi(now, shares))


@query("new_categories", _CATS + "select feature, value from j where is_new")
def new_categories(t):
    shares, now = cats(t)
    return drift.new_categories(now, shares)


@query("chi_square", _CATS + f""",
    x as (select *, greatest(e * total, 1e-6) as raw from j), y as (select *, raw * total / sum(raw) over (partition by feature) as ex from x)
    select feature, {R('ln(1 + sum((n - ex) * (n - ex) / ex))')} as ln_statistic, count(*) - 1 as dof,
        count(*) filter (where is_new) as n_new, first(value order by n desc, value) filter (where is_new) as new_example from y group by feature
""")
def chi_square(t):
    """A new category makes the statistic huge, so its logarithm is compared."""
    shares, now = cats(t)
    return rounded(drift.chi_square(now, shares).select("feature", F.log1p("statistic").alias("ln_statistic"), "dof", "n_new", "new_example"))


def _ks_sql(c):
    return f"""
        select '{c}' as feature, v, sum(a) over (order by v) as ca, sum(b) over (order by v) as cb, sum(a) over () as ta, sum(b) over () as tb
        from (select v, sum(a) as a, sum(b) as b from (select {c} as v, 1 as a, 0 as b from {_B} union all select {c}, 0, 1 from {_C}) group by v)
    """


@query("ks_statistics", "with k as (" + " union all ".join(_ks_sql(c) for c in NUM) + f""")
    select feature, {R('max(abs(ca / cast(ta as double) - cb / cast(tb as double)))')} as statistic, cast(any_value(ta) as bigint) as n_baseline, cast(any_value(tb) as bigint) as n_current from k group by feature
""")
def ks(t):
    before, after = halves(t)
    return rounded(drift.ks_statistics(before, after, NUM))


@query("concept_drift", f"""
    with s as (select count(*) as n, avg(default_12m) as r from {{loan_outcomes}} where outcome_observed_date >= date '1999-01-01'),
    w as (select *, 1.959963984540054::double as z from s),
    i as (select *, (r + z * z / (2 * n)) / (1 + z * z / n) as c, z * sqrt((r * (1 - r) + z * z / (4 * n)) / n) / (1 + z * z / n) as m from w)
    select n, {R('r')} as current_rate, {R('greatest(0, c - m)')} as ci_low, {R('least(1, c + m)')} as ci_high, 0.3::double as baseline_rate,
        case when 0.3 between greatest(0, c - m) and least(1, c + m) then 'OK' else 'WARNING' end as status from i
""")
def concept(t):
    seen = t["loan_outcomes"].where(F.col("outcome_observed_date") >= date(1999, 1, 1))
    return rounded(drift.concept_drift(seen, "default_12m", 0.3))


@query("feature_drift")
def feature_drift(t):
    b, sample = base(t)
    return drift.feature_drift(b, sample, halves(t)[1])


@query("prediction_drift", f"""
    with e as (select quantile_cont(o_totalprice / (o_totalprice + 200000), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from {_B}),
    x as (select case {' '.join(f'when default_probability < e[{i}] then {i - 1}' for i in range(1, 10))} else 9 end as bin from {{predictions}}, e),
    g as (select b.bin, count(x.bin) / (select cast(count(*) as double) from x) as a from (select unnest(range(10)) as bin) b left join x on x.bin = b.bin group by b.bin)
    select {R('sum((greatest(a, 1e-6) - 0.1) * ln(greatest(a, 1e-6) / 0.1))')} as drift_score, case when sum((greatest(a, 1e-6) - 0.1) * ln(greatest(a, 1e-6) / 0.1)) >= 0.25 then 'DRIFT' else 'OK' end as status from g
""")
def prediction_drift(t):
    b, _ = base(t)
    return drift.prediction_drift(b, t["predictions"]).select(r("drift_score"), "status")


_REPORTS = """
    select 'f' || cast(user_id % 5 as string) as feature_name, case when event_type = 'error' then 'ks' else 'psi' end as method, value / 100 as drift_score,
        case when value < 30 then 'OK' when value < 60 then 'WARNING' else 'DRIFT' end as status, date_trunc('day', ts) as created_at from {events}
"""


@query("drift_summary", f"""
    with r as ({_REPORTS}), l as (select * from r where created_at = (select max(created_at) from r))
    select max(created_at) as latest_run_at, count(*) as n_findings, count(*) filter (where status = 'OK') as n_ok,
        count(*) filter (where status = 'WARNING') as n_warning, count(*) filter (where status = 'DRIFT') as n_drift from l
""")
def drift_summary(t):
    reports = t.sql(_REPORTS).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    return drift.drift_summary(reports)


@query("psi_history", f"with r as ({_REPORTS}) select feature_name, cast(created_at as date) as run_date, {R('avg(drift_score)')} as psi from r where method = 'psi' group by 1, 2")
def psi_history(t):
    return rounded(drift.psi_history(t.sql(_REPORTS)))


@query("psi_pivot", f"""
    with r as ({_REPORTS}) select feature_name, {R("avg(case when created_at = timestamp '2024-01-02' then drift_score end)")} as d1, {R("avg(case when created_at = timestamp '2024-01-03' then drift_score end)")} as d2 from r where method = 'psi' group by 1
""")
def psi_pivot(t):
    h = t.sql(_REPORTS).where("method = 'psi'").withColumn("run_date", F.col("created_at").cast("date").cast("string"))
    out = portfolio.pivot_mean(h, "feature_name", "run_date", "drift_score", ["2024-01-02", "2024-01-03"])
    return rounded(out.withColumnsRenamed({"2024-01-02": "d1", "2024-01-03": "d2"}))


# -- decay, alerts, retraining -----------------------------------------------------------------

_WIDE = """
    select 0.8 - avg(value) / 1000 as roc_auc, 0.1 + avg(value) / 1000 as brier_score, 1.0 + avg(value) / 100 as calibration_slope, cast(null as double) as pr_auc,
           avg(value) / 100 as accuracy from {events}
"""


@query("metric_rows", f"""
    with w as ({_WIDE}), u as (select 'roc_auc' as metric_name, roc_auc as v from w union all select 'brier_score', brier_score from w
        union all select 'calibration_slope', calibration_slope from w union all select 'pr_auc', pr_auc from w union all select 'accuracy', accuracy from w)
    select 'm1' as model_id, metric_name, {R('v')} as metric_value, date '2024-01-01' as window_start, date '2024-01-31' as window_end from u where v is not null
""")
def metric_rows(t):
    return rounded(_metrics(t))


def _metrics(t):
    return monitor.metric_rows(t.sql(_WIDE), "m1", "2024-01-01", "2024-01-31")


def _degraded(t):
    training = t.spark.createDataFrame(
        [("roc_auc", 0.95), ("brier_score", 0.1), ("calibration_slope", 1.02), ("pr_auc", 0.5), ("accuracy", 0.99)], "metric_name string, metric_value double")
    return monitor.degraded_metrics(_metrics(t), training)


_DEGRADED = f"""
    w as ({_WIDE}), d as (select 'roc_auc' as metric, 0.95::double as training_value, roc_auc as current_value from w where roc_auc < 0.95 * 0.9
        union all select 'brier_score', 0.1, brier_score from w where brier_score > 0.1 * 1.1
        union all select 'calibration_slope', 1.02, calibration_slope from w where abs(calibration_slope - 1) > 0.02 + 0.1)
"""


@query("degraded_metrics", f"with {_DEGRADED} select metric, {R('training_value')} as training_value, {R('current_value')} as current_value, 0.1::double as tolerance from d")
def degraded(t):
    return rounded(_degraded(t))


def _findings(t):
    return t.sql(_REPORTS).select("feature_name", "method", F.lit(0.0).alias("baseline_stat"), F.col("drift_score").alias("current_stat"),
                                  "drift_score", "status", F.lit("").alias("detail"))


@query("alerts", f"""
    with r as ({_REPORTS}), {_DEGRADED}
    select 'WARNING' as severity, 'drift' as category, count(*) as n from r where status = 'DRIFT' union all select 'WARNING', 'performance', count(*) from d
    union all select 'CRITICAL', 'data_quality', count(*) from {{events}} where event_type = 'error' and event_id = (select min(event_id) from {{events}} where event_type = 'error')
""")
def alerts(t):
    errors = t["events"].agg(F.avg((F.col("event_type") == "error").cast("double")).alias("violation_rate"), F.count("*").alias("total_rows"))
    quality = errors.withColumn("status", F.when(F.col("violation_rate") >= MONITORING["violation_rate_alert"], "ALERT").otherwise("OK"))
    out = monitor.all_alerts(monitor.drift_alerts(_findings(t)), monitor.performance_alerts(_degraded(t)), monitor.quality_alerts(quality))
    return out.groupBy("severity", "category").agg(F.count("*").alias("n"))


@query("alert_messages")
def alert_messages(t):
    seen = t["loan_outcomes"].where(F.col("outcome_observed_date") >= date(1999, 1, 1))
    return monitor.all_alerts(monitor.drift_alerts(_findings(t)), monitor.performance_alerts(_degraded(t)),
                              monitor.concept_alerts(drift.concept_drift(seen, "default_12m", 0.1)))


@query("count_new_labels", "select count(*) as n_new_labels from {loan_outcomes} where outcome_observed_date > date '1998-06-01' and outcome_observed_date <= date '1999-06-01'")
def new_labels(t):
    return monitor.count_new_labels(t["loan_outcomes"], date(1998, 6, 1), date(1999, 6, 1))


@query("should_retrain", f"""
    with r as ({_REPORTS}), {_DEGRADED}, l as (select count(*) as n from {{loan_outcomes}} where outcome_observed_date > date '1998-06-01' and outcome_observed_date <= date '1999-06-01'),
    x as (select (select coalesce(string_agg(metric, ', ' order by metric), '') from d) as m, (select coalesce(string_agg(distinct feature_name, ', ' order by feature_name), '') from r where status = 'DRIFT') as f, n from l)
    select true as should_retrain, list_filter([case when m <> '' then 'performance degraded beyond tolerance: ' || m end, case when f <> '' then 'significant drift detected: ' || f end,
        case when n >= 500 then cast(n as string) || ' new labelled loans available (>= configured minimum 500)' end], lambda z: z is not null) as reasons from x
""")
def should_retrain(t):
    labels = monitor.count_new_labels(t["loan_outcomes"], date(1998, 6, 1), date(1999, 6, 1))
    return monitor.should_retrain(_degraded(t), _findings(t), labels)


@query("compare_champion", """
    with c as (select avg(value) / 1000 as base from {events})
    select round(0.4 + base, 6) as champion_pr_auc, round(0.45 + base, 6) as challenger_pr_auc, true as promoted from c
""")
def compare(t):
    avg = t["events"].agg((F.avg("value") / 1000).alias("b"))
    champion = avg.select((F.col("b") + 0.4).alias("pr_auc"), F.lit(1.2).alias("calibration_slope"))
    challenger = avg.select((F.col("b") + 0.45).alias("pr_auc"), F.lit(1.1).alias("calibration_slope"))
    return monitor.compare_champion(champion, challenger).select(r("champion_pr_auc"), r("challenger_pr_auc"), "promoted")


@query("predictive_metrics", """
    with m as (select default_12m as y, default_probability as p from {predictions} a join {loan_outcomes} b on a.loan_id = b.loan_id where model_id = 'm1'),
    k as (select p as score, cast(sum(y) as bigint) as pos, cast(count(*) - sum(y) as bigint) as neg from m group by p),
    c as (select *, sum(neg) over (order by score desc) as cn, sum(pos) over () as pt, sum(neg) over () as nt from k)
    """ + f"select count(*) as scores, {R('sum(cast(pos as double) * (nt - cn + neg / 2.0)) / (any_value(cast(pt as double)) * any_value(nt))')} as roc_auc from c")
def predictive(t):
    from riskframe.operators import joins

    m = joins.matured_predictions(t["predictions"], t["loan_outcomes"], "m1", date(1990, 1, 1), date(2030, 1, 1))
    out = monitor.predictive_metrics(m)
    return out.select(m.agg(F.count_distinct("default_probability")).scalar().alias("scores"), r("roc_auc"))
