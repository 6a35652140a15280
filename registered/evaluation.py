"""Evaluation of scores against outcomes, thresholds and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.base import R, query, r, rounded
from riskframe.operators import evaluate

# Curve per score, highest first, and its totals.
_CURVE = """
    with k as (select p as score, cast(sum(y) as bigint) as pos, cast(count(*) - sum(y) as bigint) as neg from {SOURCE} group by p),
    c as (select *, cast(sum(pos) over (order by score desc) as bigint) as cp, cast(sum(neg) over (order by score desc) as bigint) as cn,
          cast(sum(pos) over () as bigint) as pt, cast(sum(neg) over () as bigint) as nt from k)
"""
_LOANS = _CURVE.replace("{SOURCE}", "{scored_loans}")
_TIES = _CURVE.replace("{SOURCE}", "{scored_ties}")

_SUITE = f"""
    select any_value(pt + nt) as n, {R('(sum(case when score >= 0.5 then pos else 0 end) + sum(case when score < 0.5 then neg else 0 end)) / any_value(cast(pt + nt as double))')} as accuracy,
        {R('coalesce(sum(case when score >= 0.5 then pos end) / nullif(cast(sum(case when score >= 0.5 then pos + neg end) as double), 0), 0)')} as precision,
        {R('coalesce(sum(case when score >= 0.5 then pos end) / cast(any_value(pt) as double), 0)')} as recall,
        {R('coalesce(2 * sum(case when score >= 0.5 then pos end) / nullif(cast(sum(case when score >= 0.5 then pos + neg end) + any_value(pt) as double), 0), 0)')} as f1,
        {R('sum(cast(pos as double) * (nt - cn + neg / 2.0)) / (any_value(cast(pt as double)) * any_value(nt))')} as roc_auc,
        {R('sum(cast(pos as double) * cp / (cp + cn)) / any_value(pt)')} as pr_auc,
        {R('sum(cast(pos as double) * cp / (cp + cn)) / any_value(pt)')} as average_precision,
        {R('max(abs(cast(cp as double) / pt - cast(cn as double) / nt))')} as ks_statistic,
        {R('2 * sum(cast(pos as double) * (nt - cn + neg / 2.0)) / (any_value(cast(pt as double)) * any_value(nt)) - 1')} as gini,
        {R('sum(pos * (1 - score) * (1 - score) + neg * score * score) / any_value(pt + nt)')} as brier_score,
        {R('-sum(pos * ln(score) + neg * ln(1 - score)) / any_value(pt + nt)')} as log_loss
"""


@query("metric_suite", _LOANS + _SUITE + " from c")
def metric_suite(t):
    return rounded(evaluate.metric_suite(t["scored_loans"], "y", "p", calibration=False))


@query("metric_suite_tied_scores", _TIES + _SUITE + " from c")
def metric_suite_ties(t):
    return rounded(evaluate.metric_suite(t["scored_ties"], "y", "p", calibration=False))


@query("segment_metrics", """
    with s as (select 'l_linestatus' as segment, l_linestatus as value, y, p from {scored_ties} union all select 'l_returnflag', l_returnflag, y, p from {scored_ties}),
    k as (select segment, value, p as score, cast(sum(y) as bigint) as pos, cast(count(*) - sum(y) as bigint) as neg from s group by 1, 2, 3),
    c as (select *, cast(sum(pos) over (partition by segment, value order by score desc) as bigint) as cp, cast(sum(neg) over (partition by segment, value order by score desc) as bigint) as cn,
          cast(sum(pos) over (partition by segment, value) as bigint) as pt, cast(sum(neg) over (partition by segment, value) as bigint) as nt from k)
    """ + f"""
    select segment, value, any_value(pt + nt) as n, {R('case when any_value(pt) > 0 and any_value(nt) > 0 then sum(cast(pos as double) * (nt - cn + neg / 2.0)) / (any_value(cast(pt as double)) * any_value(nt)) end')} as roc_auc,
        {R('case when any_value(pt) > 0 and any_value(nt) > 0 then sum(cast(pos as double) * cp / (cp + cn)) / any_value(pt) end')} as pr_auc,
        {R('sum(pos * (1 - score) * (1 - score) + neg * score * score) / any_value(pt + nt)')} as brier_score from c group by 1, 2
""")
def segment_metrics(t):
    out = evaluate.segment_metrics(t["scored_ties"], "y", "p", ["l_linestatus", "l_returnflag"], calibration=False)
    return rounded(out.select("segment", "value", "n", "roc_auc", "pr_auc", "brier_score"))


@query("calibration_slope")
def calibration_slope(t):
    curve = evaluate.score_curve(t["scored_loans"], "y", "p")
    fits = evaluate.calibration_fit(curve)
    return t.spark.createDataFrame([(s, i) for s, i in fits.values()], "calibration_slope double, calibration_intercept double")


@query("confusion", """
    select count(*) filter (where y = 0 and p < 0.4) as tn, count(*) filter (where y = 0 and p >= 0.4) as fp,
        count(*) filter (where y = 1 and p < 0.4) as fn, count(*) filter (where y = 1 and p >= 0.4) as tp from {scored_loans}
""")
def confusion(t):
    return evaluate.confusion(t["scored_loans"], "y", "p", 0.4)


@query("expected_cost", """
    select count(*) filter (where y = 0 and p < 0.4) as tn, count(*) filter (where y = 0 and p >= 0.4) as fp, count(*) filter (where y = 1 and p < 0.4) as fn,
        count(*) filter (where y = 1 and p >= 0.4) as tp, cast(10 * count(*) filter (where y = 1 and p < 0.4) + count(*) filter (where y = 0 and p >= 0.4) as double) as expected_cost from {scored_loans}
""")
def expected_cost(t):
    return evaluate.expected_cost(evaluate.confusion(t["scored_loans"], "y", "p", 0.4))


@query("threshold_metrics", f"""
    with c as (select count(*) filter (where y = 0 and p < 0.55) as tn, count(*) filter (where y = 0 and p >= 0.55) as fp,
        count(*) filter (where y = 1 and p < 0.55) as fn, count(*) filter (where y = 1 and p >= 0.55) as tp from {{scored_ties}})
    select {R('(tp + tn) / cast(tp + fp + fn + tn as double)')} as accuracy, {R('tp / cast(tp + fp as double)')} as precision,
        {R('tp / cast(tp + fn as double)')} as recall, {R('2.0 * tp / (2 * tp + fp + fn)')} as f1 from c
""")
def threshold_metrics(t):
    c = evaluate.confusion(t["scored_ties"], "y", "p", 0.55)
    m = evaluate.threshold_metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return rounded(c.select(*[v.alias(k) for k, v in m.items()]))


@query("score_curve", _TIES + f"select {R('score')} as score, pos, neg, cp as cum_pos, cn as cum_neg from c")
def score_curve(t):
    return rounded(evaluate.score_curve(t["scored_ties"], "y", "p").select("score", "pos", "neg", "cum_pos", "cum_neg"))


@query("recall_at_precision", _LOANS + f"select {R('coalesce(max(case when cast(cp as double) / (cp + cn) >= 0.33 then cast(cp as double) / pt end), 0)')} as recall_at_precision from c")
def recall_at_precision(t):
    return rounded(evaluate.recall_at_precision(evaluate.score_curve(t["scored_loans"], "y", "p"), 0.33))


def _bin_sql(n_bins: int = 10) -> str:
    tests = " ".join(f"when k <= (n - 1) * ({i} * cast({1.0 / n_bins!r} as double)) then {i}" for i in range(1, n_bins))
    return f"case {tests} else {n_bins} end"


@query("lift_gains", f"""
    with ranked as (select y, row_number() over (order by p desc, o_orderkey) - 1 as k, count(*) over () as n from {{scored_loans}}),
    b as (select {_bin_sql()} as decile, count(*) as n, cast(sum(y) as bigint) as n_positive from ranked group by 1),
    c as (select *, cast(sum(n) over (order by decile) as bigint) as cum_n, cast(sum(n_positive) over (order by decile) as bigint) as cum_positive,
          sum(n_positive) over () as tp, sum(n) over () as total from b)
    select cast(row_number() over (order by decile) as int) as decile, n, n_positive, {R('n_positive / cast(n as double)')} as default_rate, cum_n, cum_positive,
        {R('cum_positive / cast(tp as double)')} as cum_gain, {R('(n_positive / cast(n as double)) / (tp / cast(total as double))')} as lift,
        {R('(cum_positive / cast(cum_n as double)) / (tp / cast(total as double))')} as cum_lift from c
""")
def lift_gains(t):
    return rounded(evaluate.lift_gains(t["scored_loans"], "y", "p", ["o_orderkey"]))


@query("roc_points", _LOANS + f""",
    l as (select *, lead(pos) over (order by score desc) as np, lead(neg) over (order by score desc) as nn, row_number() over (order by score desc) as nth from c)
    select {R('cast(cn as double) / nt', 9)} as fpr, {R('cast(cp as double) / pt', 9)} as tpr, {R('score', 9)} as threshold from l where nth = 1 or np is null or np <> pos or nn <> neg
    union all select 0.0, 0.0, cast('infinity' as double)
""")
def roc_points(t):
    out = evaluate.roc_points(evaluate.score_curve(t["scored_loans"], "y", "p"))
    return out.select(r("fpr", 9), r("tpr", 9), F.when(F.col("threshold") == float("inf"), F.col("threshold")).otherwise(F.round("threshold", 9)).alias("threshold"))


@query("pr_points", _TIES + f"""
    select {R('cast(cp as double) / (cp + cn)')} as precision, {R('cast(cp as double) / pt')} as recall, {R('score')} as threshold from c union all select 1.0, 0.0, null
""")
def pr_points(t):
    return rounded(evaluate.pr_points(evaluate.score_curve(t["scored_ties"], "y", "p")))


@query("calibration_curve", f"""
    with q as (select quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from {{scored_loans}}),
    b as (select y, p, case {' '.join(f'when p <= e[{i}] then {i - 1}' for i in range(1, 10))} else 9 end as bin from {{scored_loans}}, q)
    select cast(bin as int) as bin, count(*) as n, {R('avg(p)')} as mean_predicted, {R('avg(y)')} as fraction_positive from b group by bin
""")
def calibration_curve(t):
    return rounded(evaluate.calibration_curve(t["scored_loans"], "y", "p"))


_GRID = """
    with g as (select unnest(range(1001)) as k),
    x as (select least(case when (floor(p * 1000) + 1) * cast(0.001 as double) <= p then floor(p * 1000) + 1
            when floor(p * 1000) * cast(0.001 as double) > p then floor(p * 1000) - 1 else floor(p * 1000) end, 1000) as k, y from {scored_loans}),
    h as (select k, sum(y) as pos, count(*) - sum(y) as neg from x group by k),
    f as (select g.k, coalesce(pos, 0) as pos, coalesce(neg, 0) as neg from g left join h on g.k = h.k),
    c as (select k, k * cast(0.001 as double) as threshold, cast(sum(pos) over (order by k desc) as bigint) as tp, cast(sum(neg) over (order by k desc) as bigint) as fp,
          cast(sum(pos) over () as bigint) as pt, cast(sum(neg) over () as bigint) as nt from f)
"""


@query("cost_curve", _GRID + f"select cast(k as bigint) as k, {R('threshold')} as threshold, tp, fp, pt - tp as fn, nt - fp as tn, cast(10 * (pt - tp) + fp as double) as expected_cost from c")
def cost_curve(t):
    return rounded(evaluate.cost_curve(t["scored_loans"], "y", "p"))


@query("min_cost_threshold", _GRID + f"select {R('threshold')} as threshold, cast(10 * (pt - tp) + fp as double) as expected_cost from c order by 10 * (pt - tp) + fp, threshold limit 1")
def min_cost(t):
    return rounded(evaluate.min_cost_threshold(t["scored_loans"], "y", "p"))


@query("max_f1_threshold", _TIES + f""",
    f as (select score, case when cp > 0 then 2 * (cast(cp as double) / (cp + cn)) * (cast(cp as double) / pt) / ((cast(cp as double) / (cp + cn)) + (cast(cp as double) / pt) + 1e-12) else 0 end as f1 from c)
    select {R('score')} as threshold, {R('f1')} as f1 from f order by f1 desc, score limit 1
""")
def max_f1(t):
    return rounded(evaluate.max_f1_threshold(evaluate.score_curve(t["scored_ties"], "y", "p")))


@query("max_youden_threshold", _TIES + f""",
    j as (select score, cast(cp as double) / pt - cast(cn as double) / nt as j from c union all select cast('infinity' as double), 0.0)
    select case when score = cast('infinity' as double) then score else {R('score')} end as threshold, {R('j')} as youden_j from j order by j desc, score desc limit 1
""")
def max_youden(t):
    out = evaluate.max_youden_threshold(evaluate.score_curve(t["scored_ties"], "y", "p"))
    return out.select(F.when(F.col("threshold") == float("inf"), F.col("threshold")).otherwise(F.round("threshold", 6)).alias("threshold"), r("youden_j"))


@query("optimise_threshold", _GRID + f""",
    kk as (select p as score, cast(sum(y) as bigint) as pos, cast(count(*) - sum(y) as bigint) as neg from {{scored_loans}} group by p),
    cc as (select *, cast(sum(pos) over (order by score desc) as bigint) as cp, cast(sum(neg) over (order by score desc) as bigint) as cn,
          cast(sum(pos) over () as bigint) as pt, cast(sum(neg) over () as bigint) as nt from kk),
    f1s as (select score, case when cp > 0 then 2 * (cast(cp as double) / (cp + cn)) * (cast(cp as double) / pt) / ((cast(cp as double) / (cp + cn)) + (cast(cp as double) / pt) + 1e-12) else 0 end as v from cc),
    j as (select score, cast(cp as double) / pt - cast(cn as double) / nt as v from cc union all select cast('infinity' as double), 0.0)
    (select 'min_cost' as criterion, {R('threshold')} as threshold, cast(10 * (pt - tp) + fp as double) as value, true as chosen from c order by 10 * (pt - tp) + fp, threshold limit 1)
    union all (select 'max_f1', {R('score')}, {R('v')}, false from f1s order by v desc, score limit 1)
    union all (select 'max_youden_j', case when score = cast('infinity' as double) then score else {R('score')} end, {R('v')}, false from j order by v desc, score desc limit 1)
""")
def optimise(t):
    out = evaluate.optimise_threshold(t["scored_loans"], "y", "p")
    inf = F.col("threshold") == float("inf")
    return out.select("criterion", F.when(inf, F.col("threshold")).otherwise(F.round("threshold", 6)).alias("threshold"), r("value"), "chosen")
