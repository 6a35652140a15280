"""Training, calibration, scoring, explanation and the monitoring cycle."""

from __future__ import annotations

from datetime import date
from functools import cache

from pyspark.sql import Window
from pyspark.sql import functions as F

from registered.base import query, rounded
from registered.validation import AS_OF
from riskframe.config import RULES
from riskframe.operators import drift, encode, evaluate, explain, rules, training
from riskframe.operators.ordered import materialize, positions
from riskframe.plans import cycle, model

ORDER = {"customers": ["row_no"], "loan_applications": ["row_no"]}
_READY: dict = {}


def ready(t):
    """Prepared data and the trained model, once per session and data folder."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _READY:
        tables = t.credit(customers="customers_loaded", loan_applications="loans_loaded")
        prepared = model.prepare(tables, ORDER, rules.build_rules(RULES, as_of=AS_OF))
        _READY[key] = (prepared, model.train(prepared, params={"max_iter": 50}))
    return _READY[key]


@cache
def _numeric_encoder_columns():
    return ["price", "discount", "tax"], ["flag"]


def vectors(t):
    """All line items as encoded vectors with a label that depends on price.  They have
    no key, and some are equal: their place in an order over all columns is one."""
    num, cat = _numeric_encoder_columns()
    rows = t["feature_rows"]
    order = [F.asc_nulls_first(c) for c in rows.columns]
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*rows.columns).orderBy("price")))
    df = materialize(positions(rows, [*order, "nth"]).select(F.col("position").alias("id"), "price", "discount", "tax", "flag", "y"))
    state = encode.fit(df, num, cat, [])
    return encode.with_vector(df, state).select("id", "y", "features"), state


def halves(df):
    """Training and validation rows by key."""
    side = F.pmod(F.xxhash64("id"), F.lit(10))
    return df.where(side < 7), df.where(side >= 7)


@query("fit_logistic")
def fit_logistic(t):
    df, state = vectors(t)
    m = training.fit(df, "logistic_regression", {"C": 1.0}, "y", training.class_weights(df, "y"))
    return rounded(explain.importance(state.names(), m.coefficients, t.spark), 4)


@query("fit_elastic_net")
def fit_elastic_net(t):
    df, state = vectors(t)
    m = training.fit(df, "logistic_regression", {"C": 0.01, "penalty": "elasticnet", "l1_ratio": 0.5}, "y")
    return rounded(explain.importance(state.names(), m.coefficients, t.spark), 4)


@query("fit_random_forest")
def fit_forest(t):
    df, _ = vectors(t)
    a, b = halves(df)
    m = training.fit(a, "random_forest", {"n_estimators": 20, "max_depth": 4}, "y")
    return evaluate.metric_suite(training.predict(m, b), "y", "p", calibration=False)


@query("fit_boosted_trees")
def fit_boosted(t):
    """Trained on half of the rows, stopped on a fifth, measured on the rest."""
    df, _ = vectors(t)
    side = F.pmod(F.xxhash64("id"), F.lit(10))
    m = training.fit(df.where(side < 5), "boosted_trees", {"n_estimators": 10, "max_depth": 3}, "y", validation=df.where(side.between(5, 6)))
    return evaluate.metric_suite(training.predict(m, df.where(side > 6)), "y", "p", calibration=False)


@query("class_weights", "select y, count(*) as n, round((select count(*) from {scored_loans}) / (2.0 * count(*)), 9) as weight from {scored_loans} group by y")
def class_weights(t):
    w = training.class_weights(t["scored_loans"], "y")
    rows = t["scored_loans"].groupBy("y").agg(F.count("*").alias("n"))
    return training.with_weights(rows, "y", w, "weight").withColumn("weight", F.round("weight", 9))


@query("random_search")
def random_search(t):
    """Every family, by the configured draws, folds and grids."""
    df, _ = vectors(t)
    found = [training.random_search(df, family, "y", ["id"]) for family in training.FAMILIES]
    return t.spark.createDataFrame([(f.family, str(f.params), f.cv_score) for f in found], "family string, params string, cv_score double")


@query("cross_validated_metrics")
def cross_validated(t):
    df, _ = vectors(t)
    return training.cross_validate(df, "logistic_regression", {"C": 1.0, "max_iter": 20}, "y", ["id"], folds=5)


@query("leaderboard")
def leaderboard(t):
    """Each family's cross-validated score on the training rows beside its metrics on
    the validation rows."""
    df, _ = vectors(t)
    a, b = (materialize(x) for x in halves(df))
    results = []
    for family, params in (("logistic_regression", {"max_iter": 20}), ("random_forest", {"n_estimators": 10, "max_depth": 4}), ("boosted_trees", {"n_estimators": 5, "max_depth": 3})):
        folds = training.cross_validate(a, family, params, "y", ["id"], folds=3)
        m = training.fit(a, family, params, "y")
        metrics = evaluate.metric_suite(training.predict(m, b), "y", "p", calibration=False).first().asDict()
        results.append({"family": family, "name": family, "cv_score": folds.where("metric = 'pr_auc'").first()["mean"], "metrics": metrics})
    evaluate.select_best(results, "pr_auc")
    return training.leaderboard(results, t.spark)


# Few features of all loans: neighbours stay exact and quick.
def loan_points(t):
    return t["scored_loans"].select(
        F.col("o_orderkey").alias("id"), F.datediff("d", F.lit("1995-01-01").cast("date")).cast("double").alias("a"), (F.col("p") * 1000).alias("b"), "y")


@query("smote_sizes", "select y, (select max(n) from (select count(*) as n from {scored_loans} group by y)) as n from {scored_loans} group by y")
def smote_sizes(t):
    from riskframe.operators.neighbours import smote

    return smote(loan_points(t), ["a", "b"], "y", "id").groupBy("y").agg(F.count("*").alias("n"))


@query("smote_tomek")
def smote_tomek(t):
    from riskframe.operators.neighbours import drop_tomek_links, smote

    return drop_tomek_links(smote(loan_points(t), ["a", "b"], "y", "id"), ["a", "b"], "y", "id").groupBy("y").agg(F.count("*").alias("n"))


@query("imbalance_grid")
def imbalance_grid(t):
    """All families by all configured strategies."""
    df, _ = vectors(t)
    a, b = halves(df)
    return training.imbalance_grid(a, b, {family: {} for family in training.FAMILIES}, "y", "id")


@query("calibrate")
def calibrate(t):
    c = training.calibrate(t["scored_loans"], "y", "p")
    rows = [("before", c.brier_before, c.slope_before), (c.method, c.brier[c.method], c.slope_after)] + [
        (f"candidate:{k}", v, None) for k, v in c.brier.items()]
    return t.spark.createDataFrame(rows, "step string, brier double, slope double")


# -- the whole credit chain ---------------------------------------------------------------

@query("training_data")
def training_data(t):
    prepared, _ = ready(t)
    return prepared.frame.groupBy("split").agg(F.count("*").alias("n"), F.avg("default_12m").alias("rate"), F.min("application_date").alias("first"),
                                               F.max("application_date").alias("last"))


_REPORTS: dict = {}


def _report(name):
    def fn(t):
        key = (t.spark.sparkContext.applicationId, t.folder)
        if key not in _REPORTS:
            _REPORTS[key] = model.test_report(*ready(t))
        return _REPORTS[key][name]

    return fn


for _name in ("metrics", "segments", "lift", "roc", "pr", "confusion", "calibration", "importance"):
    query(f"model_test_{_name}")(_report(_name))


@query("score_batch")
def score_batch(t):
    prepared, credit = ready(t)
    out = model.score_rows(prepared.part("test"), credit)
    return out.select("loan_id", "status", "p", "credit_score", "risk_category", "recommendation", "triggered_rules", "reason", "top_risk_factors",
                      "top_positive_factors", "base_value", "model_output_value")


@query("explain_long")
def explain_long(t):
    prepared, credit = ready(t)
    return explain.explain_long(prepared.part("test"), ["loan_id"], credit.linear, credit.encoder, credit.benchmarks)


@query("background_sample")
def background(t):
    return ready(t)[1].background.groupBy("default_12m").agg(F.count("*").alias("n"))


@query("comparison_word", """
    with m as (select quantile_cont(price, 0.5) as med from {feature_rows})
    select case when price / med >= 1.5 then 'well above' when price / med > 1.05 then 'above' when price / med >= 0.95 then 'in line with'
        when price / med > 0.5 then 'below' else 'well below' end as word, count(*) as n from {feature_rows}, m group by 1
""")
def comparison(t):
    from riskframe.operators.quantiles import quantiles

    med = quantiles(t["feature_rows"], ["price"], [0.5])["price"][0]
    return t["feature_rows"].groupBy(explain.comparison_word(F.col("price"), F.lit(med)).alias("word")).agg(F.count("*").alias("n"))


@query("reason_sentences", """
    with m as (select quantile_cont(o_totalprice, 0.5) as med from {orders}),
    x as (select o_orderkey, cast(round_even(o_totalprice, 0) as bigint) as v, cast(round_even(med, 0) as bigint) as b, o_totalprice / med as q from {orders}, m),
    f as (select o_orderkey, case when v >= 1000 then cast(v // 1000 as string) || ',' || lpad(cast(v % 1000 as string), 3, '0') else cast(v as string) end as vt,
            cast(b // 1000 as string) || ',' || lpad(cast(b % 1000 as string), 3, '0') as bt,
            case when q >= 1.5 then 'well above' when q > 1.05 then 'above' when q >= 0.95 then 'in line with' when q > 0.5 then 'below' else 'well below' end as w from x)
    select o_orderkey, 'Requested loan amount of ' || vt || ' is ' || w || ' the portfolio median of ' || bt || ', indicating '
        || case when w in ('well above', 'above') then 'a larger requested loan amount relative to the portfolio' else 'a smaller requested loan amount relative to the portfolio' end
        || ', increasing the estimated risk for this application.' as reason from f
""")
def reason_sentences(t):
    from riskframe.operators.quantiles import quantiles

    med = quantiles(t["orders"], ["o_totalprice"], [0.5])["o_totalprice"][0]
    templates = explain._templates({"loan_amount": {"median": med}})
    v = F.col("o_totalprice")
    return t["orders"].select("o_orderkey", explain.reason_sentence(F.lit("loan_amount"), v.cast("string"), v, F.lit(1.0), templates).alias("reason"))


@query("monitoring_cycle")
def monitoring_cycle(t):
    prepared, credit = ready(t)
    part = credit.probabilities(prepared.part("train"))
    base, sample = drift.build_baseline(part, "default_12m", "p", ["annual_income", "loan_amount", "dti"], ["loan_type", "education"], ["loan_id"], "m1")
    trained = t.spark.createDataFrame([("roc_auc", 0.9), ("brier_score", 0.1)], "metric_name string, metric_value double")
    out = cycle.run_cycle(
        t.credit(), t["predictions"], "m1", trained, date(1999, 1, 1), base, sample, prepared.bands, rules.build_rules(RULES, as_of=AS_OF),
        as_of=date(2000, 6, 30))
    if out.errors:
        raise RuntimeError(str(out.errors))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("result"), "n") for n, df in out.tables.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total
