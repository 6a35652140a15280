"""Score scale, bands, decisions, explanations and drift on known values."""

import math

import pytest
from pyspark.sql import functions as F

from riskframe.config import CATEGORICAL_FEATURES, NUMERIC_FEATURES, ORDINAL_FEATURES, POLICY
from riskframe.functions import display
from riskframe.sources import tables
from riskframe.operators import drift, encode, explain, registry, score


@pytest.mark.parametrize("p,want", [(0.01, 692), (0.02, 652), (0.05, 597), (0.10, 554), (0.20, 507), (0.30, 476), (0.50, 427), (0.087, 563), (1e-9, 900), (1 - 1e-9, 300)])
def test_scores(spark, p, want):
    assert spark.range(1).select(score.probability_to_score(F.lit(p))).first()[0] == want


def test_score_round_trip(spark):
    rows = spark.range(1, 90).select((F.col("id") / 100).alias("p")).withColumn("s", score.probability_to_score("p")).withColumn("q", score.score_to_probability("s")).orderBy("p").collect()
    assert all(abs(r.p - r.q) < 0.005 for r in rows)
    assert [r.s for r in rows] == sorted((r.s for r in rows), reverse=True)


def test_bands(spark):
    got = spark.createDataFrame([(749,), (750,), (300,)], "s int").select(score.categorize("s")).collect()
    assert [r[0] for r in got] == ["LOW", "VERY_LOW", "VERY_HIGH"]
    for bad in ([("A", 300, 500), ("B", 502, 900)], [("A", 300, 600), ("B", 600, 900)], [("A", 301, 900)], []):
        with pytest.raises(ValueError):
            score.check_bands(bad)


GOOD = {"previous_defaults": 0.0, "post_loan_dti": 0.3, "credit_utilization": 0.2, "employment_years": 5.0, "loan_to_income": 1.0,
        "credit_history_months": 60.0, "disposable_income": 30000.0}


@pytest.mark.parametrize("p,s,change,want", [
    (0.02, 750, {}, "APPROVE"), (0.30, 750, {}, "REJECT"), (0.02, 549, {}, "REJECT"), (0.02, 750, {"previous_defaults": 2.0}, "REJECT"),
    (0.02, 750, {"post_loan_dti": 0.61}, "REJECT"), (0.02, 750, {"credit_utilization": 0.96}, "REJECT"),
    (0.02, 750, {"employment_years": 0.4, "loan_to_income": 5.1}, "REJECT"), (0.02, 750, {"employment_years": 0.4}, "APPROVE"),
    (0.02, 750, {"credit_history_months": 11.0}, "REVIEW"), (0.02, 750, {"post_loan_dti": 0.6}, "REVIEW"),
    (0.02, 750, {"disposable_income": 4999.0}, "REVIEW"), (0.10, 690, {}, "REVIEW")])
def test_recommend(spark, p, s, change, want):
    row = {**GOOD, **change, "p": p, "s": s}
    out = score.recommend(spark.createDataFrame([row]), "p", "s", 0.084, POLICY).first()
    assert out.recommendation == want and len(out.triggered_rules) >= 1 and out.reason.endswith(out.triggered_rules[-1])


def test_recommend_needs_its_features(spark):
    with pytest.raises(KeyError):
        score.recommend(spark.createDataFrame([{"p": 0.1, "s": 700}]), "p", "s", 0.1)
    with pytest.raises(Exception, match="required feature"):
        df = spark.createDataFrame([{**GOOD, "p": 0.1, "s": 700}]).withColumn("loan_to_income", F.lit(None).cast("double"))
        score.recommend(df, "p", "s", 0.1).collect()


def test_half_even_rounding(spark):
    row = spark.range(1).select(display.fixed(F.lit(2.5), 0), display.currency(F.lit(1234567.8)), display.percentage(F.lit(0.0583)), display.ratio(F.lit(None).cast("double"))).first()
    assert tuple(row) == ("2", "₹1,234,568", "5.8%", "--")


def test_every_feature_has_a_sentence():
    explain.check_coverage(NUMERIC_FEATURES + CATEGORICAL_FEATURES + ORDINAL_FEATURES)
    with pytest.raises(KeyError):
        explain.check_coverage(["shoe_size"])


def test_attributions_sum_to_the_margin(spark):
    df = spark.createDataFrame([(30.0, "HOME", 2.0), (50.0, "AUTO", 0.0), (40.0, "HOME", 0.0)], "age double, loan_type string, previous_defaults double")
    enc = encode.fit(df, ["age", "previous_defaults"], ["loan_type"], [])
    state = explain.LinearState(enc.names(), [0.5, 1.0, -0.3, 0.2], -1.0, explain.background_means(df, enc))
    bench = {"age": {"median": 40.0}, "previous_defaults": {"median": 0.0}, "loan_type": {"mode": "HOME"}}
    out = explain.explain(df, state, enc, bench).collect()
    x = encode.transform(df, enc).collect()
    for r, v in zip(out, x):
        assert r.model_output_value == pytest.approx(-1.0 + sum(c * a for c, a in zip(state.coefficients, v)))
        assert all(f.contribution > 0 for f in r.top_risk_factors) and all(f.contribution < 0 for f in r.top_positive_factors)
    risk = {f.feature: f.reason for f in out[0].top_risk_factors}
    assert risk["previous_defaults"] == "A history of previous defaults on record, increasing the estimated risk for this application."
    sentences = {r.feature: r.reason for r in explain.explain_long(df.limit(1).withColumn("k", F.lit(1)), ["k"], state, enc, bench).collect()}
    assert sentences["age"].startswith("Applicant age of 30.0 years is below the portfolio median of 40.0 years, indicating a younger age")
    assert "matches the portfolio's most common value (HOME)" in sentences["loan_type"]
    assert explain.LinearState.from_json(state.to_json()) == state


# -- drift ------------------------------------------------------------------------

def test_psi_of_shares(spark):
    df = spark.createDataFrame([(0.5, 0.9), (0.5, 0.1)], "e double, a double")
    assert df.agg(F.sum(drift.psi_term(F.col("e"), F.col("a")))).first()[0] == pytest.approx(0.8789, abs=1e-3)
    got = spark.createDataFrame([(0.05,), (0.15,), (0.30,)], "p double").select(drift.psi_status(F.col("p"))).collect()
    assert [r[0] for r in got] == ["OK", "WARNING", "DRIFT"]


def test_numeric_psi(spark):
    edges = {"x": [float("-inf"), *[10.0 * i for i in range(1, 10)], float("inf")]}
    even = spark.range(100).select(F.col("id").cast("double").alias("x"))
    assert drift.numeric_psi(even, edges).first().psi < 0.02
    assert drift.numeric_psi(even.select(F.lit(95.0).alias("x")), edges).first().psi > 0.25
    assert drift.numeric_psi(even.where("x < 0"), edges).first().psi == 0.0


def test_merged_edges_against_itself(spark):
    df = spark.createDataFrame([(0.0,)] * 64 + [(float(i),) for i in range(1, 37)], "x double")
    edges = drift.decile_edges(df, ["x"])
    assert drift.numeric_psi(df, edges).first().psi == pytest.approx(0.876, abs=0.02)
    assert drift.numeric_psi(df, edges, drift.observed_shares(df, edges)).first().psi == pytest.approx(0.0, abs=1e-12)


def test_constant_edges(spark):
    df = spark.createDataFrame([(5.0,)] * 20, "x double")
    assert drift.decile_edges(df, ["x"]) == {"x": [float("-inf"), float("inf")]}


def test_categories(spark):
    df = spark.createDataFrame([("A",)] * 40 + [("B",)] * 40 + [("C",)] * 20, "c string")
    r = drift.categorical_psi(df, {"c": {"A": 0.5, "B": 0.5}}).first()
    assert (r.n_new, r.new_example) == (1, "C") and r.psi > 0.25
    two = {"c": {"A": 0.5, "B": 0.5}}
    assert drift.chi_square(spark.createDataFrame([("A",)] * 250 + [("B",)] * 250, "c string"), two).first().statistic == 0.0
    r = drift.chi_square(spark.createDataFrame([("A",)] * 480 + [("B",)] * 20, "c string"), two).first()
    assert r.statistic == pytest.approx(423.2) and r.dof == 1


def test_ks(spark):
    a = spark.range(100).select(F.col("id").cast("double").alias("x"))
    assert drift.ks_statistics(a, a, ["x"]).first().statistic == 0.0
    assert drift.ks_statistics(a, a.select((F.col("x") + 50).alias("x")), ["x"], rows_per_task=13).first().statistic == 0.5
    assert drift.ks_statistics(a, a.limit(1), ["x"]).first().statistic is None


def test_concept_drift(spark):
    y = spark.range(100).select((F.col("id") < 80).cast("int").alias("y"))
    assert drift.concept_drift(y, "y", 0.10).first().status == "WARNING"
    none = drift.concept_drift(y.where("y > 5"), "y", 0.10).first()
    assert none.status == "OK" and none.n == 0 and none.ci_low is None


def test_baseline_profile(spark):
    df = spark.range(100).select("id", F.col("id").cast("double").alias("income"), F.when(F.col("id") < 60, "A").otherwise("B").alias("c"),
                                 (F.col("id") < 10).cast("int").alias("y"), (F.col("id") / 100).alias("p"))
    b, sample = drift.build_baseline(df, "y", "p", ["income"], ["c"], ["id"], "m", sample_size=30)
    assert b.numeric["income"]["mean"] == 49.5 and b.categorical["c"]["A"] == 0.6 and b.default_rate == 0.1 and sample.count() == 30
    assert drift.Baseline.from_json(b.to_json()) == b
    found = drift.feature_drift(b, sample, df)
    assert {(r.feature_name, r.method) for r in found.collect()} == {("income", "psi"), ("income", "ks"), ("c", "psi"), ("c", "chi_square")}
    assert found.where("status = 'DRIFT'").count() == 0


def test_baseline_of_many_categories(spark, tmp_path):
    """Shares of rare categories are a table; drift against them needs no list."""
    df = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, "A").otherwise(F.col("id").cast("string")).alias("c"), F.lit(0).alias("y"), F.lit(0.5).alias("p"))
    b, sample = drift.build_baseline(df, "y", "p", [], ["c"], ["id"], "many", sample_size=5)
    assert b.categorical == {"c": {"A": 1 / 3}} and len(b.to_json()) < 1000
    tables.save_baseline(spark, b, sample, str(tmp_path))
    b, _ = tables.load_baseline(spark, "many", str(tmp_path))
    assert b.shares(spark).count() == 40_001
    same = drift.categorical_psi(df, b.shares(spark), columns=["c"]).first()
    assert same.n_new == 0 and abs(same.psi) < 1e-9
    now = df.withColumn("c", F.when(F.col("id") < 7, F.concat(F.lit("new"), F.col("id") % 2)).otherwise(F.col("c")))
    assert sorted(r.value for r in drift.new_categories(now, b.shares(spark), ["c"]).collect()) == ["new0", "new1"]
    assert drift.feature_drift(b, sample, now).where("status = 'DRIFT'").count() == 2
    with pytest.raises(ValueError):
        drift.categorical_psi(df, b.shares(spark))


def test_registry(spark):
    from datetime import datetime

    row = {"model_id": "a", "algorithm": "lr", "training_date": datetime(2024, 1, 1), "dataset_version": "d", "feature_list": ["x"],
           "hyperparameters": {}, "metrics": {"roc_auc": 0.8, "chosen_threshold": 0.1}, "artifact_path": ""}
    r = registry.register(registry.empty(spark), row)
    r = registry.register(r, {**row, "model_id": "b"})
    assert {x.model_id: (x.model_version, x.is_active) for x in r.collect()} == {"a": ("1.0.0", False), "b": ("1.1.0", True)}
    back = registry.rollback(r, "a")
    assert registry.model_card(back).first().model_id == "a"
    quiet = registry.register(back, {**row, "model_id": "c"}, activate=False)
    assert [x.model_id for x in registry.active(quiet).collect()] == ["a"] and math.isclose(registry.model_card(quiet).first().chosen_threshold, 0.1)
    with pytest.raises(KeyError):
        registry.activate(r, "zzz")


def test_top_factors_look_a_template_up_once(spark):
    """The lookup was repeated for every part of the sentence that reads the template."""
    from pyspark.sql import functions as F

    templates = explain._templates({"age": {"median": 40.0}, "dti": {"median": 0.3}, "gender": {"mode": "MALE"}})
    schema = "a array<struct<rank_key:double,place:int,feature:string,value:string,number:double,contribution:double>>"
    factors = [(-3.0, 0, "age", "20", 20.0, 3.0), (-2.0, 1, "dti", None, None, 2.0), (-1.0, 2, "gender", "MALE", None, -1.0), (-0.5, 3, "dti", "0.5", 0.5, 0.5)]
    df = spark.createDataFrame([(factors,), ([],), (None,)], schema)
    for sign, want in ((1, ["age", "dti"]), (-1, ["gender"])):
        out = df.select(explain.top_factors(F.col("a"), sign, 2, templates).alias("top"))
        assert out._jdf.queryExecution().analyzed().toString().count("try_element_at(") == 1
        rows = [r.top for r in out.collect()]
        assert [f.feature for f in rows[0]] == want and rows[1:] == [[], None]
        for f, (_, _, feature, value, number, contribution) in zip(rows[0], [x for x in factors if x[5] * sign > 0]):
            one = spark.range(1).select(explain.reason_sentence(
                F.lit(feature), F.lit(value).cast("string"), F.lit(number).cast("double"), F.lit(contribution), templates)).first()[0]
            assert (f.value, f.contribution, f.reason) == (value, contribution, one)
