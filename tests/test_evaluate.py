"""Hand-computed metrics, thresholds, lift and calibration."""

import math

import pytest
from pyspark.sql import functions as F

from riskframe.operators import evaluate, explore, monitor, training
from riskframe.functions.pvalues import chi2_p, correlation_p, ks_p


def scored(spark, y, p):
    return spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "id long, y int, p double")


def test_confusion_and_suite(spark):
    df = scored(spark, [0, 0, 1, 1], [0.1, 0.6, 0.4, 0.9])
    assert tuple(evaluate.confusion(df, "y", "p", 0.5).first()) == (1, 1, 1, 1)
    m = evaluate.metric_suite(df, "y", "p").first()
    assert m.accuracy == m.precision == m.recall == m.f1 == 0.5 and m.roc_auc == 0.75 and m.gini == 0.5


def test_ks_and_ties(spark):
    assert evaluate.metric_suite(scored(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]), "y", "p", calibration=False).first().ks_statistic == 1.0
    tied = evaluate.metric_suite(scored(spark, [0, 1, 0, 1], [0.5] * 4), "y", "p").first()
    assert tied.ks_statistic == 0.0 and tied.roc_auc == 0.5 and tied.pr_auc == 0.5


def test_single_class_gives_nulls(spark):
    m = evaluate.metric_suite(scored(spark, [0, 0], [0.1, 0.2]), "y", "p").first()
    assert m.roc_auc is None and m.pr_auc is None and m.calibration_slope is None and m.brier_score == pytest.approx(0.025)


def test_average_precision_is_the_step_sum(spark):
    m = evaluate.metric_suite(scored(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1]), "y", "p", calibration=False).first()
    assert m.pr_auc == pytest.approx(0.5 * 1.0 + 0.5 * 2 / 3)


@pytest.mark.parametrize("per_task", [5, 1000])
def test_curve_does_not_depend_on_slices(spark, per_task):
    df = scored(spark, [i * 7 % 3 == 0 for i in range(300)], [(i * 37 % 100) / 100 for i in range(300)])
    m = evaluate.suite_of_curve(evaluate.score_curve(df, "y", "p", rows_per_task=per_task)).first()
    pos = [b for a, b in [(i * 7 % 3 == 0, (i * 37 % 100) / 100) for i in range(300)] if a]
    neg = [b for a, b in [(i * 7 % 3 == 0, (i * 37 % 100) / 100) for i in range(300)] if not a]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert m.roc_auc == pytest.approx(auc, rel=1e-12)


def test_recall_at_precision(spark):
    curve = evaluate.score_curve(scored(spark, [0, 1, 0, 1], [0.5] * 4), "y", "p")
    assert evaluate.recall_at_precision(curve, 0.99).first()[0] == 0.0


def test_lift_bins_are_not_ntile(spark):
    y = [1] * 7 + [0] * 8 + [1] * 10 + [0] * 121
    df = scored(spark, y, [1 - i / 146 for i in range(146)])
    rows = evaluate.lift_gains(df, "y", "p", ["id"], rows_per_task=20).collect()
    assert [r.n for r in rows] == [15, 15, 14, 15, 14, 15, 14, 15, 14, 15]
    assert rows[0].lift == pytest.approx(4.0078, abs=1e-4) and rows[-1].cum_gain == 1.0


def test_thresholds(spark):
    df = scored(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])
    best = evaluate.min_cost_threshold(df, "y", "p").first()
    assert best.expected_cost == 1.0 and best.threshold == 101 * 0.001
    cheap = evaluate.min_cost_threshold(df, "y", "p", {"fn": 0.1, "fp": 1.0, "tp": 0.0, "tn": 0.0}).first()
    assert cheap.threshold > best.threshold
    curve = evaluate.score_curve(df, "y", "p")
    assert evaluate.max_f1_threshold(curve).first().threshold == 0.35
    assert evaluate.max_youden_threshold(curve).first().threshold == 0.8
    assert [r.criterion for r in evaluate.optimise_threshold(df, "y", "p").where("chosen").collect()] == ["min_cost"]


def test_roc_drops_collinear_points(spark):
    curve = evaluate.score_curve(scored(spark, [1, 1, 0, 0], [0.9, 0.8, 0.3, 0.2]), "y", "p")
    assert sorted((r.fpr, r.tpr) for r in evaluate.roc_points(curve).collect()) == [(0.0, 0.0), (0.0, 0.5), (0.0, 1.0), (1.0, 1.0)]
    assert evaluate.roc_points(curve, False).count() == 5
    curve = evaluate.score_curve(scored(spark, [1, 1, 0, 1, 0], [0.9, 0.8, 0.7, 0.6, 0.5]), "y", "p")
    assert (0.0, pytest.approx(1 / 3), 0.9) in [(r.fpr, r.tpr, r.threshold) for r in evaluate.roc_points(curve).collect()]


def test_roc_of_segments_is_that_of_each_segment(spark):
    a = [(1, 0.9), (0, 0.8), (0, 0.7), (1, 0.6), (1, 0.5)]
    b = [(0, 0.9), (1, 0.8), (1, 0.75), (1, 0.7)]
    both = spark.createDataFrame([("a", *r) for r in a] + [("b", *r) for r in b], "k string, y int, p double")
    got = evaluate.roc_points(evaluate.score_curve(both, "y", "p", ["k"])).collect()
    for k, rows in (("a", a), ("b", b)):
        alone = evaluate.roc_points(evaluate.score_curve(scored(spark, [y for y, _ in rows], [p for _, p in rows]), "y", "p")).collect()
        assert sorted((r.fpr, r.tpr, r.threshold) for r in got if r.k == k) == sorted(map(tuple, alone))


def test_calibration_of_perfect_scores(spark):
    rows = [(int(i < round(1000 * p)), p) for p in (0.1, 0.3, 0.5, 0.8) for i in range(1000)]
    m = evaluate.metric_suite(scored(spark, [r[0] for r in rows], [r[1] for r in rows]), "y", "p").first()
    assert m.calibration_slope == pytest.approx(1.0, abs=1e-8) and m.calibration_intercept == pytest.approx(0.0, abs=1e-8)


def test_calibration_lowers_brier(spark):
    rows = [(int(i < round(200 * p)), min(0.99, p * 1.8)) for p in (0.05, 0.1, 0.2, 0.4) for i in range(200)]
    c = training.calibrate(scored(spark, [r[0] for r in rows], [r[1] for r in rows]), "y", "p")
    assert c.brier[c.method] == min(c.brier.values()) < c.brier_before


def test_accuracy_is_refused():
    with pytest.raises(ValueError):
        evaluate.select_best([{"metrics": {"accuracy": 1}}], "accuracy")
    assert evaluate.select_best([{"n": 1, "metrics": {"a": 1}}, {"n": 2, "metrics": {"a": 3}}], "a")["n"] == 2


def test_logistic_matches_newton_optimum(spark):
    from pyspark.ml.feature import VectorAssembler

    df = scored(spark, [int((i * 13 % 10) < i // 20) for i in range(200)], [i / 100 - 1 for i in range(200)])
    m = training.fit(VectorAssembler(inputCols=["p"], outputCol="features").transform(df), "logistic_regression", {"C": 2.0, "tol": 1e-12}, "y")
    b, a = float(m.coefficients[0]), m.intercept
    rows = df.collect()
    mu = [1 / (1 + math.exp(-(b * r.p + a))) for r in rows]
    assert abs(sum(u - r.y for u, r in zip(mu, rows))) < 1e-4
    assert abs(2.0 * sum((u - r.y) * r.p for u, r in zip(mu, rows)) + b) < 1e-4


def test_draws_are_distinct():
    d = training.draw_params({"a": [1, 2, 3], "b": [1, 2]}, 5, 7)
    assert len({tuple(sorted(x.items())) for x in d}) == 5 and len(training.draw_params({"a": [1, 2]}, 20, 1)) == 2


# -- exploration ---------------------------------------------------------------

def test_default_rate_and_woe(spark):
    df = spark.createDataFrame([("A", int(i < 3)) for i in range(5)] + [("B", int(i < 1)) for i in range(5)], "g string, y int")
    assert tuple(explore.default_rate_summary(df, "y").first()) == (10, 4, 6, 0.4)
    rows = {r.value: r for r in explore.woe_iv_categorical(df, ["g"], "y").collect()}
    assert rows["A"].woe == pytest.approx(-0.8109302162) and rows["B"].woe == pytest.approx(0.9808292530)
    assert sum(r.iv_part for r in rows.values()) == pytest.approx(0.7465664455)
    split = spark.createDataFrame([("A", 0)] * 5 + [("B", 1)] * 5, "g string, y int")
    assert all(math.isfinite(r.iv_part) and r.iv_part > 0 for r in explore.woe_iv_categorical(split, ["g"], "y").collect())


def test_zero_inflated_count_keeps_its_iv(spark):
    rows = [(0, int(i < 6)) for i in range(80)] + [(1, int(i < 6)) for i in range(15)] + [(2, int(i < 4)) for i in range(5)]
    iv = explore.iv_table(spark.createDataFrame(rows, "v int, y int"), ["v"], [], "y").first()
    assert iv.iv > 0.02


@pytest.mark.parametrize("iv,label", [(0.01, "useless"), (0.05, "weak"), (0.2, "medium"), (0.4, "strong"), (0.6, "suspicious")])
def test_interpret_iv(spark, iv, label):
    assert spark.range(1).select(explore.interpret_iv(F.lit(iv))).first()[0].startswith(label)


def test_constant_column_is_one_decile(spark):
    df = spark.range(20).select(F.lit(5.0).alias("v"), (F.col("id") % 2).alias("y"))
    assert [(r.decile, r.n) for r in explore.decile_counts(df, ["v"], "y").collect()] == [(1, 20)]


def test_months_and_regime(spark):
    df = spark.createDataFrame([("2024-01-05", 0), ("2024-01-06", 1), ("2024-02-01", 0), ("2024-03-01", 1), ("2024-03-02", 0)], "d string, y int")
    rows = explore.monthly_rates(df, "d", "y").collect()
    assert [r.month for r in rows] == ["2024-01", "2024-02", "2024-03"] and sum(r.n for r in rows) == 5
    flat = spark.createDataFrame([(f"m{i:02d}", 0.9 if i == 11 else 0.1 + i / 1000) for i in range(12)], "month string, default_rate double")
    assert explore.regime_shift(flat).first().flagged_months == ["m11"]


def test_p_values():
    assert correlation_p(0.5, 30) == pytest.approx(0.00491, abs=2e-5)
    assert chi2_p(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and chi2_p(423.2, 1) < 1e-50
    assert ks_p(0.5, 10, 1) is None and ks_p(0.0, 50, 50) == 1.0 and ks_p(1.0, 50, 50) < 1e-10


@pytest.mark.parametrize("name,train,now,want", [
    ("roc_auc", 0.80, 0.65, True), ("roc_auc", 0.80, 0.78, False), ("brier_score", 0.10, 0.13, True), ("brier_score", 0.10, 0.105, False),
    ("calibration_slope", 1.0, 1.5, True), ("calibration_slope", 1.0, 1.02, False), ("roc_auc", float("nan"), 0.5, False), ("other", 1.0, 0.0, False)])
def test_is_degraded(spark, name, train, now, want):
    assert spark.range(1).select(monitor.is_degraded(F.lit(name), F.lit(train), F.lit(now))).first()[0] is want
