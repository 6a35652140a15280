"""Ordered kernels give the plain answer whatever the slicing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import split
from riskframe.operators.joins import asof_join, point_in_time_join
from riskframe.operators.neighbours import drop_tomek_links, k_nearest, smote
from riskframe.operators.ordered import positions, running_sums
from riskframe.operators.quantiles import quantiles


@pytest.mark.parametrize("per_task", [7, 100, 10_000])
def test_running_sums_skewed_group(spark, per_task):
    rows = [("hot" if i % 3 else f"g{i % 5}", i * 7919 % 1000, i % 4) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {(r.g, r.k): r.cum_v for r in running_sums(df, ["k"], ["v"], ["g"], per_task).collect()}
    want, acc = {}, {}
    for g, k, v in sorted(rows):
        acc[g] = acc.get(g, 0) + v
        want[(g, k)] = acc[g]
    assert got == want


def test_positions_descending(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("p"))
    got = [r.id for r in positions(df, [F.desc("p"), "id"], rows_per_task=40).orderBy("position").collect()]
    assert got == sorted(range(500), key=lambda i: (-(i % 3), i))


@pytest.mark.parametrize("values", [[5.0] * 50, [0.0] * 80 + [float(i) for i in range(20)], [float(i * i % 997) for i in range(3000)], [1.0, 2.0]])
def test_quantiles_large_path_equals_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for limit in (10_000_000, 0):
        got = quantiles(df, ["x"], probs, small_column=limit, rows_per_task=50)["x"]
        assert np.allclose(got, np.quantile(values, probs), rtol=0, atol=1e-9)
    assert quantiles(df.where("x > 1e9"), ["x"], probs)["x"] is None


def test_quantiles_recover_from_missed_bracket(spark, monkeypatch):
    from riskframe.operators import quantiles as module

    monkeypatch.setattr(module, "_merge", lambda intervals: [(1e17, 1e18)])
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    assert module.quantiles(df, ["x"], [0.5], small_column=0)["x"] == [499.5]


@pytest.mark.parametrize("most", [64, 0])
def test_values_outside_brackets_make_no_rows(spark, monkeypatch, most):
    from riskframe.operators import quantiles as module

    met, sums = [], module.running_sums
    monkeypatch.setattr(module, "MOST_TESTS", most)
    monkeypatch.setattr(module, "running_sums", lambda df, *a: met.append(df.agg(F.sum("n")).first()[0]) or sums(df, *a))
    df = spark.range(20000).select((F.col("id") * 7919 % 20000).cast("double").alias("x"), F.when(F.col("id") % 3 > 0, F.col("id") * 1.5).alias("y"))
    got = module.quantiles(df, ["x", "y"], [0.01, 0.5, 0.99])
    for c in ("x", "y"):
        values = [r[0] for r in df.select(c).collect() if r[0] is not None]
        assert np.allclose(got[c], np.quantile(values, [0.01, 0.5, 0.99]), rtol=0, atol=1e-9)
    assert sum(met) < 2000


def test_asof_slices_equal_unsliced(spark, inputs):
    errors = inputs["events"].where("event_type = 'error'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("v"))
    left = inputs["events"].select("event_id", "user_id", "ts")
    args = (left, errors, "user_id", "ts", "at", ["v"], "hit")
    plain = sorted(map(tuple, asof_join(*args).collect()), key=repr)
    for unit in ("day", "hour"):
        assert sorted(map(tuple, asof_join(*args, slice_unit=unit).collect()), key=repr) == plain


def test_point_in_time_never_looks_ahead(spark):
    c = {"customer_id": "C1", "age": 30, "gender": "MALE", "marital_status": "SINGLE", "dependents": 0, "education": "GRADUATE",
         "employment_type": "SALARIED", "employment_years": 5.0, "annual_income": 480000.0, "city_tier": 1}
    customers = spark.createDataFrame([c, {**c, "customer_id": "C2"}])
    loan = {"loan_id": "L1", "customer_id": "C1", "loan_type": "HOME", "loan_amount": 1000.0, "loan_tenure_months": 12, "interest_rate": 9.0,
            "loan_purpose": "HOME", "application_date": "2024-06-01"}
    loans = spark.createDataFrame([loan, {**loan, "loan_id": "L2", "customer_id": "C2"}])
    days = [("C1", "2024-05-01", 40000.0, 24), ("C1", "2024-06-01", 41000.0, 25), ("C1", "2024-09-01", 99000.0, 99), ("C2", "2024-07-01", 1.0, 1)]
    fin = spark.createDataFrame([(k, d, m, 1.0, 0, 0.0, 0.0, 0.0, 0.0, 0.0) for k, d, m, _ in days],
                                "customer_id string, as_of_date string, monthly_income double, monthly_expenses double, existing_loan_count int, existing_loan_amount double, monthly_emi double, savings_balance double, total_assets double, total_liabilities double")
    cred = spark.createDataFrame([(k, d, h, 1, 1.0, 1.0, 0, 0, 0, 0, 0) for k, d, _, h in days],
                                 "customer_id string, as_of_date string, credit_history_months int, num_credit_accounts int, total_credit_limit double, total_outstanding double, previous_defaults int, late_payments_12m int, missed_payments_12m int, active_loans int, closed_loans int")
    rows = {r.loan_id: r for r in point_in_time_join(customers, loans, fin, cred).collect()}
    assert len(rows["L1"]) == 36
    assert (rows["L1"].monthly_income, rows["L1"].credit_history_months) == (41000.0, 25)
    assert rows["L2"].monthly_income is None and rows["L2"].credit_as_of_date is None


def test_temporal_split_and_folds(spark):
    df = spark.range(101).select(F.col("id").alias("loan_id"), F.lit("2024-01-01").alias("application_date"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    s = split.temporal_split(df, rows_per_task=10)
    assert {r.split: r.n_loans for r in split.split_ranges(s).collect()} == {"train": 71, "val": 15, "test": 15}
    assert s.where("split = 'train'").agg(F.max("loan_id")).first()[0] == 70
    sizes = {(r.y, r.fold): r["count"] for r in split.stratified_folds(df, "y", ["loan_id"], 5).groupBy("y", "fold").count().collect()}
    for y in (0, 1):
        mine = [n for (c, _), n in sizes.items() if c == y]
        assert len(mine) == 5 and max(mine) - min(mine) <= 1


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(1000).select("id", (F.col("id") < 100).cast("int").alias("y"))
    a = sorted(r.id for r in split.exact_sample(df, ["id"], 37).collect())
    assert len(a) == 37 and a == sorted(r.id for r in split.exact_sample(df.repartition(7), ["id"], 37, rows_per_task=50).collect())
    assert dict(split.stratified_sample(df, "y", ["id"], 200).groupBy("y").count().collect()) == {0: 180, 1: 20}
    assert dict(split.undersample(df, "y", ["id"]).groupBy("y").count().collect()) == {0: 100, 1: 100}


def test_nudged_dates_are_distinct(spark):
    df = spark.createDataFrame([("a", i, "2024-01-01") for i in range(5)] + [("a", 9, "2024-01-03"), ("b", 1, "2024-01-01")], "k string, i int, d string").withColumn("d", F.to_date("d"))
    for direction in (1, -1):
        out = split.nudge_repeated_dates(df, "k", "d", ["i"], direction)
        assert out.count() == 7 and out.select("k", "d").distinct().count() == 7


def test_calibrated_intercept(spark):
    df = spark.range(200).select((F.col("id") / 50.0 - 2).alias("x"))
    b = split.calibrate_intercept(df, "x", 0.11)
    assert abs(df.agg(F.avg(1 / (1 + F.exp(-(F.col("x") + b))))).first()[0] - 0.11) < 1e-4


def _points(spark, n=400):
    rng = np.random.default_rng(3)
    xy = rng.normal(size=(n, 2))
    return xy, spark.createDataFrame([(i, float(a), float(b), int(i % 4 == 0)) for i, (a, b) in enumerate(xy)], "id long, a double, b double, y int")


def test_blocked_neighbours_equal_brute_force(spark):
    xy, df = _points(spark)
    d = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :3]
    for limits in ({}, {"broadcast_numbers": 0, "block_rows": 60}):
        got = {}
        for r in k_nearest(df, df, ["a", "b"], 3, **limits).collect():
            got.setdefault(r.id, {})[r["rank"]] = r.distance
        assert np.allclose([[got[i][k] for k in (1, 2, 3)] for i in range(len(xy))], want, atol=1e-6)


@pytest.mark.parametrize("limits", [{}, {"broadcast_numbers": 0, "block_rows": 40}])
def test_neighbours_of_large_values_and_ties(spark, limits):
    """Differences, not products, give distances; of equal ones the smaller ids stay."""
    rows = [(i, 5e6 + 1e-3 * (i % 7), 4e6 + 1e-3 * (i // 30)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(3)
    got = {}
    for r in k_nearest(df, df, ["a", "b"], 3, **limits).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour, r.distance))
    x = np.array([r[1:] for r in rows])
    for i in range(150):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = sorted((round(v, 9), j) for j, v in enumerate(d) if j != i)[:3]
        assert [(round(v, 9), j) for _, j, v in sorted(got[i])] == want


def test_smote_balances_and_stays_between_neighbours(spark):
    xy, df = _points(spark)
    out = smote(df, ["a", "b"], "y", "id", k=5).collect()
    assert sum(r.y for r in out) == sum(1 - r.y for r in out) == 300
    minority = xy[::4]
    for r in [r for r in out if r.id < 0][:50]:
        p = np.array([r.a, r.b])
        gaps = np.linalg.norm(minority[:, None] - p, axis=2)[:, 0]
        i, j = np.argsort(gaps)[:2]
        assert gaps.min() < 3
    assert len({r.id for r in out}) == 600


def test_tomek_links(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0), (2, 0.1, 0.0, 1), (3, 5.0, 5.0, 0), (4, 5.1, 5.0, 0)], "id long, a double, b double, y int")
    assert sorted(r.id for r in drop_tomek_links(df, ["a", "b"], "y", "id").collect()) == [3, 4]
