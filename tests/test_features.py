"""Hand-computed features, bands, cleaning and encoding."""

import pytest
from pyspark.sql import functions as F

from riskframe.config import CLEANING, RULES
from riskframe.operators import cleaning, encode, features, rules


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items())
    row = tuple(v if isinstance(v, str) or v is None else float(v) for v in values.values())
    return spark.createDataFrame([row], schema or "x double").select(expr).first()[0]


@pytest.mark.parametrize("income,want", [(10000, 0.5), (0, 5.0), (-1, 5.0), (None, 5.0)])
def test_safe_divide(spark, income, want):
    assert one(spark, features.safe_divide(F.col("n"), F.col("d"), 5.0), n=5000, d=income) == want


@pytest.mark.parametrize("p,rate,n,want", [(120000, 0, 12, 10000.0), (100000, 12, 12, 100000 * 0.01 * 1.01**12 / (1.01**12 - 1)), (500, 10, 0, 500.0), (None, 10, 12, 0.0)])
def test_proposed_emi(spark, p, rate, n, want):
    got = one(spark, features.proposed_emi(F.col("p"), F.col("r"), F.col("n")), p=p, r=rate, n=n)
    assert got == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("u,want", [(0.3, "0-30"), (0.300001, "30-50"), (0.9, "70-90"), (1.5, "90+"), (None, "nan")])
def test_utilization_band_is_right_closed(spark, u, want):
    assert one(spark, features.utilization_band("u"), u=u) == want


def test_quantile_band(spark):
    edges = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    got = [one(spark, features.quantile_band(F.col("v"), edges), v=v) for v in (-9, 2, 2.1, 99, None)]
    assert got == ["Q1", "Q1", "Q2", "Q5", "nan"]
    assert one(spark, features.quantile_band(F.col("v"), [5.0]), v=5) == "nan"


def test_leakage_guard():
    features.assert_no_leakage(["post_loan_dti", "age"])
    for bad in ("default_12m", "future_income", "score_after_decision", "outcome_observed_date", "status"):
        with pytest.raises(features.LeakageError):
            features.assert_no_leakage(["age", bad])


def test_leaky_feature_is_found(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("y"), (F.col("id") % 2 * 3.0).alias("leak"), F.rand(1).alias("noise"), F.lit(1.0).alias("constant"))
    assert [r.feature for r in features.correlation_offenders(df, ["leak", "noise", "constant"], "y").collect()] == ["leak"]


def customers(spark, rows):
    return spark.createDataFrame(
        [(k, a, "MALE", "SINGLE", 0, "GRADUATE", "SALARIED", 1.0, inc, None if inc is None else inc / 12, 1, i) for i, (k, a, inc) in enumerate(rows)],
        "customer_id string, age int, gender string, marital_status string, dependents int, education string, employment_type string, "
        "employment_years double, annual_income double, monthly_income double, city_tier int, n int")


def clean(spark, rows, train=None):
    order = {"customers": ["n"], "loan_applications": ["n"]}
    state = cleaning.fit({"customers": customers(spark, train or rows)}, CLEANING, order)
    return state, cleaning.apply({"customers": customers(spark, rows)}, state, CLEANING, order, rules.build_rules(RULES))


def test_clean_dedup_clip_and_quarantine(spark):
    _, out = clean(spark, [("a", 200, 1000.0), ("b", 30, -500000.0), ("c", 35, 900.0), ("c", 36, 900.0)])
    rows = {r.customer_id: r for r in out.tables["customers"].collect()}
    assert len(rows) == 3 and rows["a"].age == 100 and rows["c"].age == 36
    assert all(r.annual_income >= 0 for r in rows.values())
    assert out.validation.violations.where("severity = 'ERROR'").count() == 0


def test_impute_uses_training_median(spark):
    state, out = clean(spark, [("x", 40, 1000.0), ("y", 40, None)], train=[("a", 40, 100.0), ("b", 40, 200.0), ("c", 40, None)])
    assert state.medians["customers"]["annual_income"] == 150.0
    y = out.repaired["customers"].where("customer_id = 'y'").first()
    assert y.annual_income == 150.0 and y.annual_income_was_missing
    assert cleaning.CleanState.from_json(state.to_json()) == state


def test_cleaning_is_idempotent(spark):
    rows = [(f"k{i}", 20 + i, 1000.0 + i) for i in range(30)]
    order = {"customers": ["n"], "loan_applications": ["n"]}
    state, once = clean(spark, rows)
    again = cleaning.apply(once.tables, state, CLEANING, order, rules.build_rules(RULES)).tables["customers"]
    cols = [c for c in again.columns if not c.endswith("_was_missing")]
    assert sorted(map(tuple, again.select(cols).collect())) == sorted(map(tuple, once.tables["customers"].select(cols).collect()))


def test_encoder(spark):
    df = spark.createDataFrame([(1.0, "a", "Q1"), (3.0, "a", "Q2"), (None, "b", "Q2"), (2.0, None, "nan")], "v double, c string, b string")
    state = encode.fit(df, ["v"], ["c"], ["b"], 0.3, {"b": ["Q1", "Q2"]})
    assert state.numeric["v"][0] == 2.0 and state.kept["c"] == ["a"] and state.infrequent == {"c": 2}
    assert state.names() == ["v", "c_a", "c_infrequent", "b"] and state.sources()["c_infrequent"] == "c"
    new = spark.createDataFrame([(2.0, "zzz", "Q9"), (None, "b", None)], "v double, c string, b string")
    assert [tuple(r) for r in encode.transform(new, state).collect()] == [(0.0, 0.0, 0.0, -1.0), (0.0, 0.0, 1.0, 1.0)]
    assert encode.EncoderState.from_json(state.to_json()) == state
    assert encode.source_feature("loan_type_HOME", ["age"], ["loan", "loan_type"], []) == "loan_type"
    with pytest.raises(ValueError):
        encode.check_finite(new, ["v"])


def test_a_million_levels(spark, tmp_path):
    """Levels are rows: half of the rows have one value, the others one each; unseen values fit no column."""
    from riskframe.sources import tables

    n = 1_000_000
    df = spark.range(2 * n).select("id", F.when(F.col("id") % 2 == 0, "big").otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("c"))
    state = encode.fit(df, [], ["c"], [])
    assert state.kept == {"c": ["big"]} and state.infrequent == {"c": n} and len(state.to_json()) < 1000
    tables.save_encoder(spark, state, str(tmp_path / "encoder"))
    state = tables.load_state(spark, encode.EncoderState, str(tmp_path / "encoder"))
    new = df.unionByName(spark.range(5).select("id", F.lit("unseen").alias("c"))).unionByName(spark.range(1).select("id", F.lit("\0" + "1").alias("c")))
    got = encode.transform(new, state).groupBy("c_big", "c_infrequent").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(1.0, 0.0): n, (0.0, 1.0): n, (0.0, 0.0): 6}
    assert encode.with_vector(new, state).where("id = 1 and c = 'v1'").first().features.toArray().tolist() == [0.0, 1.0]
