"""Round trips through storage, a streaming replay and a whole monitoring cycle."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from riskframe.config import CLEANING
from riskframe.operators import cleaning, drift, explain
from riskframe.sources import tables
from riskframe.streaming import jobs


def test_dataset_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "id int, v double")
    version = tables.dataset_version({"b": 1, "a": 2})
    assert version.endswith(tables.config_hash({"a": 2, "b": 1})) and len(version.split("_")[2]) == 8
    tables.write_dataset({"t": df}, str(tmp_path), version, {"seed": 1}, {"dup": 3})
    back = tables.read_tables(spark, str(tmp_path), version, ["t"])["t"]
    assert {r.id: r.v for r in back.collect()} == {1: None, 2: 3.0}
    assert tables.read_metadata(spark, str(tmp_path), version)["row_counts"] == {"t": 2}
    assert tables.read_manifest(spark, str(tmp_path), version) == {"dup": 3}


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.reload(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path)
    change = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    for _ in range(2):
        tables.upsert_table(spark, path, change, ["k"])
    old = tables.read_current(spark, path)
    assert sorted(map(tuple, old.collect())) == [(1, "a"), (2, "B"), (3, "c")]
    tables.upsert_table(spark, path, spark.createDataFrame([(9, "z")], "k int, v string"), ["k"])
    assert old.count() == 3 and tables.read_current(spark, path).count() == 4


def test_feature_sink_refuses_missing_values(spark, tmp_path):
    df = spark.createDataFrame([("train", 1.0, 0), ("test", 2.0, 1)], "split string, x double, y int")
    meta = tables.write_features(df, str(tmp_path), ["x"], "y")
    assert meta["shapes"] == {"train": [1, 1], "test": [1, 1]}
    assert spark.read.parquet(f"{tmp_path}/X").where("split = 'test'").first().x == 2.0
    with pytest.raises(ValueError):
        tables.write_features(df.withColumn("x", F.lit(None).cast("double")), str(tmp_path), ["x"], "y")


def test_fitted_state_round_trips(spark, tmp_path):
    state = cleaning.CleanState({"customers": {"age": 3.0}}, {"customers": {"age": (1.0, 9.0)}})
    tables.save_state(spark, state, str(tmp_path / "clean"))
    assert tables.load_state(spark, cleaning.CleanState, str(tmp_path / "clean")) == state
    base = drift.Baseline("m", 10, 0.1, {"x": {"mean": 1.0, "edges": [float("-inf"), 2.0, float("inf")]}}, {"c": {"a": 1.0}}, [0.1])
    tables.save_baseline(spark, base, spark.createDataFrame([(1.0,)], "x double"), str(tmp_path))
    back, sample = tables.load_baseline(spark, "m", str(tmp_path))
    assert back == base and sample.count() == 1
    with pytest.raises(FileNotFoundError):
        tables.load_baseline(spark, "absent", str(tmp_path))


def test_issue_log_and_missing_folder(spark, tmp_path):
    v = spark.createDataFrame([("customers", "a", "r", "ERROR", "d")], "`table` string, record_key string, rule_name string, severity string, detail string")
    for _ in range(2):
        tables.append_issues(v, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).where("table_name = 'customers'").count() == 2


def test_late_rows_are_left_out_and_windows_close(spark, tmp_path):
    """Append mode: only closed windows come out, and a row behind the watermark does not count."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "created_at timestamp, recommendation string, credit_score int, default_probability double, risk_category string"

    def add(*times):
        spark.createDataFrame([(t, "APPROVE", 700, 0.1, "LOW") for t in times], schema.replace("created_at timestamp", "created_at string")).withColumn(
            "created_at", F.to_timestamp("created_at")).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(schema).parquet(src)
        df = jobs.windowed_operations(stream, "1 hour", lateness="10 minutes")
        q = df.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").start(out)
        q.awaitTermination()

    add("2024-01-01 00:10:00", "2024-01-01 00:50:00")
    run()
    add("2024-01-01 02:30:00")
    run()
    add("2024-01-01 00:20:00", "2024-01-01 04:00:00")
    run()
    rows = {str(r.window_start): r.prediction_volume for r in spark.read.parquet(out).collect()}
    assert rows["2024-01-01 00:00:00"] == 2.0
    assert "2024-01-01 04:00:00" not in rows


def test_whole_chain_and_cycle(spark, inputs, tmp_path):
    """Prepare, train, store, score, explain and monitor the derived credit tables."""
    from registered.modelling import ready
    from registered.validation import AS_OF
    from riskframe.config import RULES
    from riskframe.operators import rules
    from riskframe.plans import cycle, model

    prepared, credit = ready(inputs)
    parts = {r.split: r for r in prepared.frame.groupBy("split").agg(F.min("application_date").alias("a"), F.max("application_date").alias("b")).collect()}
    assert parts["train"].b <= parts["val"].a and parts["val"].b <= parts["test"].a
    assert set(prepared.clean.medians) <= set(CLEANING["impute_numeric"])
    scored = model.score_rows(prepared.part("test"), credit)
    rows = scored.collect()
    assert len(rows) == prepared.part("test").count()
    assert all(300 <= r.credit_score <= 900 for r in rows)
    assert all((r.recommendation in ("APPROVE", "REVIEW", "REJECT")) == (r.status == "scored") for r in rows)
    lacking = model.score_rows(prepared.part("test").limit(5).withColumn("previous_defaults", F.lit(None).cast("int")), credit).collect()
    assert len(lacking) == 5 and all("previous_defaults" in r.status and r.recommendation is None and r.reason is None and r.credit_score for r in lacking)
    assert all(len(r.top_risk_factors) <= 5 and all(f.reason.endswith(".") for f in r.top_risk_factors) for r in rows)
    tables.save_explainer(spark, credit, "m", str(tmp_path))
    background, bench, linear = tables.load_explainer(spark, "m", str(tmp_path))
    assert linear == credit.linear and background.count() == credit.background.count() and bench["age"]["median"] == credit.benchmarks["age"]["median"]
    assert linear.base_value == pytest.approx(credit.linear.base_value)
    broken = cycle.run_cycle(inputs.credit(), inputs["predictions"], "m1", spark.createDataFrame([], "metric_name string, metric_value double"),
                             date(1999, 1, 1), None, None, prepared.bands, rules.build_rules(RULES, as_of=AS_OF), date(2000, 6, 30))
    assert set(broken.errors) == {"drift", "retrain"} and {"metrics", "quality", "alerts"} <= set(broken.tables)
    assert isinstance(linear, explain.LinearState)
