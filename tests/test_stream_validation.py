"""Rows in = good rows + rejected rows, with repeats, late rows and several batches."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from riskframe.operators import rules
from riskframe.streaming import jobs

START = datetime(2024, 1, 1)


def run_on(spark, tmp_path, i, rows):
    """One more batch of rows (none if ``i`` is None) through the same query."""
    source = tmp_path / "in"
    schema = "loan_id string, interest_rate double, applied timestamp, note string"
    if i is not None:
        df = spark.createDataFrame([(k, rate, START + timedelta(hours=h), n) for k, rate, h, n in rows], schema)
        df.coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    check = rules.numeric_range("loan_applications", "interest_rate", 0, 20, severity="ERROR")
    q = jobs.validate_stream(stream, "loan_applications", [check], f"{tmp_path}/good", f"{tmp_path}/issues", f"{tmp_path}/checkpoint",
                             time="applied", lateness="1 day", key=["loan_id"], rejected=f"{tmp_path}/rejected")
    q.awaitTermination()
    return {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("good", "issues", "rejected")}


def run(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        out = run_on(spark, tmp_path, i, rows)
    return out


def test_no_row_vanishes(spark, tmp_path):
    batches = [
        [("L1", 10.0, 0, "first"), ("L1", 99.0, 1, "repeat"), ("L2", 50.0, 0, "bad"), ("L3", 5.0, 2, "fine"), ("L3", 5.0, 2, "fine")],
        [("L1", 9.0, 3, "repeat in a later batch"), ("L4", 1.0, 60, "moves the time on")],
        [("L5", 1.0, 2, "late"), ("L5", 2.0, 61, "in time"), ("L1", 3.0, 62, "known long ago")],
    ]
    out = run(spark, tmp_path, batches)
    good = {(r.loan_id, r.note) for r in out["good"].collect()}
    assert good == {("L1", "first"), ("L3", "fine"), ("L4", "moves the time on"), ("L5", "in time"), ("L1", "known long ago")}
    assert out["good"].count() + out["rejected"].count() == sum(map(len, batches))
    issues = sorted((r.record_key, r.rule_name.split(":")[0]) for r in out["issues"].collect())
    assert issues == sorted([("L1", "numeric_range"), ("L1", "duplicate_record"), ("L2", "numeric_range"), ("L3", "duplicate_record"), ("L1", "duplicate_record"), ("L5", "late_record")])
    assert out["issues"].where(F.col("severity") != "ERROR").count() == 0


def test_key_store_stops_growing(spark, tmp_path):
    """One key a day for twelve days: what is stored and read stays within the lateness."""
    sizes = []
    for day in range(12):
        out = run_on(spark, tmp_path, day, [(f"L{day}", 1.0, 24 * day, "new"), (f"L{day - 1}", 1.0, 24 * day, "again")])
        sizes.append(spark.read.schema(jobs.KeyStore.SCHEMA).parquet(f"{tmp_path}/checkpoint-keys/keys").count())
    assert max(sizes) <= 6 and sizes[-1] == sizes[-3]
    assert len(list((tmp_path / "checkpoint-keys/newest").glob("batch=*"))) <= 3
    assert sorted(r.loan_id for r in out["good"].collect()) == sorted(["L-1"] + [f"L{d}" for d in range(12)])
    assert out["rejected"].count() == 11


def test_replayed_batch_changes_nothing(spark, tmp_path):
    """A batch whose commit was lost runs again and finds the same."""
    import shutil

    rows = [[("L1", 1.0, 0, "a"), ("L2", 1.0, 1, "b")], [("L1", 1.0, 5, "c"), ("L3", 1.0, 70, "d")], [("L3", 1.0, 71, "e"), ("L4", 1.0, 71, "f"), ("L2", 1.0, 2, "late")]]
    for i, batch in enumerate(rows):
        out = run_on(spark, tmp_path, i, batch)
    before = {n: sorted(map(tuple, df.collect())) for n, df in out.items()}
    commits = tmp_path / "checkpoint/commits"
    for f in ("2", ".2.crc"):
        (commits / f).unlink(missing_ok=True)
    out = run_on(spark, tmp_path, None, [])
    assert {n: sorted(map(tuple, df.collect())) for n, df in out.items()} == before
    shutil.rmtree(tmp_path / "checkpoint-keys")
