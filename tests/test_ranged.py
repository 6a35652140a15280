"""Key-range tables: an upsert writes what it touches, and writers that meet conflict."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from riskframe.sources import model_store, ranged


def rows(spark, lo, hi, word="a"):
    return spark.range(lo, hi).select(F.col("id").alias("k"), F.concat(F.lit(word), F.col("id").cast("string")).alias("v"))


def content(spark, root):
    found = ranged.read(spark, root).collect()
    out = {r.k: r.v for r in found}
    assert len(out) == len(found)
    return out


def test_an_upsert_writes_in_proportion_to_its_changes(spark, tmp_path):
    root = str(tmp_path)
    first = ranged.upsert(spark, root, rows(spark, 0, 10_000), ["k"], 1000)
    assert len(first.pieces) >= 10 and sum(p.rows for p in first.pieces) == 10_000 and max(p.rows for p in first.pieces) < 1000
    second = ranged.upsert(spark, root, rows(spark, 4000, 4010, "b").withColumn("extra", F.lit(1)), ["k"], 1000)
    changed = [p for p in second.pieces if p not in first.pieces]
    assert 1 <= len(changed) <= 2 and len(second.pieces) == len(first.pieces)
    assert sum(p.rows for p in changed) < 2000
    expected = {k: f"a{k}" for k in range(10_000)} | {k: f"b{k}" for k in range(4000, 4010)}
    assert content(spark, root) == expected
    # Every row lies in the piece that its key is looked up in.
    for i, p in enumerate(second.pieces):
        piece = spark.read.schema(second.schema).parquet(f"{root}/{p.path}").select(ranged._range(second).alias("r")).distinct().collect()
        assert [r.r for r in piece] == [i]
    assert [tuple(r) for r in ranged.read_key(spark, root, 4005).collect()] == [(4005, "b4005")]
    assert ranged.read_key(spark, root, -1).isEmpty()
    # Keys below and above all others, and a piece that outgrows the limit.
    third = ranged.upsert(spark, root, rows(spark, -5, 0).unionByName(rows(spark, 10_000, 13_000)), ["k"], 1000)
    assert len(third.pieces) > len(second.pieces) and sum(p.rows for p in third.pieces) == 13_005
    assert content(spark, root) == expected | {k: f"a{k}" for k in [*range(-5, 0), *range(10_000, 13_000)]}
    assert not [f for f in (tmp_path / "data").iterdir() if not (f / "state").exists()]


def test_keys_of_several_columns_and_texts(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(3000).select((F.col("id") % 3).cast("string").alias("t"), (F.col("id") % 1000).cast("int").alias("n"), F.col("id").alias("v"))
    done = ranged.upsert(spark, root, df, ["t", "n"], 500)
    assert len(done.pieces) > 5
    ranged.upsert(spark, root, df.where("n = 7").withColumn("v", F.lit(-1).cast("long")), ["t", "n"], 500)
    assert ranged.read(spark, root).count() == 3000 and ranged.read(spark, root).where("v = -1").count() == 3
    assert ranged.read_key(spark, root, "2", 7).first().v == -1


def test_edges(spark, tmp_path):
    root = str(tmp_path)
    assert ranged.state(spark, root) is None
    with pytest.raises(FileNotFoundError):
        ranged.read(spark, root)
    assert ranged.upsert(spark, root, rows(spark, 0, 0), ["k"]).number == 1
    assert ranged.read(spark, root).columns == ["k", "v"] and ranged.read(spark, root).isEmpty()
    ranged.upsert(spark, root, rows(spark, 0, 3), ["k"])
    assert ranged.upsert(spark, root, rows(spark, 0, 0), ["k"]).number == 2
    for bad in (rows(spark, 0, 2).unionByName(rows(spark, 1, 2)), rows(spark, 0, 2).withColumn("k", F.lit(None).cast("long"))):
        with pytest.raises(ValueError):
            ranged.upsert(spark, root, bad, ["k"])
    with pytest.raises(ValueError):
        ranged.upsert(spark, root, rows(spark, 0, 2), ["v"])
    assert content(spark, root) == {0: "a0", 1: "a1", 2: "a2"}


def test_two_writers_conflict(spark, tmp_path, monkeypatch):
    root, claim = str(tmp_path), ranged._claim
    ranged.upsert(spark, root, rows(spark, 0, 3), ["k"])

    def overtaken(spark, root, number, folder):
        monkeypatch.setattr(ranged, "_claim", claim)
        ranged.upsert(spark, root, rows(spark, 1, 2, "first"), ["k"])
        claim(spark, root, number, folder)

    monkeypatch.setattr(ranged, "_claim", overtaken)
    with pytest.raises(ranged.WriteConflict):
        ranged.upsert(spark, root, rows(spark, 1, 2, "second"), ["k"])
    assert content(spark, root) == {0: "a0", 1: "first1", 2: "a2"}
    ranged.upsert(spark, root, rows(spark, 1, 2, "second"), ["k"])
    assert content(spark, root)[1] == "second1"


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    ranged.upsert(spark, root, rows(spark, 0, 3), ["k"])
    # It claims a number and dies before it names its folder.
    (tmp_path / "claims" / "2").touch()
    assert content(spark, root) == {0: "a0", 1: "a1", 2: "a2"}
    with pytest.raises(ranged.WriteConflict):
        ranged.upsert(spark, root, rows(spark, 0, 1, "b"), ["k"])
    assert ranged.drop_unfinished(spark, root) == 1
    ranged.upsert(spark, root, rows(spark, 0, 1, "b"), ["k"])
    assert content(spark, root)[0] == "b0"


def model(name):
    return {"model_id": name, "algorithm": "logistic_regression", "training_date": datetime(2024, 1, 1), "dataset_version": "d", "feature_list": ["a"],
            "hyperparameters": {"C": "1"}, "metrics": {"roc_auc": 0.8}, "artifact_path": ""}


def test_a_model_gets_metrics_and_reports_in_one_commit(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    assert model_store.models(spark, root).isEmpty()
    model_store.register(spark, root, model("m1"), {"lift": rows(spark, 0, 4)})
    model_store.register(spark, root, model("m2"))
    found = {r.model_id: r for r in model_store.models(spark, root).collect()}
    assert {k: (r.model_version, r.is_active) for k, r in found.items()} == {"m1": ("1.0.0", False), "m2": ("1.1.0", True)}
    assert model_store.report(spark, root, "m2") == {} and model_store.report(spark, root, "m1")["lift"].count() == 4
    model_store.attach(spark, root, "m1", {"gini": 0.6}, {"lift": rows(spark, 0, 5), "roc": rows(spark, 0, 6)})
    row = model_store.models(spark, root).where("model_id = 'm1'").first()
    assert row.metrics == {"roc_auc": 0.8, "gini": 0.6}
    assert {k: df.count() for k, df in model_store.report(spark, root, "m1").items()} == {"lift": 5, "roc": 6}

    def die(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(ranged, "_claim", die)
    with pytest.raises(RuntimeError):
        model_store.attach(spark, root, "m1", {"gini": 0.1}, {"lift": rows(spark, 0, 9)})
    assert model_store.models(spark, root).where("model_id = 'm1'").first() == row
    assert model_store.report(spark, root, "m1")["lift"].count() == 5
    with pytest.raises(ValueError):
        model_store.register(spark, root, model("m1"))
    with pytest.raises(KeyError):
        model_store.attach(spark, root, "m9", {}, {})
