import inspect
from types import SimpleNamespace

from registered import modelling
from riskframe.config import IMBALANCE_STRATEGIES, SEARCH
from riskframe.operators import training


def called(monkeypatch, name, query, result=None):
    """The arguments of each call that a query makes to a function of training."""
    sign, calls = inspect.signature(getattr(training, name)), []

    def record(*args, **kwargs):
        bound = sign.bind(*args, **kwargs)
        bound.apply_defaults()
        calls.append(bound.arguments)
        return result

    monkeypatch.setattr(modelling, "vectors", lambda t: (None, None))
    monkeypatch.setattr(modelling, "halves", lambda df: (None, None))
    monkeypatch.setattr(training, name, record)
    query(SimpleNamespace(spark=SimpleNamespace(createDataFrame=lambda rows, schema: rows)))
    return calls


def test_imbalance_grid_runs_all_families_and_strategies(monkeypatch):
    (call,) = called(monkeypatch, "imbalance_grid", modelling.imbalance_grid)
    assert list(call["families"]) == list(training.FAMILIES) and all(p == {} for p in call["families"].values())
    assert list(call["strategies"]) == IMBALANCE_STRATEGIES


def test_random_search_takes_the_configured_search(monkeypatch):
    found = training.SearchResult("x", {}, 0.5)
    calls = called(monkeypatch, "random_search", modelling.random_search, found)
    assert [c["family"] for c in calls] == list(training.FAMILIES)
    assert all((c["n_iter"], c["folds"], c["grid"]) == (SEARCH["n_iter"], SEARCH["cv_folds"], None) for c in calls)


def test_tables_are_reduced_to_written_customers(spark):
    """The customers of the loans are found once, not anew for each table."""
    from riskframe.operators import joins

    loans = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), (None, "c"), ("4", None)], "loan_id string, customer_id string")
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", 3), (None, 4)], "customer_id string, v int")
    tables = {"loan_applications": loans, "customers": rows, "financial_profiles": rows, "credit_history": rows, "loan_outcomes": loans.select("loan_id")}
    ids = spark.createDataFrame([("1",), ("1",), ("4",), (None,)], "loan_id string")
    out = joins.filter_tables(tables, ids)
    for t in ("customers", "financial_profiles", "credit_history"):
        assert out[t]._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
        assert [tuple(r) for r in out[t].collect()] == [("a", 1), ("a", 1)]
    assert {r[0] for r in out["loan_applications"].collect()} == {"1", "4"} == {r[0] for r in out["loan_outcomes"].collect()}


def test_cycle_reduces_the_tables_once(spark, monkeypatch):
    from datetime import date

    from riskframe.operators import joins
    from riskframe.plans import cycle

    calls = []

    def window_tables(tables, start, end):
        calls.append(start)
        return {"customers": tables["loan_outcomes"]}

    monkeypatch.setattr(joins, "window_tables", window_tables)
    monkeypatch.setattr(cycle, "feature_frame", lambda t, bands: t["customers"])
    monkeypatch.setattr(cycle.drift, "feature_drift", lambda *a: spark.createDataFrame([], cycle.drift.FINDINGS))
    monkeypatch.setattr(cycle.drift, "concept_drift", lambda *a: None)
    outcomes = spark.createDataFrame([], "loan_id string, default_12m int, outcome_observed_date date")
    predictions = spark.createDataFrame([], "loan_id string, default_probability double, credit_score int, risk_category string, recommendation string, latency_ms int, created_at timestamp, model_id string")
    base = cycle.drift.Baseline.__new__(cycle.drift.Baseline)
    object.__setattr__(base, "default_rate", 0.1)
    out = cycle.run_cycle({"loan_outcomes": outcomes}, predictions, "m", None, date(1999, 1, 1), base, None, {}, [], date(2000, 6, 30))
    assert "drift" in out.tables and "quality" in out.tables
    assert len(calls) == 1


def test_encoded_vectors_are_kept_while_a_model_is_fitted(spark, monkeypatch):
    """Fitting reads them several times; they were encoded anew each time."""
    import pytest

    from riskframe.plans import model

    class Fitted(Exception):
        pass

    def fit(train, *args, **kwargs):
        assert train.storageLevel.useMemory and train.columns == ["default_12m", "features"]
        train.unpersist()
        raise Fitted

    monkeypatch.setattr(model.training, "fit", fit)
    rows = spark.createDataFrame([("1", 0, 0.5), ("2", 1, 0.1)], "loan_id string, default_12m int, features double")
    with pytest.raises(Fitted):
        model.train(SimpleNamespace(vectors=lambda part: rows))


def test_prepare_writes_clean_loans_and_splits_large_methods(spark, monkeypatch):
    """The join reads the clean loans twice; they were cleaned anew each time.  Stages
    whose generated method the JVM would not compile ran interpreted."""
    import pytest

    from riskframe.operators.ordered import METHOD_LIMIT, compile_whole
    from riskframe.plans import model

    class Joined(Exception):
        pass

    def join(customers, loans, financial, credit):
        assert all("Join" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (loans, financial, credit))
        assert [r.loan_id for r in loans.orderBy("loan_id").collect()] == ["1", "2"]
        raise Joined

    loans = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", None)], "loan_id string, customer_id string").selectExpr("*", "date'2000-01-01' as application_date")
    known = loans.select("customer_id").distinct()
    done = {t: loans.join(known, "customer_id", "left_semi") for t in ("customers", "loan_applications", "financial_profiles", "credit_history", "loan_outcomes")}
    monkeypatch.setattr(model.joins, "filter_tables", lambda tables, ids: tables)
    monkeypatch.setattr(model.cleaning, "fit", lambda *a: None)
    monkeypatch.setattr(model.cleaning, "apply", lambda *a: SimpleNamespace(tables=done))
    monkeypatch.setattr(model.joins, "point_in_time_join", join)
    old = spark.conf.get(METHOD_LIMIT)
    try:
        spark.conf.unset(METHOD_LIMIT)
        with pytest.raises(Joined):
            model.prepare({"loan_applications": loans}, {}, [])
        assert spark.conf.get(METHOD_LIMIT) == "8000"
        spark.conf.set(METHOD_LIMIT, "100")
        compile_whole(spark)
        assert spark.conf.get(METHOD_LIMIT) == "100"
    finally:
        spark.conf.set(METHOD_LIMIT, old)


def test_prepare_by_slices_gives_the_same_and_leaves_little(spark, monkeypatch, tmp_path):
    """All steps' tables and shuffle files stayed on disk until the session ended."""
    import os

    from registered.inputs import Inputs
    from registered.validation import AS_OF
    from riskframe.config import RULES
    from riskframe.operators import ordered, rules
    from riskframe.plans import model

    monkeypatch.setattr(ordered, "shared_dir", lambda spark: str(tmp_path))
    t = Inputs(spark, "/root/testdata/sf0.001")
    tables = t.credit(customers="customers_loaded", loan_applications="loans_loaded")
    tables = {n: tables[n] for n in tables}
    old, left = set(os.listdir(tmp_path)), []
    for rows in (ordered.SLICE_ROWS, 2000):
        monkeypatch.setattr(ordered, "SLICE_ROWS", rows)
        left.append(model.prepare(tables, modelling.ORDER, rules.build_rules(RULES, as_of=AS_OF)))
    whole, sliced = left
    assert whole.frame.columns == sliced.frame.columns and whole.frame.count() > 100
    assert whole.frame.exceptAll(sliced.frame).isEmpty() and sliced.frame.exceptAll(whole.frame).isEmpty()
    assert (whole.clean, whole.bands) == (sliced.clean, sliced.bands)
    assert whole.splits.count() == sliced.splits.count() > 0
    # Splits and features of each; the features of two slices are written one by one.
    assert len(set(os.listdir(tmp_path)) - old) == 2 + 1 + 2
    assert spark.conf.get(ordered.SHUFFLE_CLEANUP) == "false"
