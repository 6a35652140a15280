from datetime import date

import pytest

from registered import all_queries
from registered import inputs as source
from registered.inputs import DAILY, Inputs
from riskframe.config import CLEANING, RULES
from riskframe.operators import cleaning, engine, ordered, rules

ORDER = {"customers": ["row_no"], "loan_applications": ["row_no"]}


@pytest.fixture
def written(monkeypatch):
    """The columns of each table that is written, with no table written before."""
    found, write = [], source.materialize

    def record(df):
        found.append(df.columns)
        return write(df)

    monkeypatch.setattr(source, "materialize", record)
    monkeypatch.setattr(source, "_STORED", {})
    return found


@pytest.fixture
def tables(spark, written):
    return Inputs(spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", DAILY)
def test_daily_tables_are_those_of_their_sql(tables, name):
    stored, plain = tables.stored(name), tables[name]
    assert stored.dtypes == plain.dtypes and plain.count() > 0
    assert stored.exceptAll(plain).isEmpty() and plain.exceptAll(stored).isEmpty()


def test_daily_tables_are_joined_and_grouped_once(tables, written):
    for name in DAILY:
        tables.credit()[name].count()
    assert len(written) == 1


def test_a_rule_writes_its_own_tables_only(tables, written):
    engine.violations(tables.credit(), [rules.missing_value("customers", "marital_status", 0.15)]).count()
    assert [c[0] for c in written] == ["customer_id"]
    engine.violations(tables.credit(), [rules.orphan_record("loan_applications", "customers", "customer_id")]).count()
    assert [c[0] for c in written] == ["customer_id", "loan_id"]


def test_fit_asks_for_fitted_tables_only(tables, written):
    cleaning.fit(tables.credit(customers="customers_loaded", loan_applications="loans_loaded"), CLEANING, ORDER)
    assert not any("default_12m" in c for c in written)


def test_flags_of_a_table_ask_for_the_tables_of_its_rules_only(tables):
    asked = []

    class Recorded(dict):
        def __getitem__(self, name):
            asked.append(name)
            return tables[name]

        def get(self, name, default=None):
            return self[name]

    names = ("customers", "loan_applications", "financial_profiles", "credit_history", "loan_outcomes")
    run = engine.run(Recorded.fromkeys(names), rules.build_rules(RULES, as_of=date(2001, 1, 1)))
    assert run.flagged("loan_applications").where("is_quarantined").count() > 0
    assert set(asked) == {"customers", "loan_applications"}


@pytest.mark.parametrize("name", ["rule_expense_consistency", "rule_orphan_record", "engine_quarantine_flags"])
def test_queries_of_few_rules_write_no_table(spark, written, name):
    assert all_queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert not written


@pytest.mark.parametrize("name", ["request_bounds", "scoring_input_bounds", "request_cross_fields", "intake_commit"])
def test_requests_by_slices_count_the_same(spark, tables, monkeypatch, name):
    """All rows were joined in one step, whose shuffle files lay on disk at once."""
    whole = sorted(map(tuple, all_queries()[name](spark, tables.folder).collect()))
    monkeypatch.setattr(ordered, "SLICE_ROWS", 2000)
    monkeypatch.setattr(source, "_STORED", {})
    assert tables.slices() == 3 and len(list(tables.credit_slices())) == 3
    assert sorted(map(tuple, all_queries()[name](spark, tables.folder).collect())) == whole


def test_daily_table_by_slices(spark, tables, monkeypatch):
    whole = {n: tables[n] for n in DAILY}
    monkeypatch.setattr(ordered, "SLICE_ROWS", 2000)
    for name, plain in whole.items():
        stored = tables.stored(name)
        assert stored.dtypes == plain.dtypes and stored.count() == plain.count() and stored.exceptAll(plain).isEmpty()
    by_slice = [set(r[0] for r in part["financial_profiles"].select("customer_id").distinct().collect()) for part in tables.credit_slices()]
    assert all(by_slice) and sum(map(len, by_slice)) == len(set().union(*by_slice))
