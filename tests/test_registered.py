"""Registered queries: names, SQL and a few plans."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from registered.inputs import RAW
from tools.verify import rows_of

SF = "/root/testdata/sf0.001"


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_checks_load_without_a_session():
    """Rules and queries build no columns before a session exists."""
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 100"
    root = Path(__file__).resolve().parents[1]
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["iv_table", "point_in_time_join", "engine_violations", "metric_suite", "temporal_split", "stream_psi", "recommend"])
def test_sample_of_checks(spark, name):
    con = duckdb.connect()
    for t in RAW:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())


@pytest.mark.parametrize("name", ["point_in_time_join", "ratio_features", "rule_duplicate_key", "segment_table", "categorical_frequency"])
def test_no_single_task_over_rows(spark, name):
    """No window or join in these plans gathers all rows in one partition."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    lines = plan.splitlines()
    for exchange, child in zip(lines, lines[1:]):
        assert "SinglePartition" not in exchange or "partial_" in child


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["fetch_filtered"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan
    plan = entry.queries()["default_rate_by_band"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan


def test_library_works_without_the_training_data_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=False).returncode == 0
