"""Datasets on shared storage: one folder per version, one parquet table per name."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ["customers", "loan_applications", "financial_profiles", "credit_history", "loan_outcomes"]


def read_tables(spark: SparkSession, root: str, version: str, names: Sequence[str] = TABLES, schemas: dict[str, T.StructType] | None = None) -> dict[str, DataFrame]:
    """The tables of a dataset version; NaN in numbers is read as null."""
    out = {}
    for n in names:
        reader = spark.read.schema(schemas[n]) if schemas and n in schemas else spark.read
        out[n] = nan_to_null(reader.parquet(f"{root}/{version}/{n}"))
    return out


def nan_to_null(df: DataFrame) -> DataFrame:
    wide = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in wide}) if wide else df


def config_hash(config: dict) -> str:
    """First 8 hex digits of the SHA-256 of the config with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:8]


def dataset_version(config: dict, at: datetime | None = None) -> str:
    at = at or datetime.now(timezone.utc)
    return f"ds_{at:%Y%m%d}_{config_hash(config)}"


def write_dataset(tables: dict[str, DataFrame], root: str, version: str, metadata: dict, manifest: dict | None = None) -> None:
    """Tables, then metadata with row counts and the manifest as JSON."""
    spark = next(iter(tables.values())).sparkSession
    counts = {}
    for n, df in tables.items():
        path = f"{root}/{version}/{n}"
        df.write.mode("overwrite").parquet(path)
        counts[n] = spark.read.parquet(path).count()
    write_json(spark, {**metadata, "dataset_version": version, "row_counts": counts}, f"{root}/{version}/metadata")
    write_json(spark, manifest or {}, f"{root}/{version}/injection_manifest")


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small JSON document through Spark's file system layer."""
    spark.createDataFrame([(json.dumps(value, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_metadata(spark: SparkSession, root: str, version: str) -> dict:
    return read_json(spark, f"{root}/{version}/metadata")


def read_manifest(spark: SparkSession, root: str, version: str) -> dict:
    return read_json(spark, f"{root}/{version}/injection_manifest")


def fetch(df: DataFrame, filters: dict | None = None) -> DataFrame:
    """Rows where every column equals its value (a pushed-down scan filter)."""
    for c, v in (filters or {}).items():
        df = df.where(F.col(c) == F.lit(v))
    return df


def get_by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).limit(1)


def insert(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def reload(df: DataFrame, path: str) -> None:
    """Truncate and load; repeating it changes nothing."""
    df.write.mode("overwrite").parquet(path)


def upsert(current: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Current rows with those of ``changes`` added or replaced by key.  Keys of
    ``changes`` are unique; columns absent there become null."""
    kept = current.join(changes.select(*key), list(key), "left_anti")
    return kept.unionByName(changes, allowMissingColumns=True).select(*current.columns)


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of an upserted table; a plain parquet folder is
    the version before the first upsert."""
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/{versions[-1]}" if versions else path)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of the versions written so far, oldest first (one row each)."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema("nth long, folder string").parquet(f"{path}/versions").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [r.folder for r in sorted(rows, key=lambda r: r.nth)]


def upsert_table(spark: SparkSession, path: str, changes: DataFrame, key: Sequence[str]) -> None:
    """Upsert into a table: the merged rows are a new version beside the old one, and
    one small file then names it.  A failure at any point leaves the old version
    current, and readers of it undisturbed.  One writer at a time."""
    merged, nth = upsert(read_current(spark, path), changes, key), len(_versions(spark, path))
    folder = f"data-{nth:06d}-{uuid.uuid4().hex}"
    merged.write.parquet(f"{path}/{folder}")
    spark.createDataFrame([(nth, folder)], "nth long, folder string").coalesce(1).write.mode("append").parquet(f"{path}/versions")


def merge_metrics(registry: DataFrame, model_id: str, patch: dict[str, float]) -> DataFrame:
    """Shallow merge of ``patch`` into the metrics map of one model."""
    new = F.create_map(*[x for k, v in patch.items() for x in (F.lit(k), F.lit(float(v)))])
    old = F.map_filter("metrics", lambda k, _: ~k.isin(list(patch)))
    return registry.withColumn("metrics", F.when(F.col("model_id") == model_id, F.map_concat(old, new)).otherwise(F.col("metrics")))


def write_features(df: DataFrame, root: str, feature_names: Sequence[str], label: str, split: str = "split") -> dict:
    """X and y per split (partition folders), after a check that all features are finite."""
    from riskframe.operators.encode import check_finite

    spark = df.sparkSession
    check_finite(df, feature_names)
    df.select(split, *feature_names).write.mode("overwrite").partitionBy(split).parquet(f"{root}/X")
    df.select(split, label).write.mode("overwrite").partitionBy(split).parquet(f"{root}/y")
    shapes = {r[0]: [r[1], len(feature_names)] for r in df.groupBy(split).count().collect()}
    meta = {"n_features": len(feature_names), "feature_names": list(feature_names), "shapes": shapes}
    write_json(spark, meta, f"{root}/features_metadata")
    return meta


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_issues(violations: DataFrame, path: str, detected_at: Column | None = None) -> None:
    """Violations appended to the issue log."""
    shaped = violations.withColumnRenamed("table", "table_name")
    shaped.withColumn("detected_at", detected_at if detected_at is not None else F.current_timestamp()).write.mode("append").parquet(path)


def save_state(spark: SparkSession, state, path: str) -> None:
    """Fitted state (anything with ``to_json``) as JSON."""
    write_json(spark, json.loads(state.to_json()), path)


def load_state(spark: SparkSession, cls, path: str):
    return cls.from_json(json.dumps(read_json(spark, path)))


def _with_table(spark: SparkSession, state, member: str, path: str):
    """The state with the table that ``member`` points to copied to ``path``."""
    if not getattr(state, member):
        return state
    spark.read.parquet(getattr(state, member)).write.mode("overwrite").parquet(path)
    return replace(state, **{member: path})


def save_encoder(spark: SparkSession, encoder, path: str) -> None:
    """A fitted encoder with its table of infrequent levels; ``load_state`` reads it."""
    save_state(spark, _with_table(spark, encoder, "levels", f"{path}-levels"), path)


def save_baseline(spark: SparkSession, baseline, sample: DataFrame, root: str) -> None:
    baseline = _with_table(spark, baseline, "rare", f"{root}/{baseline.model_id}/shares")
    save_state(spark, baseline, f"{root}/{baseline.model_id}/profile")
    sample.write.mode("overwrite").parquet(f"{root}/{baseline.model_id}/sample")


def load_baseline(spark: SparkSession, model_id: str, root: str):
    """(profile, sample); a model without a baseline is an error."""
    from pyspark.errors import AnalysisException

    from riskframe.operators.drift import Baseline

    try:
        return load_state(spark, Baseline, f"{root}/{model_id}/profile"), spark.read.parquet(f"{root}/{model_id}/sample")
    except AnalysisException as e:
        raise FileNotFoundError(f"no baseline for model {model_id}") from e


def save_explainer(spark: SparkSession, credit, model_id: str, root: str) -> None:
    """Background rows, portfolio benchmarks and linear state of a trained model."""
    credit.background.write.mode("overwrite").parquet(f"{root}/{model_id}/background")
    write_json(spark, credit.benchmarks, f"{root}/{model_id}/benchmarks")
    if credit.linear is not None:
        save_state(spark, credit.linear, f"{root}/{model_id}/linear")


def load_explainer(spark: SparkSession, model_id: str, root: str):
    """(background rows, benchmarks, linear state)."""
    from riskframe.operators.explain import LinearState

    return (
        spark.read.parquet(f"{root}/{model_id}/background"), read_json(spark, f"{root}/{model_id}/benchmarks"),
        load_state(spark, LinearState, f"{root}/{model_id}/linear"),
    )


def save_report(report: dict[str, DataFrame], model_id: str, root: str) -> None:
    """Curves and tables of a model's test report, one parquet folder each."""
    for name, df in report.items():
        df.write.mode("overwrite").parquet(f"{root}/{model_id}/report/{name}")


def load_report(spark: SparkSession, model_id: str, root: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{model_id}/report/{n}") for n in names}
