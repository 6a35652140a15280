"""Registered models with their metrics and report tables, each change one commit.

The registry is a key-range table; tables of a report are written to a folder of
their own first, and the model's row then names them together with its metrics.  A
change that dies before leaves the row, and what it names, as they were.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators import registry
from riskframe.sources import ranged
from riskframe.sources.tables import merge_metrics

NO_ARTEFACTS = "cast(map() as map<string,string>)"


def models(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the registry, with ``artefacts``: table name to folder."""
    if ranged.state(spark, f"{root}/registry") is None:
        return registry.empty(spark).withColumn("artefacts", F.expr(NO_ARTEFACTS))
    return ranged.read(spark, f"{root}/registry")


def _written(report: dict[str, DataFrame], root: str) -> dict[str, str]:
    folder = f"{root}/artefacts/{uuid.uuid4().hex}"
    for name, df in report.items():
        df.write.parquet(f"{folder}/{name}")
    return {name: f"{folder}/{name}" for name in report}


def _named(found: dict[str, str]):
    return F.create_map(*[F.lit(x) for item in found.items() for x in item]) if found else F.expr(NO_ARTEFACTS)


def register(spark: SparkSession, root: str, row: dict, report: dict[str, DataFrame] | None = None, activate: bool = True) -> ranged.State:
    """Add a model under the next version, with the tables of its report.  Activating
    deactivates the others in the same commit.  A known model_id is an error."""
    now = models(spark, root)
    if not now.where(F.col("model_id") == row["model_id"]).isEmpty():
        raise ValueError(f"model {row['model_id']} is registered already")
    changed = now.where("is_active").withColumn("is_active", F.lit(False)) if activate else now.limit(0)
    new = registry.register(now.drop("artefacts"), row, activate).where(F.col("model_id") == row["model_id"])
    new = new.withColumn("artefacts", _named(_written(report or {}, root)))
    return ranged.upsert(spark, f"{root}/registry", changed.unionByName(new), ["model_id"])


def attach(spark: SparkSession, root: str, model_id: str, metrics: dict[str, float], report: dict[str, DataFrame]) -> ranged.State:
    """Merge metrics and report tables into a model's row; those of the same name are replaced."""
    row = models(spark, root).where(F.col("model_id") == model_id)
    if row.isEmpty():
        raise KeyError(f"no registered model {model_id}")
    if metrics:
        row = merge_metrics(row, model_id, metrics)
    kept = F.map_filter("artefacts", lambda name, _: ~name.isin(list(report)))
    row = row.withColumn("artefacts", F.map_concat(kept, _named(_written(report, root))))
    return ranged.upsert(spark, f"{root}/registry", row, ["model_id"])


def report(spark: SparkSession, root: str, model_id: str) -> dict[str, DataFrame]:
    """The report tables that a model's row names."""
    row = models(spark, root).where(F.col("model_id") == model_id).first()
    if row is None:
        raise KeyError(f"no registered model {model_id}")
    return {name: spark.read.parquet(path) for name, path in sorted(row.artefacts.items())}
