"""Model registry as a small table: versions only grow, one row is active."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "model_id string, model_version string, algorithm string, training_date timestamp, dataset_version string, "
    "feature_list array<string>, hyperparameters map<string,string>, metrics map<string,double>, "
    "artifact_path string, is_active boolean"
)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def _parts(version):
    """Version as comparable numbers; unreadable versions count as 0.0.0."""
    p = F.split(version, r"\.")
    numbers = [F.get(p, F.lit(i)).try_cast("int") for i in range(3)]
    good = (F.size(p) == 3) & numbers[0].isNotNull() & numbers[1].isNotNull() & numbers[2].isNotNull()
    return F.struct(*[F.when(good, n).otherwise(F.lit(0)).alias(k) for k, n in zip(("major", "minor", "patch"), numbers)])


def next_version(registry: DataFrame) -> DataFrame:
    """One row ``next_version``: the minor above the highest version, 1.0.0 if there is none."""
    top = registry.agg(F.max(_parts(F.col("model_version"))).alias("v"))
    bumped = F.concat_ws(".", F.col("v.major").cast("string"), (F.col("v.minor") + 1).cast("string"), F.lit("0"))
    return top.select(F.when(F.col("v").isNull(), "1.0.0").otherwise(bumped).alias("next_version"))


def register(registry: DataFrame, row: dict, activate: bool = True) -> DataFrame:
    """Registry with a new row under the next version; activating deactivates the rest."""
    spark = registry.sparkSession
    version = next_version(registry).first()[0]
    new = spark.createDataFrame([{**row, "model_version": version, "is_active": activate}], SCHEMA)
    old = registry.withColumn("is_active", F.lit(False)) if activate else registry
    return old.select(*new.columns).unionByName(new)


def activate(registry: DataFrame, model_id: str) -> DataFrame:
    """Exactly this model active; also the way back to an earlier version."""
    if registry.where(F.col("model_id") == model_id).isEmpty():
        raise KeyError(f"no registered model {model_id}")
    return registry.withColumn("is_active", F.col("model_id") == model_id)


rollback = activate


def active(registry: DataFrame) -> DataFrame:
    return registry.where("is_active")


def model_card(registry: DataFrame) -> DataFrame:
    """The active model with its numeric metrics."""
    return active(registry).select(
        "model_id", "model_version", "algorithm", "training_date", "dataset_version",
        F.size("feature_list").alias("feature_count"), F.map_filter("metrics", lambda _, v: v.isNotNull() & ~F.isnan(v)).alias("metrics"),
        F.col("metrics")["chosen_threshold"].alias("chosen_threshold"), "is_active",
    )


def versions(registry: DataFrame) -> DataFrame:
    """Every model, newest training date first."""
    return registry.select("model_id", "model_version", "algorithm", "training_date", "is_active", "metrics").orderBy(
        F.desc("training_date"), F.desc("model_id"))
