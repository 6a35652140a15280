"""From credit tables to a calibrated, explainable model and back to scored rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.config import (
    BACKGROUND_ROWS,
    CATEGORICAL_FEATURES,
    CLEANING,
    COSTS,
    NUMERIC_FEATURES,
    ORDINAL_FEATURES,
    POLICY,
    SEGMENT_COLUMNS,
    TOP_K_FACTORS,
)
from riskframe.operators import cleaning, encode, evaluate, explain, explore, features, joins, score, split, training
from riskframe.operators.ordered import compile_whole, join_slices, materialize, passing, slices_of, write_slices


@dataclass
class Prepared:
    """Per-loan feature frame with ``split`` and ``default_12m``, and its fitted state."""

    frame: DataFrame
    clean: cleaning.CleanState
    bands: dict[str, list[float]]
    encoder: encode.EncoderState
    splits: DataFrame

    def part(self, name: str) -> DataFrame:
        return self.frame.where(F.col("split") == name)

    def vectors(self, name: str) -> DataFrame:
        return encode.with_vector(self.part(name), self.encoder)


def _labelled(merged: DataFrame, labels: DataFrame) -> DataFrame:
    """Loans with their label and split; both tables are those of the same customers."""
    labels = labels.select(F.col("loan_id").alias("_loan"), F.col("customer_id").alias("_customer"), "default_12m", "split")
    same = (F.col("loan_id") == F.col("_loan")) & F.col("customer_id").eqNullSafe(F.col("_customer"))
    return merged.join(labels, same).drop("_loan", "_customer")


def add_features(merged: DataFrame) -> DataFrame:
    return features.behavioural_features(features.ratio_features(merged))


def prepare(tables: dict[str, DataFrame], order_by: dict[str, Sequence[str]], rules, config: dict = CLEANING) -> Prepared:
    """Split by time, fit everything on the training loans only, clean and join all
    loans once.  What several later steps read is written out: the splits, the clean
    loans and snapshot tables and the feature frame; the rest stays lazy.  Only splits
    and features outlive this; customers are joined slice by slice."""
    spark = tables["loan_applications"].sparkSession
    compile_whole(spark)
    with passing(spark) as keep:
        loans = tables["loan_applications"].groupBy("loan_id").agg(F.min("application_date").alias("application_date"))
        splits = keep(split.temporal_split(loans))
    with passing(spark):
        train_ids = splits.where(F.col("split") == "train").select("loan_id")
        clean = cleaning.fit(joins.filter_tables(tables, train_ids), config, order_by)
    with passing(spark) as keep:
        done = cleaning.apply(tables, clean, config, order_by, rules).tables
        # The join reads loans and snapshots twice, for their times and for their values.
        n = slices_of(max(tables[t].count() for t in ("loan_applications", "financial_profiles", "credit_history") if t in tables))
        parts = [write_slices(done[t], "customer_id", n) for t in ("loan_applications", "financial_profiles", "credit_history")]
        merged = [joins.point_in_time_join(done["customers"], *part) for part in zip(*parts)]
        labels = joins.align_target(done["loan_applications"].select("loan_id", "customer_id").distinct(), done["loan_outcomes"])
        labels = write_slices(labels.join(splits.select("loan_id", "split"), "loan_id"), "customer_id", n)
        featured = join_slices([add_features(_labelled(m, y)) for m, y in zip(merged, labels)], keep)
    with passing(spark):
        bands = features.fit_bands(featured.where(F.col("split") == "train"))
        frame = features.add_bands(featured, bands)
        encoder = encode.fit(frame.where(F.col("split") == "train"), NUMERIC_FEATURES, CATEGORICAL_FEATURES, ORDINAL_FEATURES)
    features.assert_no_leakage(encoder.names())
    return Prepared(frame, clean, bands, encoder, splits)


@dataclass
class CreditModel:
    model: object
    family: str
    params: dict
    linear: explain.LinearState | None
    bands: dict[str, list[float]]
    encoder: encode.EncoderState
    calibration: training.Calibration
    threshold: float
    benchmarks: dict[str, dict]
    background: DataFrame

    def probabilities(self, frame: DataFrame) -> DataFrame:
        """Frame rows with the calibrated default probability ``p``."""
        scored = training.predict(self.model, encode.with_vector(frame, self.encoder)).drop("features")
        return self.calibration.apply(scored)


def train(prepared: Prepared, family: str = "logistic_regression", params: dict | None = None, seed: int = 42) -> CreditModel:
    """Fit with balanced class weights, calibrate and choose the threshold on the
    validation loans, and keep what explanations need."""
    params = params or {}
    # Fitting reads the vectors several times; encoding them costs more than a pass.
    train_rows = prepared.vectors("train").select("default_12m", "features").persist()
    weights = training.class_weights(train_rows, "default_12m")
    model = training.fit(train_rows, family, params, "default_12m", weights, seed=seed)
    train_rows.unpersist()
    held = materialize(training.predict(model, prepared.vectors("val")).select("loan_id", "default_12m", "p"))
    calibration = training.calibrate(held, "default_12m")
    chosen = evaluate.min_cost_threshold(calibration.apply(held), "default_12m", "p", COSTS).first()["threshold"]
    part = prepared.part("train")
    background = split.stratified_sample(part, "default_12m", ["loan_id"], BACKGROUND_ROWS, seed)
    linear = None
    if family == "logistic_regression":
        means = explain.background_means(background, prepared.encoder)
        linear = explain.LinearState(prepared.encoder.names(), [float(c) for c in model.coefficients], float(model.intercept), means)
    # The encoder was fitted on the same rows and already holds their medians.
    medians = {c: {"median": m} for c, (m, _, _) in prepared.encoder.numeric.items()}
    bench = {**medians, **explore.benchmarks(part, [], CATEGORICAL_FEATURES + ORDINAL_FEATURES)}
    return CreditModel(model, family, params, linear, prepared.bands, prepared.encoder, calibration, chosen, bench, background)


def test_report(prepared: Prepared, credit: CreditModel) -> dict[str, DataFrame]:
    """Metrics, segment metrics, lift, curves, confusion and importance on the test loans."""
    scored = materialize(credit.probabilities(prepared.part("test")).select("loan_id", "default_12m", "p", *SEGMENT_COLUMNS))
    curve = evaluate.score_curve(scored, "default_12m", "p")
    spark = scored.sparkSession
    weights = credit.linear.coefficients if credit.linear else list(credit.model.featureImportances.toArray())
    return {
        "metrics": evaluate.suite_of_curve(curve, credit.threshold),
        "segments": evaluate.segment_metrics(scored, "default_12m", "p", SEGMENT_COLUMNS, credit.threshold),
        "lift": evaluate.lift_gains(scored, "default_12m", "p", ["loan_id"]),
        "roc": evaluate.roc_points(curve),
        "pr": evaluate.pr_points(curve),
        "confusion": evaluate.confusion(scored, "default_12m", "p", credit.threshold),
        "calibration": evaluate.calibration_curve(scored, "default_12m", "p"),
        "importance": explain.importance(credit.encoder.names(), weights, spark),
    }


def score_rows(frame: DataFrame, credit: CreditModel, policy: dict = POLICY, k: int = TOP_K_FACTORS, missing: str = "mark") -> DataFrame:
    """Every feature row with probability, score, band, decision, rules and reasons.
    Rows without a required feature keep probability and score, have no decision, and
    say so in ``status``; ``missing="raise"`` makes them fail the job instead.
    Reasons need a linear model; for others their columns are null."""
    out = credit.probabilities(frame)
    out = out.withColumn("credit_score", score.probability_to_score("p"))
    out = out.withColumn("risk_category", score.categorize("credit_score"))
    out = score.recommend(out, "p", "credit_score", credit.threshold, policy, missing)
    if missing == "raise":
        out = out.withColumn("status", F.lit("scored"))
    if credit.linear is None:
        return out.withColumns({c: F.lit(None).cast(t) for c, t in explain.COLUMNS.items()})
    return explain.explain(out, credit.linear, credit.encoder, credit.benchmarks, k)
