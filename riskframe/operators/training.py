"""Fitting, searching, balancing and calibrating default models with Spark ML."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.config import BOOSTED_GRID, FOREST_GRID, IMBALANCE_STRATEGIES, LOGISTIC_GRID, SEARCH
from riskframe.operators import evaluate
from riskframe.operators.neighbours import drop_tomek_links, smote
from riskframe.operators.split import class_sizes, stratified_folds, undersample

FAMILIES = ("logistic_regression", "random_forest", "boosted_trees")
GRIDS = {"logistic_regression": LOGISTIC_GRID, "random_forest": FOREST_GRID, "boosted_trees": BOOSTED_GRID}


def class_weights(df: DataFrame, label: str) -> dict[int, float]:
    """n / (2 * n_class)."""
    sizes = class_sizes(df, label)
    total = sum(sizes.values())
    return {c: total / (len(sizes) * n) for c, n in sizes.items()}


def with_weights(df: DataFrame, label: str, weights: dict | None, output: str = "_weight") -> DataFrame:
    expr = F.lit(1.0)
    for c, w in (weights or {}).items():
        expr = F.when(F.col(label) == F.lit(c), F.lit(w)).otherwise(expr)
    return df.withColumn(output, expr)


def logistic(total_weight: float, C: float = 1.0, penalty: str = "l2", l1_ratio: float = 0.0, max_iter: int = 200, tol: float = 1e-6, label: str = "label", features: str = "features") -> LogisticRegression:  # noqa: N803
    """Penalty of 1/C on the summed loss, as mean loss plus regParam."""
    alpha = l1_ratio if penalty == "elasticnet" else 0.0
    return LogisticRegression(
        featuresCol=features, labelCol=label, weightCol="_weight", regParam=1.0 / (C * total_weight), elasticNetParam=alpha,
        standardization=False, maxIter=max_iter, tol=tol)


def forest(n_estimators: int = 100, max_depth: int | None = None, min_samples_leaf: int = 1, max_features="sqrt", seed: int = 42, label: str = "label", features: str = "features") -> RandomForestClassifier:
    """An unlimited depth is Spark's maximum of 30."""
    return RandomForestClassifier(
        featuresCol=features, labelCol=label, weightCol="_weight", numTrees=n_estimators, maxDepth=30 if max_depth is None else max_depth,
        minInstancesPerNode=min_samples_leaf, featureSubsetStrategy=str(max_features), seed=seed)


def boosted(n_estimators: int = 100, max_depth: int = 4, learning_rate: float = 0.1, subsample: float = 1.0, seed: int = 42, validation: str | None = None, label: str = "label", features: str = "features") -> GBTClassifier:
    """Trees added until the validation rows stop improving, if a marker column names them."""
    gbt = GBTClassifier(
        featuresCol=features, labelCol=label, weightCol="_weight", maxIter=n_estimators, maxDepth=max_depth, stepSize=learning_rate,
        subsamplingRate=subsample, seed=seed)
    return gbt.setValidationIndicatorCol(validation) if validation else gbt


def estimator(family: str, params: dict, total_weight: float, label: str, features: str = "features", seed: int = 42, validation: str | None = None):
    if family == "logistic_regression":
        return logistic(total_weight, label=label, features=features, **params)
    if family == "random_forest":
        return forest(label=label, features=features, seed=seed, **params)
    if family == "boosted_trees":
        return boosted(label=label, features=features, seed=seed, validation=validation, **params)
    raise ValueError(f"unknown model family {family}")


def fit(train: DataFrame, family: str, params: dict, label: str, weights: dict | None = None, features: str = "features", seed: int = 42, validation: DataFrame | None = None):
    """A fitted model; validation rows only stop the boosting early."""
    data = with_weights(train, label, weights)
    marker = None
    if validation is not None and family == "boosted_trees":
        marker = "_validation"
        held = with_weights(validation, label, None).withColumn(marker, F.lit(True))
        data = data.withColumn(marker, F.lit(False)).unionByName(held, allowMissingColumns=True)
        total = 1.0
    else:
        total = data.agg(F.sum("_weight")).first()[0]
    return estimator(family, params, total, label, features, seed, marker).fit(data)


def probability(output: str = "probability") -> Column:
    return vector_to_array(F.col(output))[1]


def predict(model, df: DataFrame, output: str = "p") -> DataFrame:
    """The frame with the positive-class probability."""
    scored = model.transform(df)
    return scored.withColumn(output, probability()).drop("rawPrediction", "probability", "prediction")


class AveragePrecision(Evaluator):
    """Average precision of the positive-class probability, for model search."""

    def __init__(self, label: str) -> None:
        super().__init__()
        self.label = label

    def _evaluate(self, dataset: DataFrame) -> float:
        scored = dataset.select(self.label, probability().alias("p"))
        return evaluate.metric_suite(scored, self.label, "p", calibration=False).first()["pr_auc"] or 0.0

    def isLargerBetter(self) -> bool:  # noqa: N802
        return True


@dataclass(frozen=True)
class SearchResult:
    family: str
    params: dict
    cv_score: float


def draw_params(grid: dict[str, list], n: int, seed: int) -> list[dict]:
    """n different draws from the grid (all of it, if it is smaller)."""
    names = sorted(grid)
    combos = 1
    for k in names:
        combos *= len(grid[k])
    picks = random.Random(seed).sample(range(combos), min(n, combos))
    out = []
    for pick in picks:
        params = {}
        for k in names:
            pick, i = divmod(pick, len(grid[k]))
            params[k] = grid[k][i]
        out.append(params)
    return out


def random_search(train: DataFrame, family: str, label: str, key: Sequence[str], weights: dict | None = None, n_iter: int = SEARCH["n_iter"], folds: int = SEARCH["cv_folds"], seed: int = 42, parallelism: int = 4, grid: dict | None = None, features: str = "features") -> SearchResult:
    """Best of n random settings by cross-validated average precision."""
    fold = stratified_folds(train, label, key, folds, seed).select(*key, "fold")
    data = with_weights(train.join(fold, list(key)), label, weights)
    total = data.agg(F.sum("_weight")).first()[0] * (folds - 1) / folds
    draws = draw_params(grid or GRIDS[family], n_iter, seed)
    base = estimator(family, {}, total, label, features, seed)
    maps = []
    for d in draws:
        tuned = estimator(family, d, total, label, features, seed)
        maps.append({p: tuned.getOrDefault(p) for p in tuned.params if tuned.isSet(p)})
    data = data.persist()
    cv = CrossValidator(estimator=base, estimatorParamMaps=maps, evaluator=AveragePrecision(label), numFolds=folds, foldCol="fold", parallelism=parallelism, seed=seed)
    scores = cv.fit(data).avgMetrics
    data.unpersist()
    best = max(range(len(draws)), key=lambda i: scores[i])
    return SearchResult(family, draws[best], float(scores[best]))


def cross_validate(train: DataFrame, family: str, params: dict, label: str, key: Sequence[str], weights: dict | None = None, folds: int = 5, seed: int = 42, threshold: float = 0.5, features: str = "features") -> DataFrame:
    """Mean and standard deviation of every metric over stratified folds."""
    fold = stratified_folds(train, label, key, folds, seed).select(*key, "fold")
    data = train.join(fold, list(key)).persist()
    parts = []
    for i in range(folds):
        model = fit(data.where(F.col("fold") != i), family, params, label, weights, features, seed)
        scored = predict(model, data.where(F.col("fold") == i)).select(label, "p")
        parts.append(evaluate.metric_suite(scored, label, "p", threshold).first())
    data.unpersist()
    names = [n for n in parts[0].asDict() if n != "n"]
    rows = train.sparkSession.createDataFrame([[float(r[n]) if r[n] is not None else None for n in names] for r in parts], ", ".join(f"{n} double" for n in names))
    items = [F.struct(F.lit(n).alias("metric"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("std")) for n in names]
    return rows.agg(F.array(*items).alias("a")).select(F.inline("a"))


def resample(train: DataFrame, strategy: str, vector: str, label: str, key: str, seed: int = 42, **limits) -> DataFrame:
    """Training rows after a resampling strategy (key, label, vector)."""
    if strategy in ("none", "class_weight"):
        return train.select(key, label, vector)
    if strategy == "random_undersampling":
        return undersample(train.select(key, label, vector), label, [key], seed)
    if strategy not in ("smote", "smote_tomek"):
        raise ValueError(f"unknown strategy {strategy}")
    from pyspark.ml.functions import array_to_vector

    size = len(train.select(vector).first()[0])
    cols = [f"x{i}" for i in range(size)]
    wide = train.select(key, label, *[vector_to_array(vector)[i].alias(c) for i, c in enumerate(cols)])
    out = smote(wide, cols, label, key, seed=seed, **limits)
    if strategy == "smote_tomek":
        out = drop_tomek_links(out, cols, label, key, **limits)
    return out.select(key, label, array_to_vector(F.array(*cols)).alias(vector))


def imbalance_grid(train: DataFrame, validation: DataFrame, families: dict[str, dict], label: str, key: str, strategies: Sequence[str] = IMBALANCE_STRATEGIES, target_precision: float = 0.5, seed: int = 42, features: str = "features") -> DataFrame:
    """family, strategy and validation metrics; only the training rows are resampled."""
    from riskframe.operators.ordered import materialize

    parts = []
    for s in strategies:
        data = materialize(resample(train, s, features, label, key, seed))
        weights = class_weights(train, label) if s == "class_weight" else None
        for family, params in families.items():
            scored = predict(fit(data, family, params, label, weights, features, seed), validation).select(label, "p")
            curve = evaluate.score_curve(scored, label, "p")
            suite = evaluate.suite_of_curve(curve)
            recall = evaluate.recall_at_precision(curve, target_precision).scalar()
            parts.append(suite.select(F.lit(family).alias("family"), F.lit(s).alias("strategy"), "*", recall.alias("recall_at_precision")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leaderboard(results: Sequence[dict], spark) -> DataFrame:
    """family, cv_score, pr_auc of fitted families, best validation score first."""
    rows = [(r["family"], float(r["cv_score"]), float(r["metrics"]["pr_auc"])) for r in results]
    return spark.createDataFrame(rows, "family string, cv_score double, pr_auc double").orderBy(F.desc("pr_auc"))


# -- calibration -----------------------------------------------------------------------

@dataclass
class Calibration:
    method: str
    brier_before: float
    brier: dict[str, float]
    slope_before: float | None
    slope_after: float | None
    sigmoid: tuple[float, float] | None = None
    isotonic: object = None

    def apply(self, df: DataFrame, p: str = "p", output: str = "p") -> DataFrame:
        return _apply(df, p, output, self.method, self.sigmoid, self.isotonic)


def _margin(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return F.ln(q / (1 - q))


def _apply(df, p, output, method, sigmoid, isotonic):
    if method == "sigmoid":
        a, b = sigmoid
        return df.withColumn(output, 1.0 / (1.0 + F.exp(-(_margin(F.col(p)) * a + b))))
    out = isotonic.transform(df.withColumn("_score", F.col(p))).drop("_score")
    return out.withColumn(output, F.least(F.greatest(F.col("_calibrated"), F.lit(0.0)), F.lit(1.0))).drop("_calibrated")


def fit_sigmoid(curve: DataFrame) -> tuple[float, float]:
    """Slope and intercept of Platt scaling on the margin, with smoothed targets."""
    total = curve.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    hi, lo = (total.P + 1.0) / (total.P + 2.0), 1.0 / (total.N + 2.0)
    soft = F.col("pos") * hi + F.col("neg") * lo
    points = curve.select(evaluate.ALL, _margin(F.col("score")).alias("x"), soft.alias("pos"), (F.col("pos") + F.col("neg") - soft).alias("neg"))
    return next(iter(evaluate.newton_logit(points, [evaluate.ALL]).values()))


def fit_isotonic(curve: DataFrame):
    """Monotone fit on one weighted point per distinct score."""
    points = curve.select(
        F.col("score").alias("_score"), (F.col("pos") / (F.col("pos") + F.col("neg"))).alias("_rate"),
        (F.col("pos") + F.col("neg")).cast("double").alias("_n"))
    return IsotonicRegression(featuresCol="_score", labelCol="_rate", weightCol="_n", predictionCol="_calibrated").fit(points)


def calibrate(validation: DataFrame, label: str, p: str = "p", methods: Sequence[str] = ("isotonic", "sigmoid")) -> Calibration:
    """The method with the lower Brier score on the same validation rows; the model itself stays as it is."""
    curve = evaluate.score_curve(validation, label, p)
    sigmoid = fit_sigmoid(curve) if "sigmoid" in methods else None
    isotonic = fit_isotonic(curve) if "isotonic" in methods else None
    pos, neg = F.col("pos"), F.col("neg")

    def brier(df, c):
        s = F.col(c)
        return df.agg(F.sum(pos * (1 - s) * (1 - s) + neg * s * s) / F.sum(pos + neg)).first()[0]

    before = brier(curve, "score")
    scores = {m: brier(_apply(curve, "score", "q", m, sigmoid, isotonic), "q") for m in methods}
    best = min(methods, key=lambda m: scores[m])
    after = _apply(curve, "score", "q", best, sigmoid, isotonic).groupBy(evaluate.ALL, F.col("q").alias("score")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    slopes = [next(iter(evaluate.calibration_fit(c).values())) for c in (curve, after)]
    return Calibration(best, before, scores, *[s[0] if s else None for s in slopes], sigmoid, isotonic)
