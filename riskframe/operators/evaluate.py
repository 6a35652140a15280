"""Evaluation of a binary outcome against a score.

Everything comes from one table, the score curve: positives and negatives per
distinct score with running totals from the highest score down.  Counting per
score first keeps tied and crowded scores cheap; the running totals are sliced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.config import COSTS
from riskframe.functions.bins import bin_index
from riskframe.operators.ordered import positions, running_sums
from riskframe.operators.quantiles import quantiles

ALL = "_all"


def score_curve(df: DataFrame, y: str, p: str, segments: Sequence[str] = (), rows_per_task: int | None = None) -> DataFrame:
    """segments..., score, pos, neg, cum_pos, cum_neg, cum_one (rank of the score)."""
    keys = list(segments) or [ALL]
    label = F.col(y).cast("int")
    base = df if segments else df.withColumn(ALL, F.lit(1))
    counts = base.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(
        *keys, F.col(p).cast("double").alias("score")
    ).agg(F.count_if(label == 1).alias("pos"), F.count_if(label != 1).alias("neg"))
    return running_sums(counts.withColumn("one", F.lit(1).cast("long")), [F.desc("score")], ["pos", "neg", "one"], keys, rows_per_task)


def _keys(curve: DataFrame) -> list[str]:
    fixed = {"score", "pos", "neg", "one", "cum_pos", "cum_neg", "cum_one"}
    return [c for c in curve.columns if c not in fixed]


def _with_totals(curve: DataFrame) -> DataFrame:
    keys = _keys(curve)
    totals = curve.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return curve.join(totals, keys)


def _div(a: Column, b: Column, zero: float | None = None) -> Column:
    out = F.when(b != 0, a / b)
    return out if zero is None else out.otherwise(F.lit(zero))


def threshold_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """accuracy, precision, recall, F1 from counts; 0/0 is 0."""
    return {
        "accuracy": _div(tp + tn, tp + fp + fn + tn),
        "precision": _div(tp, tp + fp, 0.0),
        "recall": _div(tp, tp + fn, 0.0),
        "f1": _div(2 * tp, 2 * tp + fp + fn, 0.0),
    }


def confusion(df: DataFrame, y: str, p: str, threshold: float) -> DataFrame:
    """tn, fp, fn, tp; a score at the threshold is predicted positive."""
    label, predicted = F.col(y).cast("int") == 1, F.col(p) >= threshold
    return df.agg(
        F.count_if(~label & ~predicted).alias("tn"), F.count_if(~label & predicted).alias("fp"),
        F.count_if(label & ~predicted).alias("fn"), F.count_if(label & predicted).alias("tp"),
    )


def calibration_fit(curve: DataFrame) -> dict[tuple, tuple[float, float] | None]:
    """Slope and intercept of y ~ logit(score) per segment, unpenalised; None for a
    segment with one class."""
    keys = _keys(curve)
    p = F.least(F.greatest(F.col("score"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return newton_logit(curve.select(*keys, F.ln(p / (1 - p)).alias("x"), "pos", "neg"), keys)


def newton_logit(points: DataFrame, keys: Sequence[str], max_iter: int = 50, tol: float = 1e-10) -> dict[tuple, tuple[float, float] | None]:
    """One-feature logistic fits on (keys..., x, pos, neg) weights.  Each Newton step
    is one aggregate for all keys at once; the driver holds two numbers per key."""
    spark = points.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*keys).schema)
    state, done = {}, {}
    for r in points.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).collect():
        k = tuple(r[c] for c in keys)
        if r.P > 0 and r.N > 0:
            state[k] = (0.0, math.log(r.P / r.N))
        else:
            done[k] = None
    single = len(state) + len(done) == 1
    for _ in range(max_iter):
        if not state:
            break
        if single:
            b, a = next(iter(state.values()))
            with_coef = points.withColumns({"b": F.lit(b), "a": F.lit(a)})
        else:
            coef = spark.createDataFrame([(*k, b, a) for k, (b, a) in state.items()], f"{schema}, b double, a double")
            with_coef = points.join(coef, list(keys))
        mu = 1.0 / (1.0 + F.exp(-(F.col("b") * F.col("x") + F.col("a"))))
        n = F.col("pos") + F.col("neg")
        sums = with_coef.select(
            *keys, "x", (F.col("pos") - n * mu).alias("g"), (n * mu * (1 - mu)).alias("w"),
        ).groupBy(*keys).agg(
            F.sum("g").alias("g0"), F.sum(F.col("g") * F.col("x")).alias("g1"), F.sum("w").alias("h00"),
            F.sum(F.col("w") * F.col("x")).alias("h01"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("h11"),
        )
        for r in sums.collect():
            k = tuple(r[c] for c in keys)
            b, a = state[k]
            det = r.h00 * r.h11 - r.h01 * r.h01
            if det <= 1e-12 * max(r.h00 * r.h11, 1e-300):
                # All scores equal: only the level can be fitted.
                done[k] = state.pop(k)
                continue
            db = (r.h00 * r.g1 - r.h01 * r.g0) / det
            da = (r.h11 * r.g0 - r.h01 * r.g1) / det
            state[k] = (b + db, a + da)
            if abs(db) + abs(da) < tol * (1.0 + abs(b) + abs(a)):
                done[k] = state.pop(k)
    return {**done, **state}


def metric_suite(
    df: DataFrame, y: str, p: str, threshold: float = 0.5, segments: Sequence[str] = (),
    calibration: bool = True, curve: DataFrame | None = None,
) -> DataFrame:
    """All ranking, calibration and threshold metrics, one row (per segment)."""
    curve = curve if curve is not None else score_curve(df, y, p, segments)
    return suite_of_curve(curve, threshold, calibration)


def suite_of_curve(curve: DataFrame, threshold: float = 0.5, calibration: bool = True) -> DataFrame:
    keys = _keys(curve)
    c = _with_totals(curve)
    pos, neg, s = F.col("pos"), F.col("neg"), F.col("score")
    cp, cn = F.col("cum_pos"), F.col("cum_neg")
    eps = 2.220446049250313e-16  # float64 machine epsilon
    q = F.least(F.greatest(s, F.lit(eps)), F.lit(1.0 - eps))
    above = s >= threshold
    g = c.groupBy(*keys).agg(
        F.first("P").alias("P"), F.first("N").alias("N"),
        F.sum(pos.cast("double") * (F.col("N") - cn + neg / 2.0)).alias("pairs"),
        F.sum(pos.cast("double") * cp / (cp + cn)).alias("ap"),
        F.max(F.abs(_div(cp.cast("double"), F.col("P")) - _div(cn.cast("double"), F.col("N")))).alias("ks"),
        F.sum(pos * (1 - s) * (1 - s) + neg * s * s).alias("sq"),
        F.sum(pos * F.ln(q) + neg * F.ln(1 - q)).alias("ll"),
        F.coalesce(F.sum(F.when(above, pos)), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(above, neg)), F.lit(0)).alias("fp"),
    )
    P, N, n = F.col("P"), F.col("N"), F.col("P") + F.col("N")
    both = (P > 0) & (N > 0)
    t = threshold_metrics(F.col("tp"), F.col("fp"), P - F.col("tp"), N - F.col("fp"))
    auc = F.when(both, F.col("pairs") / (P.cast("double") * N))
    ap = F.when(both, F.col("ap") / P)
    out = g.select(
        *keys, n.alias("n"), *[v.alias(k) for k, v in t.items()], auc.alias("roc_auc"), ap.alias("pr_auc"),
        ap.alias("average_precision"), F.when(both, F.col("ks")).alias("ks_statistic"),
        (2 * auc - 1).alias("gini"), (F.col("sq") / n).alias("brier_score"),
        F.when(both, -F.col("ll") / n).alias("log_loss"),
    )
    if calibration:
        fits = [(*k, *(v or (None, None))) for k, v in calibration_fit(curve).items()]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in curve.select(*keys).schema)
        fitted = curve.sparkSession.createDataFrame(
            fits, f"{schema}, calibration_slope double, calibration_intercept double")
        out = out.join(fitted, keys, "left")
    return out.drop(ALL)


def segment_metrics(df: DataFrame, y: str, p: str, segment_columns: Sequence[str], threshold: float = 0.5, calibration: bool = True) -> DataFrame:
    """The metric suite per value of each segment column, all columns in one job."""
    items = [F.struct(F.lit(c).alias("segment"), F.col(c).cast("string").alias("value")) for c in segment_columns]
    long = df.select(y, p, F.explode(F.array(*items)).alias("s")).select(y, p, "s.*").where("value is not null")
    return metric_suite(long, y, p, threshold, ["segment", "value"], calibration).orderBy("segment", "value")


def gini(roc_auc: float) -> float:
    return 2.0 * roc_auc - 1.0


def recall_at_precision(curve: DataFrame, target: float) -> DataFrame:
    """Best recall among scores whose precision reaches the target, else 0."""
    c = _with_totals(curve)
    precise = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")) >= target
    recall = _div(F.col("cum_pos"), F.col("P"))
    return c.groupBy(*_keys(curve)).agg(
        F.coalesce(F.max(F.when(precise, recall)), F.lit(0.0)).alias("recall_at_precision")).drop(ALL)


def lift_gains(df: DataFrame, y: str, p: str, tie_break: Sequence[str], n_bins: int = 10, rows_per_task: int | None = None) -> DataFrame:
    """Lift and gains by quantile bins of the position after sorting by falling
    score; ``tie_break`` makes the order unique.  Not ntile: bin edges are the
    linear quantiles of the positions."""
    ranked = positions(
        df.select(F.col(y).cast("int").alias("y"), F.col(p).alias("p"), *tie_break),
        [F.desc("p"), *tie_break], rows_per_task=rows_per_task,
    )
    n = ranked.count()
    edges = [(n - 1) * (i * (1.0 / n_bins)) for i in range(1, n_bins)]
    place = (F.col("position") - 1).cast("double")
    bins = ranked.groupBy((bin_index(place, edges, "right") + 1).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("y").cast("long").alias("n_positive"))
    # n_bins rows from here on.
    every = Window.partitionBy()
    up_to = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total_pos, total = F.sum("n_positive").over(every), F.sum("n").over(every)
    t = bins.select(
        "*", total_pos.alias("tp"), total.alias("t"), F.row_number().over(Window.orderBy("bin")).alias("decile"),
        F.sum("n").over(up_to).alias("cum_n"), F.sum("n_positive").over(up_to).alias("cum_positive"),
    )
    base = F.col("tp") / F.col("t")
    rate = F.col("n_positive") / F.col("n")
    return t.select(
        "decile", "n", "n_positive", rate.alias("default_rate"), "cum_n", "cum_positive",
        _div(F.col("cum_positive"), F.col("tp")).alias("cum_gain"), _div(rate, base).alias("lift"),
        _div(F.col("cum_positive") / F.col("cum_n"), base).alias("cum_lift"),
    ).orderBy("decile")


def roc_points(curve: DataFrame, drop_collinear: bool = True) -> DataFrame:
    """(segments...,) fpr, tpr, threshold from the origin on; points inside a straight
    run are dropped, the first and the last score always stay."""
    c, keys = _with_totals(curve), _keys(curve)
    if drop_collinear:
        # A point lies inside a straight run when the next score adds the same counts.
        after = c.select(*keys, (F.col("cum_one") - 1).alias("cum_one"), F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg"))
        c = c.join(after, [*keys, "cum_one"], "left").where(
            (F.col("cum_one") == 1) | F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")))
    points = c.select(
        *keys, _div(F.col("cum_neg"), F.col("N")).alias("fpr"), _div(F.col("cum_pos"), F.col("P")).alias("tpr"),
        F.col("score").alias("threshold"))
    origin = curve.where(F.col("cum_one") == 1).select(*keys, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold"))
    return origin.unionByName(points).drop(ALL)


def pr_points(curve: DataFrame) -> DataFrame:
    """precision, recall, threshold per score, and the end point (1, 0)."""
    c = _with_totals(curve)
    points = c.select(
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        _div(F.col("cum_pos"), F.col("P")).alias("recall"), F.col("score").alias("threshold"))
    end = curve.sparkSession.createDataFrame([(1.0, 0.0, None)], "precision double, recall double, threshold double")
    return points.unionByName(end)


def calibration_curve(df: DataFrame, y: str, p: str, n_bins: int = 10) -> DataFrame:
    """Mean score and share of positives per quantile bin, empty bins dropped."""
    q = quantiles(df, [p], [i / n_bins for i in range(n_bins + 1)])[p] or [0.0, 1.0]
    inner = q[1:-1]
    grouped = df.where(F.col(p).isNotNull()).groupBy(bin_index(p, inner, "right").alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("fraction_positive"))
    return grouped.orderBy("bin")


# -- thresholds ---------------------------------------------------------------

def expected_cost(counts: DataFrame, costs: dict[str, float] = COSTS) -> DataFrame:
    """Add ``expected_cost`` to tn, fp, fn, tp counts."""
    return counts.withColumn("expected_cost", sum(F.col(k) * F.lit(costs[k]) for k in ("fn", "fp", "tp", "tn")))


def cost_curve(df: DataFrame, y: str, p: str, costs: dict[str, float] = COSTS, n_thresholds: int = 1000) -> DataFrame:
    """Expected cost at each grid threshold k * (1 / n): one histogram of the
    scores over the grid, then running sums over its n + 1 rows."""
    step = 1.0 / n_thresholds
    # Largest k with k * step <= score; the product, not the quotient, decides.
    raw = F.floor(F.col(p) * n_thresholds).cast("long")
    k = F.when((raw + 1) * F.lit(step) <= F.col(p), raw + 1).when(raw * F.lit(step) > F.col(p), raw - 1).otherwise(raw)
    label = F.col(y).cast("int") == 1
    hist = df.where(F.col(p).isNotNull()).groupBy(F.least(k, F.lit(n_thresholds)).alias("k")).agg(
        F.count_if(label).alias("pos"), F.count_if(~label).alias("neg"))
    grid = df.sparkSession.range(-1, n_thresholds + 1).select(F.col("id").alias("k"))
    full = grid.join(hist, "k", "left").na.fill(0, ["pos", "neg"])
    down = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    tp, fp = F.sum("pos").over(down), F.sum("neg").over(down)
    counts = full.select(
        "k", (F.col("k") * F.lit(step)).alias("threshold"), tp.alias("tp"), fp.alias("fp"),
        (F.sum("pos").over(every) - tp).alias("fn"), (F.sum("neg").over(every) - fp).alias("tn"),
    ).where("k >= 0")
    return expected_cost(counts, costs)


def min_cost_threshold(df: DataFrame, y: str, p: str, costs: dict[str, float] = COSTS, n_thresholds: int = 1000) -> DataFrame:
    """threshold, expected_cost: the first grid threshold of least cost."""
    c = cost_curve(df, y, p, costs, n_thresholds)
    return c.agg(F.min_by("threshold", F.struct("expected_cost", "threshold")).alias("threshold"),
                 F.min("expected_cost").alias("expected_cost"))


def max_f1_threshold(curve: DataFrame) -> DataFrame:
    """threshold, f1: the lowest score among those of greatest F1."""
    c = _with_totals(curve)
    precision, recall = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")), _div(F.col("cum_pos"), F.col("P"))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall + F.lit(1e-12))).otherwise(F.lit(0.0))
    c = c.withColumn("f1", f1)
    return c.agg(F.min_by("score", F.struct(-F.col("f1"), F.col("score"))).alias("threshold"), F.max("f1").alias("f1"))


def max_youden_threshold(curve: DataFrame) -> DataFrame:
    """threshold, youden_j: the highest score among those of greatest tpr - fpr."""
    points = roc_points(curve, drop_collinear=False).withColumn("j", F.col("tpr") - F.col("fpr"))
    return points.agg(F.max_by("threshold", F.struct("j", "threshold")).alias("threshold"), F.max("j").alias("youden_j"))


def optimise_threshold(df: DataFrame, y: str, p: str, costs: dict[str, float] = COSTS, n_thresholds: int = 1000) -> DataFrame:
    """criterion, threshold, value, chosen: least cost is chosen, the others reported."""
    curve = score_curve(df, y, p)
    parts = [
        (min_cost_threshold(df, y, p, costs, n_thresholds), "min_cost", "expected_cost"),
        (max_f1_threshold(curve), "max_f1", "f1"),
        (max_youden_threshold(curve), "max_youden_j", "youden_j"),
    ]
    rows = [d.select(F.lit(name).alias("criterion"), "threshold", F.col(v).cast("double").alias("value"),
                     F.lit(name == "min_cost").alias("chosen")) for d, name, v in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def select_best(results: list[dict], metric: str) -> dict:
    """Entry with the highest metric; accuracy is refused, it rewards predicting the majority."""
    if metric == "accuracy":
        raise ValueError("accuracy cannot select a model under class imbalance")
    if not results:
        raise ValueError("no results to select from")
    return max(results, key=lambda r: r["metrics"][metric])
