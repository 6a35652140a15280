"""Baseline profiles and drift of current data against them.

A profile is small fitted state (edges, shares of frequent categories), a table of the
shares of all other categories, and a reference sample.
Current data is reduced to counts per bin, category or distinct value; only those
counts meet the baseline.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.config import MONITORING
from riskframe.functions.bins import indexed_bin, open_ended
from riskframe.functions.exprs import number
from riskframe.functions.pvalues import chi2_p, ks_p, normal_quantile
from riskframe.operators.explore import _long
from riskframe.operators.ordered import materialize, running_sums, write_shared
from riskframe.operators.quantiles import quantiles
from riskframe.operators.split import exact_sample

PREDICTION = "__prediction_probability__"
FINDINGS = (
    "feature_name string, method string, baseline_stat double, current_stat double, "
    "drift_score double, status string, detail string"
)


SHARES = "feature string, value string, expected double"
# Categories with a smaller share are rows of a table; at most 1/RARE a column are not.
RARE = 0.01


@dataclass(frozen=True)
class Baseline:
    model_id: str
    n_rows: int
    default_rate: float
    numeric: dict[str, dict]  # mean, std, min, max, edges
    categorical: dict[str, dict[str, float]]  # category -> share, of those above RARE
    prediction_edges: list[float]
    window: tuple[str, str] = ("", "")
    rare: str = ""  # folder of the (feature, value, expected) table of all others

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def shares(self, spark: SparkSession) -> DataFrame:
        """feature, value, expected of every category of training."""
        listed = _listed_shares(spark, self.categorical)
        return listed.unionByName(spark.read.schema(SHARES).parquet(self.rare)) if self.rare else listed

    @classmethod
    def from_json(cls, text: str) -> Baseline:
        raw = json.loads(text)
        raw["window"] = tuple(raw["window"])
        return cls(**raw)


def decile_edges(df: DataFrame, columns: Sequence[str], n: int = 10) -> dict[str, list[float]]:
    """Distinct quantile edges with open outer ends; a constant column gives [-inf, inf]."""
    q = quantiles(df, columns, [i / n for i in range(n + 1)])
    return {c: open_ended(e) for c, e in q.items() if e}


def build_baseline(
    train: DataFrame, label: str, probability: str, numeric: Sequence[str], categorical: Sequence[str],
    key: Sequence[str], model_id: str, n_deciles: int = 10, sample_size: int = MONITORING["reference_sample_size"],
    seed: int = 42, window: tuple[str, str] = ("", ""),
) -> tuple[Baseline, DataFrame]:
    """Profile of training data and a reference sample of at most ``sample_size`` rows."""
    edges = decile_edges(train, [*numeric, probability], n_deciles)
    row = train.agg(
        F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("rate"),
        *[f(number(c)).alias(f"{k}_{i}") for i, c in enumerate(numeric)
          for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))],
    ).first()
    profile = {
        c: {"mean": row[f"mean_{i}"], "std": row[f"std_{i}"], "min": row[f"min_{i}"], "max": row[f"max_{i}"], "edges": edges[c]}
        for i, c in enumerate(numeric) if c in edges
    }
    shares: dict[str, dict[str, float]] = {c: {} for c in categorical}
    rare = ""
    if categorical:
        share = (F.col("n") / F.lit(float(row.n))).alias("expected")
        counts = materialize(category_counts(train, categorical).select("feature", "value", share))
        for r in counts.where(F.col("expected") >= RARE).collect():  # at most 1/RARE a column
            shares[r.feature][r.value] = r.expected
        others = counts.where(F.col("expected") < RARE)
        rare = "" if others.isEmpty() else write_shared(others)
    sample = exact_sample(train, key, sample_size, seed).select(*numeric, F.col(probability).alias("__p_default__"))
    return Baseline(model_id, row.n, row.rate, profile, shares, edges[probability], window, rare), sample


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, value, n; a missing value is the category 'nan'."""
    rows = _long(df, columns).withColumn("value", F.coalesce("value", F.lit("nan")))
    return rows.groupBy("feature", "value").agg(F.count("*").alias("n"))


def psi_term(expected: Column, actual: Column, epsilon: float = MONITORING["epsilon"]) -> Column:
    """One bin's part of the population stability index; empty bins are floored."""
    e, a = F.greatest(expected, F.lit(epsilon)), F.greatest(actual, F.lit(epsilon))
    return (a - e) * F.ln(a / e)


def psi_status(psi: Column, warning: float = MONITORING["psi_warning"], drift: float = MONITORING["psi_drift"]) -> Column:
    return F.when(psi >= drift, "DRIFT").when(psi >= warning, "WARNING").otherwise("OK")


def histogram_counts(df: DataFrame, edges: dict[str, Sequence[float]], group_by: Sequence[str] = ()) -> DataFrame:
    """group_by..., feature, bin, n over left-closed bins, all features in one job."""
    items = [
        F.struct(F.lit(i).alias("i"), F.lit(c).alias("feature"), number(c).alias("value")) for i, c in enumerate(edges)
    ]
    rows = df.select(*group_by, F.explode(F.array(*items)).alias("s")).select("*", "s.*").drop("s")
    bins = indexed_bin(F.col("i"), F.col("value"), [list(e)[1:-1] for e in edges.values()], "left")
    return rows.where("value is not null").groupBy(*group_by, "feature", bins.alias("bin")).agg(F.count("*").alias("n"))


def psi_of_counts(counts: DataFrame, edges: dict[str, Sequence[float]], expected: dict[str, Sequence[float]] | None = None,
                  epsilon: float = MONITORING["epsilon"], group_by: Sequence[str] = ()) -> DataFrame:
    """group_by..., feature, psi from bin counts.  Without ``expected`` shares every
    bin is assumed to hold the same mass, also where edges were merged."""
    rows = []
    for c, e in edges.items():
        bins = len(e) - 1
        rows += [(c, b, float(expected[c][b]) if expected else 1.0 / bins) for b in range(bins)]
    bins = counts.sparkSession.createDataFrame(rows, "feature string, bin int, expected double")
    totals = counts.groupBy(*group_by, "feature").agg(F.sum("n").alias("total"))
    full = totals.join(bins, "feature").join(counts, [*group_by, "feature", "bin"], "left")
    actual = F.coalesce(F.col("n"), F.lit(0)) / F.col("total")
    return full.groupBy(*group_by, "feature").agg(F.sum(psi_term(F.col("expected"), actual, epsilon)).alias("psi"))


def numeric_psi(df: DataFrame, edges: dict[str, Sequence[float]], expected: dict[str, Sequence[float]] | None = None,
                epsilon: float = MONITORING["epsilon"]) -> DataFrame:
    """feature, psi; a feature without current values scores 0."""
    found = psi_of_counts(histogram_counts(df, edges), edges, expected, epsilon)
    names = df.sparkSession.createDataFrame([(c,) for c in edges], "feature string")
    return names.join(found, "feature", "left").na.fill(0.0, ["psi"])


def observed_shares(df: DataFrame, edges: dict[str, Sequence[float]]) -> dict[str, list[float]]:
    """Actual share per bin, the alternative to assuming equal mass."""
    counts: dict[str, dict[int, int]] = {}
    for r in histogram_counts(df, edges).collect():  # bins x features rows
        counts.setdefault(r.feature, {})[r.bin] = r.n
    out = {}
    for c, e in edges.items():
        mine = counts.get(c, {})
        total = sum(mine.values()) or 1
        out[c] = [mine.get(b, 0) / total for b in range(len(e) - 1)]
    return out


Shares = dict[str, dict[str, float]] | DataFrame


def _listed_shares(spark: SparkSession, shares: dict[str, dict[str, float]]) -> DataFrame:
    rows = [(c, v, float(p)) for c, m in shares.items() for v, p in m.items()]
    return spark.createDataFrame(rows, SHARES)


def _expected(df: DataFrame, shares: Shares, columns: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    """Shares as a table, and the columns they are of."""
    if isinstance(shares, DataFrame):
        if columns is None:
            raise ValueError("a table of shares needs the names of its columns")
        return shares.where(F.col("feature").isin(list(columns))), list(columns)
    return _listed_shares(df.sparkSession, shares), list(shares)


def category_table(df: DataFrame, shares: Shares, columns: Sequence[str] | None = None) -> DataFrame:
    """feature, value, expected share (0 if new), n, total for every category on either side.
    ``shares`` lists each column's categories, or is a table (feature, value, expected)
    of any length, for the named columns."""
    expected, columns = _expected(df, shares, columns)
    counts = category_counts(df, columns)
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    both = counts.join(expected, ["feature", "value"], "full")
    return both.join(F.broadcast(totals), "feature").select(  # a row per column
        "feature", "value", F.coalesce("expected", F.lit(0.0)).alias("expected"),
        F.coalesce("n", F.lit(0)).alias("n"), "total", F.col("expected").isNull().alias("is_new"),
    )


def categorical_psi(df: DataFrame, shares: Shares, epsilon: float = MONITORING["epsilon"], columns: Sequence[str] | None = None) -> DataFrame:
    """feature, psi, n_new, new_example: how many categories the baseline never saw,
    and the most frequent of them (``new_categories`` has them all, as rows)."""
    t = category_table(df, shares, columns)
    return t.groupBy("feature").agg(F.sum(psi_term(F.col("expected"), F.col("n") / F.col("total"), epsilon)).alias("psi"), *_new())


def _new() -> list[Column]:
    """Number of new categories, and the most frequent one (the first of equals)."""
    return [F.count_if("is_new").alias("n_new"), F.min(F.when(F.col("is_new"), F.struct((-F.col("n")).alias("n"), "value")))["value"].alias("new_example")]


def chi_square(df: DataFrame, shares: Shares, columns: Sequence[str] | None = None) -> DataFrame:
    """feature, statistic, dof, n_new, new_example of the goodness-of-fit test."""
    t = category_table(df, shares, columns)
    weight = t.groupBy("feature").agg(F.sum("expected").alias("w"))
    floor = F.greatest(F.col("expected") / F.col("w") * F.col("total"), F.lit(1e-6))
    t = t.join(F.broadcast(weight), "feature").where("w > 0").withColumn("e", floor)
    scale = t.groupBy("feature").agg((F.sum("n") / F.sum("e")).alias("scale"))
    e = F.col("e") * F.col("scale")
    return t.join(F.broadcast(scale), "feature").groupBy("feature").agg(
        F.sum((F.col("n") - e) * (F.col("n") - e) / e).alias("statistic"), (F.count("*") - 1).alias("dof"), *_new())


def ks_statistics(baseline: DataFrame, current: DataFrame, columns: Sequence[str], rows_per_task: int | None = None) -> DataFrame:
    """feature, statistic, n_baseline, n_current: largest gap between the two
    distributions, from counts per distinct value with running totals."""
    def tagged(df, side):
        items = [F.struct(F.lit(c).alias("feature"), number(c).alias("value")) for c in columns]
        return df.select(F.explode(F.array(*items)).alias("s")).select("s.*").where("value is not null").select(
            "feature", "value", F.lit(side).alias("side"))

    counts = tagged(baseline, 0).unionByName(tagged(current, 1)).groupBy("feature", "value").agg(
        F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    cum = running_sums(counts, ["value"], ["a", "b"], ["feature"], rows_per_task)
    totals = cum.groupBy("feature").agg(F.sum("a").alias("n_baseline"), F.sum("b").alias("n_current"))
    gap = F.abs(F.col("cum_a") / F.col("n_baseline") - F.col("cum_b") / F.col("n_current"))
    out = cum.join(totals, "feature").where("n_baseline >= 2 and n_current >= 2").groupBy("feature").agg(F.max(gap).alias("statistic"))
    return totals.join(out, "feature", "left").select("feature", "statistic", "n_baseline", "n_current")


def concept_drift(outcomes: DataFrame, label: str, baseline_rate: float, confidence: float = MONITORING["concept_drift_confidence"]) -> DataFrame:
    """n, current_rate, Wilson interval, baseline_rate, status of matured loans."""
    z = normal_quantile(1 - (1 - confidence) / 2)
    n = F.count(label)
    out = outcomes.agg(n.alias("n"), F.avg(F.col(label).cast("double")).alias("current_rate"))
    n, r = F.col("n"), F.col("current_rate")
    denom = 1 + F.lit(z * z) / n
    center = (r + F.lit(z * z) / (2 * n)) / denom
    margin = F.lit(z) * F.sqrt((r * (1 - r) + F.lit(z * z) / (4 * n)) / n) / denom
    has = n > 0
    low = F.when(has, F.greatest(F.lit(0.0), center - margin))
    high = F.when(has, F.least(F.lit(1.0), center + margin))
    out = out.withColumns({"ci_low": low, "ci_high": high, "baseline_rate": F.lit(float(baseline_rate))})
    outside = ~F.col("baseline_rate").between(F.col("ci_low"), F.col("ci_high"))
    return out.withColumn("status", F.when(F.coalesce(outside, F.lit(False)), "WARNING").otherwise("OK"))


def feature_drift(baseline: Baseline, sample: DataFrame, current: DataFrame, settings: dict = MONITORING) -> DataFrame:
    """Findings per feature and method.  Statistics are computed by Spark for all
    features at once; the driver only turns one number per feature into a p-value."""
    spark = current.sparkSession
    eps, alpha = settings["epsilon"], settings["significance_level"]
    rows = []

    def status(psi):
        return "DRIFT" if psi >= settings["psi_drift"] else "WARNING" if psi >= settings["psi_warning"] else "OK"

    edges = {c: p["edges"] for c, p in baseline.numeric.items() if c in current.columns}
    if edges:
        for r in numeric_psi(current, edges, None, eps).collect():
            rows.append((r.feature, "psi", 0.0, r.psi, r.psi, status(r.psi), ""))
        shared = [c for c in edges if c in sample.columns]
        for r in ks_statistics(sample, current, shared).collect() if shared else []:
            p = ks_p(r.statistic, r.n_baseline, r.n_current)
            bad = p is not None and p < alpha
            rows.append((r.feature, "ks", 0.0, r.statistic, r.statistic, "DRIFT" if bad else "OK",
                         f"p_value={p if p is not None else math.nan:.4g}"))
    columns = [c for c in baseline.categorical if c in current.columns]
    if columns:
        shares = baseline.shares(spark)
        for r in categorical_psi(current, shares, eps, columns).collect():
            rows.append((r.feature, "psi", 0.0, r.psi, r.psi, "DRIFT" if r.n_new else status(r.psi),
                         f"{r.n_new} categories not seen in training, such as {r.new_example}" if r.n_new else ""))
        for r in chi_square(current, shares, columns).collect():
            p = chi2_p(r.statistic, r.dof)
            bad = (not math.isnan(p) and p < alpha) or r.n_new > 0
            rows.append((r.feature, "chi_square", 0.0, r.statistic, r.statistic, "DRIFT" if bad else "OK", f"p_value={p:.4g}"))
    return spark.createDataFrame(rows, FINDINGS)


def prediction_drift(baseline: Baseline, predictions: DataFrame, probability: str = "default_probability", settings: dict = MONITORING) -> DataFrame:
    """The PSI finding of the predicted probability."""
    psi = numeric_psi(predictions, {probability: baseline.prediction_edges}, None, settings["epsilon"])
    return psi.select(
        F.lit(PREDICTION).alias("feature_name"), F.lit("psi").alias("method"), F.lit(0.0).alias("baseline_stat"),
        F.col("psi").alias("current_stat"), F.col("psi").alias("drift_score"),
        psi_status(F.col("psi"), settings["psi_warning"], settings["psi_drift"]).alias("status"),
        F.lit("prediction-probability distribution drift (earliest warning signal)").alias("detail"),
    )


def drift_summary(reports: DataFrame) -> DataFrame:
    """One row: time of the latest run and its findings per status."""
    latest = reports.agg(F.max("created_at")).scalar()
    return reports.where(F.col("created_at") == latest).agg(
        F.max("created_at").alias("latest_run_at"), F.count("*").alias("n_findings"),
        F.count_if(F.col("status") == "OK").alias("n_ok"),
        F.count_if(F.col("status") == "WARNING").alias("n_warning"), F.count_if(F.col("status") == "DRIFT").alias("n_drift"),
    )


def psi_history(reports: DataFrame) -> DataFrame:
    """Mean PSI per feature and run date, in long form."""
    return reports.where(F.col("method") == "psi").groupBy(
        "feature_name", F.to_date("created_at").alias("run_date")
    ).agg(F.avg(F.col("drift_score").cast("double")).alias("psi"))


def new_categories(df: DataFrame, shares: Shares, columns: Sequence[str] | None = None) -> DataFrame:
    """feature, value of categories the baseline never saw."""
    known, columns = _expected(df, shares, columns)
    return category_counts(df, columns).join(known, ["feature", "value"], "left_anti").select("feature", "value")
