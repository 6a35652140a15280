"""Linear attributions per source feature, top factors and reason sentences.

Per row this is one array of (feature, value, contribution) structs built from
the encoder's column expressions; only the factors that are kept are rendered.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.config import TOP_K_FACTORS
from riskframe.functions.display import feature_value
from riskframe.functions.reason_text import TEMPLATES
from riskframe.operators.encode import EncoderState, encoded_columns, with_levels, without_levels


@dataclass(frozen=True)
class LinearState:
    """Coefficients of a linear model and the background means they are explained against."""

    names: list[str]
    coefficients: list[float]
    intercept: float
    means: list[float]

    @property
    def base_value(self) -> float:
        return self.intercept + sum(c * m for c, m in zip(self.coefficients, self.means))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> LinearState:
        return cls(**json.loads(text))


def background_means(sample: DataFrame, encoder: EncoderState) -> list[float]:
    """Mean of every encoded column over the background rows."""
    cols = encoded_columns(encoder)
    row = with_levels(sample, encoder).agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)]).first()
    return [row[f"m_{i}"] for i in range(len(cols))]


def check_coverage(features: Iterable[str]) -> None:
    """Every feature needs a reason template."""
    missing = sorted(set(features) - set(TEMPLATES))
    if missing:
        raise KeyError(f"no reason template for {missing}")


def contributions(state: LinearState, encoder: EncoderState) -> Column:
    """array<struct<rank_key, place, feature, value, number, contribution>> per source
    feature: coefficient x (value - background mean), one-hot columns summed."""
    if state.names != encoder.names():
        raise ValueError("the model and the encoder disagree about the columns")
    source = encoder.sources()
    parts: dict[str, Column] = {}
    for name, x, c, m in zip(state.names, encoded_columns(encoder), state.coefficients, state.means):
        term = (x - F.lit(m)) * F.lit(c)
        f = source[name]
        parts[f] = parts[f] + term if f in parts else term
    items = [
        F.struct(
            (-F.abs(v)).alias("rank_key"), F.lit(i).alias("place"), F.lit(f).alias("feature"),
            F.col(f).cast("string").alias("value"), F.col(f).try_cast("double").alias("number"), v.alias("contribution"),
        )
        for i, (f, v) in enumerate(parts.items())
    ]
    return F.array(*items)


def comparison_word(value: Column, benchmark: Column) -> Column:
    """Where a value stands against the portfolio median."""
    ratio = F.when(benchmark != 0, value / benchmark)
    at_zero = F.when(value > 0, "above").when(value == 0, "in line with").otherwise("below")
    return (
        F.when(benchmark == 0, at_zero).when(ratio >= 1.5, "well above").when(ratio > 1.05, "above")
        .when(ratio >= 0.95, "in line with").when(ratio > 0.5, "below").otherwise("well below")
    )


def _templates(benchmarks: dict[str, dict]) -> Column:
    entries = []
    for f, (display, kind, high, low) in TEMPLATES.items():
        b = benchmarks.get(f, {})
        median = b.get("median")
        entries += [F.lit(f), F.struct(
            F.lit(display).alias("display"), F.lit(kind).alias("kind"), F.lit(high).alias("high"), F.lit(low).alias("low"),
            F.lit(0.0 if median is None else float(median)).alias("median"), F.lit(str(b.get("mode"))).alias("mode"),
        )]
    return F.create_map(*entries)


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1_000_000))


def reason_sentence(feature: Column, value: Column, number: Column, contribution: Column, templates: Column) -> Column:
    """A factual clause and the direction of the contribution; a feature without a
    template is an error."""
    return _sentence(F.try_element_at(templates, feature), feature, value, number, contribution)


def _sentence(t: Column, feature: Column, value: Column, number: Column, contribution: Column) -> Column:
    """The sentence by the feature's template, which is read many times: a column, not a lookup."""
    direction = F.when(contribution > 0, "increasing the estimated risk for this application").otherwise(
        "reducing the estimated risk for this application")
    kind, high, low, median = t["kind"], t["high"], t["low"], t["median"]
    present = F.concat(_capital(F.when(F.coalesce(number > 0, F.lit(False)), high).otherwise(low)), F.lit(", "), direction, F.lit("."))
    text = F.coalesce(value, F.lit("None"))
    same = text == t["mode"]
    category = F.concat(
        t["display"], F.lit(" of "), text, F.when(same, " matches").otherwise(" differs from"),
        F.lit(" the portfolio's most common value ("), t["mode"], F.lit("), indicating "),
        F.when(same, low).otherwise(high), F.lit(", "), direction, F.lit("."))
    word = comparison_word(number, median)
    numeric = F.concat(
        t["display"], F.lit(" of "), feature_value(number, kind), F.lit(" is "), word, F.lit(" the portfolio median of "),
        feature_value(median, kind), F.lit(", indicating "), F.when(word.isin("well above", "above"), high).otherwise(low),
        F.lit(", "), direction, F.lit("."))
    return (
        F.when(t.isNull(), F.raise_error(F.concat(F.lit("no reason template for "), feature)).cast("string"))
        .when(kind.isin("count_zero", "flag"), present).when(kind == "category", category).otherwise(numeric)
    )


def top_factors(all_factors: Column, sign: int, k: int, templates: Column) -> Column:
    """The k strongest factors of one sign with their sentences.  Each factor's template
    is looked up once, beside it."""
    mine = F.filter(all_factors, lambda f: f["contribution"] > 0 if sign > 0 else f["contribution"] < 0)
    found = F.transform(F.slice(F.sort_array(mine), 1, k), lambda f: F.struct(
        f.alias("f"), F.try_element_at(templates, f["feature"]).alias("t")))
    return F.transform(found, lambda x: F.struct(
        x["f"]["feature"].alias("feature"), x["f"]["value"].alias("value"), x["f"]["contribution"].alias("contribution"),
        _sentence(x["t"], x["f"]["feature"], x["f"]["value"], x["f"]["number"], x["f"]["contribution"]).alias("reason"),
    ))


_FACTORS = "array<struct<feature:string,value:string,contribution:double,reason:string>>"
#: What ``explain`` adds.
COLUMNS = {"base_value": "double", "model_output_value": "double", "top_risk_factors": _FACTORS, "top_positive_factors": _FACTORS}


def explain(df: DataFrame, state: LinearState, encoder: EncoderState, benchmarks: dict[str, dict], k: int = TOP_K_FACTORS) -> DataFrame:
    """Add base_value, model_output_value, top_risk_factors and top_positive_factors."""
    check_coverage(set(encoder.sources().values()))
    templates = _templates(benchmarks)
    total = F.aggregate("_factors", F.lit(state.base_value), lambda acc, f: acc + f["contribution"])
    marked = with_levels(df, encoder).withColumn("_factors", contributions(state, encoder))
    return without_levels(marked, encoder).withColumns({
        "base_value": F.lit(state.base_value), "model_output_value": total,
        "top_risk_factors": top_factors(F.col("_factors"), 1, k, templates),
        "top_positive_factors": top_factors(F.col("_factors"), -1, k, templates),
    }).drop("_factors")


def explain_long(df: DataFrame, key: Sequence[str], state: LinearState, encoder: EncoderState, benchmarks: dict[str, dict]) -> DataFrame:
    """Every feature of every row: value, impact, sentence, benchmark, rank by impact."""
    check_coverage(set(encoder.sources().values()))
    templates = _templates(benchmarks)
    rows = with_levels(df, encoder).withColumn("_factors", F.sort_array(contributions(state, encoder))).select(*key, F.posexplode("_factors").alias("pos", "f"))
    sentence = reason_sentence(F.col("f.feature"), F.col("f.value"), F.col("f.number"), F.col("f.contribution"), templates)
    median = {f: b.get("median") for f, b in benchmarks.items()}
    known = F.create_map(*[x for f in TEMPLATES for x in (F.lit(f), F.lit(median.get(f)).cast("double"))])
    return rows.select(
        *key, (F.col("pos") + 1).alias("rank"), F.col("f.feature").alias("feature"), F.col("f.value").alias("value"),
        F.col("f.contribution").alias("impact"), sentence.alias("reason"), F.try_element_at(known, F.col("f.feature")).alias("benchmark_median"))


def importance(names: Sequence[str], weights: Sequence[float], spark) -> DataFrame:
    """Features by falling magnitude of their coefficient or importance."""
    rows = sorted(zip(names, (float(w) for w in weights)), key=lambda r: -abs(r[1]))
    return spark.createDataFrame([(i + 1, n, w) for i, (n, w) in enumerate(rows)], "rank int, feature string, importance double")
