"""Cleaning in a fixed order: dedup, clip, winsorize, impute, quarantine, cascade.

Medians and winsor bounds are fitted on training tables only and kept as a small
JSON-able state; applying them is one projection per table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.config import KEY_COLUMNS
from riskframe.functions.exprs import clip, number
from riskframe.operators.engine import ValidationRun, run
from riskframe.operators.ordered import materialize, passing
from riskframe.operators.quantiles import quantiles

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class CleanState:
    medians: dict[str, dict[str, float]]
    winsor: dict[str, dict[str, tuple[float, float]]]

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> CleanState:
        raw = json.loads(text)
        winsor = {t: {c: tuple(b) for c, b in cols.items()} for t, cols in raw["winsor"].items()}
        return cls(raw["medians"], winsor)


def dedup(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Last row per key in the given order.  An aggregate, not a row_number window:
    it combines before the shuffle, so a heavy key never sits in one task."""
    last = F.max_by(F.struct(*df.columns), F.struct(*order_by)).alias("r")
    return df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(last).select("r.*")


def clip_columns(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    kinds = dict(df.dtypes)
    changed = {c: clip(number(c), lo, hi).cast(kinds[c] if kinds[c] != "string" else "double")
               for c, (lo, hi) in bounds.items() if c in df.columns}
    return df.withColumns(changed) if changed else df


def clip_counts(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """Values below and above the bounds per column."""
    items = []
    for c, (lo, hi) in bounds.items():
        if c in df.columns:
            low = number(c) < F.lit(lo) if lo is not None else F.lit(False)
            high = number(c) > F.lit(hi) if hi is not None else F.lit(False)
            items.append(F.struct(F.lit(c).alias("column"), F.count_if(low).alias("n_clipped_low"),
                                  F.count_if(high).alias("n_clipped_high")))
    return df.agg(F.array(*items).alias("a")).select(F.inline("a"))


def _dedup_clip(tables: Tables, config: dict, order_by: dict[str, Sequence[str]]) -> Tables:
    out = dict(tables)
    for t, keys in config["dedup"].items():
        if t in out:
            out[t] = dedup(out[t], keys, order_by[t])
    for t, bounds in config["clip"].items():
        if t in out:
            out[t] = clip_columns(out[t], bounds)
    return out


def fit(train: Tables, config: dict, order_by: dict[str, Sequence[str]]) -> CleanState:
    """Medians and winsor bounds after dedup and clip.  Per table only the fitted
    columns are deduplicated, clipped and written out; the quantile passes read that."""
    w = config["winsorize"]
    medians: dict[str, dict[str, float]] = {}
    winsor: dict[str, dict[str, tuple[float, float]]] = {}
    for t in train:
        if not config["impute_numeric"].get(t) and not w["columns"].get(t):
            continue
        df = train[t]
        med = [c for c in config["impute_numeric"].get(t, []) if c in df.columns]
        win = [c for c in w["columns"].get(t, []) if c in df.columns]
        wanted = list(dict.fromkeys(med + win))
        if not wanted:
            continue
        needed = [*wanted, *config["dedup"].get(t, []), *(order_by[t] if t in config["dedup"] else [])]
        narrow = df.select(*dict.fromkeys(needed))
        with passing(df.sparkSession):
            source = materialize(_dedup_clip({t: narrow}, config, order_by)[t].select(*wanted))
            q = quantiles(source, wanted, [w["lower"], 0.5, w["upper"]])
        if med:
            medians[t] = {c: q[c][1] for c in med if q[c]}
        if win:
            winsor[t] = {c: (q[c][0], q[c][2]) for c in win if q[c]}
    return CleanState(medians, winsor)


def impute(df: DataFrame, medians: dict[str, float], categorical: Sequence[str]) -> DataFrame:
    """Median for numbers plus a ``<col>_was_missing`` flag, 'UNKNOWN' for text."""
    new = {}
    for c, m in medians.items():
        if c in df.columns:
            new[f"{c}_was_missing"] = F.col(c).isNull()
            new[c] = F.coalesce(F.col(c), F.lit(m))
    for c in categorical:
        if c in df.columns:
            new[c] = F.coalesce(F.col(c), F.lit("UNKNOWN"))
    return df.withColumns(new) if new else df


def repair(tables: Tables, state: CleanState, config: dict, order_by: dict[str, Sequence[str]]) -> Tables:
    """Everything before the quarantine step."""
    out = _dedup_clip(tables, config, order_by)
    for t in list(out):
        if t in state.winsor:
            out[t] = clip_columns(out[t], state.winsor[t])
        out[t] = impute(out[t], state.medians.get(t, {}), config["impute_categorical"].get(t, []))
    return out


def cascade(tables: Tables) -> Tables:
    """Drop children of dropped parents."""
    out = dict(tables)
    if "customers" in out:
        known = out["customers"].select("customer_id").distinct()
        for child in ("loan_applications", "financial_profiles", "credit_history"):
            if child in out:
                out[child] = out[child].join(known, "customer_id", "left_semi")
    if "loan_applications" in out and "loan_outcomes" in out:
        known = out["loan_applications"].select("loan_id").distinct()
        out["loan_outcomes"] = out["loan_outcomes"].join(known, "loan_id", "left_semi")
    return out


@dataclass
class CleanResult:
    tables: Tables
    repaired: Tables
    validation: ValidationRun

    def quarantined(self, table: str) -> DataFrame:
        return self.validation.quarantined(table)

    def quarantine_issues(self) -> DataFrame:
        """Issue records of rows that could not be repaired."""
        parts = [
            self.validation.quarantined(t).select(
                F.lit(t).alias("table_name"),
                F.concat_ws("|", *[F.col(k).cast("string") for k in KEY_COLUMNS[t]]).alias("record_key"),
                F.lit("cleaning:structural_quarantine").alias("rule_name"), F.lit("ERROR").alias("severity"),
                F.lit("row dropped: ERROR rules still violated after repair").alias("detail"),
            )
            for t in self.repaired if t in KEY_COLUMNS
        ]
        return reduce(DataFrame.unionByName, parts)


def apply(tables: Tables, state: CleanState, config: dict, order_by: dict[str, Sequence[str]], rules) -> CleanResult:
    """Repair, drop rows that still break an ERROR rule, and drop their children.
    Repaired tables of which rows were dropped are written once: every rule and the split read
    them again.  The others are one projection of the given tables.  The customers that stay
    are written too, as three tables are reduced to them."""
    repaired = {t: materialize(df) if t in config["dedup"] else df for t, df in repair(tables, state, config, order_by).items()}
    validation = run(repaired, [r for r in rules if r.severity == "ERROR"])
    kept = {t: validation.clean(t) if t in KEY_COLUMNS else df for t, df in repaired.items()}
    if "customers" in kept:
        kept["customers"] = materialize(kept["customers"])
    return CleanResult(cascade(kept), repaired, validation)


def report(raw: Tables, state: CleanState, config: dict, order_by: dict[str, Sequence[str]], result: CleanResult) -> DataFrame:
    """table, step, column, n of everything cleaning did."""
    spark = next(iter(raw.values())).sparkSession
    parts = [spark.createDataFrame([], "`table` string, step string, `column` string, n long")]

    def add(df: DataFrame, table: str, step: str, column, n):
        parts.append(df.select(F.lit(table).alias("table"), F.lit(step).alias("step"),
                               column.alias("column"), n.cast("long").alias("n")))

    deduped = {t: dedup(raw[t], k, order_by[t]) if t in raw else None for t, k in config["dedup"].items()}
    for t, df in deduped.items():
        if df is not None:
            gone = raw[t].agg(F.count("*").alias("a")).select((F.col("a") - df.agg(F.count("*")).scalar()).alias("n"))
            add(gone, t, "dedup", F.lit(None).cast("string"), F.col("n"))
    for t, df in raw.items():
        df = deduped.get(t) or df
        bounds = config["clip"].get(t)
        if bounds:
            c = clip_counts(df, bounds)
            add(c, t, "clip_low", F.col("column"), F.col("n_clipped_low"))
            add(c, t, "clip_high", F.col("column"), F.col("n_clipped_high"))
            df = clip_columns(df, bounds)
        if state.winsor.get(t):
            c = clip_counts(df, state.winsor[t])
            add(c, t, "winsorize_low", F.col("column"), F.col("n_clipped_low"))
            add(c, t, "winsorize_high", F.col("column"), F.col("n_clipped_high"))
        filled = [c for c in [*state.medians.get(t, {}), *config["impute_categorical"].get(t, [])] if c in df.columns]
        if filled:
            nulls = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n"))
                                     for c in filled]).alias("a")).select(F.inline("a"))
            add(nulls, t, "impute", F.col("column"), F.col("n"))
        if t in KEY_COLUMNS:
            add(result.quarantined(t).agg(F.count("*").alias("n")), t, "quarantine", F.lit(None).cast("string"), F.col("n"))
    return reduce(DataFrame.unionByName, parts).where("n > 0")
