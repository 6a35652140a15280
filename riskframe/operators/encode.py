"""Encoding of feature columns: scaled numbers, one-hot categories, ordered bands.

``fit`` looks at training rows only and returns a small JSON-able state.  Levels that
reach the minimum frequency f are at most 1/f a column and become columns; all other
levels seen in training, however many, are rows of a table in shared storage, which
``transform`` looks up by a join.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.config import (
    CATEGORICAL_FEATURES,
    NUMERIC_FEATURES,
    ONE_HOT_MIN_FREQUENCY,
    ORDINAL_FEATURES,
    ORDINAL_ORDER,
)
from riskframe.functions.exprs import number
from riskframe.operators.explore import _long
from riskframe.operators.ordered import materialize, write_shared
from riskframe.operators.quantiles import quantiles

LEVELS = "feature string, value string"
# Rows of kept levels need no lookup; as join keys they are spread over so many values.
SPREAD = 4096


@dataclass(frozen=True)
class EncoderState:
    numeric: dict[str, tuple[float, float, float]]  # median, mean, scale
    kept: dict[str, list[str]]  # one-hot levels
    infrequent: dict[str, int]  # how many levels share one column
    most_frequent: dict[str, str | None]  # ordinal columns
    order: dict[str, list[str]]
    levels: str = ""  # folder of the (feature, value) table of the infrequent ones

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> EncoderState:
        raw = json.loads(text)
        raw["numeric"] = {c: tuple(v) for c, v in raw["numeric"].items()}
        return cls(**raw)

    def names(self) -> list[str]:
        """Encoded column names in model order."""
        out = list(self.numeric)
        for c, levels in self.kept.items():
            out += [f"{c}_{v}" for v in levels]
            if self.infrequent[c]:
                out.append(f"{c}_infrequent")
        return out + list(self.most_frequent)

    def sources(self) -> dict[str, str]:
        """Encoded name -> the feature column it came from."""
        out = {c: c for c in self.numeric}
        for c, levels in self.kept.items():
            out.update({f"{c}_{v}": c for v in levels})
            if self.infrequent[c]:
                out[f"{c}_infrequent"] = c
        return {**out, **{c: c for c in self.most_frequent}}


def source_feature(encoded: str, numeric: Sequence[str], categorical: Sequence[str], ordinal: Sequence[str]) -> str:
    """Feature column of an encoded name; of several matching prefixes the longest."""
    if encoded in numeric or encoded in ordinal:
        return encoded
    fits = [c for c in categorical if encoded.startswith(f"{c}_")]
    return max(fits, key=len) if fits else encoded


def fit(
    train: DataFrame,
    numeric: Sequence[str] = NUMERIC_FEATURES,
    categorical: Sequence[str] = CATEGORICAL_FEATURES,
    ordinal: Sequence[str] = ORDINAL_FEATURES,
    min_frequency: float = ONE_HOT_MIN_FREQUENCY,
    order: dict[str, list[str]] = ORDINAL_ORDER,
) -> EncoderState:
    medians = {c: q[0] if q else 0.0 for c, q in quantiles(train, numeric, [0.5]).items()} if numeric else {}
    scaled: dict[str, tuple[float, float, float]] = {}
    if numeric:
        filled = [F.coalesce(number(c), F.lit(medians[c])) for c in numeric]
        row = train.agg(
            *[F.avg(v).alias(f"m_{i}") for i, v in enumerate(filled)],
            *[F.stddev_pop(v).alias(f"s_{i}") for i, v in enumerate(filled)],
        ).first()
        scaled = {c: (medians[c], row[f"m_{i}"], row[f"s_{i}"] or 1.0) for i, c in enumerate(numeric)}
    kept: dict[str, list[str]] = {c: [] for c in categorical}
    rare = dict.fromkeys(categorical, 0)
    frequent: dict[str, str | None] = dict.fromkeys(ordinal)
    path = ""
    if categorical or ordinal:
        text = train.select(
            *[_level(c).alias(c) for c in categorical],
            *[F.col(c).cast("string").alias(c) for c in ordinal],
        )
        counts = _long(text, [*categorical, *ordinal]).where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
        counts = materialize(counts)
        least = F.lit(min_frequency * train.count())
        is_category = F.col("feature").isin(list(categorical))
        for r in counts.where(is_category & (F.col("n") >= least)).orderBy("feature", "value").collect():  # at most 1/min_frequency a column
            kept[r.feature].append(r.value)
        seldom = counts.where(is_category & (F.col("n") < least))
        for r in seldom.groupBy("feature").agg(F.count("*").alias("levels")).collect():
            rare[r.feature] = r.levels
        if any(rare.values()):
            path = write_shared(seldom.select("feature", "value"))
        if ordinal:
            modes = counts.where(F.col("feature").isin(list(ordinal))).groupBy("feature")
            for r in modes.agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("first")).collect():
                frequent[r.feature] = r.first.value
    return EncoderState(scaled, kept, rare, frequent, {c: list(order[c]) for c in ordinal}, path)


def _level(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN"))


def _mark(i: int) -> str:
    return f"__infrequent_{i}"


def with_levels(df: DataFrame, state: EncoderState) -> DataFrame:
    """The frame with a mark per categorical column: its value is an infrequent level of
    training.  Spark broadcasts the level table where it is small, and shuffles by value
    where it is not; the frequent values, which can be most rows, have keys of their own."""
    known = None
    for i, c in enumerate(state.kept):
        if not state.infrequent[c]:
            continue
        known = df.sparkSession.read.schema(LEVELS).parquet(state.levels) if known is None else known
        mine = known.where(F.col("feature") == c).select(F.col("value").alias("__value"), F.lit(True).alias("__seen"))
        frequent = _level(c).isin(state.kept[c]) if state.kept[c] else F.lit(False)
        spread = F.concat(F.lit("\0"), (F.monotonically_increasing_id() % SPREAD).cast("string"))
        keyed = df.withColumn("__frequent", frequent).withColumn("__level", F.when(F.col("__frequent"), spread).otherwise(_level(c)))
        joined = keyed.join(mine, F.col("__level") == F.col("__value"), "left")
        mark = ~F.col("__frequent") & F.col("__seen").isNotNull()
        df = joined.withColumn(_mark(i), mark).drop("__frequent", "__level", "__value", "__seen")
    return df


def without_levels(df: DataFrame, state: EncoderState) -> DataFrame:
    return df.drop(*[_mark(i) for i in range(len(state.kept))])


def ordinal_code(c: Column, order: Sequence[str], fill: str | None) -> Column:
    """0-based place in the order, -1 for an unknown value."""
    v = F.coalesce(c.cast("string"), F.lit(fill)) if fill is not None else c.cast("string")
    place = F.array_position(F.array(*[F.lit(o) for o in order]), v)
    return F.coalesce(place - 1, F.lit(-1)).cast("double")


def encoded_columns(state: EncoderState) -> list[Column]:
    """Expressions over a frame that ``with_levels`` has marked."""
    cols = [
        ((F.coalesce(number(c), F.lit(median)) - F.lit(mean)) / F.lit(scale)).alias(c)
        for c, (median, mean, scale) in state.numeric.items()
    ]
    for i, (c, levels) in enumerate(state.kept.items()):
        cols += [(_level(c) == F.lit(level)).cast("double").alias(f"{c}_{level}") for level in levels]
        if state.infrequent[c]:
            cols.append(F.col(_mark(i)).cast("double").alias(f"{c}_infrequent"))
    cols += [ordinal_code(F.col(c), state.order[c], fill).alias(c) for c, fill in state.most_frequent.items()]
    return cols


def transform(df: DataFrame, state: EncoderState, keep: Sequence[str] = ()) -> DataFrame:
    """keep columns plus one double column per encoded name."""
    return with_levels(df, state).select(*[F.col(c).alias(f"_keep_{c}") for c in keep], *encoded_columns(state)).withColumnsRenamed(
        {f"_keep_{c}": c for c in keep if c not in state.names()})


def with_vector(df: DataFrame, state: EncoderState, output: str = "features") -> DataFrame:
    """The frame itself plus the encoded vector."""
    names = state.names()
    parts = [c.alias(f"_x_{i}") for i, c in enumerate(encoded_columns(state))]
    wide = without_levels(with_levels(df, state).select("*", *parts), state)
    temp = [f"_x_{i}" for i in range(len(names))]
    return VectorAssembler(inputCols=temp, outputCol=output).transform(wide).drop(*temp)


def check_finite(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Count of null, NaN or infinite values per column; raises if there are any."""
    row = df.agg(*[
        F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(f"b_{i}")
        for i, c in enumerate(columns)
    ]).first()
    bad = {c: row[f"b_{i}"] for i, c in enumerate(columns) if row[f"b_{i}"]}
    if bad:
        raise ValueError(f"null, NaN or infinite values in {bad}")
    return {c: 0 for c in columns}
