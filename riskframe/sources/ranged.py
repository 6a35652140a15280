"""A table in files of key ranges, where an upsert rewrites only the ranges it touches.

A state of the table lists its pieces in key order: the lowest key that belongs to a
piece, its folder and its rows.  An upsert finds the pieces that its keys fall into,
merges and rewrites those, writes the new list, and claims the next number by
creating one small file that no writer overwrites.  Until then readers see the old
state; of two writers that began from the same state one gets a conflict.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.operators.ordered import Scratch
from riskframe.sources.tables import read_json, write_json

#: Rows from which a piece is split.
ROWS_PER_PIECE = 1_000_000
RANGE, SLICE = "_range_of_key", "_slice_of_range"
KEY_TYPES = (T.IntegralType, T.StringType, T.DateType, T.DecimalType)


class WriteConflict(Exception):
    """Another writer changed the table since this one read it."""


@dataclass(frozen=True)
class Piece:
    low: list[str] | None  # the lowest key of the range; None: no key is too low
    path: str  # below the table's folder; empty: no row yet
    rows: int


@dataclass(frozen=True)
class State:
    number: int
    key: list[str]
    schema: T.StructType
    pieces: list[Piece]


def _at(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _claims(spark: SparkSession, root: str) -> list[int]:
    fs, path = _at(spark, f"{root}/claims")
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n) for n in names if n.isdigit())


def _claimed(spark: SparkSession, root: str, number: int) -> str | None:
    """The folder that a claim names; None if its writer has not finished it."""
    row = spark.read.text(f"{root}/claims/{number}").first()
    return row["value"] if row and row["value"] else None


def state(spark: SparkSession, root: str) -> State | None:
    """The newest state; None before the first write."""
    for number in reversed(_claims(spark, root)):
        folder = _claimed(spark, root, number)
        if folder:
            raw = read_json(spark, f"{root}/data/{folder}/state")
            return State(number, raw["key"], T.StructType.fromJson(raw["schema"]), [Piece(*p) for p in raw["pieces"]])
    return None


def _rows(spark: SparkSession, root: str, at: State, pieces: Sequence[Piece]) -> DataFrame:
    paths = [f"{root}/{p.path}" for p in pieces if p.path]
    return spark.read.schema(at.schema).parquet(*paths) if paths else spark.createDataFrame([], at.schema)


def read(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the newest state."""
    now = state(spark, root)
    if now is None:
        raise FileNotFoundError(f"no table at {root}")
    return _rows(spark, root, now, now.pieces)


def _key_of(at: State, low: list[str]) -> Column:
    return F.struct(*[F.lit(v).cast(at.schema[c].dataType).alias(c) for c, v in zip(at.key, low)])


def _range(at: State) -> Column:
    """Number of the piece that a row's key belongs to, by bisection over the lowest keys."""
    lows = [p.low for p in at.pieces[1:]]
    if not lows:
        return F.lit(0)
    bounds, key = F.array(*[_key_of(at, low) for low in lows]), F.struct(*at.key)

    def halve(between: Column, _: Column) -> Column:
        middle = ((between["low"] + between["high"]) / 2).cast("int")
        open_ = between["low"] < between["high"]
        right = open_ & (F.get(bounds, middle) <= key)
        return F.struct(
            F.when(right, middle + 1).otherwise(between["low"]).alias("low"),
            F.when(open_ & ~right, middle).otherwise(between["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(lows)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(lows).bit_length())), start, halve, lambda b: b["low"])


def read_key(spark: SparkSession, root: str, *values) -> DataFrame:
    """The row of one key, from the one piece that can hold it."""
    now = state(spark, root)
    if now is None:
        raise FileNotFoundError(f"no table at {root}")
    one = spark.range(1).select(*[F.lit(v).cast(now.schema[c].dataType).alias(c) for c, v in zip(now.key, values)])
    piece = now.pieces[one.select(_range(now)).first()[0]]
    found = _rows(spark, root, now, [piece])
    for c, v in zip(now.key, values):
        found = found.where(F.col(c) == F.lit(v))
    return found


def _write(rows: DataFrame, key: Sequence[str], path: str) -> None:
    rows.sortWithinPartitions(RANGE, SLICE, *key).write.partitionBy(RANGE, SLICE).parquet(path)


def _written(spark: SparkSession, root: str, path: str, at: State) -> dict[int, list[Piece]]:
    """Pieces in key order by the range they were written for."""
    schema = T.StructType([*at.schema.fields, T.StructField(RANGE, T.IntegerType()), T.StructField(SLICE, T.IntegerType())])
    least = spark.read.schema(schema).parquet(f"{root}/{path}").groupBy(RANGE, SLICE).agg(F.min(F.struct(*at.key)).alias("k"), F.count("*").alias("n"))
    out: dict[int, list[Piece]] = {}
    for r in least.select(RANGE, SLICE, F.array(*[F.col(f"k.{c}").cast("string") for c in at.key]).alias("low"), "n").orderBy(RANGE, SLICE).collect():
        out.setdefault(r[0], []).append(Piece(r.low, f"{path}/{RANGE}={r[0]}/{SLICE}={r[1]}", r.n))
    return out


def upsert(spark: SparkSession, root: str, changes: DataFrame, key: Sequence[str], rows_per_piece: int = ROWS_PER_PIECE) -> State:
    """Add the rows of ``changes``, or replace those of equal keys, in the table at ``root``.

    The first call creates the table with the columns of ``changes``; later ones must have
    all of its columns, and others are ignored.  Keys are integers, texts, dates or decimals, not null, and
    unique in ``changes``; anything else is an error before something is written.  No
    changes leave the table as it is.  The driver holds one entry per piece."""
    before = state(spark, root)
    if before is None:
        before = State(0, list(key), changes.schema, [Piece(None, "", 0)])
    if before.key != list(key):
        raise ValueError(f"the key of the table is {before.key}")
    if any(not isinstance(before.schema[c].dataType, KEY_TYPES) for c in key):
        raise ValueError(f"no ranges over the types of {list(key)}")
    scratch = Scratch(spark)
    try:
        changes = scratch.write(changes.select(*[F.col(f.name).cast(f.dataType) for f in before.schema]).withColumn(RANGE, _range(before)))
        missing = F.greatest(*[F.col(c).isNull() for c in key], F.lit(False))
        if not changes.groupBy(*key).agg(F.count("*").alias("_rows_of_key")).where((F.col("_rows_of_key") > 1) | missing).isEmpty():
            raise ValueError(f"keys {list(key)} of the changes are null or not unique")
        fresh = dict(changes.groupBy(RANGE).count().collect())
        if not fresh and before.number:
            return before
        folder = f"{before.number + 1:09d}-{uuid.uuid4().hex}"
        after = _merge(spark, root, before, changes, fresh, folder, rows_per_piece)
        pieces = [[p.low, p.path, p.rows] for p in after.pieces]
        write_json(spark, {"key": after.key, "schema": after.schema.jsonValue(), "pieces": pieces}, f"{root}/data/{folder}/state")
        _claim(spark, root, after.number, folder)
        return after
    finally:
        scratch.clear()


def _merge(spark: SparkSession, root: str, before: State, changes: DataFrame, fresh: dict[int, int], folder: str, rows_per_piece: int) -> State:
    """Write the touched pieces anew; those that are too large now are split by key."""
    key = before.key
    old = _rows(spark, root, before, [before.pieces[i] for i in sorted(fresh)]).withColumn(RANGE, _range(before))
    keys = changes.select(*key)
    replaced = dict(old.select(RANGE, *key).join(keys, key, "left_semi").groupBy(RANGE).count().collect())
    size = {i: before.pieces[i].rows + n - replaced.get(i, 0) for i, n in fresh.items()}
    merged = old.join(keys, key, "left_anti").unionByName(changes)
    large = [i for i, n in size.items() if n > rows_per_piece]
    in_large = F.col(RANGE).isin(large)
    written: dict[int, list[Piece]] = {}
    if len(large) < len(size):
        _write(merged.where(~in_large).repartition(len(size) - len(large), RANGE).withColumn(SLICE, F.lit(0)), key, f"{root}/data/{folder}/rows")
        written |= _written(spark, root, f"data/{folder}/rows", before)
    if large:
        # Halves of the limit, so that the next few rows do not split them again.
        slices = -(-2 * sum(size[i] for i in large) // rows_per_piece)
        split = merged.where(in_large).repartitionByRange(slices, RANGE, *key).withColumn(SLICE, F.spark_partition_id())
        _write(split, key, f"{root}/data/{folder}/split")
        written |= _written(spark, root, f"data/{folder}/split", before)
    pieces = []
    for i, p in enumerate(before.pieces):
        new = written.get(i, [p])
        # The first keeps the bound of the range: keys below its first row still belong there.
        pieces += [Piece(p.low, new[0].path, new[0].rows), *new[1:]]
    return State(before.number + 1, key, before.schema, pieces)


def _claim(spark: SparkSession, root: str, number: int, folder: str) -> None:
    fs, path = _at(spark, f"{root}/claims/{number}")
    try:
        if any(n >= number for n in _claims(spark, root)):
            raise WriteConflict(f"state {number} of {root} is another writer's")
        try:
            out = fs.create(path, False)
        except Exception as e:
            if fs.exists(path):
                raise WriteConflict(f"state {number} of {root} is another writer's") from e
            raise
    except WriteConflict:
        fs.delete(_at(spark, f"{root}/data/{folder}")[1], True)
        raise
    out.write(bytearray(folder.encode()))
    out.close()


def drop_unfinished(spark: SparkSession, root: str) -> int:
    """Remove claims whose writer died before it named its folder; they block all later
    writes.  How many there were.  To be called while no writer runs."""
    fs, gone = _at(spark, root)[0], 0
    for number in _claims(spark, root):
        if _claimed(spark, root, number) is None:
            fs.delete(_at(spark, f"{root}/claims/{number}")[1], False)
            gone += 1
    return gone
