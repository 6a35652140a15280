"""Intake of flat loan applications into four tables, each application whole or not at all.

An application becomes a customer, a loan, a financial and a credit row.  If one of
them breaks a constraint, none is stored.  The rows of an intake are written to a
folder of their own that nobody reads yet; one small manifest file then makes all four
tables' rows visible at once.  An intake that dies before leaves nothing behind that
a reader sees.  Manifest files are numbered and never overwritten, so of two writers that
started from the same state one gets a conflict and can run again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators.constraints import CHECKS, NOT_NULL, UNIQUE_NAMES
from riskframe.operators.joins import intake_split
from riskframe.operators.ordered import Scratch, materialize

TABLES = ("customers", "loan_applications", "financial_profiles", "credit_history")
#: Columns of a flat application that no two stored applications share.
KEYS = {"customers": "customer_id", "loan_applications": "loan_id"}


class IntakeConflict(Exception):
    """Another intake was stored since this one began."""


@dataclass
class Intake:
    number: int
    stored: int
    issues: DataFrame  # loan_id, customer_id, rule_name of applications that were not stored


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []


def _numbers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n) for n in _files(spark, f"{root}/manifest")[1] if n.isdigit())


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    """The four tables as stored so far; None before the first intake."""
    if not _numbers(spark, root):
        return None
    folders = [r["value"] for r in spark.read.text(f"{root}/manifest").where("value <> ''").collect()]
    return {t: spark.read.parquet(*[f"{root}/data/{f}/{t}" for f in sorted(folders)]) for t in TABLES}


def _first_break(applications: DataFrame) -> Column:
    """The first not-null or check constraint of the four rows that an application breaks."""
    tests = []
    for t in TABLES:
        present = intake_split(applications)[t].columns
        tests += [F.when(F.col(c).isNull(), f"not_null_violation:{t}.{c}") for c in NOT_NULL[t] if c in present and c in applications.columns]
        tests += [F.when(~F.expr(condition), name) for name, condition in CHECKS[t].items()]
    return F.coalesce(*tests)


def _conflicts(rows: DataFrame, stored: dict[str, DataFrame] | None) -> DataFrame:
    """Add ``_rule``: the key that is stored already."""
    rule = F.lit(None).cast("string")
    for t, key in KEYS.items() if stored else ():
        known = stored[t].select(F.col(key).alias("_known")).distinct()
        rows = rows.join(known, F.col(key) == F.col("_known"), "left").withColumn(f"_has_{t}", F.col("_known").isNotNull()).drop("_known")
        rule = F.coalesce(rule, F.when(F.col(f"_has_{t}"), UNIQUE_NAMES[t]))
    return rows.withColumn("_rule", rule).drop(*[f"_has_{t}" for t in KEYS])


def _first_come(rows: DataFrame, order_by: Sequence[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``_rule``): in the given order an application is accepted
    unless an earlier accepted one has its customer or loan.  Each round accepts those
    that are first for both and rejects what they exclude; chains of exclusions are short."""
    order = F.struct(*[F.col(c) for c in order_by], "_nth")
    open_, accepted, rejected = rows, [], []
    while not open_.isEmpty():
        marked = open_
        for t, key in KEYS.items():
            first = open_.groupBy(F.col(key).alias(f"_k_{t}")).agg(F.min(order).alias(f"_first_{t}"))
            marked = marked.join(first, F.col(key) == F.col(f"_k_{t}"))
        first = reduce(lambda a, b: a & b, [order == F.col(f"_first_{t}") for t in KEYS])
        taken = scratch.write(marked.where(first).select(*rows.columns))
        rest = _conflicts(open_.join(taken.select("_nth"), "_nth", "left_anti"), {t: taken for t in KEYS})
        rest = scratch.write(rest)
        accepted.append(taken)
        rejected.append(rest.where("_rule is not null"))
        open_ = rest.where("_rule is null").drop("_rule")
    none = rows.limit(0)
    return reduce(DataFrame.unionByName, accepted, none), reduce(DataFrame.unionByName, rejected, none.withColumn("_rule", F.lit("")))


def take_in(spark: SparkSession, root: str, applications: DataFrame, order_by: Sequence[str]) -> Intake:
    """Store flat applications under ``root``.

    ``order_by`` says which application came first; equal ones are taken in any order.  Applications
    with a null or a value that a table refuses, of a stored customer or loan, or of one
    that an earlier application of this intake has, come out in ``issues``.  An empty
    intake is stored as such.  Columns beyond those of the tables are ignored."""
    number = max(_numbers(spark, root), default=0) + 1
    stored = read_tables(spark, root)
    scratch = Scratch(spark)
    rows = scratch.write(applications.withColumn("_nth", F.monotonically_increasing_id()))
    checked = scratch.write(_conflicts(rows, stored).withColumn("_rule", F.coalesce(_first_break(applications), "_rule")))
    accepted, late = _first_come(checked.where("_rule is null").drop("_rule"), order_by, scratch)
    folder = f"{number:09d}-{uuid.uuid4().hex}"
    for t, df in intake_split(accepted).items():
        df.write.parquet(f"{root}/data/{folder}/{t}")
    refused = checked.where("_rule is not null").unionByName(late).select("loan_id", "customer_id", F.col("_rule").alias("rule_name"))
    issues = materialize(refused)
    count = accepted.count()
    _commit(spark, root, number, folder)
    scratch.clear()
    return Intake(number, count, issues)


def _commit(spark: SparkSession, root: str, number: int, folder: str) -> None:
    fs, _ = _files(spark, f"{root}/manifest")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/{number}")
    try:
        out = fs.create(path, False)
    except Exception as e:
        if fs.exists(path):
            raise IntakeConflict(f"intake {number} was stored by another writer") from e
        raise
    out.write(bytearray(folder.encode()))
    out.close()
