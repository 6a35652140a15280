"""Exact global order without a single-task window.

Positions and running sums over a whole table are the one thing a plain window
cannot do at scale: without ``partitionBy`` every row goes to one task, and with
a coarse bucket a hot bucket does.  Here the table is range-partitioned on its
(unique) order columns, so slices are even whatever the value distribution; the
slice id is written down once, per-slice totals are summed into offsets, and the
window runs inside each slice.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Up to this many rows one task may order a table; the count is checked first.
ROWS_PER_TASK = 1_000_000
# Bytes of bytecode up to which Spark runs a stage as one generated method.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
# Whether shuffle files are deleted with the execution that wrote them, or when Java collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# A wide job over many keys is done in slices of about so many rows, and in so many slices at most.
SLICE_ROWS, MOST_SLICES = 8_000_000, 6
#: Tables written in the innermost block of ``passing``.
_PASSING: ContextVar[Scratch | None] = ContextVar("passing", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: the session's ``spark.checkpoint.dir``.  Only a
    local session without one gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="riskframe-"))
    return spark.sparkContext.getCheckpointDir()


def write_shared(df: DataFrame) -> str:
    """Write a table to a new place in the shared folder; its path."""
    path = f"{shared_dir(df.sparkSession)}/riskframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and
    survives lost executors.  One that is written inside of ``passing`` goes with the block."""
    held = _PASSING.get()
    return held.write(df) if held else df.sparkSession.read.schema(df.schema).parquet(write_shared(df))


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose written tables are deleted at its end, and whose shuffle files go with
    each execution.  The disk then holds what one step needs, not what all steps wrote.
    The function it gives writes a table that outlives the block."""
    held = Scratch(spark)
    before, token = spark.conf.get(SHUFFLE_CLEANUP, None), _PASSING.set(held)

    def keep(df: DataFrame) -> DataFrame:
        inner = _PASSING.set(token.old_value if isinstance(token.old_value, Scratch) else None)
        try:
            return materialize(df)
        finally:
            _PASSING.reset(inner)

    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield keep
    finally:
        _PASSING.reset(token)
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
        held.clear()


@contextmanager
def lasting() -> Iterator[None]:
    """A block whose written tables stay, also inside of ``passing``."""
    token = _PASSING.set(None)
    try:
        yield
    finally:
        _PASSING.reset(token)


def slices_of(rows: int) -> int:
    """Slices for a job over so many rows."""
    return max(1, min(MOST_SLICES, rows // SLICE_ROWS))


def slice_of(key: str | Column, n: int) -> Column:
    """The slice that rows of a key are in; equal keys are in the same one."""
    return F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key), F.lit(n)).cast("int")


def write_slices(df: DataFrame, key: str, n: int, write: Callable[[DataFrame], DataFrame] = materialize) -> list[DataFrame]:
    """The table written once, its rows told apart by the slice of a key, and its slices.  A
    slice reads its own files only."""
    if n == 1:
        return [write(df)]
    path = f"{shared_dir(df.sparkSession)}/riskframe-{uuid.uuid4().hex}"
    df.withColumn("_slice", slice_of(key, n)).write.partitionBy("_slice").parquet(path)
    if held := _PASSING.get():
        held.paths.append(path)
    table = read_slices(df.sparkSession, path, df.schema)
    return [table.where(F.col("_slice") == i).drop("_slice") for i in range(n)]


def read_slices(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table in folders by slice, with the column ``_slice``."""
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema.fields)}, _slice int").parquet(path)


def join_slices(parts: Sequence[DataFrame], write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows of tables that are made and written one after the other."""
    return reduce(DataFrame.unionByName, [write(p) for p in parts])


def compile_whole(spark: SparkSession) -> None:
    """Have Spark split generated code that the JVM would not compile.  A stage over many
    columns becomes one method; above 8000 bytes of bytecode the JVM interprets it, several
    times slower.  With this limit Spark runs such a stage by operators, in small methods
    that are compiled.  Results are the same; a limit that the session has set stays."""
    if spark.conf.get(METHOD_LIMIT, None) in (None, "65535"):  # Spark's default
        spark.conf.set(METHOD_LIMIT, "8000")


class Scratch:
    """Tables written to the shared folder that are deleted once nothing reads them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame) -> DataFrame:
        self.paths.append(write_shared(df))
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def clear(self) -> None:
        while self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _slices(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    return max(2, -(-rows // rows_per_task))


def running_sums(
    df: DataFrame,
    order_by: Sequence[str | Column],
    values: Sequence[str],
    group_by: Sequence[str] = (),
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add ``cum_<v>``, the inclusive running sum of each value column in the
    given order, over all rows or per group.  ``order_by`` must be unique (per
    group).  The input is written out once, pre-aggregated by the caller."""
    rows_per_task = rows_per_task or ROWS_PER_TASK
    table = materialize(df)
    rows = table.count()
    group = list(group_by)
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    if rows <= rows_per_task:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return table.select("*", *[F.sum(v).over(w).alias(f"cum_{v}") for v in values])

    keys = [F.col(g).asc() for g in group] + order
    sliced = materialize(
        table.repartitionByRange(_slices(df.sparkSession, rows, rows_per_task), *keys)
        .withColumn("_slice", F.spark_partition_id())
    )
    totals = sliced.groupBy(*group, "_slice").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    # One row per slice (and group boundary), so this window is over slice ids, not rows.
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, "_slice",
        *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values],
    )
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = sliced.select("*", *[F.sum(v).over(inside).alias(f"_s_{v}") for v in values])
    joined = summed.join(offsets, [*group, "_slice"])
    return joined.select(
        *table.columns, *[(F.col(f"_s_{v}") + F.col(f"_o_{v}")).alias(f"cum_{v}") for v in values]
    )


def positions(
    df: DataFrame,
    order_by: Sequence[str | Column],
    group_by: Sequence[str] = (),
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add ``position``: the 1-based place of each row in the given unique order."""
    out = running_sums(df.withColumn("_one", F.lit(1).cast("long")), order_by, ["_one"], group_by, rows_per_task)
    return out.drop("_one").withColumnRenamed("cum__one", "position")
