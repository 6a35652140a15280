"""Near-duplicate embeddings by hashing with the lattice E8.

Vectors of a label are projected onto random orthonormal directions, eight at a
time, scaled, and decoded to the nearest lattice points, which name the cell.
Every table has its own directions; a vector stands in its home cell and also looks
into neighbouring cells.  Vectors that meet are verified by cosine in double
precision, so only true links are reported; links that no table brings together
are missed, which the tables and probes keep rare.

Equal vectors are one class with a weight.  A link is counted where it is found
first, by table, so links are never written out as pairs: each bucket gives sums by
class and the links of a spanning forest.  The classes at home in a crowded cell are
cut into blocks, and those that look into it stream past each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.components import components
from riskframe.llm.lattice import cells, keys
from riskframe.llm.simhash import forest
from riskframe.operators.ordered import materialize

COSINE = 0.98
#: Tables; groups of eight directions in a key; cells looked into per group; scale.
TABLES, GROUPS, PROBES, SCALE = 4, 2, 2, 4.0
#: Classes at home in a cell that one task holds.
BLOCK = 8192
#: Crowded cells are sent to all tasks up to this many, and joined beyond it.
CROWDED_ROWS = 100_000
#: Rows, and pairs of a tile, held at a time.
ROWS, TILE = 20_000, 2_000_000

BOTH, HOME, GUEST = 0, 1, 2


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled first so that squares neither over- nor underflow."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cell_keys(x: np.ndarray, tables: int, groups: int, probes: int, scale: float) -> np.ndarray:
    """(rows, tables, cells looked into) keys of unit vectors; the first is home.
    The others move one group to a neighbouring cell."""
    n, dim = x.shape
    width = max(dim, 8 * groups)
    if dim < width:
        x = np.hstack([x, np.zeros((n, width - dim))])
    out = np.empty((n, tables, 1 + groups * (probes - 1)), dtype=np.int64)
    for t in range(tables):
        directions, _ = np.linalg.qr(np.random.default_rng([t, width]).standard_normal((width, 8 * groups)))
        # Projections of vectors that are linked shrink by the root of the share of directions.
        y = x @ directions * (scale * np.sqrt(width / 64))
        per = [keys(cells(y[:, 8 * g:8 * g + 8], probes), t * groups + g) for g in range(groups)]
        home = sum(p[:, 0] for p in per)
        out[:, t, 0] = home
        at = 1
        for p in per:
            for i in range(1, probes):
                out[:, t, at] = home - p[:, 0] + p[:, i]
                at += 1
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def _placed(classes: DataFrame, shape: tuple, with_vector: bool) -> DataFrame:
    """A row per class and cell it looks into; all vectors of a batch have one size
    because classes are handled by ``dim``."""
    tables, groups, probes, scale = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                for s in range(0, part.num_rows, 1024):
                    some = part.slice(s, 1024)
                    k = cell_keys(unit(_vectors(some.column(4))), tables, groups, probes, scale)
                    n, t, c = k.shape
                    rows = np.repeat(np.arange(n), t * c)
                    role = np.tile(np.where(np.arange(c) == 0, BOTH, GUEST), n * t)
                    vector = some.column(4).take(pa.array(rows)) if with_vector else pa.nulls(len(rows), some.column(4).type)
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0).take(take), some.column(1).take(take), pa.array(np.tile(np.repeat(np.arange(t), c), n).astype(np.int32)), pa.array(k.ravel()),
                         pa.array(role.astype(np.int32)), some.column(2).take(take), some.column(3).take(take), vector],
                        names=["label", "dim", "t", "cell", "role", "rep", "w", "vector"])

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    schema = f"label {kinds['label']}, dim int, t int, cell long, role int, rep long, w long, vector {kinds['vector']}"
    return classes.select("label", "dim", "rep", "w", "vector").mapInArrow(run, schema)


_KEY = ["label", "dim", "t", "cell", "block"]


def _met(placed: DataFrame, shape: tuple, cosine: float) -> DataFrame:
    """(a, b, n): class a has n links in this part; or, with null n, a spanning link."""
    tables, groups, probes, scale = shape

    def search(rows: pa.Table, bucket: np.ndarray) -> pa.RecordBatch:
        role, rep, w, t = (rows[c].to_numpy() for c in ("role", "rep", "w", "t"))
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(starts[1:], len(bucket))
        gained = np.zeros(len(bucket), dtype=np.int64)
        flat = rows["vector"].combine_chunks()
        flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
        dims = rows["dim"].to_numpy()
        forests: list[tuple[np.ndarray, np.ndarray]] = []
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def settle() -> None:
            """Count each verified pair where it is met first."""
            nonlocal held, waiting
            if not held:
                return
            i, j = (np.concatenate(x) for x in zip(*waiting))
            forests.append((i, j))
            for dim in np.unique(dims[i]):
                one = dims[i] == dim
                a, b = i[one], j[one]
                used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
                k = cell_keys(unit(_vectors(flat.take(pa.array(used)))), tables, groups, probes, scale)
                ka, kb = place[:len(a)], place[len(a):]
                new = np.ones(len(a), dtype=bool)
                for table in range(tables):
                    there = np.zeros(len(a), dtype=bool)
                    back = np.zeros(len(a), dtype=bool)
                    for c in range(k.shape[2]):
                        there |= k[kb, table, c] == k[ka, table, 0]
                        back |= k[ka, table, c] == k[kb, table, 0]
                    new &= ~((table < t[a]) & (there | back)) & ~((table == t[a]) & back & (rep[b] < rep[a]))
                np.add.at(gained, a[new], w[b[new]])
                np.add.at(gained, b[new], w[a[new]])
            waiting, held = [], 0

        for s, e in zip(starts.tolist(), ends.tolist()):
            homes = s + int(np.searchsorted(role[s:e], GUEST))
            if homes == s or e - s < 2 or (e - s == 2 and rep[s] == rep[s + 1]):
                continue
            x = unit(_vectors(flat.slice(s, homes - s)))
            others = np.arange(s, e)[role[s:e] != HOME]
            step = max(1, TILE // len(x))
            for p in range(0, len(others), step):
                other = others[p:p + step]
                y = unit(_vectors(flat.take(pa.array(other))))
                a, b = np.nonzero(x @ y.T >= cosine)
                a, b = a + s, other[b]
                apart = rep[a] != rep[b]
                waiting.append((a[apart], b[apart]))
                held += int(apart.sum())
                if held >= TILE:
                    settle()
        settle()
        label = forest(len(bucket), iter(forests))
        tied = np.flatnonzero(label != np.arange(len(bucket)))
        some = np.flatnonzero(gained)
        return pa.RecordBatch.from_arrays([
            pa.array(np.append(rep[some], rep[tied])), pa.array(np.append(np.zeros(len(some), np.int64), rep[label[tied]])),
            pa.array(np.append(gained[some], np.zeros(len(tied), np.int64)), mask=np.append(np.zeros(len(some), bool), np.ones(len(tied), bool)))],
            names=["a", "b", "n"])

    def buckets(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, dtype=bool)
        for c in _KEY:
            v = rows[c].combine_chunks()
            codes = v.dictionary_encode()
            codes = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < ROWS:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            bucket = buckets(rows)
            at = int(np.searchsorted(bucket, bucket[-1]))
            if at:
                yield search(rows.slice(0, at), bucket[:at])
            rows = rows.slice(at)
            role = rows["role"].to_numpy()
            if role[-1] == GUEST and rows.num_rows >= ROWS:
                # A crowded cell: those at home stay, the guests so far have been met.
                yield search(rows, np.zeros(rows.num_rows, dtype=np.int64))
                rows = rows.slice(0, int(np.searchsorted(role, GUEST)))
                stay = pa.array(np.full(rows.num_rows, HOME, dtype=np.int32))
                rows = rows.set_column(rows.schema.get_field_index("role"), "role", stay)
            held, n = rows.to_batches(), 0 if role[-1] == GUEST else rows.num_rows
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            if rows.num_rows:
                yield search(rows, buckets(rows))

    return placed.mapInArrow(run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, tables: int = TABLES, groups: int = GROUPS, probes: int = PROBES, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, ``n_links`` (other vectors of the label found at
    ``cosine`` or more), ``component_id`` (smallest id reachable by links), ``kept``.

    A row whose label or vector is null, or whose vector is empty, all zero or has a
    null or non-finite entry, links with nothing and is its own component.  Vectors
    of different sizes do not link.  Repeated rows link like equal vectors (a row
    that repeats an id counts as another vector).  An empty table gives no rows;
    other columns are ignored.  ``scale`` fits a cosine of about 0.98."""
    shape = (tables, groups, probes, scale)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fit = F.coalesce(F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0), F.lit(False))
    classes = materialize(rows.where(fit).groupBy("label", "vector").agg(F.min("id").cast("long").alias("rep"), F.count("*").alias("w")).where("rep is not null"))
    sized = classes.withColumn("dim", F.size("vector"))

    sizes = _placed(sized, shape, False).where(F.col("role") == BOTH).groupBy("label", "dim", "t", "cell").agg(F.count("*").alias("at_home"))
    crowded = materialize(sizes.where(F.col("at_home") > block))
    placed = _placed(sized, shape, True)
    placed = placed.join(F.broadcast(crowded) if crowded.count() <= CROWDED_ROWS else crowded, ["label", "dim", "t", "cell"], "left")
    blocks = F.ceil(F.coalesce("at_home", F.lit(1)) / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks.cast("long")).cast("int")
    each = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(b.alias("block"), F.when((F.col("role") == BOTH) & (b == own), BOTH).otherwise(GUEST).alias("role")))
    placed = placed.withColumn("p", F.explode(each)).select("label", "dim", "t", "cell", "p.block", "p.role", "rep", "w", "vector")
    placed = placed.repartition(*_KEY).sortWithinPartitions(*_KEY, "role")

    met = materialize(_met(placed, shape, cosine))
    links = met.where("n is not null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    tied = components(met.where("n is null").select("a", "b")).withColumnRenamed("node", "rep")
    known = classes.join(links, "rep", "left").join(tied, "rep", "left").select(
        "label", "vector", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    joined = rows.withColumn("fit", fit).join(known, ["label", "vector"], "left")
    component = F.when(F.col("fit"), F.col("component"))
    component = F.coalesce(component, F.col("id").cast("long"))
    return joined.select(
        F.col("id").alias(id_col), F.when(F.col("fit"), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("id").cast("long").eqNullSafe(component).alias("kept"))
