"""Exact copies through an extendible-hash index on shared files.

Every text, white space deleted, gets a 64-bit key.  The leading bits of the key
name its bucket: a directory of 2^depth entries starts with one bucket, and a
bucket with more distinct keys than its capacity is split by its next bit, the
directory doubling when it has no bit left.  An entry is one text, found by comparing
all its bytes, so colliding keys stay apart.  The directory names buckets but places
no rows: bucket, key and text are grouped by hash, so that a crowded bucket or key is
spread over tasks and combined before the shuffle.

Only keys that occur more than once meet their texts again.  That join is salted
and equal texts are combined before they are shuffled, so a group of copies that
holds a third of all rows costs each task one row.  Only DataFrame functions.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import BLANKS, whole_text
from riskframe.operators.ordered import materialize

#: Distinct keys that a bucket may hold before it is split.
CAPACITY = 100_000
#: Bits by which the directory may grow; it is broadcast, with at most 2^16 rows.
MAX_DEPTH = 16
#: Tasks that share the rows of one key while texts are compared.
SALTS = 16

_WIDE = Decimal(2**64)
_TOP = Decimal(2**63 - 1)


def normalised(text: Column) -> Column:
    """The text without blanks and \\x09 to \\x0D."""
    return F.translate(text, BLANKS, "")


def _rank(text: Column, key: Column) -> Column:
    """One number that orders rows by code points, then by descending id."""
    points = F.length(text).cast("decimal(10,0)") * F.lit(_WIDE)
    return (points + (F.lit(_TOP) - key.cast("decimal(20,0)"))).cast("decimal(38,0)")


def directory(prefixes: dict[int, int], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """(depth, bucket of each of the 2^depth directory entries) from the number of
    distinct keys per ``max_depth``-bit prefix.  A bucket is named by the first
    entry that points to it.  Buckets that no bit can split stay overfull."""
    sums = [dict(prefixes)]
    for _ in range(max_depth):
        up: dict[int, int] = {}
        for p, n in sums[-1].items():
            up[p >> 1] = up.get(p >> 1, 0) + n
        sums.append(up)
    sums.reverse()  # sums[d]: keys per d-bit prefix
    leaves, overfull = [], [(0, 0)]
    while overfull:
        depth, prefix = overfull.pop()
        if sums[depth].get(prefix, 0) > capacity and depth < max_depth:
            overfull += [(depth + 1, 2 * prefix), (depth + 1, 2 * prefix + 1)]
        else:
            leaves.append((depth, prefix))
    top = max(d for d, _ in leaves)
    entries = [0] * (1 << top)
    for depth, prefix in leaves:
        first = prefix << (top - depth)
        entries[first:first + (1 << (top - depth))] = [first] * (1 << (top - depth))
    return top, entries


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256`` of the normalised text.

    Null texts count as empty and are copies of each other; of equal texts the one
    with the most code points stays, then the smallest id.  Rows that repeat an id
    are counted each; each of them is kept if the id is.  Null ids stay rows and
    lose ties.  An empty table gives an empty result; other columns are ignored.
    ``key`` replaces the 64-bit hash of the normalised text (column ``norm``)."""
    spark = docs.sparkSession
    text = whole_text(text_col)
    key = F.xxhash64("norm") if key is None else key
    rows = docs.select(F.col(id_col).alias("id"), normalised(text).alias("norm"), text.alias("text"))
    rows = rows.withColumn("key", key)
    leaves = materialize(rows.select("id", "key", F.sha2("norm", 256).alias("sha")))

    # The directory, from distinct keys per prefix: at most 2^max_depth small rows.
    per_key = leaves.groupBy("key").agg(F.count("*").alias("n"))
    prefix = F.shiftrightunsigned("key", 64 - max_depth)
    found = per_key.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n")).collect()
    depth, entries = directory({r["prefix"]: r["n"] for r in found}, capacity, max_depth)
    slots = spark.createDataFrame(list(enumerate(entries)), "slot long, bucket long")

    def placed(df: DataFrame) -> DataFrame:
        if not depth:
            return df.withColumn("bucket", F.lit(0).cast("long"))
        slot = F.shiftrightunsigned("key", 64 - depth)
        return df.withColumn("slot", slot).join(F.broadcast(slots), "slot").drop("slot")

    # Texts of repeated keys, chained within their bucket by their bytes.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    repeated = per_key.where("n > 1").select("key", salts.alias("salt"))
    texts = rows.select("key", "norm", _rank(F.col("text"), F.col("id")).alias("rank"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    texts = texts.join(repeated.hint("shuffle_hash"), ["key", "salt"], "left_semi")
    chained = placed(texts).groupBy("bucket", "key", "norm").agg(F.count("*").alias("size"), F.max("rank").alias("best"))
    keep = (F.lit(_TOP) - F.col("best") % F.lit(_WIDE)).cast("long")
    index = materialize(chained.select("bucket", "key", F.sha2("norm", 256).alias("sha"), "size", keep.alias("keep")))

    joined = placed(leaves).join(index, ["bucket", "key", "sha"], "left")
    keep_id = F.coalesce("keep", "id")
    return joined.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        keep_id.eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"),
    )
