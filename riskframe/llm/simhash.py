"""SimHash near-duplicates through a Gray-order hierarchical index.

Documents with equal fingerprints are one class.  Classes within the allowed
distance agree on some blocks of their bits, so tables keyed by those blocks bring
them together without a cross join.  Inside a bucket fingerprints are sorted by
Gray rank, in which neighbours differ in few bits, and an index is built over the
order: a node holds the bits that all fingerprints below it share, as a mask and a
pattern.  A search adds up, from the root down, the differing bits of each node's
new mask, and drops a whole group once the sum is over the limit.

A bucket gives the links of a spanning forest, never all its pairs.  Buckets with
too many classes are keyed by further blocks before any task takes them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.components import components
from riskframe.operators.ordered import materialize

WORDS, DISTANCE = 3, 3
#: Bits of the fingerprints that verify a link.
CHECK_BITS = 256
#: Children of an index node.
FANOUT = 16
#: Classes of a bucket above which it is keyed by further blocks.
BUCKET = 20_000
#: Query and node pairs held at a time.
FRONTIER = 2_000_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BYTE_BITS = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], dtype=np.int64)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` lower-cased words, blank-joined; a
    text with fewer words is one run."""
    found = text.translate(_LOWER).split()
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = [digest(joined, 42)] if found else []
    else:
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ends = np.cumsum(sizes + 1) - 1
        hashes = [digest(joined[a:b], 42) for a, b in zip((ends - sizes).tolist(), ends[words - 1:].tolist())]
    return np.array(hashes, dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes; without hashes, 0."""
    table = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(table[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    h = (hashes ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, distinct: bool = False, check_words: int | None = None) -> DataFrame:
    """id, ``fp`` (a signed long) and ``check``: with ``check_words``, fingerprints of
    CHECK_BITS bits in all of the distinct shingles of so many words.  With
    ``distinct``, repeats of a shingle count once in ``fp`` too.  Null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, checks = [], []
            for text in batch.column(1).cast(pa.binary()):
                text = text.as_py() or b""
                hashes = shingle_hashes(text, words)
                fps.append(fingerprint(np.unique(hashes) if distinct else hashes))
                if check_words is not None:
                    hashes = np.unique(shingle_hashes(text, check_words))
                    checks += [fingerprint(_mixed(hashes, i + 1)) for i in range(CHECK_BITS // 64)]
            per = len(checks) // max(1, len(fps))
            flat = pa.array(np.array(checks, dtype=np.uint64).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1) * per, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), lists], names=["id", "fp", "check"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long, check array<long>")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Index over fingerprints that are sorted by bucket, then by Gray rank."""

    def __init__(self, fp: np.ndarray, bucket: np.ndarray):
        full = np.full(len(fp), np.uint64(2**64 - 1))
        # From the leaves up: mask, pattern, and the range of children of each node.
        self.levels = [(full, fp, None, None)]
        owner = bucket
        while len(owner) and len(owner) > owner[-1] + 1 or len(self.levels) == 1:
            mask, pattern, _, _ = self.levels[-1]
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            first = np.flatnonzero(place % FANOUT == 0)
            ends = np.append(first[1:], len(owner))
            ones, zeros = np.bitwise_and.reduceat(pattern & mask, first), np.bitwise_and.reduceat(~pattern & mask, first)
            self.levels.append((ones | zeros, ones, first, ends))
            owner = owner[first]
        self.root = np.searchsorted(owner, np.arange(int(owner[-1]) + 1)) if len(owner) else owner
        self.bucket, self.fp = bucket, fp

    def pairs(self, limit: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places within ``limit`` bits in one bucket, the earlier first."""
        for start in range(0, len(self.fp), FRONTIER // FANOUT):
            query = np.arange(start, min(len(self.fp), start + FRONTIER // FANOUT))
            top = len(self.levels) - 1
            root = self.root[self.bucket[query]]
            mask, pattern, _, _ = self.levels[top]
            differing = np.bitwise_count((self.fp[query] ^ pattern[root]) & mask[root]).astype(np.int64)
            yield from self._below(top, query, root, differing, limit)

    def _below(self, level: int, query: np.ndarray, node: np.ndarray, differing: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if level == 0:
            later = (differing <= limit) & (node > query)
            yield query[later], node[later]
            return
        open_ = differing <= limit
        query, node, differing = query[open_], node[open_], differing[open_]
        mask, _, first, ends = self.levels[level]
        below_mask, below_pattern, _, _ = self.levels[level - 1]
        step = max(1, FRONTIER // FANOUT)
        for s in range(0, len(query), step):
            q, n, d = query[s:s + step], node[s:s + step], differing[s:s + step]
            count = ends[n] - first[n]
            child = np.repeat(first[n] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
            q, parent = np.repeat(q, count), np.repeat(n, count)
            fresh = below_mask[child] & ~mask[parent]
            d = np.repeat(d, count) + np.bitwise_count((self.fp[q] ^ below_pattern[child]) & fresh)
            yield from self._below(level - 1, q, child, d, limit)


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n places the smallest place that the pairs connect it with."""
    label = np.arange(n)
    for a, b in pairs:
        while len(a):
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
    return label


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    """The bits cut into so many runs of nearly equal length."""
    cut = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:])]


def _taken(fp: Column, bits: list[int]) -> Column:
    return fp.bitwiseAND(F.lit(sum(1 << b for b in bits) - (1 << 64 if 63 in bits else 0)))


def _tables(classes: int, distance: int) -> list[list[int]]:
    """Bit sets such that fingerprints within the distance agree on all bits of one
    of them.  More classes take longer keys; what is found is the same."""
    parts = distance + 1
    while parts < distance + 6 and 64 * (parts - distance) // parts < classes.bit_length() - 4:
        parts += 1
    blocks = _blocks(list(range(64)), parts)
    return [sum(c, []) for c in combinations(blocks, parts - distance)]


def links(classes: DataFrame, count: int, distance: int = DISTANCE, bucket_rows: int = BUCKET, check_distance: int | None = None) -> DataFrame:
    """Edges (a, b) between ``rep`` of classes whose ``fp`` are within the distance (and
    ``check`` within its own): of every bucket a spanning forest."""
    tables = _tables(count, distance)
    keyed = classes.select("fp", "rep", "check", F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), _taken(F.col("fp"), bits).alias("key")) for i, bits in enumerate(tables)])).alias("k")).select("fp", "rep", "check", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n"))
    keyed = keyed.join(sizes, ["t", "key"])
    # Buckets too large for one task: agree on one more of the blocks of the other bits.
    further = []
    for t, bits in enumerate(tables):
        rest = _blocks([b for b in range(64) if b not in bits], distance + 1)
        further.append(F.array(*[_taken(F.col("fp"), r) for r in rest]))
    more = F.lit(None).cast("array<bigint>")
    for t, column in enumerate(further):
        more = F.when(F.col("t") == t, column).otherwise(more)
    keyed = keyed.select("fp", "rep", "check", "t", "key", F.posexplode(F.when(F.col("n") > bucket_rows, more).otherwise(F.array(F.lit(0).cast("long")))).alias("u", "sub"))
    keyed = keyed.repartition("t", "key", "u", "sub").sortWithinPartitions("t", "key", "u", "sub")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whole buckets are searched together; only the open one is carried on.
        held: list[pa.RecordBatch] = []
        rows = 0

        def found(table: pa.Table) -> pa.RecordBatch:
            fp = table["fp"].to_numpy().view(np.uint64)
            rep = table["rep"].to_numpy()
            key = np.stack([table[c].to_numpy().astype(np.int64) for c in ("t", "key", "u", "sub")])
            bucket = np.append(0, np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))) if len(fp) else np.empty(0, np.int64)
            order = np.lexsort((gray_rank(fp), bucket))
            fp, rep, bucket = fp[order], rep[order], bucket[order]
            check = table["check"].combine_chunks()
            check = check if isinstance(check, pa.Array) else check.chunk(0)
            check = check.flatten().to_numpy().view(np.uint64).reshape(len(fp), -1)[order] if len(fp) else None

            def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for a, b in GrayIndex(fp, bucket).pairs(distance):
                    if check_distance is not None:
                        near = np.bitwise_count(check[a] ^ check[b]).sum(axis=1, dtype=np.int64) <= check_distance
                        a, b = a[near], b[near]
                    yield a, b

            label = forest(len(fp), pairs()) if len(fp) else np.empty(0, np.int64)
            joined = np.flatnonzero(label != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(rep[joined]), pa.array(rep[label[joined]])], names=["a", "b"])

        def last_bucket(table: pa.Table) -> int:
            """Where the last bucket of a sorted table starts."""
            key = np.stack([table[c].to_numpy().astype(np.int64) for c in ("t", "key", "u", "sub")])
            changes = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
            return int(changes[-1]) + 1 if len(changes) else 0

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 200_000:
                table = pa.Table.from_batches(held).combine_chunks()
                at = last_bucket(table)
                if at:
                    yield found(table.slice(0, at))
                held, rows = table.slice(at).to_batches(), table.num_rows - at
        if held:
            yield found(pa.Table.from_batches(held).combine_chunks())

    return keyed.mapInArrow(search, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE, bucket_rows: int = BUCKET, distinct: bool = False, check_words: int | None = None, check_distance: int | None = None) -> DataFrame:
    """One row per input row: id, ``fp`` (signed long) and ``component_id``, the
    smallest id reachable over fingerprints at ``distance`` or fewer differing bits.
    With ``check_words``, fingerprints of CHECK_BITS bits over shingles of that many
    words must also be within ``check_distance`` (see ``check_limit``).

    Null texts count as empty; a text without words has fingerprint 0 and is linked
    like any other; a text with fewer words than a shingle is one shingle.  Repeated
    rows share a component.  Ids are longs; rows with a null id keep it and name no
    component unless they are alone in it (then null).  An empty table gives no
    rows; other columns are ignored."""
    fps = materialize(fingerprints(docs, id_col, text_col, words, distinct, check_words))
    classes = materialize(fps.groupBy("fp", "check").agg(F.min("id").cast("long").alias("rep")))
    edges = links(classes.where("rep is not null"), classes.count(), distance, bucket_rows, check_distance)
    found = components(edges)
    owner = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "check", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(owner, ["fp", "check"]).select(F.col("id").alias(id_col), "fp", "component_id")


def check_limit(similarity: float, deviations: float = 2) -> int:
    """Bits of CHECK_BITS in which fingerprints of shingle sets with this Jaccard
    similarity differ, so many standard deviations above the mean: the share of bits
    is the angle between the sets over pi."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(CHECK_BITS * share + deviations * math.sqrt(CHECK_BITS * share * (1 - share)))
