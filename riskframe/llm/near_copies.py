"""Near copies: documents whose sets of word shingles have a given Jaccard similarity.

Documents with equal shingle sets are one class.  The SimHash operator's index links
classes whose fingerprints are close, and the shingle sets verify its links.  That finds
the closest copies; those of lower similarity differ in too many bits.  Keys made of the smallest hashes of
a set bring classes together: two sets agree on one minimum with the probability of
their similarity, wherever in the text they differ.  Inside a bucket of equal keys
SimHash fingerprints of CHECK_BITS bits narrow the pairs, and the shingle sets themselves
decide: no link has less than the similarity.

Links are looked for in rounds, each leaving out what is connected already: a class
meets the next one of its bucket, then the next few, then all others.  A crowd of
copies is connected by the first rounds, so its pairs are never listed; buckets of
more than BLOCK classes are cut into blocks, and blocks meet block by block.

What a crowd leaves unconnected are mostly classes too far from all others, and they
must not be listed with the whole crowd.  Two exact bounds rule them out: the smaller
set must have ``similarity`` of the larger one's size, and a set shares with no other
class the shingles that are its own, so only the rest of it can be common ground.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.simhash import CHECK_BITS, _mixed, check_limit, fingerprint, links, shingle_hashes
from riskframe.llm.components import components
from riskframe.operators.ordered import Scratch, materialize

#: Keys of a set, and minima in a key: sets of similarity s share a key with the
#: probability 1 - (1 - s^MINIMA)^KEYS, 0.9998 at 0.8.
KEYS, MINIMA = 16, 4
#: Classes of a bucket that one task compares with each other.
BLOCK = 2_000
#: Shingles of the classes of a block, and bytes of rows a task holds before it works on them.
BLOCK_SHINGLES, HELD_BYTES = 2_000_000, 16 << 20
#: Places after its own with which a class is compared, by round; then come all.
REACH = (1, 16)
#: Standard deviations that fingerprints may differ more than the similarity implies:
#: they only narrow, and those of few shingles scatter more.
SLACK = 6
#: Shingles hashed at a time.
STEP = 2_048

_random = np.random.default_rng(10)
_FLIP, _FACTOR, _JOIN = (_random.integers(0, 2**64, size=KEYS * MINIMA, dtype=np.uint64) | np.uint64(1) for _ in range(3))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text without words has one, the empty."""
    found = np.unique(shingle_hashes(text, words))
    return found if len(found) else np.array([xxhash.xxh64_intdigest(b"", 42)], dtype=np.uint64)


def bucket_keys(shingles: np.ndarray) -> np.ndarray:
    """KEYS keys of a set."""
    least = np.full(KEYS * MINIMA, np.uint64(2**64 - 1))
    for s in range(0, len(shingles), STEP):
        mixed = (shingles[None, s:s + STEP] ^ _FLIP[:, None]) * _FACTOR[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    return (least * _JOIN).reshape(KEYS, MINIMA).sum(axis=1, dtype=np.uint64)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, ``same`` (equal for equal sets), ``check`` and ``keys``.  Null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(values: list[np.ndarray], per: int) -> pa.Array:
            flat = np.concatenate(values or [np.empty(0, np.uint64)]).view(np.int64)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * per, pa.int32()), pa.array(flat))

        for batch in batches:
            same, checks, keys = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                found = shingle_set(text.as_py() or b"", words)
                same.append(xxhash.xxh3_128_digest(found.tobytes()))
                checks.append(np.array([fingerprint(_mixed(found, i + 1)) for i in range(CHECK_BITS // 64)], dtype=np.uint64))
                keys.append(bucket_keys(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(same, pa.binary()), lists(checks, CHECK_BITS // 64), lists(keys, KEYS)], names=["id", "same", "check", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, same binary, check array<long>, keys array<long>")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """rep and ``shingles``, the hashes of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py() or b"", words).view(np.int64) for text in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "shingles"])

    return docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).mapInArrow(run, "rep long, shingles array<long>")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs whose sets have the Jaccard similarity or more."""
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("of_a"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(one, "a").join(two, "b").where(both / (F.size("of_a") + F.size("of_b") - both) >= similarity).select("a", "b")


def _close(check: np.ndarray, part: np.ndarray, size: np.ndarray, most: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the places a and b those that are apart, can have the similarity by their
    sizes and the shingles they can share, and are within the limit of bits."""
    apart = part[a] != part[b]
    a, b = a[apart], b[apart]
    share = np.minimum(np.minimum(most[a], most[b]), np.minimum(size[a], size[b]))
    able = share * (1 + similarity) >= similarity * (size[a] + size[b]) - 1e-6
    a, b = a[able], b[able]
    near = np.bitwise_count(check[a] ^ check[b]).sum(axis=1, dtype=np.int64) <= limit
    return a[near], b[near]


def _starts(table: pa.Table) -> np.ndarray:
    """Where the groups of a table sorted by key, i, j begin."""
    key = np.stack([table[c].to_numpy().astype(np.int64) for c in ("key", "i", "j")])
    return np.append(0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups; only the open group is carried on."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= 50_000 or size >= HELD_BYTES:
            table = pa.Table.from_batches(held)
            at = int(_starts(table)[-1])
            if at:
                yield table.slice(0, at)
            held, rows, size = table.slice(at).to_batches(), table.num_rows - at, 0
    if rows:
        yield pa.Table.from_batches(held)


def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    """rep, part, size, most and check of the rows."""
    check = pa.concat_arrays(table["check"].chunks).flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)
    return (*(table[c].to_numpy() for c in ("rep", "part", "size", "most")), check)


def _edges(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(a), 1_000_000):
        x, y = a[s:s + 1_000_000], b[s:s + 1_000_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _neighbours(members: DataFrame, beyond: int, reach: int, limit: int, similarity: float) -> DataFrame:
    """Pairs (a < b) of one bucket in different parts that the bounds and fingerprints
    leave, of those more than ``beyond`` and at most ``reach`` places apart in a block.

    ``members`` has ``key``, ``blocks`` (of the bucket), ``rep``, ``part``, ``check``, ``size`` and
    ``most`` (how many of its shingles can be in another class)."""
    home = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    members = members.select("key", home.alias("i"), home.alias("j"), F.xxhash64("rep").alias("place"), "rep", "part", "check", "size", "most")
    members = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            rep, part, size, most, check = _columns(table)
            first = _starts(table)
            last = np.append(first[1:], len(rep))
            group = np.repeat(np.arange(len(first)), last - first)
            for step in range(beyond + 1, min(reach, int((last - first).max()) - 1) + 1):
                at = np.flatnonzero(group[step:] == group[:-step])
                x, y = _close(check, part, size, most, at, at + step, limit, similarity)
                yield from _edges(rep[x], rep[y])

    return members.mapInArrow(run, "a long, b long").distinct()


def _forest(members: DataFrame, beyond: int, limit: int, similarity: float) -> DataFrame:
    """Links (a < b) of each bucket between classes in different parts, all pairs more than
    ``beyond`` places apart in a block being compared, down to their ``shingles``, where the bounds
    and fingerprints leave them.  Of a block, or of two that meet, comes a spanning forest."""
    # Blocks i <= j meet at (i, j); the rows of i come first.
    home = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    members = members.withColumn("home", home).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select(
        "key", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"), "home", F.xxhash64("rep").alias("place"),
        "rep", "part", "check", "size", "most", "shingles")
    members = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "home", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            rep, part, size, most, check = _columns(table)
            part = part.copy()
            home, i, j = (table[c].to_numpy() for c in ("home", "i", "j"))
            lists = pa.concat_arrays(table["shingles"].chunks)
            flat = lists.flatten().to_numpy().view(np.uint64)
            begin = np.append(0, np.cumsum(size))
            first = _starts(table)
            left, right = [], []
            for s, e in zip(first.tolist(), np.append(first[1:], len(rep)).tolist()):
                # Of two blocks each row of the first meets the second; in one, each row those
                # after it that no earlier round has shown it.
                cut = s + int(np.searchsorted(home[s:e], i[s], side="right")) if i[s] != j[s] else e
                for a in range(s, cut if i[s] != j[s] else e - 1):
                    b = np.arange(cut if i[s] != j[s] else a + beyond + 1, e)
                    _, b = _close(check, part, size, most, np.full(len(b), a), b, limit, similarity)
                    own = flat[begin[a]:begin[a + 1]]
                    for k in range(0, len(b), 256):
                        some = b[k:k + 256]
                        theirs = np.concatenate([flat[begin[x]:begin[x + 1]] for x in some])
                        place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                        common = np.add.reduceat(own[place] == theirs, np.append(0, np.cumsum(size[some])[:-1]), dtype=np.int64)
                        for x in some[common / (size[a] + size[some] - common) >= similarity].tolist():
                            if part[x] != part[a]:
                                left.append(rep[a])
                                right.append(rep[x])
                                inside = part[s:e]
                                inside[inside == part[x]] = part[a]
            yield from _edges(np.array(left, dtype=np.int64), np.array(right, dtype=np.int64))

    return members.mapInArrow(run, "a long, b long").distinct()


def fingerprint_links(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes by the SimHash operator's Gray-order index: those of a
    fingerprint with the first of them, and the first ones of fingerprints at DISTANCE
    or fewer differing bits (of every bucket a spanning forest)."""
    prints = classes.where("rep is not null").select(F.element_at("check", 1).alias("fp"), "rep", "check")
    firsts = materialize(prints.groupBy("fp").agg(F.min_by(F.struct("rep", "check"), "rep").alias("f")).select("fp", "f.rep", "f.check"))
    equal = prints.select("fp", F.col("rep").alias("a")).join(firsts.select("fp", F.col("rep").alias("b")), "fp").where("a <> b").select("a", "b")
    return equal.unionByName(links(firsts, firsts.count())).distinct()


def near_copies(docs: DataFrame, similarity: float, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``component_id``, the smallest id reachable over
    near copies.

    Null texts count as empty, and texts without words are equal; a text with fewer
    words than a shingle is one shingle.  Repeated rows share a component.  Ids are
    longs; rows with a null id keep it and name no component unless they are alone in
    it (then null).  An empty table gives no rows; other columns are ignored."""
    spark, limit = docs.sparkSession, check_limit(similarity, SLACK)
    found = materialize(signatures(docs, id_col, text_col, words))
    classes = materialize(found.groupBy("same").agg(F.min("id").cast("long").alias("rep"), F.first("check").alias("check"), F.first("keys").alias("keys")))
    held = Scratch(spark)
    keyed = classes.where("rep is not null").select("rep", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowd = held.write(keyed.join(sizes, "key"))
    printed = held.write(fingerprint_links(classes))
    asked = crowd.select("rep").unionByName(printed.select(F.explode(F.array("a", "b")).alias("rep")))
    named = docs.where(F.col(id_col).isNotNull()).join(asked.select(F.col("rep").alias(id_col)).distinct(), id_col, "left_semi")
    sets = held.write(shingle_sets(named.select(id_col, text_col).dropDuplicates([id_col]), id_col, text_col, words))
    # Shingles that one class of the large buckets has alone.
    large = crowd.where(F.col("n") > REACH[-1] + 1).select("rep").distinct()
    shingles = sets.join(large, "rep", "left_semi").select("rep", F.explode("shingles").alias("s"))
    alone = shingles.groupBy("s").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).where("n = 1").groupBy("rep").agg(F.count("*").alias("alone"))
    size = sets.select("rep", F.size("shingles").cast("long").alias("size")).join(alone, "rep", "left")
    facts = classes.select("rep", "check").join(size, "rep").select("rep", "check", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("most"))
    facts = held.write(facts)
    edges = held.write(similar(printed, sets, similarity))
    owner = held.write(components(edges).withColumnRenamed("node", "rep"))
    beyond = 0
    for reach in (*REACH, None):
        # Earlier rounds have compared all of a bucket that is no larger than their reach.
        members = crowd.where(F.col("n") > beyond + 1).join(facts, "rep")
        # What a class has alone among those of large buckets, one of a small bucket may share.
        most = F.when(F.col("n") > REACH[-1] + 1, F.col("most")).otherwise(F.col("size"))
        members, part = members.join(owner, "rep", "left"), F.coalesce("component", "rep")
        round_ = Scratch(spark)
        members = round_.write(members.select("key", "n", "rep", "check", "size", most.alias("most"), part.alias("part")))
        # A class that could not be close to the smallest of its bucket is close to none.
        least = members.groupBy("key").agg(F.min("size").alias("least"))
        needed = similarity * (F.col("size") + F.greatest(F.col("least"), similarity * F.col("size")))
        members = members.join(least, "key").where((1 + similarity) * F.col("most") >= needed - 1e-6)
        # A bucket of one part has nothing left to find.
        mixed = members.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.sum("size").alias("total"))
        # The same blocks and places in each round, as sizes and bounds are the bucket's own.
        blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
        members = members.join(mixed.where("low < high"), "key").withColumn("blocks", blocks)
        if reach is None:
            linked = held.write(_forest(members.join(sets, "rep"), beyond, limit, similarity))
        else:
            pairs = round_.write(_neighbours(members, beyond, reach, limit, similarity))
            linked = held.write(similar(pairs, sets, similarity))
        round_.clear()
        edges = edges.unionByName(linked)
        owner = held.write(components(edges).withColumnRenamed("node", "rep"))
        beyond = reach
    owner = materialize(owner)
    held.clear()
    whole = classes.join(owner, "rep", "left").select("same", F.coalesce("component", "rep").alias("component_id"))
    return found.select("id", "same").join(whole, "same").select(F.col("id").alias(id_col), "component_id")
