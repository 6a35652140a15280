"""Source divergence audit: how far the term frequencies of sources lie apart.

Partial counts are made by Arrow's own kernels where the texts are read: ``ascii_lower``,
``split_pattern_regex``, ``dictionary_encode`` and hash ``group_by`` inside
``mapInArrow``, for some megabytes of text at a time.  Spark merges them into one count a
(language, source, term), written as columnar shards.

A term's scaled frequency is p = 1 + floor(SCALE (count + 1) / (N + V)), with N the counted
occurrences of the group's kept terms and V the language's number of kept terms.  The
divergence of p from q is the sum of floor((p - q)^2 / q) over the V kept terms.  Most terms
are missing in most sources, so with p0 for a count of zero each summand splits into

    f(p0, q0) + [f(p, q0) - f(p0, q0)] + [f(p0, q) - f(p0, q0)] + c,

where c is 0 unless both sources have the term.  The first three depend on the number of
terms per count of one source; c is summed per shard of terms, over tiles of sources.  All
numbers are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import whole_text
from riskframe.operators.ordered import materialize

#: Fixed value: what lies between terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: A term is kept if at least so many documents of its language have it.
LEAST_DOCS = 3
#: Frequencies are counted in billionths.
SCALE = 1_000_000_000
#: Terms of a group that are reported.
TOP = 200
#: Bytes of text that are counted at a time, and partial counts held before they are sent.
PIECE_BYTES, HELD_ROWS = 4 << 20, 400_000
#: Counts in a shard, and sources in a tile.
SHARD_ROWS, TILE = 100_000, 256

PARTIAL = "lang string, source string, term string, n long, docs long"


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``PIECE_BYTES`` of text, at least one row each."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) // PIECE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n, docs of a few texts.  A row with a null term counts the
    documents of its group."""
    groups = pa.table({"lang": batch.column("lang"), "source": batch.column("source")})
    lists = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), BETWEEN)
    owner = pc.list_parent_indices(lists)
    terms = pc.list_flatten(lists)
    real = pc.greater(pc.binary_length(terms), 0)
    owner, codes = owner.filter(real), terms.filter(real).dictionary_encode()
    per_doc = pa.table({"owner": owner, "code": codes.indices}).group_by(["owner", "code"]).aggregate([([], "count_all")])
    rows = groups.take(per_doc["owner"]).append_column("code", per_doc["code"]).append_column("n", per_doc["count_all"])
    rows = rows.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    term = codes.dictionary.take(rows["code"].combine_chunks())
    found = pa.table({"lang": rows["lang"], "source": rows["source"], "term": term, "n": rows["n_sum"], "docs": rows["count_all"]})
    docs = groups.group_by(["lang", "source"]).aggregate([([], "count_all")])
    none = pa.nulls(docs.num_rows, pa.string())
    zero = pa.array(np.zeros(docs.num_rows, dtype=np.int64))
    return pa.concat_tables([found, pa.table({"lang": docs["lang"], "source": docs["source"], "term": none, "n": zero, "docs": docs["count_all"]})])


def _merged(tables: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return summed.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        for piece in _pieces(batch):
            held.append(_counted(piece))
            rows += held[-1].num_rows
            if rows > 2 * HELD_ROWS:
                held = [_merged(held)]
                rows = held[0].num_rows
                if rows > HELD_ROWS:  # too many different ones to wait for more
                    yield from held[0].to_batches()
                    held, rows = [], 0
    if held:
        yield from _merged(held).to_batches()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, total: occurrences of each kept term in the group and in the
    language.  A row with a null term stands for the group itself, with or without terms."""
    texts = docs.select(whole_text(text_col).alias("text"), whole_text(lang_col).alias("lang"), whole_text(source_col).alias("source"))
    partial = texts.mapInArrow(_partial_counts, PARTIAL)
    merged = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    merged = merged.withColumn("total", F.sum("n").over(term)).withColumn("in_docs", F.sum("docs").over(term))
    kept = merged.where(F.col("term").isNull() | (F.col("in_docs") >= least_docs))
    return kept.select("lang", "source", "term", "n", "total")


def _scaled(n: Column, total: Column, terms: Column) -> Column:
    up = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", up, (total + terms).cast("decimal(20,0)"))


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _np_gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _common_terms(shard: pa.Table) -> pa.Table:
    """The sums of c over the terms of a shard, for each source of the tile and each source
    that shares a term with it: lang, a, b, c."""
    a0 = shard["tile"][0].as_py() * TILE
    src, code = shard["nth"].to_numpy(), shard["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    p, p0 = shard["p"].to_numpy(), shard["p0"].to_numpy()
    sources, first = np.unique(src, return_index=True)
    tile = np.flatnonzero((sources >= a0) & (sources < a0 + TILE))
    zero = dict(zip(sources.tolist(), p0[first].tolist()))
    order = np.argsort(src, kind="stable")
    ends = np.searchsorted(src[order], sources, side="right")
    of = {s: order[e0:e1] for s, e0, e1 in zip(sources.tolist(), [0, *ends[:-1]], ends)}
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    n_terms = int(code.max()) + 1
    for i in range(0, len(tile), 16):
        own = sources[tile[i:i + 16]]
        base = np.array([zero[s] for s in own.tolist()], dtype=np.int64)[:, None]
        dense = np.repeat(base, n_terms, axis=1)
        for k, s in enumerate(own.tolist()):
            dense[k, code[of[s]]] = p[of[s]]
        for b in sources.tolist():
            q, q0, pa_ = p[of[b]][None, :], zero[b], dense[:, code[of[b]]]
            c = _np_gap(pa_, q) - _np_gap(pa_, np.int64(q0)) - _np_gap(base, q) + _np_gap(base, np.int64(q0))
            out.append((own, b, c.sum(axis=1)))
    a = np.concatenate([o[0] for o in out])
    b = np.concatenate([np.full(len(o[0]), o[1]) for o in out])
    c = np.concatenate([o[2] for o in out])
    live = (a != b) & (c != 0)
    return pa.table({"lang": pa.array([shard["lang"][0].as_py()] * int(live.sum()), pa.string()), "a": a[live].astype(np.int32), "b": b[live].astype(np.int32), "c": c[live]})


def divergences(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: the divergence of a source from each other source (``item``) of its
    language.  Part ``term``: the ``top`` kept terms that the source uses more than
    its language does, by their summand of the divergence from the language.  Ranks start
    at 1 for each group and part, by descending value, ties by the bytes of the item.

    Null text, language and source read as ''.  Each row is a document, repeated ones too.
    A group without terms, or of a language without kept terms, still has its pairs; a
    language of one source has none.  An empty table gives an empty result; other columns
    are ignored."""
    counts = materialize(term_counts(docs, text_col, lang_col, source_col, least_docs))
    terms = counts.where("term is not null")
    per_lang = terms.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("lang_n"), F.count("*").alias("rows"))
    per_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("term").alias("own"))
    per_group = per_group.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = per_group.join(per_lang, "lang", "left").na.fill(0, ["v", "lang_n", "rows"])
    p_zero = F.when(F.col("v") > 0, _scaled(F.lit(0), F.col("group_n"), F.col("v")))
    groups = materialize(groups.withColumn("p0", p_zero).withColumn("sources", F.count("*").over(Window.partitionBy("lang"))))

    facts = groups.select("lang", "source", "nth", "sources", "group_n", "lang_n", "v", "rows", "p0")
    placed = terms.join(facts, ["lang", "source"])
    placed = placed.withColumn("p", _scaled(F.col("n"), F.col("group_n"), F.col("v")))

    # Terms above their language's frequency.
    more = placed.withColumn("q", _scaled(F.col("total"), F.col("lang_n"), F.col("v"))).where(F.col("p") > F.col("q"))
    more = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = more.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    # c, per shard of terms and tile of sources.
    shards = F.ceil(F.col("rows") / shard_rows)
    shard = F.pmod(F.xxhash64("term"), shards)
    tiles = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / TILE).cast("int")))
    sharded = placed.select("lang", shard.alias("shard"), tiles.alias("tile"), "nth", "term", "p", "p0")
    common = sharded.groupBy("lang", "shard", "tile").applyInArrow(_common_terms, "lang string, a int, b int, c long")
    common = common.groupBy("lang", "a", "b").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("c"))

    # The parts that depend on one source's counts and on the other's p0 only.
    other = groups.select("lang", F.col("nth").alias("o"), F.col("p0").alias("q0"))
    kinds = placed.groupBy("lang", "nth", "p", "p0").agg(F.count("*").alias("k"))
    kinds = kinds.join(other, "lang").where("nth <> o")
    gain = lambda x: (x.cast("decimal(38,0)") * F.col("k")).cast("decimal(38,0)")
    own = gain(_gap(F.col("p"), F.col("q0")) - _gap(F.col("p0"), F.col("q0")))
    his = gain(_gap(F.col("q0"), F.col("p")) - _gap(F.col("q0"), F.col("p0")))
    sides = kinds.groupBy("lang", "nth", "o").agg(F.sum(own).alias("as_a"), F.sum(his).alias("as_b"))
    as_a = sides.select("lang", F.col("nth").alias("a"), F.col("o").alias("b"), F.col("as_a").alias("c"))
    as_b = sides.select("lang", F.col("o").alias("a"), F.col("nth").alias("b"), F.col("as_b").alias("c"))

    left = groups.select("lang", "source", F.col("nth").alias("a"), "p0", "v")
    right = groups.select("lang", F.col("source").alias("item"), F.col("nth").alias("b"), F.col("p0").alias("q0"))
    pairs = left.join(right, "lang").where("a <> b")
    floor = F.coalesce(_gap(F.col("p0"), F.col("q0")).cast("decimal(38,0)") * F.col("v"), F.lit(0)).cast("decimal(38,0)")
    rest = common.unionByName(as_a).unionByName(as_b).groupBy("lang", "a", "b").agg(F.sum("c").alias("c"))
    pairs = pairs.join(rest, ["lang", "a", "b"], "left")
    value = (floor + F.coalesce("c", F.lit(0).cast("decimal(38,0)"))).cast("long")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(more)
