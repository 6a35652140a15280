"""Token counts by a separator scan over flat, unindexed token files.

A file is a run of fixed-width token ids in which an end-of-document id closes each
document; nothing says where documents begin.  Files are read as blocks, and any
block may begin and end inside a document.  Each block is searched for separators
with one vectorised comparison and keeps only lengths: ids before its first
separator, between separators, and after its last.  A prefix scan over the blocks
of a file gives each block the number of documents closed before it and the ids
that its first document already had, so documents may span any number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.chunks import tokenizers_encoder
from riskframe.operators.ordered import running_sums

#: Ids in a block.
BLOCK_IDS = 1 << 18

SCAN = "file string, block long, n long, closed long, head long, tail long, inner array<long>, doc_ids array<long>"


def file_blocks(spark: SparkSession, path: str, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of the flat token files at ``path`` (each of at most 2 GB): file,
    block, ids, and null ``doc_ids``."""
    size = block_ids * width
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("content") / size).cast("int") - 1)), lambda i: F.struct(
        i.cast("long").alias("block"), F.substring(F.col("content"), i * size + 1, F.lit(size)).alias("ids")))
    return files.select(F.col("path").alias("file"), F.explode(parts).alias("b")).select("file", "b.block", "b.ids", F.lit(None).cast("array<long>").alias("doc_ids"))


def token_blocks(docs: DataFrame, tokenizer: str, separator: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """The token stream of each partition as blocks of a flat file of 16-bit ids,
    with the ids of the documents that a block closes beside it.  Null texts count
    as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizers_encoder(tokenizer)
        file, block = str(TaskContext.get().partitionId()), 0
        end = np.array([separator], dtype="<u2").tobytes()
        kept, closed, buffer = [], [], bytearray()
        size = 2 * block_ids

        def cut(at: int) -> pa.RecordBatch:
            nonlocal block, closed, buffer
            inside = [d for d, e in closed if e <= at]
            closed = [(d, e - at) for d, e in closed if e > at]
            out = pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([block], pa.int64()), pa.array([bytes(buffer[:at])], pa.binary()), pa.array([inside], pa.list_(pa.int64()))],
                names=["file", "block", "ids", "doc_ids"])
            del buffer[:at]
            block += 1
            return out

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.texts(batch.column(1).to_pylist())):
                wide = np.frombuffer(ids, dtype="<u4")
                if len(wide) and wide.max() >= separator:
                    raise ValueError("a text has the id of the separator, or one above it")
                buffer += wide.astype("<u2").tobytes() + end
                closed.append((doc_id, len(buffer)))
                while len(buffer) >= size:
                    yield cut(size)
        if buffer:
            yield cut(len(buffer))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "file string, block long, ids binary, doc_ids array<long>")


def _lengths(blocks: DataFrame, separator: int, width: int) -> DataFrame:
    """A row of lengths for each block; ids themselves go no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, closed, head, tail, inner = [], [], [], [], []
            for ids in batch.column(2).to_pylist():
                ids = np.frombuffer(ids or b"", dtype=f"<u{width}")
                at = np.flatnonzero(ids == separator)
                n.append(len(ids))
                closed.append(len(at))
                head.append(int(at[0]) if len(at) else len(ids))
                tail.append(len(ids) - 1 - int(at[-1]) if len(at) else len(ids))
                inner.append(np.diff(at) - 1)
            numbers = [pa.array(x, pa.int64()) for x in (n, closed, head, tail)]
            columns = [batch.column(0), batch.column(1), *numbers, pa.array(inner, pa.list_(pa.int64())), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "n", "closed", "head", "tail", "inner", "doc_ids"])

    return blocks.select("file", "block", "ids", "doc_ids").mapInArrow(run, SCAN)


def count_tokens(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """One row per document: file, ``ordinal`` in it, ``doc_id`` (null where the
    blocks name none), ``n_tokens`` without the separator, ``closed``.

    Ids after the last separator of a file are a document with ``closed`` false.
    Two separators in a row close an empty document.  Null or empty blocks hold no
    ids, and no blocks give no rows.  (file, block) must be unique."""
    scanned = _lengths(blocks, separator, width)
    # run: how many blocks with a separator the file has had so far, this one included.
    scanned = scanned.withColumn("starts", (F.col("closed") > 0).cast("long"))
    scan = running_sums(scanned, ["block"], ["closed", "starts"], group_by=["file"])
    scan = scan.withColumnRenamed("cum_starts", "run").withColumn("before", F.col("cum_closed") - F.col("closed"))
    # What a run leaves open goes to the first document that the next run closes.
    open_ids = scan.groupBy("file", "run").agg(F.sum("tail").alias("left"), F.max("cum_closed").alias("ordinal"))
    carry = open_ids.select("file", (F.col("run") + 1).alias("run"), F.col("left").alias("carry"))
    closing = scan.where("closed > 0").join(carry, ["file", "run"], "left")
    counts = F.concat(F.array(F.coalesce("carry", F.lit(0).cast("long")) + F.col("head")), F.col("inner"))
    rows = closing.select("file", "before", "doc_ids", F.posexplode(counts).alias("i", "n_tokens"))
    whole = rows.select("file", (F.col("before") + F.col("i")).alias("ordinal"), F.get("doc_ids", F.col("i")).alias("doc_id"), "n_tokens", F.lit(True).alias("closed"))
    last = open_ids.groupBy("file").agg(F.max_by(F.struct("left", "ordinal"), "run").alias("o"))
    rest = last.where("o.left > 0").select("file", "o.ordinal", F.lit(None).cast("long").alias("doc_id"), F.col("o.left").alias("n_tokens"), F.lit(False).alias("closed"))
    return whole.unionByName(rest)
