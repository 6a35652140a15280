"""Cost-balanced packing of documents into fixed-length training sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (attention within the
piece).  A block of documents is tokenized where it lies; whole sequences are cut
off each document first, and the rest are assigned in descending length to the
sequence of lowest cost that has room.  A piece for which no sequence has room is
cut to fill the roomiest one.  Nothing is shuffled: blocks are packed where they are read.

A block opens exactly as many tokens of capacity as it has: full sequences, and
for what is left over sequences whose lengths are powers of two, so none is padded.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.chunks import tokenizers_encoder

LENGTH = 1024
#: Tokens that are packed together; a block ends with the document that reaches it.
BLOCK_TOKENS = 2_000_000
#: Sequence ids of a partition start at its number times this.
IDS_PER_PARTITION = 1 << 40

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def capacities(tokens: int, length: int) -> list[int]:
    """Sequence lengths that hold exactly ``tokens``: full ones, then powers of two."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << b for b in range(length.bit_length(), -1, -1) if rest >> b & 1]


def assign(lengths: list[int], length: int = LENGTH, linear: float = 1.0, quadratic: float = 1.0 / LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, tokens, sequence, offset) for pieces of 1 to ``length``
    tokens.  Sequences that have room for the current length stand in a heap by
    cost; the others wait by their room until the length has come down to it."""
    room = capacities(sum(lengths), length)
    size, cost = list(room), [0.0] * len(room)
    todo: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]
    for i in reversed(range(len(lengths))):
        todo[lengths[i]].append((i, 0))
    waiting: list[list[tuple[float, int]]] = [[] for _ in range(length + 1)]
    roomy = 0  # bit r: some sequence waits with room r
    for s, r in enumerate(room):
        waiting[r].append((0.0, s))
        roomy |= 1 << r
    out, ready = [], []
    for n in range(length, 0, -1):
        for entry in waiting[n]:
            heapq.heappush(ready, entry)
        waiting[n] = []
        roomy &= ~(1 << n)
        while todo[n]:
            piece, start = todo[n].pop()
            if ready:
                take, (_, s) = n, heapq.heappop(ready)
            else:
                take = roomy.bit_length() - 1
                _, s = heapq.heappop(waiting[take])
                if not waiting[take]:
                    roomy &= ~(1 << take)
                todo[n - take].append((piece, start + take))
            out.append((piece, start, take, s, size[s] - room[s]))
            room[s] -= take
            cost[s] += linear * take + quadratic * take * take
            if room[s] >= n:
                heapq.heappush(ready, (cost[s], s))
            elif room[s]:
                heapq.heappush(waiting[room[s]], (cost[s], s))
                roomy |= 1 << room[s]
    return out


def pack_block(docs: list[tuple[int | None, bytes]], base: int, length: int, linear: float, quadratic: float) -> tuple[list[tuple], int]:
    """Rows of SCHEMA for documents given as 4-byte ids, and the next free sequence id."""
    rows, rest = [], []
    for doc_id, ids in docs:
        n = len(ids) // 4
        for start in range(0, n - length + 1, length):
            rows.append((doc_id, start, length, ids[4 * start:4 * (start + length)], n, base, 0))
            base += 1
        if n % length:
            rest.append((doc_id, ids, n, n - n % length))
    top = base
    for piece, start, take, s, offset in assign([n - at for _, _, n, at in rest], length, linear, quadratic):
        doc_id, ids, n, at = rest[piece]
        at += start
        rows.append((doc_id, at, take, ids[4 * at:4 * (at + take)], n, base + s, offset))
        top = max(top, base + s + 1)
    return rows, top


def pack(docs: DataFrame, tokenizer: str, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, linear: float = 1.0, quadratic: float = 1.0 / LENGTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: the document, ``start`` (its ids before the piece),
    ``length``, ``ids`` (little-endian unsigned 32 bits), ``doc_tokens``,
    ``sequence_id`` and ``offset`` in the sequence.

    A document is its ids by the ``tokenizer`` file and one ``separator``.  Null
    texts count as empty and are one separator; repeated rows are packed each; an
    empty table gives no pieces.  Equal lengths are taken in the order read.  Long
    texts fill sequences of their own.  Other columns are ignored."""
    end = np.array([separator], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizers_encoder(tokenizer)
        base = TaskContext.get().partitionId() * IDS_PER_PARTITION
        block, tokens = [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal base, block, tokens
            rows, base = pack_block(block, base, length, linear, quadratic)
            for i in range(0, len(rows), 1024):
                columns = list(zip(*rows[i:i + 1024]))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)
            block, tokens = [], 0

        types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.texts(batch.column(1).to_pylist())):
                block.append((doc_id, ids + end))
                tokens += len(ids) // 4 + 1
                if tokens >= block_tokens:
                    yield from packed()
        if block:
            yield from packed()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA).withColumnRenamed("doc_id", id_col)
