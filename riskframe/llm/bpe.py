"""Byte-level BPE with a hierarchical-bitmap rank queue.

Pre-tokens start as single bytes in a linked list; many of them share one list and
one queue, since parts of different pre-tokens are never neighbours in it.  Each
neighbouring pair that has a rank is put into the bucket of that rank, which holds
positions of the list.  A bitmap over ranks with a summary bit for each of its words
tells the lowest rank whose bucket has entries by two find-first-set operations.  A
merge changes the pairs of its two neighbours; their old entries stay and are
skipped as stale when they come up.  The work is n log n for n bytes, however long a
pre-token is.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.chunks import ChunkEncoder, windows
from riskframe.llm.common import process_cache

#: Bits of a bitmap word, and the shift that gives a rank's word.
SHIFT = 8
WORD = 1 << SHIFT


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Bpe:
    """Encoder and decoder over a table of merge ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.vocabulary = {rank: token for token, rank in ranks.items()}
        self.size = max(ranks.values(), default=0) + 1
        # What two neighbours with these ranks merge to, and the same for single bytes.
        self.pairs = {
            ranks[token[:i]] * self.size + ranks[token[i:]]: rank
            for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks}
        self.bytes = np.array([ranks.get(bytes((i,)), -1) for i in range(256)])
        self.two = np.array([ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)])

    def merge(self, tokens: list[bytes]) -> list[bytes]:
        """Ids of each of the (not empty) pre-tokens, as little-endian unsigned 32 bits.
        In a pre-token the lowest rank is merged first, and of equal ranks the leftmost."""
        data = np.frombuffer(b"".join(tokens), dtype=np.uint8).astype(np.int64)
        n = len(data)
        if not n:
            return []
        sizes = np.array([len(t) for t in tokens])
        ends = np.cumsum(sizes)
        own = self.bytes[data]
        if (own < 0).any():
            raise ValueError("a byte has no rank")
        first = np.full(n, -1)
        first[:-1] = self.two[data[:-1] << 8 | data[1:]]
        first[ends - 1] = -1
        part, pair, size, merged = own.tolist(), first.tolist(), self.size, self.pairs.get
        # Neighbours in the list; -1 beyond the ends of a pre-token.
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - sizes] = -1, -1
        after, before = after.tolist(), before.tolist()

        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0):]
        found, starts = np.unique(first[order], return_index=True)
        order = order.tolist()
        buckets = {r: order[a:b] for r, a, b in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)])}
        words, summary = [0] * ((size >> SHIFT) + 1), 0
        for r in buckets:
            words[r >> SHIFT] |= 1 << (r & WORD - 1)
            summary |= 1 << (r >> SHIFT)

        while summary:
            # Find first set, twice.
            w = (summary & -summary).bit_length() - 1
            word = words[w]
            r = (w << SHIFT) + (word & -word).bit_length() - 1
            words[w] = word = word & word - 1
            if not word:
                summary &= summary - 1
            bucket = buckets.pop(r)
            bucket.sort()
            for nth, i in enumerate(bucket):
                if pair[i] != r:
                    continue  # stale
                gone = after[i]
                end = after[i] = after[gone]
                part[i], part[gone], pair[gone] = r, -1, -1
                left, lowest = before[i], size
                if end >= 0:
                    before[end] = i
                    q = merged(r * size + part[end])
                    if q is None:
                        pair[i] = -1
                    else:
                        pair[i], lowest = q, q
                        if q in buckets:
                            buckets[q].append(i)
                        else:
                            buckets[q] = [i]
                            words[q >> SHIFT] |= 1 << (q & WORD - 1)
                            summary |= 1 << (q >> SHIFT)
                else:
                    pair[i] = -1
                if left >= 0:
                    q = merged(part[left] * size + r)
                    if q is None:
                        pair[left] = -1
                    else:
                        pair[left], lowest = q, min(lowest, q)
                        if q in buckets:
                            buckets[q].append(left)
                        else:
                            buckets[q] = [left]
                            words[q >> SHIFT] |= 1 << (q & WORD - 1)
                            summary |= 1 << (q >> SHIFT)
                if lowest <= r:  # a new pair comes before the rest of this bucket
                    buckets[r] = buckets.get(r, []) + bucket[nth + 1:]
                    words[w] |= 1 << (r & WORD - 1)
                    summary |= 1 << w
                    break
        ids = np.array(part)
        alive = ids >= 0
        out = ids[alive].astype("<u4").tobytes()
        cut = [0, *(4 * np.cumsum(np.add.reduceat(alive.astype(np.int64), ends - sizes))).tolist()]
        return [out[a:b] for a, b in zip(cut, cut[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; a match of the pattern that is a token is not merged."""
        known: dict[str, bytes] = {}
        todo: dict[str, bytes] = {}
        cut = []
        for text in texts:
            # One match of letters needs no pattern.
            letters = text[1:].isalpha() and (text[0] == " " or text[0].isalpha())
            cut.append([text] if letters else self.pattern.findall(text))
            for t in cut[-1]:
                if t not in known and t not in todo:
                    token = t.encode("utf-8")
                    rank = self.ranks.get(token)
                    if rank is None:
                        todo[t] = token
                    else:
                        known[t] = struct.pack("<I", rank)
        known.update(zip(todo, self.merge(list(todo.values()))))
        return [known[c[0]] if len(c) == 1 else b"".join(map(known.__getitem__, c)) for c in cut]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def _bpe(ranks_path: str, pattern: str) -> Bpe:
    cache = process_cache()
    key = f"bpe {ranks_path} {pattern}"
    if key not in cache:
        cache[key] = Bpe(read_ranks(ranks_path), pattern)
    return cache[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids`` (little-endian unsigned 32 bits) of every whole text.

    Null counts as empty; an empty text has no ids.  Repeated rows are encoded
    each, an empty table gives no rows, other columns are ignored.  A single byte
    that has no rank is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(f"ids {ranks_path} {pattern}", _bpe(ranks_path, pattern).encode)
        for batch in batches:
            at = 0
            for texts in windows(batch.column(1).to_pylist()):
                out = pa.array(list(encoder.texts(texts)), type=pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), out], names=["id", "ids"])
                at += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """All columns and ``decoded``, the bytes of the ids.  Null ids give null; an id
    outside the table is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks_path, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            out = [None if x is None else bpe.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=pa.binary())], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")
