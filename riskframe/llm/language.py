"""Language identification by prediction with partial matching.

For each language a context tree over bytes is fitted once and frozen: contexts of
up to ORDER bytes with the counts of what followed them.  The probability of a byte
in a context is its count over count plus distinct followers; the rest is the
escape to the context without its first byte, spread over bytes not yet seen there.
A text's code length under a language is the exact sum of -log2 of its bytes'
probabilities, and the shortest code names the language.

The tree is stored as a table: a row for each context, with the code length of each
byte and the longest known context after it.  Texts are cut into segments that each
repeat the ORDER bytes before them, which fix the context, so all segments advance
together and long texts cost no more than short ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of context.
ORDER = 4
#: Contexts kept for a language: the threshold on their counts rises until they fit.
CONTEXTS = 4096
#: Documents per language that the trees are fitted on (in expectation), of all
#: labelled ones; chosen by a hash of the id.
SAMPLE_DOCS = 400
#: Bytes of a segment.
SEGMENT = 512
#: Bytes worked on at a time.
WINDOW = 4_000_000
UNDETERMINED = "und"

_PAD = 256
_WIDTH = 257


class Tree:
    """Frozen context tree of one language: ``bits`` and ``after`` hold, for
    context * 257 + byte, the code length and 257 times the next context.  Symbol
    256 is padding: it costs nothing and leaves the context."""

    def __init__(self, texts: list[bytes], order: int = ORDER, contexts: int = CONTEXTS):
        grams = [_grams(texts, k) for k in range(order + 1)]
        floor = 2
        while sum(int((n >= floor).sum()) for _, n in (_contexts(*g) for g in grams[1:])) >= contexts:
            floor = floor * 5 // 4 + 1
        number: dict[tuple[int, int], int] = {(0, 0): 0}
        parents = [0]
        for k in range(1, order + 1):
            codes, n = _contexts(*grams[k])
            for c in codes[n >= floor].tolist():
                number[k, c] = len(number)
                parents.append(number[k - 1, c & ((1 << 8 * (k - 1)) - 1)])
        p = np.full((len(number), 256), 1 / 256)
        after = np.zeros((len(number), 256), dtype=np.int64)
        for k in range(order + 1):
            codes, counts = grams[k]
            context = codes >> 8
            edges = np.append(np.flatnonzero(np.append(True, context[1:] != context[:-1])), len(codes)) if len(codes) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                s = number.get((k, int(context[a])))
                if s is None:
                    continue
                base = p[parents[s]] if k else p[0].copy()
                seen, n = (codes[a:b] & 255).astype(np.int64), counts[a:b].astype(float)
                left = 1 - base[seen].sum()
                total = n.sum() + (len(seen) if len(seen) < 256 else 0)
                p[s] = base * (len(seen) / total / left if len(seen) < 256 and left > 0 else 0)
                p[s, seen] = n / total
        for (k, c), s in number.items():  # in ascending order of length
            if k:
                after[s] = after[parents[s]]
            if k < order:
                for b in range(256):
                    t = number.get((k + 1, c << 8 | b))
                    if t is not None:
                        after[s, b] = t
        # A longer context after a shorter one replaces what the parent said.
        self.bits = np.zeros((len(number), _WIDTH), dtype=np.float32)
        self.after = np.empty((len(number), _WIDTH), dtype=np.int32)
        self.bits[:, :256] = -np.log2(np.maximum(p, 2.0**-40))
        self.after[:, :256] = after * _WIDTH
        self.after[:, _PAD] = np.arange(len(number)) * _WIDTH
        self.bits, self.after = self.bits.ravel(), self.after.ravel()


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of all runs of order + 1 bytes and their counts; runs never
    cross texts."""
    found = []
    for t in texts:
        b = np.frombuffer(t, dtype=np.uint8).astype(np.uint64)
        if len(b) > order:
            code = b[:len(b) - order].copy()
            for i in range(1, order + 1):
                code = code << np.uint64(8) | b[i:len(b) - order + i]
            found.append(code)
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(np.concatenate(found), return_counts=True)


def _contexts(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contexts of the runs and their counts."""
    context = codes >> np.uint64(8)
    first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(codes) else np.empty(0, np.int64)
    return context[first], np.add.reduceat(counts, first) if len(first) else np.empty(0, np.int64)


def code_lengths(texts: list[bytes], trees: list[Tree], order: int = ORDER) -> np.ndarray:
    """Bits of each text (row) under each tree (column)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.zeros((len(texts), len(trees)))
    if not sizes.sum():
        return out
    symbols = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int32)
    begins = np.append(0, np.cumsum(sizes)[:-1])
    count = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = begins[owner] + nth * SEGMENT
    stop = np.minimum(start + SEGMENT, begins[owner] + sizes[owner])
    states = [np.zeros(len(owner), dtype=np.int32) for _ in trees]
    bits = [np.zeros(len(owner)) for _ in trees]
    for step in range(-order, SEGMENT):
        at = start + step
        inside = (at >= begins[owner]) & (at < stop)
        if not inside.any():
            continue
        symbol = np.where(inside, symbols[np.minimum(np.maximum(at, 0), len(symbols) - 1)], np.int32(_PAD))
        for i, tree in enumerate(trees):
            cell = states[i] + symbol
            if step >= 0:
                bits[i] += tree.bits.take(cell)
            states[i] = tree.after.take(cell)
    for i in range(len(trees)):
        out[:, i] = np.bincount(owner, weights=bits[i], minlength=len(texts))
    return out


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> dict[str, Tree]:
    """A tree per language from a bounded sample of the labelled rows that are not
    held out: about ``sample_docs`` of each language, taken by a hash of the id, at
    most twice as many in all.  Rows with a null id, text or label teach nothing."""
    rows = docs.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label_col).count().collect()}
    if not counts:
        return {}
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))])
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("language sample")), F.lit(1 << 30))
    chosen = rows.where(place < share[F.col(label_col)] * (1 << 30)).select(F.col(label_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    texts: dict[str, list[bytes]] = {}
    for lang, text, _ in sorted(chosen.limit(2 * sample_docs * len(counts)).collect(), key=lambda r: (r["lang"], r["id"])):
        texts.setdefault(lang, []).append(text.encode())
    return {lang: Tree(t) for lang, t in sorted(texts.items())}


def identify(docs: DataFrame, trees: dict[str, Tree], id_col: str = "doc_id", text_col: str = "text", carried: Sequence[str] = ()) -> DataFrame:
    """One row per input row: id, ``lang_pred``, ``score`` (the posterior of the
    language under equal priors) and ``bits_per_byte`` of its code; before them the
    ``carried`` columns of the row, in the place of id where there are any.

    A null text, or one without a letter, is ``und`` with score 0 and null bits, and
    so is every text if there are no trees.  Of equal codes the first language in
    alphabetical order is taken.  Repeated rows are predicted each, an empty table
    gives no rows, other columns are ignored."""
    names = sorted(trees)
    # Plain arrays: a broadcast names classes, which executors may not have, by their module.
    box = docs.sparkSession.sparkContext.broadcast([(trees[n].bits, trees[n].after) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = [SimpleNamespace(bits=bits, after=after) for bits, after in box.value]
        for batch in batches:
            lang: list = [UNDETERMINED] * batch.num_rows
            score, per_byte = [0.0] * batch.num_rows, [None] * batch.num_rows
            some, texts, size = [], [], 0

            def settle() -> None:
                bits = code_lengths(texts, frozen)
                best = bits.argmin(axis=1)
                odds = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                for i, t, b, o, row in zip(some, texts, best.tolist(), odds.tolist(), bits):
                    lang[i], score[i], per_byte[i] = names[b], 1 / o, float(row[b]) / len(t)

            letters = batch.column(1).to_pylist()
            column = batch.column(0).cast(pa.binary())
            for i in range(batch.num_rows if names else 0):
                if letters[i]:
                    some.append(i)
                    texts.append(column[i].as_py())
                    size += len(texts[-1])
                    if size >= WINDOW:
                        settle()
                        some, texts, size = [], [], 0
            if texts:
                settle()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(per_byte, pa.float64())],
                names=[*batch.schema.names[2:], "lang_pred", "score", "bits_per_byte"])

    carried = list(carried) or [id_col]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    rows = docs.select(F.col(text_col).alias("_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letters"), *carried)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, bits_per_byte double")
