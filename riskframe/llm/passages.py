"""Repeated passages, removed wherever they do not stand first.

A byte goes if it lies in a string of WINDOW bytes that starts earlier as well.
Windows meet through their anchors (module ``anchors``).  All windows of an anchor
form a segment; segments sorted by anchor hash, content hash and place show at once
which are whole copies of an earlier one.  Segments that share an anchor but not
their content are put together in blocks, and the Burrows-Wheeler transform of a
block tells which of their windows are equal (module ``intervals``).

The sort is by range over hash and place, so an anchor that a third of all documents
share is spread over many tasks.  Where a range begins or ends inside an anchor, its
segments count as different until the transform has compared them.  An anchor with
too many different segments is split: fewer windows to a segment, so longer strings
must agree, down to single windows, whose copies the sort finds alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.anchors import GRAM, WINDOW, anchors, range_hashes
from riskframe.llm.intervals import later_windows
from riskframe.operators.ordered import materialize

#: Bytes of text hashed at a time, and of segments in one transform.
HASHED, BLOCK = 4_000_000, 1_000_000
#: Different segments of an anchor that one task compares.
SEGMENTS = 2000
#: Windows to a segment where an anchor has more.
SPLITS = (8, 1)

_SEGMENT = "key long, digest long, doc long, first long, at int, windows int"


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """A row per anchor: hash of its run, hash of its segment, document, first
    window, place of the anchor in the segment, number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).to_pylist()
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            part = np.cumsum(sizes) // HASHED
            for p in np.unique(part):
                some = np.flatnonzero(part == p)
                data = np.frombuffer(b"".join(texts[i] for i in some), dtype=np.uint8)
                ends = np.cumsum(sizes[some])
                starts = ends - sizes[some]
                key, at, first, last = anchors(data, starts, ends, window, gram)
                digest = range_hashes(data, first, last + window) + ((at - first) * 512 + (last - first)).astype(np.uint64)
                owner = np.searchsorted(starts, at, side="right") - 1
                yield _batch({
                    "key": key.view(np.int64), "digest": digest.view(np.int64), "doc": ids[some[owner]], "first": first - starts[owner],
                    "at": (at - first).astype(np.int32), "windows": (last - first + 1).astype(np.int32)})

    return docs.mapInArrow(run, _SEGMENT)


def _folded(segments: DataFrame) -> DataFrame:
    """Segments that matter, each marked: a ``copy`` of an earlier one with the same
    content, or a first one whose anchor has other contents too (or may have, at the
    edge of a range).  Lone segments are left out; copies lose key and content."""
    by = ["key", "digest", "doc", "first"]
    content = "content" in segments.columns

    def given(rows: pa.RecordBatch, copy: np.ndarray) -> pa.RecordBatch:
        names = ["key", "doc", "first", "at", "windows", *(["content"] if content else [])]
        columns = [rows.column(rows.schema.get_field_index(c)) for c in names]
        first_only = pa.array(np.arange(len(copy)), mask=copy)
        columns = [v.take(first_only) if c in ("key", "content") else v for c, v in zip(names, columns)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(copy)], names=[*names, "copy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening = None  # anchor at the start of the range: counts as shared
        last = None  # key and digest of the last row
        head = None  # document and place of the last first segment
        held, shown = None, True  # that segment, and whether it was given
        for batch in batches:
            if not batch.num_rows:
                continue
            key, digest, doc, place = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in by)
            if last is None:
                opening, last, head = key[0], (key[0], ~digest[0]), (doc[0], place[0])
            new = (key != np.append(last[0], key[:-1])) | (digest != np.append(last[1], digest[:-1]))
            heads = np.flatnonzero(new)
            of = np.cumsum(new)
            # A row that repeats an id and a place is the same segment again, no copy.
            copy = (doc != np.append(head[0], doc[heads])[of]) | (place != np.append(head[1], place[heads])[of])
            k = key[heads]
            same = k[1:] == k[:-1]
            give = np.append(same, False) | np.append(False, same)[:len(k)] if len(k) else np.empty(0, bool)
            give |= k == opening
            if len(k) and held is not None and held.column(held.schema.get_field_index("key"))[0].as_py() == k[0]:
                give[0] = True
                if not shown:
                    yield given(held, np.array([False]))
            out = copy.copy()
            out[heads[give]] = True
            chosen = np.flatnonzero(out)
            if len(chosen):
                yield given(batch.take(pa.array(chosen)), copy[chosen])
            if len(k):
                at = int(heads[-1])
                held, shown, head = batch.take(pa.array([at])), bool(give[-1]), (doc[at], place[at])
            last = (key[-1], digest[-1])
        if held is not None and not shown:
            yield given(held, np.array([False]))

    schema = "key long, doc long, first long, at int, windows int" + (", content binary" if content else "") + ", copy boolean"
    return segments.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def _contents(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The bytes of the wanted segments."""
    listed = wanted.groupBy("doc").agg(F.collect_set(F.struct("key", "first", "at", "windows")).alias("s"))
    joined = docs.join(listed.hint("shuffle_hash"), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, s in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2)):
                s = s.values
                first, windows = s.field("first"), s.field("windows")
                pieces = [text[a:a + w + window - 1] for a, w in zip(first.to_pylist(), windows.to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [s.field("key"), pa.array([doc] * len(pieces), pa.int64()), first, s.field("at"), windows, pa.array(pieces, pa.binary())],
                    names=["key", "doc", "first", "at", "windows", "content"])

    return joined.mapInArrow(run, "key long, doc long, first long, at int, windows int, content binary")


def _split(segments: DataFrame, width: int, window: int) -> DataFrame:
    """Segments of at most ``width`` windows, cut at fixed distances from the anchor
    and keyed by the bytes that all their windows share."""

    def h(b: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("key", "digest", "doc", "first", "at", "windows", "content")}
            for doc, first, at, windows, content in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                low = 0
                while low < windows:
                    # Windows at the same multiple of width before the anchor stay together.
                    high = min(windows, low + ((at - low) % width) + 1)
                    # All windows of the stretch, were it as wide as it can be, share these bytes.
                    top = low + ((at - low) % width)
                    shared = content[top:top - width + 1 + window]
                    piece = content[low:high + window - 1]
                    for c, v in zip(out, (h(shared + (at - top).to_bytes(4, "little")), h(piece + (at - low).to_bytes(4, "little")), doc, first + low, at - low, high - low, piece)):
                        out[c].append(v)
                    low = high
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["key"], pa.int64()), pa.array(out["digest"], pa.int64()), pa.array(out["doc"], pa.int64()), pa.array(out["first"], pa.int64()),
                 pa.array(out["at"], pa.int32()), pa.array(out["windows"], pa.int32()), pa.array(out["content"], pa.binary())], names=list(out))

    columns = segments.select("key", "doc", "first", "at", "windows", "content")
    return columns.mapInArrow(run, f"{_SEGMENT}, content binary")


def _compared(segments: DataFrame, window: int) -> DataFrame:
    """Stretches of windows that equal an earlier one, of the segments of shared
    anchors; the segments of an anchor are compared in one block."""

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key = rows["key"].to_numpy()
        _, nth, count = np.unique(key, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count[nth] > 1)
        if not len(shared):
            return
        rows = rows.take(pa.array(shared))
        doc, first = rows["doc"].to_numpy(), rows["first"].to_numpy()
        piece, offset = later_windows(rows["content"].to_pylist(), doc, first, window)
        if not len(piece):
            return
        doc, start = doc[piece], first[piece] + offset
        by = np.lexsort((start, doc))
        doc, start = doc[by], start[by]
        new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + window))
        begin = np.flatnonzero(new)
        end = start[np.append(begin[1:], len(start)) - 1] + window
        yield _batch({"doc": doc[begin], "start": start[begin], "stop": end})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < BLOCK:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            key = rows["key"].to_numpy()
            changes = np.flatnonzero(key[1:] != key[:-1]) + 1
            at = 0
            # Whole anchors, about a block at a time; the last one may go on.
            per = max(1, int(rows.num_rows * BLOCK / size))
            while len(changes) and at < changes[-1]:
                to = changes[min(np.searchsorted(changes, at + per), len(changes) - 1)]
                yield from compare(rows.slice(at, int(to) - at))
                at = int(to)
            rest = rows.slice(at)
            held, size = rest.to_batches(), int(size * rest.num_rows / rows.num_rows)
        if held:
            yield from compare(pa.Table.from_batches(held).combine_chunks())

    columns = segments.select("key", "doc", "first", "content")
    return columns.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc long, start long, stop long")


def _copies(marked: DataFrame, window: int) -> DataFrame:
    return marked.where("copy").select("doc", F.col("first").alias("start"), (F.col("first") + F.col("windows") + (window - 1)).alias("stop"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, segments_at_once: int = SEGMENTS) -> DataFrame:
    """(doc, start, stop): byte stretches of ``docs`` (doc, text) that are covered by
    windows which also start earlier; stretches of a document may overlap."""
    marked = materialize(_folded(_segments(docs, window, gram)))
    found = [_copies(marked, window)]
    segments = materialize(_contents(docs, marked.where("not copy").drop("copy"), window))
    for width in SPLITS:
        crowded = materialize(segments.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > segments_at_once).select("key"))
        if crowded.isEmpty():
            break
        found.append(_compared(segments.join(crowded, "key", "left_anti"), window))
        marked = materialize(_folded(_split(segments.join(crowded, "key", "left_semi"), width, window)))
        found.append(_copies(marked, window))
        segments = marked.where("not copy").drop("copy")
    found.append(_compared(segments, window))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, segments_at_once: int = SEGMENTS) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs) and ``kept``, the bytes that remain.

    Texts are their UTF-8 bytes, null counting as empty; texts shorter than a window
    keep all.  Earlier means a smaller id, then a smaller place.  Ids are integers;
    a row that repeats an id must repeat its text, and fares like the other one.
    Rows with a null id take no part and keep all.  An empty table gives no rows;
    other columns are ignored.  ``gram`` is a power of two below ``window``, which is
    at most 255."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = repeated_spans(rows.where("doc is not null"), window, gram, segments_at_once)
    listed = spans.groupBy("doc").agg(F.collect_set(F.struct("start", "stop")).alias("s"))
    joined = rows.join(listed.hint("shuffle_hash"), "doc", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, kept = [], [], []
            for text, s in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2)):
                spans = [] if s.values is None else sorted(zip(s.values.field("start").to_pylist(), s.values.field("stop").to_pylist()))
                parts, at, gone, n = [], 0, 0, 0
                for a, b in spans:
                    if a > at or not n:
                        parts.append(text[at:a])
                        n, gone, at = n + 1, gone + b - a, b
                    elif b > at:
                        gone, at = gone + b - at, b
                parts.append(text[at:])
                removed.append(gone)
                runs.append(n)
                kept.append(b"".join(parts))
            size = pc.binary_length(batch.column(1).cast(pa.binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    out = joined.mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("doc", id_col)
