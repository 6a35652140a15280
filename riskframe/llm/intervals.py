"""Repeats of a minimum length by interval expansion on a Burrows-Wheeler transform.

The intervals of all strings of length 1, 2, 3, ... are visited breadth first: an
interval of the sorted suffixes is extended to the left by each symbol that stands
before it in the transform.  An interval found at depth d whose right border is still
open shows that the common prefix across the border has d - 1 symbols, and only
such an interval is expanded further; so common prefixes come out by increasing
value, each border is set once, and the work ends at the minimum length.  Borders
still open then lie inside groups of suffixes that share that many symbols.
"""

from __future__ import annotations

import numpy as np


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols or more, by doubling.
    Symbols are below 512; past the end counts as lower than any."""
    n = len(s)
    known = 7
    padded = np.zeros(n + known, dtype=np.int64)
    padded[:n] = s
    key = np.zeros(n, dtype=np.int64)
    for i in range(known):
        key = key << 9 | padded[i:n + i]
    while True:
        order = np.argsort(key)
        value = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.append(1, value[1:] != value[:-1])) if n else 0
        if known >= depth or (n and rank[order[-1]] == n) or not n:
            return order
        later = np.zeros(n, dtype=np.int64)
        later[:max(0, n - known)] = rank[known:]
        key = rank * (n + 1) + later
        known *= 2


def common_prefixes(s: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): suffixes sorted to ``least`` symbols at least, and the common
    prefix of each with the one before it; -1 where it has ``least`` symbols or more.
    ``s`` must end with a symbol that is the lowest."""
    n = len(s)
    order = suffix_order(s, least)
    lcp = np.full(n + 1, -1, dtype=np.int32)
    lcp[0] = lcp[n] = 0
    if not n:
        return order, lcp[:0]
    transform = s[order - 1].astype(np.uint16)
    stable = np.argsort(transform, kind="stable")
    previous = np.empty(n, dtype=np.int64)  # row of the suffix one symbol longer
    previous[stable] = np.arange(n)
    first = transform[stable]
    ends = np.append(np.flatnonzero(first[1:] != first[:-1]), n - 1)
    begins = np.append(0, ends[:-1] + 1)
    fresh = ends < n - 1
    lcp[ends[fresh] + 1] = 0
    lb, rb = begins[fresh], ends[fresh]
    for depth in range(1, least):
        if not len(lb):
            break
        size = rb - lb + 1
        total = int(size.sum())
        source = np.repeat(np.arange(len(lb)), size)
        rows = previous[np.repeat(lb - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(total)]
        if 16 * total < n:
            by = np.argsort(rows)
            rows, source = rows[by], source[by]
        else:
            owner = np.full(n, -1, dtype=np.int64)
            owner[rows] = source
            rows = np.flatnonzero(owner >= 0)
            source = owner[rows]
        stop = np.append((source[1:] != source[:-1]) | (rows[1:] != rows[:-1] + 1) | (first[rows[1:]] != first[rows[:-1]]), True)
        right = rows[stop]
        left = rows[np.append(True, stop[:-1])]
        fresh = lcp[right + 1] < 0
        lb, rb = left[fresh], right[fresh]
        lcp[rb + 1] = depth
    return order, lcp[:n]


def later_windows(pieces: list[bytes], doc: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of each window of ``window`` bytes in the pieces that equals a
    window with a smaller (doc, start + offset)."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    bytes_ = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    begins = np.cumsum(sizes + 1) - sizes - 1
    s = np.zeros(int(sizes.sum()) + len(pieces), dtype=np.int64)
    inside = np.ones(len(s), dtype=bool)
    inside[begins + sizes] = False
    s[inside] = bytes_.astype(np.int64) + 1
    order, lcp = common_prefixes(s, window)
    group = np.cumsum(lcp >= 0)
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)[order]
    offset = order - begins[owner]
    real = offset + window <= sizes[owner]
    group, owner, offset = group[real], owner[real], offset[real]
    at = start[owner] + offset
    by = np.lexsort((at, doc[owner], group))
    group, owner, offset, at = group[by], owner[by], offset[by], at[by]
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, np.int64)
    earliest = np.repeat(head, np.diff(np.append(head, len(group))))
    later = (doc[owner] != doc[owner[earliest]]) | (at != at[earliest])
    return owner[later], offset[later]
