"""Anchors of byte windows: places that equal windows agree on.

Every window of WINDOW bytes names the place of the lowest hash among the runs of
GRAM bytes inside it (the leftmost, if several).  Equal windows name the same place
in them, so windows can only be equal if the runs at their anchors are, and one
anchor stands for all the windows that name it.
"""

from __future__ import annotations

import numpy as np

WINDOW = 100
GRAM = 32

_BASE = 0x9E3779B97F4A7C15 | 1


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the run of ``gram`` bytes (a power of two) at each place."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    size, power = 1, _BASE
    while size < gram:
        h = h[:-size] * np.uint64(power) + h[size:]
        size, power = 2 * size, power * power % 2**64
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` over each run of ``width`` values."""
    size, out = 1, x
    while 2 * size <= width:
        out = best(out[:-size], out[size:])
        size *= 2
    return best(out[:len(x) - width + 1], out[width - size:]) if size < width else out


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, first, last) of each anchor in texts that lie one after another
    in ``data``: the windows that start from ``first`` to ``last`` name it.  No
    window crosses an end."""
    none = np.empty(0, np.int64)
    if len(data) < window:
        return none.astype(np.uint64), none, none, none
    runs = window - gram + 1
    h = _gram_hashes(data, gram)
    low = _sliding(h, runs, np.minimum)  # of the window at each start
    whole = np.zeros(len(data) + 1, dtype=np.int8)
    long = ends - starts >= window
    np.add.at(whole, starts[long], 1)
    np.add.at(whole, ends[long] - window + 1, -1)
    inside = np.cumsum(whole[:len(low)], dtype=np.int8).astype(bool)
    low[~inside] = 0
    edge = np.zeros(runs - 1, dtype=np.uint64)
    named = _sliding(np.concatenate([edge, low, edge]), runs, np.maximum)  # highest of the lows of windows over each run
    at = np.flatnonzero((named == h) & (named > 0))
    value = h[at]
    del h, low, named
    owner = np.searchsorted(starts, at, side="right") - 1
    begin, end = starts[owner], ends[owner]
    # The nearest anchors that take a window away: earlier and not higher, or later and lower.
    before, after = begin - 1, end - gram + 1
    for side in (-1, 1):
        index = np.arange(len(at))
        step = 0
        while len(index):
            step += 1
            other = index + side * step
            near = (other >= 0) & (other < len(at))
            index, other = index[near], other[near]
            near = np.abs(at[other] - at[index]) < runs
            index, other = index[near], other[near]
            takes = value[other] <= value[index] if side < 0 else value[other] < value[index]
            if side < 0:
                before[index[takes]] = np.maximum(before[index[takes]], at[other[takes]])
            else:
                after[index[takes]] = np.minimum(after[index[takes]], at[other[takes]])
            index = index[~takes]
    first = np.maximum(np.maximum(at - runs + 1, before + 1), begin)
    last = np.minimum(np.minimum(at, after - runs), end - window)
    real = first <= last
    return value[real], at[real], first[real], last[real]


def range_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``data[begin:end]`` for each pair, from prefix sums."""
    value = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)
    down = np.full(len(data) + 1, np.uint64(pow(_BASE, -1, 2**64)))
    down[0] = 1
    np.multiply.accumulate(down, out=down)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(value[data] * down[:-1], out=sums[1:])
    # BASE ** begin by squaring, so that equal bytes hash alike wherever they lie.
    up, power, rest = np.ones(len(begin), dtype=np.uint64), np.uint64(_BASE), begin.astype(np.uint64)
    while len(rest) and rest.any():
        up = np.where(rest & np.uint64(1), up * power, up)
        with np.errstate(over="ignore"):
            power = power * power
        rest = rest >> np.uint64(1)
    h = (sums[end] - sums[begin]) * up
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xBF58476D1CE4E5B9)
