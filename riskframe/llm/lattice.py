"""The lattice E8: decoding to the nearest point, and the cells around it."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even sum: the worst-rounded coordinate moves
    to its second nearest integer where the sum is odd."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    if len(odd):
        off = x[odd] - r[odd]
        worst = np.abs(off).argmax(axis=1)
        rows = np.arange(len(odd))
        r[odd, worst] += np.where(off[rows, worst] >= 0, 1.0, -1.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 (even points, and those shifted by one half) to each row."""
    whole, half = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def roots() -> np.ndarray:
    """The 240 shortest vectors: steps from a point to its nearest neighbours."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [v for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


_ROOTS = roots()


def cells(x: np.ndarray, probes: int) -> np.ndarray:
    """(rows, probes, 8): the cell of each row and then the neighbouring cells whose
    centres are nearest to it."""
    home = decode(x)
    out = np.empty((len(x), probes, 8))
    out[:, 0] = home
    if probes > 1:
        near = (x - home) @ _ROOTS.T
        best = np.argsort(-near, axis=1, kind="stable")[:, :probes - 1]
        out[:, 1:] = home[:, None] + _ROOTS[best]
    return out


def keys(points: np.ndarray, seed: int) -> np.ndarray:
    """64-bit key of each point; different points may share one, which only costs
    work."""
    doubled = np.rint(points * 2).astype(np.int64).view(np.uint64)
    h = np.full(points.shape[:-1], np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64))
    for i in range(points.shape[-1]):
        h = (h ^ doubled[..., i]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)
