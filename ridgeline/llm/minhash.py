"""One-permutation MinHash with optimal densification, and band keys."""

from __future__ import annotations

from functools import cache

import numpy as np

from . import kernels as K

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_PROBES = 64


@cache
def _probes(bins: int) -> np.ndarray:
    """For each attempt, the bin that an empty bin borrows from."""
    return np.random.default_rng(bins).integers(0, bins, (_PROBES, bins))


def signatures(of: np.ndarray, hashes: np.ndarray, n: int, bins: int) -> np.ndarray:
    """n x bins minima of the sets whose elements are ``hashes`` with owners ``of``; empty sets keep the empty value.

    One hash per element: its high bits name the bin, its low bits compete for the bin's minimum.  An empty
    bin borrows from bins drawn by a fixed random sequence of its own until one is not empty (optimal
    densification), so two sets borrow alike.
    """
    out = np.full(n * bins, _EMPTY, dtype=np.uint64)
    where = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(out, of * bins + where, hashes & np.uint64(0xFFFFFFFFFFFF))
    out = out.reshape(n, bins)
    empty = out == _EMPTY
    rows = np.flatnonzero(empty.any(axis=1) & ~empty.all(axis=1))
    if len(rows):
        source, filled, todo = out[rows], out[rows].copy(), empty[rows].copy()
        for probe in _probes(bins):
            if not todo.any():
                break
            i, j = np.nonzero(todo)
            borrowed = source[i, probe[j]]
            filled[i, j] = borrowed
            todo[i, j] = borrowed == _EMPTY
        i, j = np.nonzero(todo)  # left after all probes: the set's smallest value, equal for equal sets
        filled[i, j] = source[i].min(axis=1)
        out[rows] = filled
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """n x bands keys (int64): each mixes the band's number with its rows of the signature."""
    n, bins = signature.shape
    rows = bins // bands
    parts = signature.reshape(n, bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands))
    for r in range(rows):
        keys = K.mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return keys.view(np.int64)
