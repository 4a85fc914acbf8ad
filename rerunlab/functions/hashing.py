"""Spark's xxhash64 of numbers in numpy: the draws of ``special.uniform`` where they are
made by the million, without a row for each."""

from __future__ import annotations

import numpy as np

P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_ONE = np.uint64(0x3FF0000000000000)


def _spread(h: np.ndarray, tmp: np.ndarray) -> np.ndarray:
    for shift, prime in ((33, P2), (29, P3)):
        np.right_shift(h, np.uint64(shift), out=tmp)
        h ^= tmp
        h *= prime
    np.right_shift(h, np.uint64(32), out=tmp)
    h ^= tmp
    return h


def _rotated(h: np.ndarray, by: int, tmp: np.ndarray) -> np.ndarray:
    np.left_shift(h, np.uint64(by), out=tmp)
    h >>= np.uint64(64 - by)
    h |= tmp
    return h


def with_int(seeds: np.ndarray, value: int | np.ndarray, out: np.ndarray | None = None, tmp: np.ndarray | None = None) -> np.ndarray:
    """The hash so far, ``seeds``, carried on over a column of Spark's int."""
    with np.errstate(over="ignore"):
        add = (np.asarray(value, np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)) * P1
        if out is None:
            out = np.empty(np.broadcast_shapes(seeds.shape, add.shape), np.uint64)
        tmp = np.empty_like(out) if tmp is None else tmp
        np.add(seeds, P5 + np.uint64(4), out=out)
        out ^= add
        _rotated(out, 23, tmp)
        out *= P2
        out += P3
        return _spread(out, tmp)


def of_long(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """The hash of a column of Spark's bigint."""
    with np.errstate(over="ignore"):
        h = values.astype(np.int64).view(np.uint64) * P2
        tmp = np.empty_like(h)
        _rotated(h, 31, tmp)
        h *= P1
        h ^= np.uint64(seed) + P5 + np.uint64(8)
        _rotated(h, 27, tmp)
        h *= P1
        h += P4
        return _spread(h, tmp)


def unit_interval(hashes: np.ndarray) -> np.ndarray:
    """``special.uniform``'s number in (0, 1) for each hash; ``hashes`` is used up."""
    hashes >>= np.uint64(12)
    hashes |= _ONE
    u = hashes.view(np.float64)  # 1 + bits / 2^52
    u -= 1 - 2.0**-53
    return u
