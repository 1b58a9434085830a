"""Hashes of byte spans from one prefix pass: polynomial over 2^64 with fixed random letters, then mixed."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that every bit depends on all."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) <= n:
        size = max(2 * len(_powers), n + 1, 1 << 16)
        inverse = np.uint64(pow(int(BASE), -1, 2**64))
        tables = []
        for step in (BASE, inverse):
            run = np.full(size, step, np.uint64)
            run[0] = 1
            tables.append(np.multiply.accumulate(run))
        _powers, _inverse = tables
    return _powers, _inverse


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a uint8 array; n + 1 numbers."""
    out = np.zeros(len(data) + 1, np.uint64)
    powers, _ = _tables(len(data))
    np.cumsum(_LETTERS[data] * powers[: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hash of each span of bytes; equal spans have equal hashes wherever they stand."""
    _, inverse = _tables(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
