"""MurmurHash3 x64-128 over numpy arrays, and the 63-bit hashes built on it."""

from __future__ import annotations

import numpy as np

SEED = 9001
_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
_MASK = (1 << 64) - 1


def _rot(x, r):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _fmix(x):
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _finish(h1, h2, n):
    h1, h2 = h1 ^ n, h2 ^ n
    h1 = h1 + h2
    h2 = h2 + h1
    h1, h2 = _fmix(h1), _fmix(h2)
    h1 = h1 + h2
    return h1, h2 + h1


def murmur_longs(values: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Both halves for each 64-bit value, hashed as its 8 little-endian bytes."""
    k = np.ascontiguousarray(values).view(np.uint64) * _C1
    h1 = np.full(len(values), seed, np.uint64) ^ (_rot(k, 31) * _C2)
    return _finish(h1, np.full(len(values), seed, np.uint64), np.uint64(8))


def murmur_doubles(values: np.ndarray, seed: int = SEED):
    """As murmur_longs on the bits; -0.0 counts as 0.0 and every NaN as one."""
    v = np.asarray(values, np.float64) + 0.0
    v = np.where(np.isnan(v), np.frombuffer(np.uint64(0x7FF8000000000000).tobytes(), np.float64)[0], v)
    return murmur_longs(v.view(np.int64), seed)


def murmur_bytes(data: bytes, seed: int = SEED) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        h = [np.array([seed], np.uint64), np.array([seed], np.uint64)]
        n = len(data) // 16 * 16
        for at in range(0, n, 16):
            k1, k2 = np.frombuffer(data, "<u8", 2, at).reshape(2, 1)
            h[0] = (_rot(h[0] ^ (_rot(k1 * _C1, 31) * _C2), 27) + h[1]) * np.uint64(5) + np.uint64(0x52DCE729)
            h[1] = (_rot(h[1] ^ (_rot(k2 * _C2, 33) * _C1), 31) + h[0]) * np.uint64(5) + np.uint64(0x38495AB5)
        k1, k2 = np.frombuffer(data[n:].ljust(16, b"\0"), "<u8").reshape(2, 1)
        h[1] = h[1] ^ (_rot(k2 * _C2, 33) * _C1)
        h[0] = h[0] ^ (_rot(k1 * _C1, 31) * _C2)
        a, b = _finish(h[0], h[1], np.uint64(len(data)))
    return int(a[0]), int(b[0])


def seed_hash(seed: int = SEED) -> int:
    """The 16 bits that tell sketches of different seeds apart."""
    got = murmur_bytes(int(seed).to_bytes(8, "little"), 0)[0] & 0xFFFF
    if got == 0:
        raise ValueError("this seed's hash is 0; choose another")
    return got
