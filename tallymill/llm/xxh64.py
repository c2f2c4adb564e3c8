"""XXH64 of many short slices of one buffer at once, by length."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
P1, P2, P3, P4, P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer slices are hashed one by one.
LONGEST = 128


def _rot(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def _round(acc, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * P2, 31) * P1


def _of_length(a8: np.ndarray, a4: np.ndarray, a1: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    done = 0
    with np.errstate(over="ignore"):
        s = U(seed)
        if size >= 32:
            v = [np.full(len(at), x, dtype=U) for x in (s + P1 + P2, s + P2, s, s - P1)]
            while size - done >= 32:
                v = [_round(x, a8[at + (done + 8 * i)]) for i, x in enumerate(v)]
                done += 32
            h = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
            for x in v:
                h = (h ^ _round(U(0), x)) * P1 + P4
            h = h + U(size)
        else:
            h = np.full(len(at), s + P5 + U(size), dtype=U)
        while size - done >= 8:
            h = _rot(h ^ _round(U(0), a8[at + done]), 27) * P1 + P4
            done += 8
        if size - done >= 4:
            h = _rot(h ^ a4[at + done].astype(U) * P1, 23) * P2 + P3
            done += 4
        while done < size:
            h = _rot(h ^ a1[at + done].astype(U) * P5, 11) * P1
            done += 1
        h ^= h >> U(33)
        h *= P2
        h ^= h >> U(29)
        h *= P3
        h ^= h >> U(32)
    return h


def xxh64_slices(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of data[start:end] for each pair."""
    out = np.empty(len(starts), dtype=U)
    padded = data + bytes(8)
    a8, a4, a1 = (np.ndarray(len(data) + 1, dtype=t, buffer=padded, strides=(1,)) for t in ("<u8", "<u4", "u1"))
    sizes = ends - starts
    order = np.argsort(np.minimum(sizes, LONGEST + 1).astype(np.uint8), kind="stable")
    ranked = sizes[order]
    for size in range(min(int(ranked[0]), LONGEST + 1) if len(order) else LONGEST + 1, LONGEST + 1):
        lo, hi = np.searchsorted(ranked[: np.searchsorted(np.minimum(ranked, LONGEST + 1), LONGEST + 1)], [size, size + 1])
        if lo < hi:
            out[order[lo:hi]] = _of_length(a8, a4, a1, starts[order[lo:hi]], size, seed)
    for i in np.flatnonzero(sizes > LONGEST):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]], seed=seed)
    return out
