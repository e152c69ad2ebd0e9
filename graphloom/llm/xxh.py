"""XXH64 of many byte ranges of one array at once, in numpy."""

from __future__ import annotations

import numpy as np

_M = 2**64
_P1, _P2, _P3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_P4, _P5 = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_U = np.uint64
#: Ranges hashed in one go, so that temporaries stay in cache.
_STEP = 1 << 15


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * _U(_P2), 31) * _U(_P1)


def xxh64_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start[i]:end[i]] for each i."""
    pad = np.zeros(len(data) + 8, dtype=np.uint8)
    pad[: len(data)] = data
    u64 = np.ndarray((len(data) + 1,), dtype="<u8", buffer=pad, strides=(1,))
    u32 = np.ndarray((len(data) + 1,), dtype="<u4", buffer=pad, strides=(1,))
    out = np.empty(len(start), dtype=np.uint64)
    order = np.argsort(end - start, kind="stable")  # like lengths together: most steps then take all rows
    for i in range(0, len(order), _STEP):
        pick = order[i : i + _STEP]
        out[pick] = _some(pad, u64, u32, start[pick].astype(np.int64), end[pick].astype(np.int64), seed)
    return out


def _some(pad, u64, u32, at, end, seed):
    size = end - at
    at = at.copy()
    h = np.full(len(at), (seed + _P5) % _M, dtype=np.uint64)
    big = np.flatnonzero(size >= 32)
    if len(big):
        p, stop = at[big], end[big]
        acc = [np.full(len(big), v % _M, dtype=np.uint64) for v in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        on = np.arange(len(big))
        while len(on):
            for k in range(4):
                acc[k][on] = _round(acc[k][on], u64[p[on] + 8 * k])
            p[on] += 32
            on = on[stop[on] - p[on] >= 32]
        v = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
        for a in acc:
            v = (v ^ _round(np.zeros_like(a), a)) * _U(_P1) + _U(_P4)
        h[big], at[big] = v, p
    h += size.astype(np.uint64)
    rest = end - at
    for _ in range(3):
        on = np.flatnonzero(rest >= 8)
        if not len(on):
            break
        k = _round(np.zeros(len(on), dtype=np.uint64), u64[at[on]])
        h[on] = _rot(h[on] ^ k, 27) * _U(_P1) + _U(_P4)
        at[on] += 8
        rest[on] -= 8
    on = np.flatnonzero(rest >= 4)
    if len(on):
        h[on] = _rot(h[on] ^ (u32[at[on]].astype(np.uint64) * _U(_P1)), 23) * _U(_P2) + _U(_P3)
        at[on] += 4
        rest[on] -= 4
    for _ in range(3):
        on = np.flatnonzero(rest > 0)
        if not len(on):
            break
        h[on] = _rot(h[on] ^ (pad[at[on]].astype(np.uint64) * _U(_P5)), 11) * _U(_P1)
        at[on] += 1
        rest[on] -= 1
    h ^= h >> _U(33)
    h *= _U(_P2)
    h ^= h >> _U(29)
    h *= _U(_P3)
    return h ^ (h >> _U(32))
