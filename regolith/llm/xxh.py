"""XXH64 of many byte ranges of one buffer at once, with numpy."""

from __future__ import annotations

import numpy as np

# Fixed values of the XXH64 specification.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(buffer: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of buffer[starts[i]:ends[i]], unsigned."""
    padded = buffer + b"\0" * 40
    raw = np.frombuffer(padded, np.uint8)
    lanes = np.ascontiguousarray(np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,)))
    starts = np.asarray(starts, np.int64)
    size = np.asarray(ends, np.int64) - starts
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        h = np.full(len(starts), s + P5, np.uint64)
        at = starts.copy()
        long_ = np.flatnonzero(size >= 32)
        if len(long_):
            v = [np.full(len(long_), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            p, stripes = at[long_], size[long_] // 32
            live = np.arange(len(long_))
            while len(live):
                for j in range(4):
                    v[j][live] = _round(v[j][live], lanes[p[live] + 8 * j])
                p[live] += 32
                stripes[live] -= 1
                live = live[stripes[live] > 0]
            x = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for j in range(4):
                x = (x ^ _round(np.uint64(0), v[j])) * P1 + P4
            h[long_], at[long_] = x, p
        h += size.astype(np.uint64)
        rest = size - (at - starts)
        for _ in range(3):
            live = np.flatnonzero(rest >= 8)
            if not len(live):
                break
            h[live] = _rotl(h[live] ^ _round(np.uint64(0), lanes[at[live]]), 27) * P1 + P4
            at[live] += 8
            rest[live] -= 8
        live = np.flatnonzero(rest >= 4)
        if len(live):
            h[live] = _rotl(h[live] ^ ((lanes[at[live]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
            at[live] += 4
            rest[live] -= 4
        for _ in range(3):
            live = np.flatnonzero(rest > 0)
            if not len(live):
                break
            h[live] = _rotl(h[live] ^ (raw[at[live]].astype(np.uint64) * P5), 11) * P1
            at[live] += 1
            rest[live] -= 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))
