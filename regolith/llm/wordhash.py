"""Words of many texts as hashes, computed over one byte buffer with numpy."""

from __future__ import annotations

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(int(_R), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}
#: Bytes whose sums are held at once.
RUN = 1 << 19


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "r" not in _powers or len(_powers["r"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("r", _R), ("i", _RINV)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _powers[name] = np.multiply.accumulate(full)
    return _powers["r"], _powers["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Words:
    """The words of texts in order. text_of: each word's text; first: place of each text's first word, and the end."""

    def __init__(self, texts: list[bytes]):
        self.buffer = b" ".join(texts) + b" "
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths + 1)])
        raw = np.frombuffer(self.buffer, np.uint8)
        space = _SPACE[raw]
        edge = np.diff(space.astype(np.int8), prepend=np.int8(1), append=np.int8(1))
        self.start = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)
        self.first = np.searchsorted(self.start, self.text_start)
        self.raw = raw

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A hash of each word, made over runs of about RUN bytes, so that the sums take little memory."""
        out = np.empty(len(self), np.uint64)
        a = 0
        while a < len(self):
            base = int(self.start[a])
            b = max(a + 1, int(np.searchsorted(self.end, base + RUN, "right")))
            start, end = self.start[a:b] - base, self.end[a:b] - base
            n = int(end[-1])
            r, inv = _pow(n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((self.raw[base : base + n].astype(np.uint64) + np.uint64(1)) * r[:n], out=total[1:])
            out[a:b] = mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            a = b
        return out

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.buffer[self.start[i] : self.end[i]]

    def texts_words(self, t: int) -> list[bytes]:
        a, b = int(self.first[t]), int(self.first[t + 1])
        return [self.buffer[x:y] for x, y in zip(self.start[a:b].tolist(), self.end[a:b].tolist())]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k items from each place on (length n - k + 1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    q = np.uint64(0xA24BAED4963EE407)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * q + h[j : j + n]
    return mix(out)
