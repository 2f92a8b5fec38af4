"""Vectorised text kernels over Arrow string buffers (numpy, no per-word Python).

A chunk is a run of whole documents whose bytes lie in one buffer. Words are maximal runs
of bytes that a 256-entry table accepts and never cross documents. Span hashes come from a
prefix sum of ``byte * R**i`` modulo 2**64, so any span costs one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
ALNUM = LETTER.copy()
ALNUM[48:58] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i for i <= n, kept per worker."""
    if "r" not in _powers or len(_powers["r"]) <= n:
        m = max(n + 1, CHUNK_BYTES + 4096)
        for name, base in (("r", _R), ("i", _RINV)):
            p = np.full(m, base, dtype=np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers[name] = p
    return _powers["r"], _powers["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole documents of about ``size`` bytes."""
    column = column.fill_null("") if column.null_count else column
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, off, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    offs = np.frombuffer(off, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


class Words:
    """Words of a chunk: ``start``, ``end`` byte positions, ``doc`` row in the chunk, ``first`` per document."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, accept: np.ndarray):
        n = len(buf)
        ok = accept[buf]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offs] = True
        prev = np.zeros(n, dtype=bool)
        prev[1:] = ok[:-1]
        self.start = np.flatnonzero(ok & (~prev | edge[:n]))
        after = np.zeros(n, dtype=bool)
        after[:-1] = ok[1:]
        self.end = np.flatnonzero(ok & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.count)


class Prefix:
    """Prefix hashes of a chunk; ``span`` hashes any byte spans independently of their place."""

    def __init__(self, buf: np.ndarray):
        r, self.inv = powers(len(buf))
        self.sum = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * r[: len(buf)], out=self.sum[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.inv[start] + (end - start).astype(np.uint64))


def word_hash(word: bytes) -> int:
    """The span hash of one byte string."""
    b = np.frombuffer(word, dtype=np.uint8)
    return int(Prefix(b).span(np.array([0]), np.array([len(b)]))[0])


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values; the last k-1 places are dropped."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return out
