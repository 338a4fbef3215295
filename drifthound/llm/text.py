"""Words of whole Arrow batches as numpy arrays of 64-bit hashes.

A batch of texts is handled as the bytes of its UTF-8 buffer, one MB at a
time; both word rules of the contracts look at ASCII bytes only, so bytes of
longer characters always belong to words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_B = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, all other bytes as they are.
LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)
ALNUM = ((_B >= 48) & (_B <= 57)) | ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
NOT_SPACE = ~((_B == 32) | ((_B >= 9) & (_B <= 13)))

CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C13)
_BYTE = np.random.default_rng(7).integers(1 << 62, (1 << 63) - 1, 256, dtype=np.int64).astype(np.uint64)[LOWER]
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = [np.full(size, b, np.uint64) for b in (int(_BASE), pow(int(_BASE), -1, 1 << 64))]
        for s in steps:
            s[0] = 1
            np.multiply.accumulate(s, out=s)
        _powers = (steps[0], steps[1])
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


@dataclass
class Words:
    """Words of some texts: hash, byte span in `data`, and each text's first word."""

    data: np.ndarray
    hashes: np.ndarray
    sums: np.ndarray  # running sums over bytes, from which parts are hashed
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # one more than texts

    def text(self, i: int) -> bytes:
        return LOWER[self.data[self.starts[i] : self.ends[i]]].tobytes()


def words_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ALNUM) -> Words:
    """`data`: the bytes of consecutive texts; `offsets`: where each begins, and the end."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, np.zeros(0, np.uint64), np.zeros(1, np.uint64), none, none, np.zeros(len(offsets), np.int64))
    inside = kind[data]
    edges = np.zeros(n + 1, bool)
    edges[1:n] = inside[1:] != inside[:-1]
    edges[0] = edges[n] = True
    cuts = offsets[(offsets > 0) & (offsets < n)]
    firsts = edges.copy()
    firsts[cuts] = True
    starts = np.flatnonzero(firsts[:n] & inside)
    lasts = edges[1:]
    lasts[cuts - 1] = True
    ends = np.flatnonzero(lasts & inside) + 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(data, hashes, sums, starts, ends, np.searchsorted(starts, offsets))


def prefix_hashes(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of more than `length` bytes, hash of their first `length` bytes)."""
    at = np.flatnonzero(w.ends - w.starts > length)
    a = w.starts[at]
    _, down = _power_tables(len(w.data) + 1)
    return at, mixed((w.sums[a + length] - w.sums[a]) * down[a] + _U(length + (1 << 32)))


def hash_words(words: list[str]) -> np.ndarray:
    """The same hashes for a list of words that the caller has."""
    raw = [w.encode() for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    up, down = _power_tables(int(offsets[-1]) + 1)
    data = np.frombuffer(b"".join(raw), np.uint8)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    a, b = offsets[:-1], offsets[1:]
    return mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; null is empty.

    A run is at most `limit` bytes, or one text if that alone is longer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and len(buffers[2]) else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words (by place of its first word; k at most len)."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out = out * _U(0x9E3779B97F4A7C15) + hashes[j : j + m]
    return mixed(out)
