"""Vectorised word and shingle hashing over Arrow string buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with A-Z
lower-cased; this is the byte form of ``[^\\x20\\x09-\\x0D]+``.  Hashes are
64-bit: a polynomial over randomised bytes, finished by a bit mixer.
Buffers are worked through in windows, so that the temporary arrays stay
bounded however long a batch or a document is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_lower = np.arange(256)
_lower[65:91] += 32
BYTES = mix(_lower.astype(np.uint64) * np.uint64(_BASE) + np.uint64(1))
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Blank for word matching without punctuation: ASCII other than letters and digits.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_powers: list[np.ndarray] = []
LANES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, WINDOW + 1)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(m, base & _MASK, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=8 * column.offset) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the byte where each starts, and each text's first word."""
    hashes, places, a, n = [], [], 0, len(data)
    while a < n:
        b = min(a + WINDOW, n)
        if b < n:
            b = _word_end(data, offsets, a, b, blank)
        x = data[a:b]
        ink = ~blank[x]
        head, tail = ink.copy(), ink.copy()
        head[1:] &= ~ink[:-1]
        tail[:-1] &= ~ink[1:]
        lo, hi = np.searchsorted(offsets, (a, b))
        breaks = offsets[lo:hi] - a
        head[breaks] = ink[breaks]
        breaks = breaks[breaks > 0] - 1
        tail[breaks] = ink[breaks]
        s, e = np.flatnonzero(head), np.flatnonzero(tail)
        up, down = _power_tables(b - a)
        sums = np.cumsum(BYTES[x] * up[: b - a], dtype=np.uint64)
        h = sums[e]
        inner = s > 0
        h[inner] -= sums[s[inner] - 1]
        hashes.append(mix(h * down[s] + (e - s).astype(np.uint64)))
        places.append(s + a)
        a = b
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    return h, at, np.searchsorted(at, offsets)


def _word_end(data: np.ndarray, offsets: np.ndarray, a: int, b: int, blank: np.ndarray) -> int:
    """The last place in (a, b] where no word is cut, or the first after b."""
    blanks = np.flatnonzero(blank[data[a:b]])
    k = int(np.searchsorted(offsets, b, side="right")) - 1
    best = max(a + int(blanks[-1]) + 1 if len(blanks) else a, int(offsets[k]) if k >= 0 else a)
    if best > a:
        return best
    while b < len(data):
        step = data[b : b + WINDOW]
        blanks = np.flatnonzero(blank[step])
        stop = b + (int(blanks[0]) if len(blanks) else len(step))
        k = int(np.searchsorted(offsets, b))
        if k < len(offsets) and offsets[k] <= stop:
            return int(offsets[k])
        if len(blanks):
            return stop
        b += len(step)
    return len(data)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words, across text borders as well."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * LANES[0]
    for j in range(1, k):
        out += h[j : j + n] * LANES[j]
    return mix(out)


def shingle_sets(column: pa.Array, k: int):
    """For each text, its sorted array of distinct k-word shingle hashes.

    A text of fewer than k words has its whole word sequence as the only
    shingle; one without words has none.
    """
    h, _, first = words(*buffers(column))
    g = grams(h, k)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield np.unique(g[a : b - k + 1])
        elif b > a:
            yield mix(np.sum(h[a:b] * LANES[: b - a], dtype=np.uint64, keepdims=True) + LANES[63 - b + a])
        else:
            yield np.zeros(0, np.uint64)


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingle hashes."""
    total = np.sum(mix(shingles ^ LANES[62]), dtype=np.uint64, keepdims=True)
    return int(mix(total + np.uint64(len(shingles))).view(np.int64)[0])


def ragged(arrays: list[np.ndarray], kind=np.int64) -> pa.ListArray:
    """An Arrow list column of number arrays."""
    at = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=at[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(kind) if flat.dtype.itemsize == np.dtype(kind).itemsize else flat.astype(kind)))
