"""Vectorised scans of Arrow string columns: words, their hashes and hashed word runs, without Python strings.

Words are maximal runs of bytes that are no white space; as all separators are ASCII, this equals a scan by
code points. A batch is walked in slices of bounded size, so memory does not follow the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_rng = np.random.RandomState(20240517)
_BYTE = _rng.randint(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(4) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_RUN = _rng.randint(0, 1 << 62, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.ones(256, bool)
WORD[[9, 10, 11, 12, 13, 32]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(column: pa.Array):
    """(first row, row borders in bytes, bytes) of bounded parts of a string column; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    borders = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(borders, borders[first] + SLICE_BYTES, "right")) - 1
        last = min(len(column), max(first + 1, last))
        yield first, borders[first:last + 1] - borders[first], raw[borders[first]:borders[last]]
        first = last


def words(borders: np.ndarray, raw: np.ndarray, lower: bool = True):
    """Start, end and row of each word."""
    inside = WORD[raw]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[:1] = False
    edges = borders[:-1][borders[:-1] < len(raw)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1:] = False
    tails = borders[1:][borders[1:] > 0] - 1
    after[tails] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(borders, starts, "right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words, over A-Z lowered bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=first[1:])
    place = np.arange(first[-1]) - np.repeat(first[:-1], size)
    value = raw[np.repeat(starts, size) + place]
    power = np.ones(int(size.max()), np.uint64)
    if len(power) > 1:
        power[1:] = np.cumprod(np.full(len(power) - 1, _STEP), dtype=np.uint64)
    part = _BYTE[LOWER[value] if lower else value] * power[place]
    return mix(np.add.reduceat(part, first[:-1]) + size.astype(np.uint64))


def runs(hashes: np.ndarray, rows: np.ndarray, k: int):
    """Hashes and rows of all runs of ``k`` words; a row of 1 to k - 1 words gives one run of all of them."""
    n = len(hashes)
    out, at = [], []
    if n >= k:
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h += hashes[j:n - k + 1 + j] * _RUN[j]
        same = rows[:n - k + 1] == rows[k - 1:]
        out.append(mix(h[same] + np.uint64(k)))
        at.append(rows[:n - k + 1][same])
    if n:
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        count = np.diff(np.append(first, n))
        for f, c in zip(first[count < k], count[count < k]):
            h = np.zeros(1, np.uint64)
            for j in range(c):
                h += hashes[f + j:f + j + 1] * _RUN[j]
            out.append(mix(h + np.uint64(c)))
            at.append(rows[f:f + 1])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, r = np.concatenate(out), np.concatenate(at)
    order = np.argsort(r, kind="stable")
    return h[order], r[order]
