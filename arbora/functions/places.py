"""A vectorised scan of Arrow text columns for the places of ASCII words, without Python strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text scanned at a time; a longer text is scanned alone.
SLICE_BYTES = 4 << 20
#: Places in one row of a word's list.
LIST_PLACES = 1 << 16
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True


def word_places(borders: np.ndarray, raw: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Value, text, line (from 1) and column (in code points, from 0) of each word of the UTF-8 texts that lie side by
    side in ``raw``, text i from ``borders[i]`` to ``borders[i + 1]``. A word ends where its text ends."""
    inside = WORD_BYTES[raw]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = borders[1:-1]
    before[edges[edges < len(raw)]] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    text = np.searchsorted(borders[1:], starts, "right")
    feeds = np.flatnonzero(raw == 10)
    passed = np.searchsorted(feeds, starts)
    line = passed - np.searchsorted(feeds, borders[:-1])[text] + 1
    begins = np.maximum(borders[text], np.concatenate(([0], feeds + 1))[passed])
    if len(raw) and raw.max() > 127:
        points = np.concatenate(([0], np.cumsum(((raw & 0xC0) != 0x80).view(np.int8), dtype=np.int64)))
        column = points[starts] - points[begins]
    else:
        column = starts - begins
    cuts = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(raw[inside])), text, line, column


def _slices(batches):
    """Paths, and the words' value, text, line and column, of bounded parts of batches (path, content); a null content has none."""
    for batch in batches:
        paths, column = batch.column(0), batch.column(1).fill_null("").cast(pa.large_string())
        if not len(column):
            continue
        _, offsets, data = column.buffers()
        borders = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        first = 0
        while first < len(column):
            last = min(len(column), max(first + 1, int(np.searchsorted(borders, borders[first] + SLICE_BYTES, "right")) - 1))
            yield paths.slice(first, last - first), *word_places(borders[first:last + 1] - borders[first], raw[borders[first]:borders[last]])
            first = last


def scan(batches):
    """(token, path, line, col) of every word."""
    for paths, token, text, line, column in _slices(batches):
        yield pa.RecordBatch.from_arrays([token, paths.take(pa.array(text)), pa.array(line, pa.int32()), pa.array(column, pa.int32())], ["token", "path", "line", "col"])


def scan_lists(batches):
    """(token, files) of every distinct word of a part of the texts: ``files`` holds each path with the word's places there,
    a place being line * 2^32 + col. A list ends at LIST_PLACES places, and the word's next row goes on."""
    for paths, token, text, line, column in _slices(batches):
        code = token.dictionary_encode()
        which = code.indices.to_numpy().astype(np.int64)
        order = np.argsort(which * len(paths) + text, kind="stable")
        which, text = which[order], text[order]
        at = np.arange(len(which))
        opens = np.ones(len(which), bool)
        opens[1:] = which[1:] != which[:-1]
        rank = at - np.maximum.accumulate(np.where(opens, at, 0))
        opens |= rank % LIST_PLACES == 0
        parts = opens.copy()
        parts[1:] |= text[1:] != text[:-1]
        rows, files = np.flatnonzero(opens), np.flatnonzero(parts)
        places = pa.ListArray.from_arrays(pa.array(np.append(files, len(which)), pa.int32()), pa.array((line.astype(np.int64) << 32 | column)[order]))
        listed = pa.StructArray.from_arrays([paths.take(pa.array(text[files])), places], ["path", "places"])
        cuts = pa.array(np.append(np.searchsorted(files, rows), len(files)), pa.int32())
        yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(which[rows])), pa.ListArray.from_arrays(cuts, listed)], ["token", "files"])
