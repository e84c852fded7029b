"""Texts of an Arrow batch as one byte array, cut into words without Python strings."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space of Unicode outside ASCII, in UTF-8.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
BLANK = np.zeros(256, bool)
BLANK[32] = True


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spaces(data: np.ndarray, table: np.ndarray, wide: bool) -> np.ndarray:
    """True for each byte of a space: of ``table``, and of Unicode's others if ``wide``."""
    found = table[data]
    if wide:
        for match in WIDE_SPACE.finditer(memoryview(data)):
            found[match.start() : match.end()] = True
    return found


def segment_starts(space: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments begin: at a space after a non-space, and at the start of each text.

    A segment is a run of spaces with the run of other characters behind it, so the
    segments of a text are its whole bytes.
    """
    if not len(space):
        return np.zeros(0, np.int64)
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(start)


def strings_at(data: np.ndarray, starts: np.ndarray) -> pa.LargeStringArray:
    """The stretches of ``data`` between consecutive starts, as an Arrow array on the same bytes."""
    bounds = np.append(starts, len(data)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))


def distinct_segments(
    data: np.ndarray, offsets: np.ndarray, table: np.ndarray, wide: bool
) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct segments, the segment number at each place, first place of each text and the end)."""
    starts = segment_starts(spaces(data, table, wide), offsets)
    coded = strings_at(data, starts).dictionary_encode()
    places = coded.indices.to_numpy(zero_copy_only=False)
    return coded.dictionary, places, np.searchsorted(starts, offsets)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each (start, length), one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - ends + lengths, lengths)
