"""What a Python worker keeps from one task to the next."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa


def kept(key: tuple, make: Callable[[], object]) -> object:
    """``make()``, made once in a worker process.

    Task functions are pickled by value, so their globals are new in every task; a
    module entry is the one place that outlives them.
    """
    store = sys.modules.setdefault("_newsloom_kept", ModuleType("_newsloom_kept")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def give_back() -> None:
    """Return memory that isn't used any more; a worker lives on, and its neighbours need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has at most ``most_bytes`` in each, or one row."""
    for batch in batches:
        sizes = batch.column(column).nbytes
        pieces = max(1, -(-sizes // most_bytes))
        if pieces == 1:
            if batch.num_rows:
                yield batch
            continue
        rows = max(1, batch.num_rows // pieces)
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if part.num_rows > 1 and part.column(column).nbytes > 2 * most_bytes:
                middle = part.num_rows // 2
                yield from _halves(part, middle, column, most_bytes)
            else:
                yield part
    give_back()


def _halves(part: pa.RecordBatch, middle: int, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    for half in (part.slice(0, middle), part.slice(middle)):
        if half.num_rows > 1 and half.column(column).nbytes > most_bytes:
            yield from _halves(half, half.num_rows // 2, column, most_bytes)
        else:
            yield half


# Segments, and ids of one, that a worker remembers from batch to batch (some 60 MB).
MEMO_SEGMENTS = 300_000
MEMO_IDS = 32


class Memo:
    """Ids of segments met before. It saves work only: what it doesn't hold is made again."""

    def __init__(self, most: int = MEMO_SEGMENTS):
        self.held: dict[str, bytes] = {}
        self.most = most

    def ids(
        self, segments: pa.Array, make: Callable[[pa.Array], list[bytes]]
    ) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments as unsigned 32-bit numbers, number of ids of each)."""
        texts = segments.to_pylist()
        found = list(map(self.held.get, texts))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            for i, x in zip(new, make(segments.take(pa.array(new)))):
                found[i] = x
                if len(self.held) < self.most and len(x) <= MEMO_IDS * 4:
                    self.held[texts[i]] = x
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), np.uint32), counts
