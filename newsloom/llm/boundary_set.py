"""A set of positions in the manner of Roaring bitmaps, with select.

Positions are cut by their upper bits into containers of 65,536 values. A container is held
in the form that takes the fewest bytes: a sorted array of 16-bit values, a bitmap, or runs
(start, length). The cumulative cardinalities of the containers find the container of a rank
by binary search, and a select inside it gives the position.
"""

from __future__ import annotations

import numpy as np

CONTAINER_BITS = 16
BITMAP_BYTES = (1 << CONTAINER_BITS) // 8
WORD_BITS = 64


class ArrayContainer:
    """The values themselves, ascending."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        return self.low[ranks].astype(np.int64)


class BitmapContainer:
    """One bit for each value, with the number of ones before every word of 64 bits."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << CONTAINER_BITS, bool)
        bits[low] = True
        self.words = np.packbits(bits, bitorder="little").reshape(-1, WORD_BITS // 8)
        ones = bits.reshape(-1, WORD_BITS).sum(axis=1)
        self.before = np.cumsum(ones) - ones

    def select(self, ranks: np.ndarray) -> np.ndarray:
        # The last word that begins at this rank or earlier; words without ones before it begin there too.
        word = np.searchsorted(self.before, ranks, side="right") - 1
        ones = np.cumsum(np.unpackbits(self.words[word], axis=1, bitorder="little"), axis=1, dtype=np.int64)
        place = (ones > (ranks - self.before[word])[:, None]).argmax(axis=1)
        return word * WORD_BITS + place


class RunContainer:
    """Stretches of consecutive values, with the number of values before every one."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts = starts.astype(np.uint16)
        self.before = np.cumsum(lengths) - lengths

    def select(self, ranks: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.before, ranks, side="right") - 1
        return self.starts[run].astype(np.int64) + ranks - self.before[run]


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of ascending values below 65,536."""
    starts = np.flatnonzero(np.append(True, np.diff(low) != 1))
    if 4 * len(starts) < min(2 * len(low), BITMAP_BYTES):
        return RunContainer(low[starts], np.diff(np.append(starts, len(low))))
    return ArrayContainer(low) if 2 * len(low) <= BITMAP_BYTES else BitmapContainer(low)


class BoundarySet:
    """Ascending, distinct, non-negative positions."""

    def __init__(self, positions: np.ndarray):
        high = positions >> CONTAINER_BITS
        starts = np.flatnonzero(np.append(True, high[1:] != high[:-1])) if len(high) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(positions))
        self.keys = high[starts]
        self.before = np.append(starts, len(positions)).astype(np.int64)
        low = positions & ((1 << CONTAINER_BITS) - 1)
        self.containers = [container(low[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The position of each rank, from 0."""
        ranks = np.asarray(ranks, np.int64)
        at = np.searchsorted(self.before, ranks, side="right") - 1
        out = np.empty(len(ranks), np.int64)
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(len(self.containers) + 1))
        for number in np.unique(at).tolist():
            mine = order[bounds[number] : bounds[number + 1]]
            local = self.containers[number].select(ranks[mine] - self.before[number])
            out[mine] = (int(self.keys[number]) << CONTAINER_BITS) + local
        return out
