"""Complete binary hash trees of one block, stored in van Emde Boas order.

A tree of ``levels`` levels is cut at half its height: the top subtree comes first, then the
subtrees below it from left to right, each laid out in the same way. Aligned subtrees are therefore
contiguous at every scale, and a path from a leaf to the top crosses few of them, whatever the
size of a cache line or page. ``address`` gives a node's place by arithmetic alone.
"""

from __future__ import annotations

import hashlib

import numpy as np

DIGEST = 32
HEX = 2 * DIGEST
# How a node meets its sibling on the way up: it has none, it is on the left of it or on the right.
ALONE, SIBLING_LEFT, SIBLING_RIGHT = b"-", b"L", b"R"
STEP = 1 + HEX


def address(levels: int, depth: int, index: np.ndarray | int) -> np.ndarray | int:
    """The place of node ``index`` (from the left) at ``depth`` (0 is the top) of a tree of ``levels`` levels."""
    base = 0 * index
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below = levels - top
        subtree = index >> (depth - top)
        base = base + ((1 << top) - 1) + subtree * ((1 << below) - 1)
        index = index & ((1 << (depth - top)) - 1)
        levels, depth = below, depth - top
    return base


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


class Block:
    """``n`` nodes at the bottom and what they hash to, ``height`` levels up.

    A pair of nodes becomes the hash of both, a last node without a partner the hash of itself.
    Nodes are hex digests; the places of absent ones are empty.
    """

    def __init__(self, nodes: np.ndarray, n: int, height: int):
        self.nodes, self.n, self.height = nodes, n, height

    @classmethod
    def build(cls, leaves: np.ndarray, height: int) -> Block:
        """From the digests at the bottom (hex, as an array of bytes)."""
        levels = height + 1
        nodes = np.zeros((1 << levels) - 1, f"S{HEX}")
        now, here = leaves.tolist(), len(leaves)
        nodes[address(levels, height, np.arange(here))] = leaves
        for depth in range(height - 1, -1, -1):
            now = [digest(b"".join(now[i : i + 2])) for i in range(0, here, 2)]
            here = len(now)
            nodes[address(levels, depth, np.arange(here))] = now
        return cls(nodes, len(leaves), height)

    @property
    def root(self) -> bytes:
        return bytes(self.nodes[0])

    def packed(self) -> bytes:
        """32 bytes a node, in van Emde Boas order."""
        return bytes.fromhex(b"".join(x.ljust(HEX, b"0") for x in self.nodes.tolist()).decode())

    @classmethod
    def unpacked(cls, stored: bytes, n: int, height: int) -> Block:
        return cls(np.frombuffer(stored.hex().encode(), f"S{HEX}"), n, height)

    def paths(self, index: np.ndarray) -> list[bytes]:
        """The steps from each node at the bottom to the block's root: a mark and the sibling's digest."""
        steps, count = [], self.n
        for up in range(self.height):
            here = index >> up
            sibling = here ^ 1
            present = sibling < count
            place = address(self.height + 1, self.height - up, np.where(present, sibling, here))
            marks = np.where(present, np.where(here & 1, SIBLING_LEFT, SIBLING_RIGHT), ALONE)
            steps.append([m + s if m != ALONE else m for m, s in zip(marks.tolist(), self.nodes[place].tolist())])
            count = -(-count // 2)
        return [b"".join(own) for own in zip(*steps)] if steps else [b""] * len(index)


def steps_of(path: bytes) -> list[tuple[bytes, bytes]]:
    """(mark, sibling) of each step of a path."""
    found, at = [], 0
    while at < len(path):
        mark = path[at : at + 1]
        size = 1 if mark == ALONE else STEP
        found.append((mark, path[at + 1 : at + size]))
        at += size
    return found


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its path give."""
    for mark, sibling in path:
        leaf = digest(sibling + leaf if mark == SIBLING_LEFT else leaf + sibling)
    return leaf
