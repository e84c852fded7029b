"""Five-word shingle sets of whole texts as sorted 64-bit hashes, a batch at a time.

Two different shingles of one corpus share a hash with a chance of about m**2 / 2**65
for m shingles; everything behind the hashes is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from newsloom.llm.texts import ASCII_SPACE, buffer_of

WORDS = 5
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
STRETCH_LETTERS = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(BASE)
        np.multiply.accumulate(out, out=out)
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z in small letters, first word of each text and the end)."""
    space = ASCII_SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = ~space[heads]
    at = np.flatnonzero(begins)
    firsts = np.searchsorted(at, offsets)
    if not len(at):
        return np.zeros(0, np.uint64), firsts
    # Where words start among the letters alone.
    starts = at - np.cumsum(space, dtype=np.int32)[at]
    letters = LOWER[data[~space]]
    bounds = np.append(starts, len(letters))
    sizes = np.diff(bounds)
    powers = _powers(int(sizes.max()))
    hashed = np.empty(len(at), np.uint64)
    # Eight bytes a letter are held for a stretch of words at a time.
    first = 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + STRETCH_LETTERS, "right")) - 1)
        own = starts[first:last] - starts[first]
        here = letters[bounds[first] : bounds[last]].astype(np.uint64) + np.uint64(1)
        here *= powers[np.arange(len(here)) - np.repeat(own, sizes[first:last])]
        hashed[first:last] = np.add.reduceat(here, own)
        first = last
    return mixed(hashed + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), firsts


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ascending within each text; n + 1 offsets of the texts).

    A text with fewer words than a shingle has its whole sequence as its one shingle, a text
    without words or a null has none.
    """
    data, offsets = buffer_of(texts)
    words, firsts = word_hashes(data, offsets)
    n_words = np.diff(firsts)
    n_docs = len(n_words)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    hashes = np.zeros(len(words), np.uint64)
    short = np.minimum(n_words, WORDS)
    # Every place takes the next words of its text, five at most.
    left = np.repeat(firsts[1:], n_words) - np.arange(len(words))
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    for k in range(WORDS):
        step = mixed(hashes * np.uint64(BASE) + padded[k : k + len(words)])
        hashes = np.where(left > k, step, hashes)
    # Whole shingles, or the first place of a short text.
    size = np.repeat(short, n_words)
    document = np.repeat(np.arange(n_docs), n_words)
    starts = np.repeat(firsts[:-1], n_words)
    whole = (left >= WORDS) | ((size < WORDS) & (np.arange(len(words)) == starts))
    hashes, document = hashes[whole], document[whole]
    hashes = mixed(hashes + np.minimum(size[whole], WORDS).astype(np.uint64))
    order = np.lexsort((hashes, document))
    hashes, document = hashes[order], document[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (document[1:] != document[:-1]))
    counts = np.bincount(document[new], minlength=n_docs)
    return hashes[new], np.concatenate([[0], np.cumsum(counts)])
