"""Byte-level BPE ids of whole columns by the tokenizers library.

The pre-tokenizer of the model always breaks before a space that follows a
non-space, and what it does behind the break depends on nothing before it. So a
text may be encoded segment by segment, and in a batch each distinct segment is
given to the library once.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import public_tokenizers

from newsloom.llm.texts import ASCII_SPACE, buffer_of, distinct_segments, spaces, spread
from newsloom.llm.workers import Memo, kept

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
# Bytes of distinct segments that go to the library as one string.
RUN_BYTES = 3_072


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    return str(public_tokenizers.path(name))


class ByteIds:
    """Encoder for one tokenizer file; ids as unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.memo = Memo()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        added = {token.content for token in self.library.get_added_tokens_decoder().values()}
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            # A byte-level token has one character for each byte.
            self.sizes[number] = len(token.encode()) if token in added else len(token)

    @classmethod
    def of(cls, path: str) -> ByteIds:
        return kept(("byte ids", path), lambda: cls(path))

    def _library_ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, segments: pa.Array) -> list[bytes]:
        """The ids of each segment, as bytes."""
        data, offsets = buffer_of(segments)
        space = spaces(data, ASCII_SPACE, True)
        # Only a segment that begins with a space and ends without one can stand between others.
        chained = space[offsets[:-1]] & ~space[offsets[1:] - 1]
        out = [b""] * len(segments)
        alone = np.flatnonzero(~chained)
        for place, found in zip(alone, self._library_ids(segments.take(pa.array(alone)).to_pylist())):
            out[place] = found.tobytes()
        inside = np.flatnonzero(chained)
        if len(inside):
            body, bounds = buffer_of(segments.take(pa.array(inside)))
            cuts = np.unique(np.searchsorted(bounds, np.arange(0, len(body), RUN_BYTES)))
            cuts = np.append(cuts[cuts < len(inside)], len(inside))
            runs = [body[bounds[a] : bounds[b]].tobytes().decode() for a, b in zip(cuts[:-1], cuts[1:])]
            found = np.concatenate(self._library_ids(runs))
            reached = np.cumsum(self.sizes[found])
            last = np.searchsorted(reached, bounds[1:])
            if last[-1] != len(found) - 1 or (reached[last] != bounds[1:]).any():
                raise ValueError("the tokenizer has tokens across words; it can't be encoded by segments")
            ends = (4 * (last + 1)).tolist()
            whole = found.tobytes()
            for place, start, end in zip(inside.tolist(), [0, *ends], ends):
                out[place] = whole[start:end]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, n + 1 offsets of the rows); a null text is empty."""
        data, offsets = buffer_of(texts)
        if not len(data):
            return np.zeros(0, np.uint32), offsets
        segments, places, firsts = distinct_segments(data, offsets, ASCII_SPACE, True)
        flat, counts = self.memo.ids(segments, self._new)
        begin = np.cumsum(counts) - counts
        lengths = counts[places]
        reached = np.concatenate([[0], np.cumsum(lengths)])
        return flat[spread(begin[places], lengths)], reached[firsts]
