"""SentencePiece encoding by suffix-array matching, and decoding.

The new words of a batch are written one after another, with a mark between them, and
a suffix array of that text is built. Every piece is looked up in it by binary search,
all pieces side by side, a character a round; the range found holds all its
occurrences. Each occurrence is an edge from its start to its end. The edges, sorted by
the place in the word where they end, are relaxed front by front: an edge holds if its
piece stays apart from the piece that reaches its start (see ``piece_model``). One edge
holds at each place, so the way back from a word's end is its encoding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.piece_model import SPACE, PieceModel, model_path
from newsloom.llm.texts import BLANK, buffer_of, distinct_segments, spread
from newsloom.llm.token_counts import Transducer, with_first_space
from newsloom.llm.workers import Memo, kept, slices

# Bytes of text that are encoded at once, and characters of one suffix array.
SLICE_BYTES = 2 << 20
INDEX_CHARS = 1 << 19
# A longer word is encoded by the transducer's walk: the fronts would be as many as its characters.
LONG_WORD = 512


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``codes`` (small positive numbers) ordered by the ``depth`` characters from there."""
    bits = max(1, int(codes.max()).bit_length()) if len(codes) else 1
    step = max(1, min(depth, 62 // bits))
    padded = np.concatenate([codes.astype(np.int64), np.zeros(depth + step, np.int64)])
    n = len(codes)
    key = np.zeros(n, np.int64)
    for i in range(step):
        key = (key << bits) | padded[i : i + n]
    while True:
        order = np.argsort(key, kind="stable")
        if step >= depth:
            return order
        ordered = key[order]
        rank = np.zeros(n + step, np.int64)
        rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1])) + 1
        key = rank[:n] * (n + 2) + rank[step : step + n]
        step *= 2


def occurrences(codes: np.ndarray, order: np.ndarray, pieces: np.ndarray, sizes: np.ndarray) -> tuple:
    """Ranges [low, high) of the suffix array where each row of ``pieces`` occurs.

    Binary search of all pieces at once: round k narrows the ranges to the suffixes
    whose k-th character is the piece's.
    """
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(pieces.shape[1] + 1, codes.dtype)])
    low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), n, np.int64)
    for k in range(pieces.shape[1]):
        live = np.flatnonzero((sizes > k) & (low < high))
        if not len(live):
            break
        wanted = pieces[live, k]
        bounds = []
        for upper in (False, True):
            a, b = low[live].copy(), high[live].copy()
            while (a < b).any():
                middle = (a + b) >> 1
                seen = padded[order[np.minimum(middle, n - 1)] + k]
                on = (a < b) & ((seen <= wanted) if upper else (seen < wanted))
                b = np.where(on | (a >= b), b, middle)
                a = np.where(on, middle + 1, a)
            bounds.append(a)
        low[live], high[live] = bounds
    return low, np.maximum(low, high)


class PieceCodec:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str):
        self.model = PieceModel.of(path)
        self.walker = Transducer.of(path)
        self.memo = Memo()
        names = sorted(self.model.usable)
        self.units = np.array([self.model.usable[x] for x in names], np.int64)
        self.sizes = np.array([len(x) for x in names], np.int64)
        self.points = np.zeros((len(names), int(self.sizes.max())), np.int64)
        for row, name in enumerate(names):
            self.points[row, : len(name)] = [ord(c) for c in name]
        # Ids of each unit, one after another, for gathering.
        ids = [self.model.unit_ids.get(u, ()) for u in range(self.model.size)]
        self.id_counts = np.array([len(x) for x in ids], np.int64)
        self.id_flat = np.array([x for unit in ids for x in unit], np.uint32)
        self.id_first = np.cumsum(self.id_counts) - self.id_counts

    @classmethod
    def of(cls, path: str) -> PieceCodec:
        return kept(("codec", path), lambda: cls(path))

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as bytes, a space and ``word``; the core of the method."""
        text = "\0".join(SPACE + word for word in words) + "\0"
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        # The mark between words is no character of a piece, nor is a zero inside a word.
        n = len(points)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(lengths + 1) - lengths - 1
        mark = np.zeros(n, bool)
        mark[starts + lengths] = True
        alphabet = np.unique(points)
        codes = np.searchsorted(alphabet, points) + 2
        codes[mark] = 1

        known = np.minimum(np.searchsorted(alphabet, self.points), len(alphabet) - 1)
        inside = np.arange(self.points.shape[1]) >= self.sizes[:, None]
        possible = ((alphabet[known] == self.points) | inside).all(axis=1)
        rows = np.flatnonzero(possible)
        pieces = np.where(inside[rows], 0, known[rows] + 2)
        order = suffix_array(codes, self.points.shape[1])
        low, high = occurrences(codes, order, pieces, self.sizes[rows])

        counts = high - low
        begin = order[spread(low, counts)]
        unit = np.repeat(self.units[rows], counts)
        size = np.repeat(self.sizes[rows], counts)
        word_at = np.repeat(starts, lengths + 1)
        front = (begin + size - word_at[begin]).astype(np.int32)
        by_front = np.lexsort((size, front))
        begin, unit, size = begin[by_front], unit[by_front], size[by_front]
        ends_of = np.searchsorted(front[by_front], np.arange(1, int(lengths.max()) + 2))

        last, back = np.full(n, -1, np.int64), np.arange(-1, n - 1)
        for a, b in zip(ends_of[:-1], ends_of[1:]):
            if a == b:
                continue
            here, u = begin[a:b], unit[a:b]
            before = last[here]
            holds = before < 0
            rest = np.flatnonzero(~holds)
            holds[rest] = self.model.all_apart(before[rest], u[rest])
            at = here[holds] + size[a:b][holds]
            last[at], back[at] = u[holds], here[holds]

        # Back from the end of every word, one unit of each at a time.
        word = np.arange(len(words))
        place = starts + lengths
        found_word, found_unit, found_place = [], [], []
        while len(word):
            found_word.append(word)
            found_unit.append(last[place])
            found_place.append(back[place])
            place = back[place]
            on = place > starts[word]
            word, place = word[on], place[on]
        which = np.concatenate(found_word)
        units, place = np.concatenate(found_unit), np.concatenate(found_place)
        order = np.lexsort((place, which))
        which, units, place = which[order], units[order], place[order]
        # Characters that are no unit stand as bytes.
        strange = np.flatnonzero(units < 0)
        own = [self.model.bytes_of(text[int(place[i])]) for i in strange]
        n_ids = self.id_counts[units]
        n_ids[strange] = [len(x) for x in own]
        first = self.id_first[units]
        first[strange] = len(self.id_flat) + np.cumsum(n_ids[strange]) - n_ids[strange]
        pool = np.concatenate([self.id_flat, np.array([x for ids in own for x in ids], np.uint32)])
        flat = pool[spread(first, n_ids)].tobytes()
        reached = np.cumsum(np.bincount(which, n_ids, len(words)).astype(np.int64)) * 4
        ends = reached.tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def segments(self, segments: pa.Array) -> list[bytes]:
        """Ids of segments, each some spaces and a word."""
        texts = segments.to_pylist()
        words = [s.lstrip(" ") for s in texts]
        out = [b""] * len(texts)
        plain: list[int] = []
        room = 0

        def flush() -> None:
            nonlocal room
            for i, ids in zip(plain, self.words([words[i] for i in plain]) if plain else ()):
                out[i] = ids
            plain.clear()
            room = 0

        for i, word in enumerate(words):
            if not word:
                out[i] = np.array(self.model.space_run(len(texts[i])), np.uint32).tobytes()
            elif len(word) > LONG_WORD:
                out[i] = np.array(self.walker.units(SPACE + word), np.uint32).tobytes()
            else:
                plain.append(i)
                room += len(word) + 2
                if room > INDEX_CHARS:
                    flush()
        flush()
        alone = self.model.units[SPACE]
        for i, (text, word) in enumerate(zip(texts, words)):
            spaces = len(text) - len(word)
            if word and spaces > 1:
                ids = np.frombuffer(out[i], np.uint32)
                lonely = bool(ids[0] == alone)
                run = np.array(self.model.space_run(spaces - 1 + lonely), np.uint32)
                out[i] = np.concatenate([run, ids[lonely:]]).tobytes()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, n + 1 offsets of the rows); a null text is empty."""
        data, offsets = buffer_of(with_first_space(texts))
        if not len(data):
            return np.zeros(0, np.uint32), offsets
        segments, places, firsts = distinct_segments(data, offsets, BLANK, False)
        flat, counts = self.memo.ids(segments, self.segments)
        begin = np.cumsum(counts) - counts
        lengths = counts[places]
        reached = np.concatenate([[0], np.cumsum(lengths)])
        return flat[spread(begin[places], lengths)], reached[firsts]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: spaces for the space sign, without the first one; bytes as UTF-8."""
        names, is_byte = self.model.names, self.model.is_byte
        parts = [
            bytes([int(names[i][1:-1], 16)]) if is_byte[i] else names[i].replace(SPACE, " ").encode()
            for i in np.asarray(ids).tolist()
        ]
        return b"".join(parts).removeprefix(b" ").decode("utf-8", "replace")


def piece_codes(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model: str | None = None, keep_ids: bool = False
) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_bytes, decoded_crc32[, ids]) of each row, without a shuffle.

    The ids are those of the model's library; ``decoded_*`` are size and crc32 of the
    text decoded from them. Defined results: a null or empty text has no ids and decodes to the
    empty text; null and repeated doc_ids are rows of their own.
    """
    model = model or model_path()
    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_bytes long, decoded_crc32 long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec.of(model)
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, offsets = codec.encode(batch.column("text"))
            ends = offsets.tolist()
            each = [ids[a:b] for a, b in zip(ends, ends[1:])]
            decoded = [codec.decode(x).encode() for x in each]
            columns = [
                batch.column("doc_id"),
                pa.array(np.diff(offsets)),
                pa.array([zlib.crc32(x.astype("<u4")) for x in each], pa.int64()),
                pa.array([len(x) for x in decoded], pa.int64()),
                pa.array([zlib.crc32(x) for x in decoded], pa.int64()),
            ]
            names = ["doc_id", "n_tokens", "ids_crc32", "decoded_bytes", "decoded_crc32"]
            if keep_ids:
                columns.append(pa.array([x.tolist() for x in each], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(rows, schema + (", ids array<int>" if keep_ids else ""))
