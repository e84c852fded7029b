"""Token counts by a finite-state transducer compiled from a sentencepiece BPE model.

A state is what the rest of a word can depend on: for each place from which a piece may
still be running, the place in the tree of pieces, the last unit before it, and how
many tokens it lies behind. A transition says by how many the number of tokens of the
prefix changes, so the sum along a path is the count. States and transitions are
compiled when first met, and kept.

The transducer is back in its first state wherever a space follows a non-space, so the
map of a chunk of text is short: the text before its first such place (the head), the
tokens of the whole words behind that, and the text since the last one (the tail). Such
maps compose associatively; ``scan`` composes the maps of consecutive chunks in a
logarithmic number of rounds. Inside a batch every word is a chunk with a constant
map, whose composition is a running sum.

What differs from the plain method: a map is kept as head, count and tail and not as a table from each
entry state, of which there are as many as texts make; and only texts of more than ``CHUNK_CHARS``
characters are cut, within one task. Shorter ones, which is nearly all, are counted word by word, and
a worker looks up the words it has met. A text without a space is walked in sequence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.piece_model import SPACE, PieceModel, model_path
from newsloom.llm.texts import BLANK, buffer_of, distinct_segments
from newsloom.llm.workers import Memo, kept, slices

# Bytes of text that are counted at once; longer texts are cut into chunks of so many characters.
SLICE_BYTES = 8 << 20
CHUNK_CHARS = 1 << 20
# States that a worker keeps; transitions out of further ones are compiled each time.
MOST_STATES = 100_000
# Words whose counts a worker remembers.
MEMO_WORDS = 150_000
BREAK = re.compile(r"(?<=[^ ]) ")


class Transducer:
    """Counts tokens of a word, read as a space and its characters."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.children: list[dict[str, int]] = [{}]
        self.unit: list[int] = [-1]
        for name, unit in model.usable.items():
            node = 0
            for c in name:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.unit.append(-1)
                node = self.children[node][c]
            self.unit[node] = unit
        self.numbers: dict[tuple, int] = {}
        self.places: list[tuple] = []
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.start, self.first_count = self._step(self._state(((0, -1, 0),)), SPACE)

    @classmethod
    def of(cls, path: str) -> Transducer:
        return kept(("transducer", path), lambda: cls(PieceModel.of(path)))

    def _state(self, places: tuple) -> int:
        number = self.numbers.setdefault(places, len(self.places))
        if number == len(self.places):
            self.places.append(places)
            self.moves.append({})
        return number

    def _next(self, places: tuple, char: str) -> tuple[tuple, int]:
        """(places of the next state, change of the count)."""
        children, units, apart, running, found = self.children, self.unit, self.model.apart, [], None
        for node, last, behind in places:
            child = children[node].get(char)
            if child is None:
                continue
            unit = units[child]
            if found is None and unit >= 0 and (last < 0 or apart(last, unit)):
                found = unit, behind + len(self.model.unit_ids[unit])
            if children[child]:
                running.append((child, last, behind))
        # A character that is no unit ends every piece and stands as its bytes.
        unit, change = found or (-1, len(char.encode()))
        return (*[(node, last, behind - change) for node, last, behind in running], (0, unit, 0)), change

    def _step(self, state: int, char: str) -> tuple[int, int]:
        """Compile a transition and keep it: (next state, change of the count)."""
        places, change = self._next(self.places[state], char)
        move = self.moves[state][char] = self._state(places), change
        return move

    def count(self, word: str) -> int:
        """Tokens of a space and ``word``, which has no space."""
        state, total, moves = self.start, self.first_count, self.moves
        for at, char in enumerate(word):
            move = moves[state].get(char)
            if move is None:
                if len(self.places) >= MOST_STATES:
                    return total + self._rest(self.places[state], word[at:])
                move = self._step(state, char)
            state = move[0]
            total += move[1]
        return total

    def _rest(self, places: tuple, text: str) -> int:
        """Change of the count over ``text`` by transitions that aren't kept."""
        total = 0
        for char in text:
            places, change = self._next(places, char)
            total += change
        return total

    def segment(self, segment: str) -> int:
        """Tokens of some spaces and a word; the last space belongs to the word."""
        word = segment.lstrip(" ")
        spaces = len(segment) - len(word)
        if not word:
            return len(self.model.space_run(spaces))
        count = self.count(word)
        if spaces <= 1:
            return count
        # Where the word leaves its space alone, that space is one of the run.
        alone = self.space_alone(word)
        return count - alone + len(self.model.space_run(spaces - 1 + alone))

    def space_alone(self, word: str) -> bool:
        """Whether the encoding of a space and ``word`` begins with the space by itself."""
        return self.first_unit(word) == SPACE

    def first_unit(self, word: str) -> str:
        name = self.model.names
        units = self.units(SPACE + word)
        return name[units[0]] if 0 <= units[0] < len(name) else ""

    def units(self, text: str) -> list[int]:
        """Ids of a word in full, by the same walk; for long words and the rare case of many spaces."""
        model = self.model
        last, back = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        running: list[tuple[int, int]] = [(0, 0)]
        for i, char in enumerate(text):
            found, going = None, []
            for node, start in running:
                child = self.children[node].get(char)
                if child is None:
                    continue
                unit = self.unit[child]
                if found is None and unit >= 0 and (last[start] < 0 or model.apart(last[start], unit)):
                    found = unit, start
                if self.children[child]:
                    going.append((child, start))
            last[i + 1], back[i + 1] = found or (-1, i)
            running = [*going, (0, i + 1)]
        ids: list[tuple[int, ...]] = []
        at = len(text)
        while at:
            ids.append(model.unit_ids[last[at]] if last[at] >= 0 else model.bytes_of(text[back[at] : at]))
            at = back[at]
        return [x for unit in reversed(ids) for x in unit]


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does: ``count`` is None where it has no place at which the transducer is new."""

    head: str
    count: int | None = None
    tail: str = ""


def chunk_map(machine: Transducer, text: str) -> ChunkMap:
    cuts = [m.start() for m in BREAK.finditer(text)]
    if not cuts:
        return ChunkMap(text)
    words = sum(machine.segment(text[a:b]) for a, b in zip(cuts, cuts[1:]))
    return ChunkMap(text[: cuts[0]], words, text[cuts[-1] :])


def compose(machine: Transducer, first: ChunkMap, second: ChunkMap) -> ChunkMap:
    """The map of two neighbouring chunks; the place between them may itself be a break."""
    middle = (first.head if first.count is None else first.tail) + second.head
    if first.count is None and second.count is None:
        return chunk_map(machine, middle)
    if first.count is None:
        joined = chunk_map(machine, middle)
        if joined.count is None:
            return ChunkMap(middle, second.count, second.tail)
        return ChunkMap(joined.head, joined.count + machine.segment(joined.tail) + second.count, second.tail)
    inner = chunk_map(machine, middle)
    if second.count is None:
        if inner.count is None:
            return ChunkMap(first.head, first.count, middle)
        return ChunkMap(first.head, first.count + machine.segment(inner.head) + inner.count, inner.tail)
    return ChunkMap(first.head, first.count + count_all(machine, inner) + second.count, second.tail)


def count_all(machine: Transducer, whole: ChunkMap) -> int:
    """Tokens of a text by its map."""
    count = machine.segment(whole.head) if whole.head else 0
    return count if whole.count is None else count + whole.count + machine.segment(whole.tail)


def scan(machine: Transducer, maps: list[ChunkMap]) -> ChunkMap:
    """The map of all chunks together, composed pairwise in rounds."""
    while len(maps) > 1:
        pairs = [compose(machine, a, b) for a, b in zip(maps[::2], maps[1::2])]
        maps = pairs + maps[len(pairs) * 2 :]
    return maps[0]


def with_first_space(texts: pa.Array) -> pa.Array:
    """As the model reads them: a space before a text that isn't empty, spaces for the space sign."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring(texts, SPACE)).as_py():
        texts = pc.replace_substring(texts, SPACE, " ")
    texts = texts.cast(pa.large_string())
    led = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, led)


def count_texts(machine: Transducer, texts: pa.Array, memo: Memo, chunk_chars: int = CHUNK_CHARS) -> np.ndarray:
    """Number of tokens of each text; null has none."""
    led = with_first_space(texts)
    lengths = pc.utf8_length(led).to_numpy(zero_copy_only=False)
    totals = np.zeros(len(led), np.int64)
    long = lengths > chunk_chars
    for i in np.flatnonzero(long):
        text = led[int(i)].as_py()
        parts = [text[at : at + chunk_chars] for at in range(0, len(text), chunk_chars)]
        totals[i] = count_all(machine, scan(machine, [chunk_map(machine, part) for part in parts]))
    short = np.flatnonzero(~long)
    data, offsets = buffer_of(led.take(pa.array(short)))
    if len(data):
        segments, places, firsts = distinct_segments(data, offsets, BLANK, False)

        def counted(new: pa.Array) -> list[bytes]:
            return [machine.segment(s).to_bytes(4, "little") for s in new.to_pylist()]

        counts, _ = memo.ids(segments, counted)
        reached = np.concatenate([[0], np.cumsum(counts[places].astype(np.int64))])
        totals[short] = np.diff(reached[firsts])
    return totals


def count_tokens(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    model: str | None = None,
    limit: int = 4096,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row, in one pass without a shuffle.

    Defined results: a null or empty text has 0 bytes and 0 tokens; null and repeated
    doc_ids are rows of their own; other columns are not read.
    """
    model = model or model_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer.of(model)
        memo = kept(("piece counts", model), lambda: Memo(MEMO_WORDS))
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = batch.column("text")
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n_tokens = count_texts(machine, texts, memo)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), n_bytes, pa.array(n_tokens), pa.array(n_tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
