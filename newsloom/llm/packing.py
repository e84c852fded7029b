"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most ``capacity`` tokens. What decides a packing is only
how many pieces there are of each length, which is at most ``capacity`` numbers
whatever the corpus. ``plan_sequences`` packs that histogram: for each length, longest first,
it looks up single lengths, pairs and triples that sum to its gap, takes these combinations
as often as the counts allow, and places what is left by best fit, longest first. Each pattern of the plan says how often a list of lengths is used; a piece
finds its sequence from its number among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.byte_ids import ByteIds, tokenizer_path
from newsloom.llm.workers import slices
from newsloom.session import pin

CAPACITY = 2048
# Bytes of text that are encoded at once.
SLICE_BYTES = 4 << 20

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"


class SumIndex:
    """Sums of one, two and three of the lengths of which there are pieces left.

    ``pairs[s]`` counts the pairs of lengths that sum to s. It is kept up to date as lengths are used up, so
    a sum of three is a length and an entry of ``pairs``.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.here = left > 0
        self.pairs = np.zeros(2 * len(left), np.int64)
        lengths = np.flatnonzero(self.here)
        for i, x in enumerate(lengths.tolist()):
            self.pairs[x + lengths[: i + 1]] += 1

    def single(self, total: int) -> list[int] | None:
        return [total] if self.here[total] else None

    def pair(self, total: int) -> list[int] | None:
        """The pair with the longest first length."""
        if not self.pairs[total]:
            return None
        low = np.arange(1, total // 2 + 1)
        found = int(low[self.here[low] & self.here[total - low]][0])
        return [total - found, found]

    def triple(self, total: int) -> list[int] | None:
        first = np.flatnonzero(self.here[:total])
        first = first[self.pairs[total - first] > 0]
        return [int(first[-1]), *self.pair(total - int(first[-1]))] if len(first) else None

    def take(self, lengths: list[int]) -> int:
        """Use these lengths together as often as there are pieces; how often that was."""
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = min(int(self.left[x]) // k for x, k in need.items())
        for x, k in need.items():
            self.left[x] -= times * k
            if not self.left[x] and self.here[x]:
                self.pairs[x + np.flatnonzero(self.here)] -= 1
                self.here[x] = False
        return times


# Orders in which gaps are filled: which sums are tried in each walk over the lengths.
WALKS = (
    (("single",), ("pair",), ("triple",)),
    (("single", "pair", "triple"),),
    (("single", "pair"),),
)


def _plan(left: np.ndarray, capacity: int, walks: tuple[tuple[str, ...], ...]) -> list[tuple[int, list[int]]]:
    """A plan that fills gaps exactly in the order of ``walks``, and places the rest by best fit."""
    plan: list[tuple[int, list[int]]] = []
    index = SumIndex(left)
    if left[capacity]:
        plan.append((index.take([capacity]), [capacity]))
    for kinds in walks:
        for long in range(capacity - 1, 0, -1):
            for kind in kinds:
                while left[long]:
                    fill = getattr(index, kind)(capacity - long)
                    times = index.take([long, *fill]) if fill else 0
                    if not times:
                        break
                    plan.append((times, [long, *fill]))

    # Open sequences by the room left in them: room -> [(times, lengths)].
    rooms: dict[int, list[tuple[int, list[int]]]] = {}
    open_rooms = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            fitting = np.flatnonzero(open_rooms[length:])
            if len(fitting):
                room = length + int(fitting[0])
                times, lengths = rooms[room].pop()
                open_rooms[room] = bool(rooms[room])
                used = min(times, count)
                if used < times:
                    rooms[room].append((times - used, lengths))
                    open_rooms[room] = True
                new, rest = [*lengths, length], room - length
                count -= used
            else:
                each = capacity // length
                full, rest_count = divmod(count, each)
                used, new = (full, [length] * each) if full else (1, [length] * rest_count)
                count -= used * len(new)
                rest = capacity - length * len(new)
            if rest:
                rooms.setdefault(rest, []).append((used, new))
                open_rooms[rest] = True
            else:
                plan.append((used, new))
    return plan + [pattern for held in rooms.values() for pattern in held]


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths of the pieces in one sequence) for all pieces of the histogram ``counts``.

    Every step uses up a length or an open gap, so a plan has a bounded number of patterns however
    large the counts are. Each list is at most ``capacity`` in sum. Which gaps are filled first matters,
    so a plan is made for each order in ``WALKS``, and the one with the fewest sequences counts.
    """
    best: list[tuple[int, list[int]]] | None = None
    least = -(-sum(length * count for length, count in counts.items()) // capacity)
    for walks in WALKS:
        left = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            left[length] += count
        plan = _plan(left, capacity, walks)
        if best is None or sequences_of(plan) < sequences_of(best):
            best = plan
        if sequences_of(best) == least:
            break
    return best


def sequences_of(plan: list[tuple[int, list[int]]]) -> int:
    return sum(times for times, _ in plan)


class Places:
    """Where the n-th piece of a length goes, by a plan."""

    def __init__(self, plan: list[tuple[int, list[int]]]):
        used: dict[int, int] = {}
        rows = []
        sequence = 0
        for times, lengths in plan:
            offset = 0
            for length in lengths:
                first = used.get(length, 0)
                used[length] = first + times
                rows.append((length, first, sequence, offset))
                offset += length
            sequence += times
        rows.sort()
        self.sequences = sequence
        self.length, self.first, self.sequence, self.offset = np.array(rows, np.int64).reshape(-1, 4).T.copy()
        # Pieces of one length are fewer than 2**50.
        self.key = (self.length << 50) + self.first

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece."""
        row = np.searchsorted(self.key, (length << 50) + number, "right") - 1
        return self.sequence[row] + number - self.first[row], self.offset[row]


def cut_pieces(n_tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of every piece; only the first of several may be shorter."""
    pieces = np.maximum(1, -(-n_tokens // capacity))
    document = np.repeat(np.arange(len(n_tokens)), pieces)
    piece = np.arange(len(document)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = n_tokens - (pieces - 1) * capacity
    start = np.where(piece > 0, first[document] + (piece - 1) * capacity, 0)
    return document, piece, start, np.where(piece > 0, capacity, first[document])


def numbers_within(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """For each value how many equal ones came before; ``seen`` holds the counts of earlier calls."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.append(True, ordered[1:] != ordered[:-1]) if len(ordered) else np.zeros(0, bool)
    firsts = np.flatnonzero(new)
    run = np.arange(len(ordered)) - np.repeat(firsts, np.diff(np.append(firsts, len(ordered))))
    numbers = np.empty(len(values), np.int64)
    numbers[order] = run + seen[ordered]
    seen += np.bincount(values, minlength=len(seen))
    return numbers


def pack_documents(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = 0,
    capacity: int = CAPACITY,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    A document is its ids and ``end_id``. Defined results: a null text is empty, so its
    document is the end id alone; null and repeated doc_ids are packed as rows of their
    own; an empty table gives no rows.

    The driver gets one count per length, ``capacity`` at most.
    """
    tokenizer = tokenizer or tokenizer_path()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteIds.of(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, offsets = encoder.encode(batch.column("text"))
            rows = batch.num_rows
            document, piece, start, length = cut_pieces(np.diff(offsets) + 1, capacity)
            with_end = np.full(len(ids) + rows, end_id, "<u4")
            inside = np.ones(len(with_end), bool)
            inside[offsets[1:] + np.arange(rows)] = False
            with_end[inside] = ids
            at = (offsets[:-1] + np.arange(rows))[document] + start
            crcs = [zlib.crc32(with_end[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(document)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crcs, pa.int64()),
                    pa.array(np.full(len(piece), part, np.int32)),
                    pa.array(numbers_within(length, seen)),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"],
            )

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Pinned, since a piece's number holds only with this partitioning.
    cut = pin(chosen.mapInArrow(pieces, PIECE_SCHEMA))
    held = cut.groupBy("length", "part").agg(F.count("*").alias("rows"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = held.select("length", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    totals = cut.groupBy("length").agg(F.count("*").alias("rows")).collect()
    places = Places(plan_sequences({row["length"]: row["rows"] for row in totals}, capacity))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy() + batch.column("base").to_numpy()
            sequence, offset = places.of(length, number)
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return cut.join(bases, ["length", "part"]).mapInArrow(
        placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
