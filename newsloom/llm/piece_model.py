"""A sentencepiece BPE model as tables: units, their last merges, and which pairs stay apart.

BPE merges the best-scored pair of neighbours, the leftmost of equals, until no
pair of neighbours is a piece. Two facts make it a finite-state matter:

* a sequence of units is the encoding of its text exactly when each pair of
  neighbours is the encoding of its own text (it "stays apart");
* so the last unit of a prefix is the one unit u, ending there, that stays apart
  from the last unit of the prefix before u.

Pieces of two or more spaces have equal scores, for which the second fact fails; but no
piece has a space behind another character, so runs of spaces are encoded on their own.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import public_tokenizers

from newsloom.llm.workers import kept

DEFAULT_MODEL = "piece_bpe_32k.model"
SPACE = "▁"
# Slots of the table that remembers pairs.
SLOTS = 1 << 20


def model_path(name: str = DEFAULT_MODEL) -> str:
    return str(public_tokenizers.path(name))


class PieceModel:
    """Tables of one model file. Unit numbers below ``n_pieces`` are ids of the model."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_pieces = n = library.vocab_size()
        names = [library.id_to_piece(i) for i in range(n)]
        self.names = names
        plain = [
            i
            for i in range(n)
            if not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i) or library.is_byte(i))
        ]
        self.byte_ids = {int(names[i][1:-1], 16): i for i in range(n) if library.is_byte(i)}
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.byte_ids.values())] = True
        if len(self.byte_ids) != 256 or any(re.search(f"[^{SPACE}]{SPACE}", names[i]) for i in plain):
            raise ValueError("only BPE models with byte fallback, without pieces across words")
        self.spaces = {len(names[i]): (i, library.get_score(i)) for i in plain if not names[i].strip(SPACE)}
        self._space_runs: dict[int, tuple[int, ...]] = {}

        units = {names[i]: i for i in plain if len(names[i]) == 1 or names[i].strip(SPACE)}
        # A character that only occurs inside longer pieces is a unit that no id stands for.
        for c in sorted({c for name in units for c in name} - set(units)):
            units[c] = n + len(units)
        order = sorted((name for name in units if len(name) > 1), key=lambda x: (-library.get_score(units[x]), x))
        rank = {name: place for place, name in enumerate(order)}
        size = max(units.values()) + 1
        self.units, self.size = units, size
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        reached = set()
        pairs: dict[int, int] = {}
        for name, place in rank.items():
            unit = units[name]
            self.rank[unit] = place
            for cut in range(1, len(name)):
                a, b = units.get(name[:cut]), units.get(name[cut:])
                if a is not None and b is not None:
                    pairs[a * size + b] = place
            parts, last = self._merge(name, rank)
            if len(parts) == 1:
                reached.add(name)
                self.left[unit], self.right[unit] = units[last[0]], units[last[1]]
        # A piece that BPE never makes of its own text is no unit.
        self.usable = {name: unit for name, unit in units.items() if len(name) == 1 or name in reached}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.pairs = pairs
        # The same as lists, for one pair at a time.
        self.rank_of, self.left_of, self.right_of = self.rank.tolist(), self.left.tolist(), self.right.tolist()
        self.known = np.full(SLOTS, -1, np.int64)
        self.known_result = np.zeros(SLOTS, bool)
        # Ids of a unit: its own, or bytes for a unit without one.
        self.unit_ids = {u: (u,) if u < n else self.bytes_of(name) for name, u in self.usable.items()}

    @classmethod
    def of(cls, path: str) -> PieceModel:
        return kept(("pieces", path), lambda: cls(path))

    @staticmethod
    def _merge(text: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
        """(BPE of a short text, its last merge)."""
        parts, last = list(text), None
        while len(parts) > 1:
            place, at = min((rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if place == 1 << 60:
                break
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [last[0] + last[1]]
        return parts, last

    def bytes_of(self, text: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in text.encode())

    def space_run(self, n: int) -> tuple[int, ...]:
        """Ids of ``n`` spaces that nothing else merges with."""
        if n not in self._space_runs:
            sizes, following = [1] * n, [*range(1, n), -1]
            before = [*range(-1, n - 1)]
            heap = [(-self.spaces[2][1], i, 1, 1) for i in range(n - 1)] if 2 in self.spaces else []
            heapq.heapify(heap)
            while heap:
                _, at, own, other = heapq.heappop(heap)
                behind = following[at]
                if sizes[at] != own or behind < 0 or sizes[behind] != other:
                    continue
                sizes[at], sizes[behind] = own + other, 0
                following[at] = following[behind]
                if following[at] >= 0:
                    before[following[at]] = at
                for a in (before[at], at):
                    b = following[a] if a >= 0 else -1
                    if b >= 0 and sizes[a] + sizes[b] in self.spaces:
                        heapq.heappush(heap, (-self.spaces[sizes[a] + sizes[b]][1], a, sizes[a], sizes[b]))
            run = tuple(self.spaces[x][0] for x in sizes if x)
            if len(self._space_runs) > 10_000:
                self._space_runs.clear()
            self._space_runs[n] = run
        return self._space_runs[n]

    def apart(self, a: int, b: int) -> bool:
        """Whether unit ``a`` before unit ``b`` is the encoding of their text.

        Goes back through the merges on both sides of the border, the later one first;
        a merge across it must not have come before one that took its parts away.
        """
        rank, pairs, size = self.rank_of, self.pairs, self.size
        end_a = end_b = 1 << 60
        while True:
            across = pairs.get(a * size + b)
            if across is not None and across < end_a and across <= end_b:
                return False
            rank_a, rank_b = rank[a], rank[b]
            if rank_a > rank_b:
                end_a, a = rank_a, self.right_of[a]
            elif rank_b >= 0:
                end_b, b = rank_b, self.left_of[b]
            else:
                return True

    def all_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``apart`` of many pairs; pairs met before are remembered in a table of fixed size."""
        keys = a * self.size + b
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        result = self.known_result[slots]
        new = np.flatnonzero(self.known[slots] != keys)
        if len(new):
            fresh, back = np.unique(keys[new], return_inverse=True)
            found = self._all_apart(fresh // self.size, fresh % self.size)
            result[new] = found[back]
            self.known[slots[new]], self.known_result[slots[new]] = keys[new], found[back]
        return result

    def _all_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        end_a, end_b = np.full(len(a), 1 << 60), np.full(len(a), 1 << 60)
        while len(live):
            keys = a * self.size + b
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            across = np.where(self.pair_keys[at] == keys, self.pair_ranks[at], 1 << 61)
            wrong = (across < end_a) & (across <= end_b)
            out[live[wrong]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            on = ~wrong & ((rank_a >= 0) | (rank_b >= 0))
            live, a, b, end_a, end_b, rank_a, rank_b = (x[on] for x in (live, a, b, end_a, end_b, rank_a, rank_b))
            first = rank_a > rank_b
            end_a, end_b = np.where(first, rank_a, end_a), np.where(first, end_b, rank_b)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out
