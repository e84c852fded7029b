"""Benchmark decontamination by one Aho-Corasick automaton.

Texts are normalised to words: A-Z in small letters, every other ASCII character but digits and
letters parts words. The patterns are all windows of 10 consecutive words of the benchmark items,
questions and answers alike; an item of fewer words is one window. A text becomes a sequence of word numbers, 0
for words that no item has, and is scanned once. A number is spelt with two letters, its digits in a
base near the root of the vocabulary's size: a state then has few transitions, which the automaton
looks through one by one. First and second digits are different letters, so no match begins
inside a word. The bytes of every word are kept beside its number, so a window found is
a stretch of the original text.

Items go to the workers in groups of ``GROUP_WORDS`` words. A usual benchmark is one group; a larger one is
scanned for group by group, and the driver never holds more than one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.texts import buffer_of
from newsloom.llm.workers import kept, slices
from newsloom.session import pin

WINDOW = 10
SLICE_BYTES = 4 << 20
# Words of the items of one automaton (20 states a word at most), and of one piece of a long item.
GROUP_WORDS = 100_000
PIECE_WORDS = 1_000

IN_WORD = np.zeros(256, bool)
IN_WORD[128:] = True
for _first, _last in ((b"0", b"9"), (b"A", b"Z"), (b"a", b"z")):
    IN_WORD[_first[0] : _last[0] + 1] = True
SMALL = np.arange(256, dtype=np.uint8)
SMALL[ord("A") : ord("Z") + 1] += 32


class Words:
    """The words of a column of texts: ``names`` as bytes, ``starts`` and ``ends`` in the bytes of all texts,
    ``firsts`` the first word of each text and the end."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = buffer_of(texts)
        inside = IN_WORD[self.data]
        heads = self.offsets[:-1][np.diff(self.offsets) > 0]
        begins, ends = inside.copy(), inside.copy()
        if len(inside):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            begins[heads] = inside[heads]
            tails = self.offsets[1:][np.diff(self.offsets) > 0] - 1
            ends[tails] = inside[tails]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.firsts = np.searchsorted(self.starts, self.offsets)
        letters = np.ascontiguousarray(SMALL[self.data[inside]])
        bounds = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        self.names = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self.starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]
        )


class Automaton:
    """All windows of (item_id, words) pieces, words parted by spaces."""

    def __init__(self, pieces: list[tuple[str | None, bytes]]):
        numbers: dict[bytes, int] = {}
        holders: dict[tuple[int, ...], set[str | None]] = {}
        for item, words in pieces:
            # 0 is left for words that no item has.
            known = [numbers.setdefault(w, len(numbers) + 1) for w in words.split()]
            for at in range(max(1, len(known) - WINDOW + 1)):
                holders.setdefault(tuple(known[at : at + WINDOW]), set()).add(item)
        self.base = math.isqrt(len(numbers)) + 1
        self.vocabulary = pa.array(list(numbers), pa.large_binary())
        self.items = [sorted(x for x in found if x is not None) for found in holders.values()]
        self.tree = ahocorasick.Automaton()
        for number, window in enumerate(holders):
            self.tree.add_word(self.spelt(np.array(window)), (number, len(window)))
        self.tree.make_automaton()

    def spelt(self, numbers: np.ndarray) -> str:
        """Two letters for each word number."""
        letters = np.empty(2 * len(numbers), "<u4")
        letters[::2] = 1 + numbers // self.base
        letters[1::2] = 2 + (len(self.vocabulary) // self.base) + numbers % self.base
        return letters.tobytes().decode("utf-32-le")

    @classmethod
    def of(cls, pieces: list[tuple[str | None, bytes]], name: str) -> Automaton:
        return kept(("benchmark automaton", name), lambda: cls(pieces))

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, int, int]]], list[list[str]]]:
        """(words of each text, its stretches (first word, word behind, first character, character behind), its items)."""
        words = Words(texts)
        n_words = np.diff(words.firsts)
        ranges: list[list] = [[] for _ in n_words]
        items: list[list] = [[] for _ in n_words]
        if not len(self.items) or not len(words.names):
            return n_words, ranges, items
        numbers = pc.index_in(words.names, self.vocabulary)
        known = pc.fill_null(pc.add(numbers, 1), 0).to_numpy(zero_copy_only=False)
        letters = self.spelt(known)
        characters = None
        bounds = words.firsts.tolist()
        # A text without a known word has no window.
        some = np.flatnonzero(np.add.reduceat(np.append(known > 0, False), words.firsts[:-1]) * (n_words > 0))
        for i in some.tolist():
            first, end = bounds[i], bounds[i + 1]
            hits = [((e + 1) // 2, found) for e, found in self.tree.iter(letters[2 * first : 2 * end])]
            if not hits:
                continue
            if characters is None:
                characters = np.append(0, np.cumsum((words.data & 0xC0) != 0x80))
            stretches = merged(np.array([(e - n, e) for e, (_, n) in hits], np.int64))
            origin = characters[words.offsets[i]]
            begin = characters[words.starts[first + stretches[:, 0]]] - origin
            behind = characters[words.ends[first + stretches[:, 1] - 1]] - origin
            ranges[i] = list(zip(*(x.tolist() for x in (stretches[:, 0], stretches[:, 1], begin, behind))))
            found = {number for _, (number, _) in hits}
            items[i] = sorted(set().union(*(self.items[number] for number in found)))
        return n_words, ranges, items


def merged(spans: np.ndarray) -> np.ndarray:
    """Stretches that overlap become one; (start, end) rows in order."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.append(True, spans[1:, 0] >= reach[:-1]))
    return np.column_stack([spans[new, 0], reach[np.append(new[1:], len(spans)) - 1]])


def item_pieces(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, words, n): the normalised words of each item; long items in pieces that overlap by a window less a word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            words = Words(batch.column("text"))
            names, bounds = words.names.to_pylist(), words.firsts.tolist()
            out = []
            for item, a, b in zip(batch.column("item_id").to_pylist(), bounds, bounds[1:]):
                for at in range(a, max(a + 1, b - WINDOW + 1), PIECE_WORDS):
                    piece = names[at : min(b, at + PIECE_WORDS + WINDOW - 1)]
                    if piece:
                        out.append((item, b" ".join(piece), len(piece)))
            columns = list(zip(*out)) or [[], [], []]
            kinds = [pa.string(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["item_id", "words", "n"])

    chosen = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(rows, "item_id string, words binary, n long").distinct()


RANGE = "struct<first:long,behind:long,start:long,end:long>"
RANGE_TYPE = pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "behind", "start", "end")]))


def _lists(ranges: list[list[tuple]]) -> pa.Array:
    names = ("first", "behind", "start", "end")
    return pa.array([[dict(zip(names, x)) for x in own] for own in ranges], RANGE_TYPE)


def _scanned(docs: DataFrame, pieces: list[tuple[str | None, bytes]]) -> DataFrame:
    """(doc_id, print, n_words, ranges, items) of each row of (doc_id, print, text)."""
    name = hashlib.sha256(repr(pieces).encode()).hexdigest()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton.of(pieces, name)
        for batch in slices(batches, "text", SLICE_BYTES):
            n_words, ranges, items = automaton.scan(batch.column("text"))
            columns = [batch.column("doc_id"), batch.column("print"), pa.array(n_words, pa.int64())]
            columns += [_lists(ranges), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "n_words", "ranges", "items"])

    return docs.mapInArrow(
        rows, f"doc_id long, print string, n_words long, ranges array<{RANGE}>, items array<string>"
    )


def _joined_ranges(rows: DataFrame) -> DataFrame:
    """The stretches of each row merged."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column("ranges").to_pylist():
                if own:
                    words = merged(np.array([(x["first"], x["behind"]) for x in own], np.int64)).tolist()
                    starts, ends = {x["first"]: x["start"] for x in own}, {x["behind"]: x["end"] for x in own}
                    own = [(a, b, starts[a], ends[b]) for a, b in words]
                out.append(own or [])
            columns = [_lists(out) if c == "ranges" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return rows.mapInArrow(join, rows.schema)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    group_words: int = GROUP_WORDS,
) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) of each row.

    ``spans`` are the stretches (start, end), in code points of the original text, that windows of
    items cover; ``n_hit`` is the number of words in them; ``items`` are the ids, in the order of strings, of
    all items with a window in the text. Defined results: a null or empty text has no words and an
    item without words no window; an item without an id marks words and is not named; rows that share
    an item id are one item; rows that share a doc_id are judged by their own texts; other columns are
    not read.
    """
    pieces = pin(item_pieces(benchmark, item_id, item_text))
    groups = max(1, -(-int(pieces.agg(F.sum("n")).first()[0] or 0) // group_words))
    group_of = F.pmod(F.xxhash64("item_id", "words"), F.lit(groups))
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def of_group(number: int) -> list[tuple[str | None, bytes]]:
        found = pieces.where(group_of == number).select("item_id", "words").collect()
        return sorted(((r["item_id"], bytes(r["words"])) for r in found), key=lambda x: (x[0] or "", x[1]))

    if groups == 1:
        found = _scanned(chosen.select("doc_id", F.lit("").alias("print"), "text"), of_group(0))
    else:
        # Rows of one id and text have one result; a row without a hit in a group isn't carried on.
        known = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.sha2("text", 256), F.lit("-")))
        printed = chosen.select("doc_id", known.alias("print"), "text")
        hits = None
        for number in range(groups):
            own = pin(_scanned(printed, of_group(number)).where(F.size("ranges") > 0).dropDuplicates(["print"]))
            hits = own if hits is None else hits.unionByName(own)
        gathered = hits.groupBy("print").agg(
            F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items")
        )
        gathered = _joined_ranges(gathered).withColumn("items", F.array_sort(F.array_distinct("items")))
        counted = _scanned(printed, []).select("doc_id", "print", "n_words")
        none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
        found = counted.join(gathered, "print", "left").select(
            "doc_id", "n_words", none("ranges", f"array<{RANGE}>"), none("items", "array<string>")
        )
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["behind"] - r["first"])
    spans = F.transform("ranges", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), spans.alias("spans"), "items")
