"""Line-first quality rules.

Each line with a word is judged by itself; a line fails that

* is navigation: two separators ``|`` or more, one for every five words at least;
* has no punctuation: ten words or more without any of ``. ! ? ; :`` or the like of other scripts
  (``WIDE_MARKS``), or is all shouting marks: four ``!`` or ``?`` or more, for more than half of its words;
* is noise: more symbols ``# * $ % & | < >`` than half of its words, or ten words or more of
  which over half repeat the word before;
* is boilerplate: it holds one of ``BOILERPLATE`` for every 20 words at least, so that a long line doesn't
  fail by a phrase in passing.

Failed lines are removed. A document goes if it fails the base rule (under 20 words, or
over 30 % of its words in 8-word windows that occur twice or more) or loses more than
60 % of its words.

All counts come from byte masks over a whole batch: no loop over documents, lines or words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.texts import ASCII_SPACE, buffer_of, strings_at
from newsloom.llm.workers import slices

# Phrases of lines that belong to the site and not to the text, in lower case ASCII.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under",
    "public license",
    "terms of service",
    "terms of use",
    "privacy policy",
    "cookie policy",
    "accept cookies",
    "enable javascript",
    "subscribe to our newsletter",
    "sign up for our",
    "click here to",
)
# Words of a line for each phrase that makes it boilerplate.
PHRASE_WORDS = 20
# Marks that end or part sentences in other scripts.
WIDE_MARKS = "。．｡！？；：…।؟؛۔።։"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 60
WINDOW = 8
# Bytes of text that are judged at once.
SLICE_BYTES = 2 << 20

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bad_lines", "n_lost_words")


def _table(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


WIDE = re.compile("|".join(WIDE_MARKS).encode())
SYMBOL, SENTENCE, SHOUT, BAR = _table(b"#*$%&|<>"), _table(b".!?;:"), _table(b"!?"), _table(b"|")


def _sums(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Trues between consecutive bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[bounds])


def _repeat_words(codes: np.ndarray, document: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document the words that stand in a window found twice or more in it."""
    n = len(codes) - WINDOW + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    # Numbers of 2, 4 and 8 words in a row, exact: each is made of a pair of numbers.
    number, span = codes.astype(np.int64), 1
    while span < WINDOW:
        size = len(number) - span
        number = np.unique(number[:size] * (int(number.max()) + 1) + number[span : span + size], return_inverse=True)[1]
        span *= 2
    inside = document[:n] == document[WINDOW - 1 :]
    place = np.flatnonzero(inside)
    key = document[place].astype(np.int64) * (int(number.max()) + 1) + number[place]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    repeated = place[count[back] > 1]
    covered = np.zeros(len(codes) + 1, np.int64)
    np.add.at(covered, repeated, 1)
    np.add.at(covered, repeated + WINDOW, -1)
    return np.bincount(document, np.cumsum(covered)[:-1] > 0, n_docs).astype(np.int64)


def measure(texts: pa.Array, with_text: bool = False) -> dict[str, np.ndarray | pa.Array]:
    """The MEASURES of each text and, if asked, the text without its failed lines."""
    data, offsets = buffer_of(texts)
    n_docs = len(offsets) - 1
    space = ASCII_SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = ~space[heads]

    # Words: the bytes without white space, cut where words begin.
    word_at = np.flatnonzero(begins)
    document = np.searchsorted(offsets, word_at, "right") - 1
    codes = np.zeros(0, np.int64)
    if len(word_at):
        dense = np.cumsum(~space) - 1
        codes = strings_at(data[~space], dense[word_at]).dictionary_encode().indices.to_numpy(zero_copy_only=False)

    # Lines: from the start of a text or behind a line feed to the next.
    ends = np.flatnonzero(data == 10)
    bounds = np.unique(np.concatenate([ends + 1, offsets]))
    line_doc = np.searchsorted(offsets, bounds[:-1], "right") - 1
    line_words = _sums(begins, bounds)
    symbols = _sums(SYMBOL[data], bounds)
    bars = _sums(BAR[data], bounds)
    shouts = _sums(SHOUT[data], bounds)
    sentence = _sums(SENTENCE[data], bounds)
    whole = memoryview(np.ascontiguousarray(data))
    # Only lines that would fail are searched for wide marks.
    bare = (line_words >= 10) & (sentence == 0)
    for at in np.flatnonzero(bare).tolist():
        bare[at] = WIDE.search(whole, bounds[at], bounds[at + 1]) is None
    bad = (bars >= 2) & (5 * bars >= line_words)
    bad |= bare
    bad |= (shouts >= 4) & (2 * shouts > line_words)
    bad |= 2 * symbols > line_words
    if len(word_at):
        line = np.searchsorted(bounds, word_at, "right") - 1
        again = (codes[1:] == codes[:-1]) & (line[1:] == line[:-1])
        bad |= (line_words >= 10) & (2 * np.bincount(line[1:], again, len(line_words)) > line_words)
    phrase = re.compile("|".join(re.escape(x) for x in BOILERPLATE).encode(), re.IGNORECASE)
    hits = np.array([m.span() for m in phrase.finditer(whole)], np.int64).reshape(-1, 2)
    if len(hits):
        line = np.searchsorted(bounds, hits[:, 0], "right") - 1
        # What the end of one text and the start of the next make is no phrase.
        phrases = np.bincount(line[hits[:, 1] <= bounds[line + 1]], minlength=len(line_words))
        bad |= (phrases > 0) & (PHRASE_WORDS * phrases >= line_words)
    full = line_words > 0
    bad &= full

    # Equal lines of one text, without their line feed.
    dup = np.zeros(n_docs, np.int64)
    lines = np.flatnonzero(full)
    if len(lines):
        keep = np.repeat(full, np.diff(bounds)) & (data != 10)
        sizes = _sums(keep, bounds)[lines]
        starts = np.cumsum(sizes) - sizes
        line_codes = strings_at(data[keep], starts).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        key = line_doc[lines] * (int(line_codes.max()) + 1) + line_codes
        first = np.zeros(len(key), bool)
        first[np.unique(key, return_index=True)[1]] = True
        dup = np.bincount(line_doc[lines], ~first, n_docs).astype(np.int64)

    per_doc = lambda mask: _sums(mask, offsets)
    count = lambda weights: np.bincount(line_doc, weights, n_docs).astype(np.int64)
    out: dict[str, np.ndarray | pa.Array] = {
        "n_words": per_doc(begins),
        "word_chars": per_doc(~space & ((data & 0xC0) != 0x80)),
        "n_symbols": per_doc(SYMBOL[data]),
        "n_dup_lines": dup,
        "n_repeat_words": _repeat_words(codes, document, n_docs),
        "n_lines": count(full),
        "n_bad_lines": count(bad),
        "n_lost_words": count(line_words * bad),
    }
    if with_text:
        left = ~np.repeat(bad, np.diff(bounds))
        sizes = np.concatenate([[0], np.cumsum(_sums(left, offsets))])
        out["text"] = strings_at(data[left], sizes[:-1])
    return out


def verdicts(found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    words = found["n_words"]
    base_failed = (words < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * words)
    return base_failed, ~base_failed & (100 * found["n_lost_words"] <= MAX_LOST_PERCENT * words)


def judge_documents(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", with_text: bool = True
) -> DataFrame:
    """(doc_id, MEASURES, base_failed, kept[, clean_text]) of each row, in one pass without a shuffle.

    ``clean_text`` is the text without its failed lines; the last line left keeps the
    line feed it had. Defined results: a null or empty text has no words and fails the
    base rule, its clean text is empty; null and repeated doc_ids are rows of their own.
    """
    schema = "doc_id long, " + ", ".join(f"{x} long" for x in MEASURES) + ", base_failed boolean, kept boolean"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            found = measure(batch.column("text"), with_text)
            base_failed, kept = verdicts(found)
            columns = [batch.column("doc_id"), *(pa.array(found[x]) for x in MEASURES), pa.array(base_failed), pa.array(kept)]
            names = ["doc_id", *MEASURES, "base_failed", "kept"]
            if with_text:
                columns.append(found["text"].cast(pa.string()))
                names.append("clean_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(rows, schema + (", clean_text string" if with_text else ""))


def keep_clean(docs: DataFrame, *, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The rows that are kept, with all their columns and the text without failed lines.

    A column named ``n_chars``, if there is one, gets the length of the new text.
    """
    at = docs.columns.index(text)
    size_at = docs.columns.index(n_chars) if n_chars in docs.columns else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in slices(batches, text, SLICE_BYTES):
            found = measure(batch.column(at), True)
            _, kept = verdicts(found)
            columns = batch.columns
            clean = found["text"]
            columns[at] = clean.cast(batch.schema.field(at).type)
            if size_at is not None:
                columns[size_at] = pc.utf8_length(clean).cast(batch.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(kept))

    return docs.mapInArrow(rows, docs.schema)
