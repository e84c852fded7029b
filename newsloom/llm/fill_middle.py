"""Fill-in-the-middle: a text is cut at two token boundaries and its parts change places.

A token is white space with the word behind it, or the white space at the end of a text. The
boundaries of all tokens of a batch of texts are one ``BoundarySet``; both cuts of every text are
a select on it. The draws come from a hash of the id, so a row gives the same result in any
partitioning and on every run.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.boundary_set import BoundarySet
from newsloom.llm.texts import ASCII_SPACE, buffer_of
from newsloom.llm.workers import slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED = 42
# Of 100 texts so many are cut, and of 100 that are cut so many have the suffix first.
CUT_PERCENT = 50
SPM_PERCENT = 80
SLICE_BYTES = 4 << 20


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0 and the end of each token of the texts, in bytes."""
    if not len(data):
        return np.zeros(1, np.int64)
    space = ASCII_SPACE[data]
    ends = np.zeros(len(data), bool)
    ends[:-1] = ~space[:-1] & space[1:]
    # A text's last byte ends a word or a stretch of white space at its end.
    ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    return np.append(0, np.flatnonzero(ends) + 1)


def draws(ids: list[int | None], seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers for each id."""
    digests = (hashlib.sha256(f"{seed}:{'-' if i is None else i}".encode()).digest() for i in ids)
    return np.array([struct.unpack(">4I", x[:16]) for x in digests], np.int64).reshape(-1, 4)


def transformed(ids: list[int | None], texts: pa.Array, seed: int, cut: int, spm: int) -> dict[str, list]:
    """The columns of ``fill_in_middle`` for a batch, without the ids."""
    data, offsets = buffer_of(texts)
    ends = boundaries(data, offsets)
    found = BoundarySet(ends)
    first = np.searchsorted(ends, offsets)
    n = np.diff(first)
    h = draws(ids, seed)
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    cuts = found.select(np.concatenate([first[:-1] + np.minimum(a, b), first[:-1] + np.maximum(a, b)]))
    low, high = cuts[: len(n)], cuts[len(n) :]
    characters = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    whole = data.tobytes()
    forms, outputs = [], []
    for start, x, y, end, (_, _, h3, h4) in zip(*(z.tolist() for z in (offsets[:-1], low, high, offsets[1:], h))):
        text = whole[start:end]
        if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= cut:
            forms.append(PLAIN)
            outputs.append(text)
        elif h4 % 100 < spm:
            forms.append(SPM)
            outputs.append(b"".join((SUFFIX, whole[y:end], PREFIX, whole[start:x], MIDDLE, whole[x:y])))
        else:
            forms.append(PSM)
            outputs.append(b"".join((PREFIX, whole[start:x], SUFFIX, whole[y:end], MIDDLE, whole[x:y])))
    shown = [form != PLAIN for form in forms]
    prefix = (characters[low] - characters[offsets[:-1]]).tolist()
    middle = (characters[high] - characters[low]).tolist()
    return {
        "n": n.tolist(),
        "form": forms,
        "prefix_chars": [x if s else None for x, s in zip(prefix, shown)],
        "middle_chars": [x if s else None for x, s in zip(middle, shown)],
        "output": outputs,
    }


def fill_in_middle(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    cut_percent: int = CUT_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row; ``n`` counts tokens.

    The prefix ends after the smaller, the middle after the larger of two drawn numbers of
    tokens; both may be empty. Defined results: a null or empty text and one that holds a marker
    stay plain, with null lengths; rows that share an id are cut by the same draws; a null id draws
    as "-" and stays null; other columns are not read, whatever they are called. A text is cut whole,
    however long.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            ids = batch.column("doc_id")
            found = transformed(ids.to_pylist(), batch.column("text"), seed, cut_percent, spm_percent)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = [pa.array(found[c], kind) for c, kind in zip(("n", "form", "prefix_chars", "middle_chars"), kinds)]
            output = pa.array(found["output"], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids, *columns, output], ["doc_id", *found])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(
        rows, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: str | Column, form: str | Column) -> Column:
    """The exact text of an output; no part holds a marker, so the markers cut it in one way."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    psm, spm = F.split(body, "<[SM]>"), F.split(body, "<[PM]>")
    return (
        F.when(form == PSM, F.concat(psm[0], psm[2], psm[1]))
        .when(form == SPM, F.concat(spm[1], spm[2], spm[0]))
        .otherwise(output)
    )
