"""Language identification by compression.

For each language a zstandard raw-content dictionary is cut from some of its labelled
texts. A text is compressed with each of them; the language whose dictionary gives the
fewest bytes wins, ties going to the smaller name. Text is compressed in blocks, so the
dictionary is as near at the end of a long text as at its start, and every block counts.

The score is how much smaller the best result is than the second: 1 - best / second,
without the bytes that a frame takes by itself. A text whose score is below
``MIN_MARGIN`` is rejected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.workers import kept, slices
from newsloom.operators.ranking import top_n
from newsloom.session import pin

UNKNOWN = "und"
# Labelled rows a language is learned from at most, and bytes of its dictionary.
TRAIN_ROWS = 300
DICTIONARY_BYTES = 1 << 14
SALTS = 16
# Places of a text that a dictionary takes something from.
STRETCHES = 2
BLOCK_BYTES = 512
MIN_MARGIN = 0.005
# Matches from three bytes on, found by binary tree: languages differ in short pieces.
MIN_MATCH, SEARCH_LOG = 3, 5
NO_LETTERS = r"[\W\d_]+"
# Bytes of an empty text's frame.
FRAME_BYTES = 9
SLICE_BYTES = 2 << 20


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; rows with 1 are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def prepared(text: str) -> bytes:
    """The words in small letters with a space around each; other characters tell no language."""
    return (" " + re.sub(NO_LETTERS, " ", text.lower()) + " ").encode()


def learn(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    rows: int = TRAIN_ROWS,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> dict[str, bytes]:
    """A dictionary per language, from at most ``rows`` labelled texts of each that aren't held out.

    One text of each id takes part, the one with the smallest hash, and the ids are those with the
    smallest hash: the same for any order or partitioning. First the ids are found, then only those
    texts are read. Each gives ``STRETCHES`` short stretches from places all over it, cut before
    they come to the driver, which gets ``rows`` of them for a language and some twice the
    dictionary's size. Defined results: repeated rows count once, a text without letters gives
    nothing, other columns are not read.
    """
    labelled = docs.where(
        F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & (remainder(doc_id) != 1)
    ).select(F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    hashed = F.xxhash64("text")
    keyed = labelled.groupBy("lang", "doc_id").agg(F.min(hashed).alias("hash"))
    keyed = keyed.withColumn("key", F.xxhash64("doc_id").cast("double"))
    # First within salted parts of a language, so that the last step sees a fixed number of rows of each.
    salted = keyed.withColumn("part", F.concat_ws("/", "lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS))))
    few = pin(top_n(top_n(salted, "part", "key", "doc_id", rows).drop("rank"), "lang", "key", "doc_id", rows))
    n = few.groupBy("lang").agg(F.count("*").alias("n"))
    few = few.select("lang", "doc_id", "hash").join(n, "lang")

    # Twice what a stretch gives at an even share, for what its preparation takes away.
    size = F.ceil(F.lit(2 * dictionary_bytes / STRETCHES) / F.col("n")).cast("int") + F.lit(8)
    part = F.ceil(F.length("text") / F.lit(STRETCHES)).cast("int")

    def stretch(number: int) -> Column:
        drawn = F.pmod(F.xxhash64("doc_id", F.lit(number)), F.greatest(part - size, F.lit(0)) + F.lit(1)).cast("int")
        return F.substr("text", F.lit(number) * part + drawn + F.lit(1), F.least(size, part))

    # At most ``rows`` ids of a language, whatever their rows, so this side is small.
    picked = labelled.join(F.broadcast(few), ["lang", "doc_id"]).where(hashed == F.col("hash"))
    picked = picked.select("lang", "doc_id", F.array(*[stretch(i) for i in range(STRETCHES)]).alias("stretches"))
    picked = picked.groupBy("lang", "doc_id").agg(F.min("stretches").alias("stretches"))
    found: dict[str, list[list[bytes]]] = {}
    for row in sorted(picked.collect(), key=lambda r: (r["lang"], str(r["doc_id"]))):
        found.setdefault(row["lang"], []).append([x for x in map(prepared, row["stretches"]) if x.strip()])
    dictionaries = {}
    for name, texts in found.items():
        pieces = [x for own in texts for x in own]
        if pieces:
            share = max(1, dictionary_bytes // len(pieces))
            while sum(min(len(x), share) for x in pieces) < dictionary_bytes and share < max(map(len, pieces)):
                share *= 2
            dictionaries[name] = b" ".join(x[:share] for x in pieces)[-dictionary_bytes:]
    return {name: x for name, x in sorted(dictionaries.items()) if len(x) >= 8}


class Compressor:
    """The learned languages, ready to measure texts."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        settings = zstandard.ZstdCompressionParameters.from_level(
            3,
            min_match=MIN_MATCH,
            strategy=zstandard.STRATEGY_BTOPT,
            search_log=SEARCH_LOG,
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
        )
        self.names = sorted(dictionaries)
        self.each = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=settings)
            self.each.append(zstandard.ZstdCompressor(dict_data=content, compression_params=settings).compress)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language or UNKNOWN, score from 0 to 1)."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        data = prepared(text)
        blocks = [data[at : at + BLOCK_BYTES] for at in range(0, len(data), BLOCK_BYTES)]
        frames = FRAME_BYTES * len(blocks)
        sizes = [max(1, sum(len(compress(block)) for block in blocks) - frames) for compress in self.each]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.names[0], 1.0
        second = min(x for i, x in enumerate(sizes) if i != best)
        return self.names[best], 1.0 - sizes[best] / second


def _compressor(dictionaries: dict[str, bytes]) -> Compressor:
    key = zlib.crc32(repr(sorted(dictionaries.items())).encode())
    return kept(("languages", key), lambda: Compressor(dictionaries))


def predict_languages(
    docs: DataFrame, dictionaries: dict[str, bytes], *, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of each row, in one pass without a shuffle.

    Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected,
    and so is every text if nothing was learned; null and repeated doc_ids are rows of
    their own, a null id is never held out.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = _compressor(dictionaries)
        for batch in slices(batches, "text", SLICE_BYTES):
            found = [languages.predict(t) for t in batch.column("text").to_pylist()]
            scores = np.array([score for _, score in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([name for name, _ in found], pa.string()),
                    pa.array(scores),
                    pa.array(scores < MIN_MARGIN),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    chosen = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(remainder(doc_id) == 1, F.lit(False)).alias("held_out"),
        F.col(text).alias("text"),
    )
    return chosen.mapInArrow(
        rows, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
    )


def keep_known(docs: DataFrame, dictionaries: dict[str, bytes], *, text: str = "text") -> DataFrame:
    """The rows whose language is found by more than the margin, with all their columns."""
    at = docs.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = _compressor(dictionaries)
        for batch in slices(batches, text, SLICE_BYTES):
            scores = [languages.predict(t)[1] for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(np.array(scores) >= MIN_MARGIN))

    return docs.mapInArrow(rows, docs.schema)
