"""Importance resampling: text like the target's, drawn from the whole corpus.

Two generative models over hashed word unigrams and bigrams, one of the target texts and one
of all texts, give each document the log of their ratio for PER_FEATURES of its
features. The documents with the largest log ratio plus Gumbel noise are a sample without replacement by importance weight. The
noise is a function of the row's id, so the sample is the same on every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shingles import mixed, word_hashes
from newsloom.llm.texts import buffer_of
from newsloom.llm.workers import slices
from newsloom.operators.ranking import global_rank

BUCKETS = 10_000
# Labelled target texts that the target's model is fitted on at most.
TARGET_ROWS = 10_000
# The log ratio is taken for so many features of a document, so that its length decides nothing.
PER_FEATURES = 300
SMOOTHING = 1.0
SLICE_BYTES = 4 << 20
SEED = 20


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each unigram and bigram, n + 1 offsets of the texts)."""
    data, offsets = buffer_of(texts)
    words, firsts = word_hashes(data, offsets)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    pairs = mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    both = np.zeros((len(words), 2), np.int64)
    both[:, 0] = words % np.uint64(BUCKETS)
    both[:-1, 1] = pairs % np.uint64(BUCKETS)
    # The last word of a text begins no bigram.
    keep = np.ones((len(words), 2), bool)
    keep[firsts[1:][np.diff(firsts) > 0] - 1, 1] = False
    reached = np.concatenate([[0], np.cumsum(keep.sum(axis=1))])
    return both[keep], reached[firsts]


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all features of a column ``text``; the driver gets one number per bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, "text", SLICE_BYTES):
            total += np.bincount(features(batch.column("text"))[0], minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "rows"])

    counted = texts.select("text").mapInArrow(rows, "bucket int, rows long").groupBy("bucket").agg(F.sum("rows").alias("rows"))
    out = np.zeros(BUCKETS)
    for row in counted.collect():
        out[row["bucket"]] = row["rows"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    p, q = target + SMOOTHING, raw + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def resample(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    quality: str = "quality",
    share: float | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """(doc_id, log_weight, key, rank, kept) of each row.

    The target are the texts labelled 1; the model is fitted on the ``target_rows`` of them with
    the smallest hash of their id, the raw model on all texts. ``share`` of the rows
    are kept; by default the share that the labels call good. Defined results: a null or empty
    text has log weight 0; a row with a null id draws noise like any other id, rows that share
    an id draw the same; without labels nothing is known, all weights are 0 and all rows kept.
    """
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marks = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(quality).alias("quality"))
    good = marks.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    sample = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows)
    target = bucket_counts(chosen.join(F.broadcast(sample), "doc_id", "left_semi"))
    raw = bucket_counts(chosen)
    ratios = log_ratios(target, raw) if target.sum() else np.zeros(BUCKETS)
    if share is None:
        share = marks.agg(F.avg((F.col("quality") == 1).cast("int"))).first()[0]
        share = 1.0 if share is None or not target.sum() else share

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            buckets, offsets = features(batch.column("text"))
            reached = np.concatenate([[0.0], np.cumsum(ratios[buckets])])
            weights = PER_FEATURES * np.diff(reached[offsets]) / np.maximum(1, np.diff(offsets))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.round(weights, 6))], ["doc_id", "log_weight"]
            )

    weighted = chosen.mapInArrow(rows, "doc_id long, log_weight double")
    # A number strictly between 0 and 1 from 52 bits of the id's hash.
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.coalesce("doc_id", F.lit(-1))), 12) + 0.5) / 2.0**52
    keyed = weighted.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))
    ranked = global_rank(keyed, [F.desc("key"), F.asc_nulls_last("doc_id")], "rank")
    total = chosen.count()
    return ranked.withColumn("kept", F.col("rank") <= F.lit(int(np.ceil(share * total - 1e-9))))
