"""Token-id shards: a concatenated id array with Elias-Fano encoded document boundaries.

A shard is one blob:

    magic, id width, number of null doc_ids, smallest doc_id, number of ids
    Elias-Fano sequence of doc_id - smallest (the non-null ones, ascending)
    Elias-Fano sequence of document ends in ids
    the ids, little-endian, 2 or 4 bytes each

Shards are rows of a Parquet table, so they go through Spark's own writer: any file
system, and a lost executor leaves no half-written shard. Documents are range
partitioned by doc_id; the order of the shards is that of (partition, shard).

Defined results: a null text is empty and has the end id only; null doc_ids come
first; rows that share a doc_id stand side by side, in no set order among them;
an empty table has no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm import elias_fano
from newsloom.llm.byte_ids import ByteIds, tokenizer_path
from newsloom.llm.workers import slices

MAGIC = b"NLTOKEN1"
HEAD = "<8sBQqQ"
# Bytes of text that are encoded at once and go into one shard, more only for a single document.
SHARD_BYTES = 4 << 20

SHARD_SCHEMA = "partition int, shard int, n_docs long, n_ids long, blob binary"
ROW_SCHEMA = "partition int, shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def pack_shard(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> bytes:
    """One shard; ``doc_ids`` ascending with nulls first, ``ends`` of the documents in ``ids``."""
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    gaps = known.astype(np.uint64) - np.uint64(least % 2**64)
    width = 2 if not len(ids) or int(ids.max()) < 2**16 else 4
    head = struct.pack(HEAD, MAGIC, width, len(doc_ids) - len(known), least, len(ids))
    return b"".join([head, elias_fano.encode(gaps), elias_fano.encode(ends), ids.astype(f"<u{width}").tobytes()])


class Shard:
    """Reader of one shard blob."""

    def __init__(self, blob: bytes):
        magic, width, self.nulls, self.least, n_ids = struct.unpack_from(HEAD, blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        view = memoryview(blob)[struct.calcsize(HEAD) :]
        self.gaps = elias_fano.EliasFano(view)
        self.ends = elias_fano.EliasFano(view[self.gaps.size :])
        self.ids = np.frombuffer(view[self.gaps.size + self.ends.size :], f"<u{width}", n_ids)

    def __len__(self) -> int:
        return len(self.ends)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.gaps[i - self.nulls]

    def document(self, i: int) -> np.ndarray:
        """Ids of document ``i``, by two selects."""
        return self.ids[self.ends[i - 1] if i else 0 : self.ends[i]]


def write_token_files(
    docs: DataFrame,
    path: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
    shard_bytes: int = SHARD_BYTES,
) -> None:
    """Encode every text, append ``end_id`` and write the shards in ascending doc_id order to ``path``."""
    tokenizer = tokenizer or tokenizer_path()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteIds.of(tokenizer)
        partition = TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, "text", shard_bytes)):
            ids, offsets = encoder.encode(batch.column("text"))
            ends = offsets[1:] + np.arange(1, batch.num_rows + 1)
            with_end = np.full(len(ids) + batch.num_rows, end_id, np.uint32)
            inside = np.ones(len(with_end), bool)
            inside[ends - 1] = False
            with_end[inside] = ids
            blob = pack_shard(batch.column("doc_id").to_pylist(), with_end, ends)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([partition], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([batch.num_rows]),
                    pa.array([len(with_end)]),
                    pa.array([blob], pa.binary()),
                ],
                ["partition", "shard", "n_docs", "n_ids", "blob"],
            )

    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
    )
    ordered.mapInArrow(shards, SHARD_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    ``start`` counts the ids of all documents before. The places of shards are summed
    inside a partition and over one row per partition.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for partition, number, blob in zip(*(batch.column(c).to_pylist() for c in ("partition", "shard", "blob"))):
                shard = Shard(blob)
                ends = shard.ends.all()
                starts = np.concatenate([[0], ends[:-1]])
                known = (shard.gaps.all().astype(np.uint64) + np.uint64(shard.least % 2**64)).astype(np.int64)
                wide = shard.ids.astype("<u4")
                crcs = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ends), partition, np.int32)),
                        pa.array(np.full(len(ends), number, np.int32)),
                        pa.array([None] * shard.nulls + known.tolist(), pa.int64()),
                        pa.array(starts),
                        pa.array(ends - starts),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["partition", "shard", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.schema(SHARD_SCHEMA).parquet(path)
    sizes = files.select("partition", "shard", "n_ids")
    # One row per partition goes through this window.
    before = W.orderBy("partition").rowsBetween(W.unboundedPreceding, -1)
    partitions = sizes.groupBy("partition").agg(F.sum("n_ids").alias("_ids"))
    partitions = partitions.select("partition", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy("partition").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.join(partitions, "partition").select(
        "partition", "shard", (F.col("_base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("_base")
    )
    found = files.select("partition", "shard", "blob").mapInArrow(rows, ROW_SCHEMA)
    return found.join(bases, ["partition", "shard"]).select(
        "doc_id", (F.col("_base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )

