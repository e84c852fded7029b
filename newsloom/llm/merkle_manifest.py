"""Merkle manifest of a dataset: a hash tree per key over its rows, and one over the keys' roots.

Rows are ranked within their key by a distributed sort. Aligned blocks of 4,096 leaves are hashed in
one task each and stored in van Emde Boas order (``veb_tree``); the roots of the blocks are the leaves
of the next tier, until every key has one block. The keys' roots go through the same tiers. A leaf's
proof is its path in its own block, then that of its block's root in the next tier, and so on; paths go
down from the top, one row for each block, so no task holds more than a block and no row of the
table is gathered beyond it, however many rows a key has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.veb_tree import Block, fold, steps_of
from newsloom.operators.ranking import global_rank, prefix_sums
from newsloom.session import pin

# Levels of a block.
BLOCK_LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCKS = "key string, block long, n int, height int, root string, nodes binary"
PATHS = "key string, block long, path binary, subroot string, top string"
ALL_KEYS = "all"


def field(value: Column) -> Column:
    """A value as its number of UTF-8 bytes, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(x) for x in fields]), 256)


def key_of(value: Column) -> Column:
    """A non-null key in the order of the value's bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def _height(block: int, n: int, levels: int) -> int:
    """Levels above the ``n`` nodes of a block: all, unless it is the only one of its key."""
    return levels if block else (n - 1).bit_length()


def _tier(nodes: DataFrame, levels: int) -> DataFrame:
    """The blocks over (key, idx, digest)."""

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(table["idx"].to_numpy(), kind="stable")
        number = table["block"][0].as_py()
        leaves = np.array(table["digest"].to_pylist(), "S64")[order]
        block = Block.build(leaves, _height(number, len(leaves), levels))
        return pa.table(
            {
                "key": [table["key"][0].as_py()],
                "block": [number],
                "n": pa.array([block.n], pa.int32()),
                "height": pa.array([block.height], pa.int32()),
                "root": [block.root.decode()],
                "nodes": pa.array([block.packed()], pa.binary()),
            }
        )

    cut = nodes.select("key", "idx", "digest", F.shiftright("idx", levels).alias("block"))
    return cut.groupBy("key", "block").applyInArrow(build, BLOCKS)


def tiers(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """The tiers of blocks over (key, idx, digest), from the leaves up; in the last each key has one block."""
    found = []
    while True:
        found.append(pin(_tier(nodes, levels)))
        if not found[-1].agg(F.max("block")).first()[0]:
            return found
        nodes = found[-1].select("key", F.col("block").alias("idx"), F.col("root").alias("digest"))


def _lowered(blocks: DataFrame, levels: int) -> DataFrame:
    """(key, block, path, subroot, root) of each block of the tier below, from rows of this one with a path of their own."""

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Block.unpacked(row["nodes"], row["n"], row["height"])
                children = np.arange(own.n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["key"]] * own.n, pa.string()),
                        pa.array((row["block"] << levels) + children),
                        pa.array([x + row["path"] for x in own.paths(children)], pa.binary()),
                        pa.array([row["subroot"]] * own.n, pa.string()),
                        pa.array([row["top"]] * own.n, pa.string()),
                    ],
                    ["key", "block", "path", "subroot", "top"],
                )

    return blocks.mapInArrow(down, PATHS)


def paths_of_blocks(found: list[DataFrame], top: DataFrame, levels: int) -> DataFrame:
    """Rows of PATHS for the lowest tier's blocks, from those of the last tier's."""
    for tier in reversed(found[1:]):
        top = _lowered(tier.join(top, ["key", "block"]), levels)
    return top


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (key, idx, doc_id, leaf, altered), ``tiers`` of blocks of each key, ``key_tiers`` of the keys' roots, ``keys``
    (key, subroot, idx) in the order of the key, and the number of levels of a block."""

    leaves: DataFrame
    tiers: list[DataFrame]
    key_tiers: list[DataFrame]
    keys: DataFrame
    levels: int

    @property
    def root(self) -> DataFrame:
        """(root): one row, none for an empty table."""
        return self.key_tiers[-1].select(F.col("root"))


def build_manifest(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    lang: str = "lang",
    n_chars: str = "n_chars",
    text: str = "text",
    altered: Column | None = None,
    levels: int = BLOCK_LEVELS,
) -> Manifest:
    """The hash trees of ``docs``, a leaf for each row.

    Leaves of a language ascend by id, nulls first, and rows of one id by their digest. ``altered``
    is the number of characters that a changed copy of the row claims, for ``proofs`` to test. Defined
    results: a null in any column hashes as ``-``, and a null language is one of its own, before all
    others; equal rows are leaves of their own; an empty table has no root; other columns are not read.
    """
    names = dict(zip(FIELDS, (doc_id, source, lang, n_chars, text)))
    plain = [F.col(names[f]) for f in FIELDS]
    changed = [altered if f == "n_chars" and altered is not None else F.col(names[f]) for f in FIELDS]
    leaf = leaf_digest(plain)
    rows = pin(
        docs.select(
            key_of(F.col(lang)).alias("key"),
            F.col(doc_id).cast("long").alias("doc_id"),
            F.unhex(leaf).alias("leaf"),
            F.unhex(leaf if altered is None else leaf_digest(changed)).alias("altered"),
            # Equal rows stay apart by their place in the input, so that a large group of them is sorted in many tasks.
            F.monotonically_increasing_id().alias("at"),
            F.lit(1).alias("one"),
        )
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("at").asc()]
    counted = prefix_sums(rows, order, "one", "nth", "key")
    leaves = pin(counted.select("key", (F.col("nth") - 1).alias("idx"), "doc_id", "leaf", "altered"))
    found = tiers(leaves.select("key", "idx", F.lower(F.hex("leaf")).alias("digest")), levels)
    ranked = global_rank(found[-1].select("key", F.col("root").alias("subroot")), [F.col("key").asc()], "nth")
    keys = pin(ranked.select("key", "subroot", (F.col("nth") - 1).alias("idx")))
    key_tiers = tiers(keys.select(F.lit(ALL_KEYS).alias("key"), "idx", F.col("subroot").alias("digest")), levels)
    return Manifest(leaves, found, key_tiers, keys, levels)


def proofs(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, proof, folded_root) of each leaf.

    ``path`` has a step for each level up to the root: L or R and the digest of the sibling on that side, or
    - without one; ``proof`` is the hash of the siblings; ``folded_root`` is the root that the altered
    leaf gives with this path.
    """
    levels = manifest.levels
    # From the one root down to the keys' roots, and from these to the blocks of leaves.
    last = manifest.key_tiers[-1]
    top = last.select("key", "block", F.lit(b"").cast("binary").alias("path"), F.lit("").alias("subroot"), F.col("root").alias("top"))
    lowest = manifest.key_tiers[0].join(paths_of_blocks(manifest.key_tiers, top, levels), ["key", "block"])
    of_key = _lowered(lowest, levels).select(F.col("block").alias("idx"), "path", "top")
    starts = manifest.keys.join(of_key, "idx").select("key", F.lit(0).cast("long").alias("block"), "path", "subroot", "top")
    paths = paths_of_blocks(manifest.tiers, starts, levels)
    # A block's nodes and its path meet in its own task.
    own = manifest.tiers[0].select("key", "block", "n", "height", "nodes").unionByName(paths, allowMissingColumns=True)

    def prove(leaves: pa.Table, own: pa.Table) -> pa.Table:
        row = {k: v for x in own.to_pylist() for k, v in x.items() if v is not None}
        block = Block.unpacked(row["nodes"], row["n"], row["height"])
        paths = block.paths(leaves["idx"].to_numpy() - (row["block"] << levels))
        above = steps_of(row["path"])
        proof, folded, whole = [], [], []
        for altered, path in zip(leaves["altered"].to_pylist(), paths):
            steps = steps_of(path) + above
            proof.append(hashlib.sha256(b"".join([s for _, s in steps])).hexdigest())
            folded.append(fold(altered.hex().encode(), steps).decode())
            whole.append((path + row["path"]).decode())
        rows = leaves.num_rows
        return pa.table(
            {
                "doc_id": leaves["doc_id"],
                "leaf": [x.hex() for x in leaves["leaf"].to_pylist()],
                "subroot": [row["subroot"]] * rows,
                "root": [row["top"]] * rows,
                "path": whole,
                "proof": proof,
                "folded_root": folded,
            }
        )

    cut = manifest.leaves.select("key", "idx", "doc_id", "leaf", "altered", F.shiftright("idx", levels).alias("block"))
    return (
        cut.groupBy("key", "block")
        .cogroup(own.groupBy("key", "block"))
        .applyInArrow(
            prove,
            "doc_id long, leaf string, subroot string, root string, path string, proof string, folded_root string",
        )
    )
