"""Exact top-k inner products by ball trees, branch and bound.

Candidates are packed into shards, each with a ball tree: a node has the centre and
radius of its vectors, so for a query q no vector below scores over q.c + |q| r. A task
holds a group of shards; blocks of queries stream through it. For a query the leaves are
visited in the order of their bounds, until a bound falls below the query's current k-th
score. That score is shared: a task carries it from shard to shard, and a first round, in
which every block meets one group only, gives it to the tasks of all other groups.

Scores are whole numbers, so bounds are rounded down and equal scores can be decided by
ids: a leaf whose bound equals the k-th score is skipped if its smallest id is too large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.session import pin

SCALE = 1024
SHARD_ROWS = 4096
LEAF_ROWS = 64
BLOCK_ROWS = 256
# Shards that a task holds at once.
GROUP_SHARDS = 8
LOWEST, HIGHEST = -(2**63), 2**63 - 1

PACKED = "part long, dim int, rows int, ids binary, vectors binary"


def pack_vectors(vectors: DataFrame, vec_id: str, embedding: str, most_rows: int) -> DataFrame:
    """Rows of up to ``most_rows`` scaled vectors of one length each; unfit vectors are left out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def packed(dim: int, ids: list, values: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int(ids[0])]),
                    pa.array([dim], pa.int32()),
                    pa.array([len(ids)], pa.int32()),
                    pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                    pa.array([np.concatenate(values).astype("<f8").tobytes()], pa.binary()),
                ],
                ["part", "dim", "rows", "ids", "vectors"],
            )

        for batch in batches:
            for number, values in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                if number is None or not values.is_valid or values.values.null_count:
                    continue
                vector = values.values.to_numpy().astype(np.float64)
                if not len(vector) or not np.isfinite(vector).all():
                    continue
                # A product with a power of two is exact, and so is its floor.
                ids, kept = held.setdefault(len(vector), ([], []))
                ids.append(number)
                kept.append(np.floor(vector * SCALE))
                if len(ids) == most_rows:
                    yield packed(len(vector), *held.pop(len(vector)))
        for dim, (ids, kept) in held.items():
            yield packed(dim, ids, kept)

    chosen = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    return chosen.mapInArrow(rows, PACKED)


class Shard:
    """Candidates of one shard with their ball tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.leaves: list[np.ndarray] = []
        self._split(np.arange(len(ids)))
        self.centres = np.array([vectors[x].mean(axis=0) for x in self.leaves])
        self.radii = np.array([np.sqrt(((vectors[x] - c) ** 2).sum(axis=1).max()) for x, c in zip(self.leaves, self.centres)])
        self.least = np.array([ids[x].min() for x in self.leaves])
        self.most = float(np.abs(vectors).max()) if len(vectors) else 0.0
        # The balls above the leaves: pairs of neighbours, level by level, to the root.
        self.levels = [(self.centres, self.radii)]
        while len(self.levels[-1][1]) > 1:
            self.levels.append(self._above(*self.levels[-1]))

    def _split(self, rows: np.ndarray) -> None:
        if len(rows) <= LEAF_ROWS:
            self.leaves.append(rows)
            return
        values = self.vectors[rows]
        axis = int((values.max(axis=0) - values.min(axis=0)).argmax())
        order = np.lexsort((self.ids[rows], values[:, axis]))
        middle = len(rows) // 2
        self._split(rows[order[:middle]])
        self._split(rows[order[middle:]])

    @staticmethod
    def _above(centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = centres[::2], centres[1::2]
        r1, r2 = radii[::2], radii[1::2]
        n = len(second)
        middle, reach = first.copy(), r1.copy()
        middle[:n] = (first[:n] + second) / 2
        half = np.sqrt(((first[:n] - second) ** 2).sum(axis=1)) / 2
        reach[:n] = half + np.maximum(r1[:n], r2)
        return middle, reach

    def bounds(self, query: np.ndarray, norm: float, kth: float) -> tuple[np.ndarray, np.ndarray]:
        """(leaves that may hold a score of ``kth`` or more, their upper bounds), the highest first."""
        nodes = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            centres, radii = self.levels[level]
            bound = centres[nodes] @ query + norm * radii[nodes]
            # Room for rounding in the sums above.
            bound = np.floor(bound + 1e-9 * (np.abs(bound) + norm * (self.most + 1)) + 1e-6)
            near = bound >= kth
            nodes, bound = nodes[near], bound[near]
            if level:
                below = len(self.levels[level - 1][1])
                nodes = np.concatenate([2 * nodes, 2 * nodes + 1])
                nodes = nodes[nodes < below]
        order = np.lexsort((self.least[nodes], -bound))
        return nodes[order], bound[order]

    def scores(self, leaf: int, query: np.ndarray) -> np.ndarray:
        rows = self.vectors[self.leaves[leaf]]
        if self.most * float(np.abs(query).max()) * len(query) < 2**52:
            return (rows @ query).astype(np.int64)
        whole = [int(x) for x in query.tolist()]
        exact = [sum(int(a) * b for a, b in zip(row, whole)) for row in rows.tolist()]
        return np.array([min(max(x, LOWEST), HIGHEST) for x in exact], np.int64)


def search(shards: list[Shard], query_id: int, query: np.ndarray, k: int, kth: int) -> list[tuple[int, int]]:
    """(score, vec_id) of the best ``k`` in the shards that reach the shared score ``kth``."""
    best: list[tuple[int, int]] = []
    norm = float(np.sqrt((query * query).sum()))
    found = [(b, i, s) for s, shard in enumerate(shards) for i, b in zip(*shard.bounds(query, norm, kth))]
    found.sort(key=lambda x: (-x[0], shards[x[2]].least[x[1]]))
    for bound, leaf, s in found:
        full = len(best) == k
        if bound < (max(kth, best[-1][0]) if full else kth):
            break
        shard = shards[s]
        if full and bound == best[-1][0] and shard.least[leaf] > best[-1][1]:
            continue
        scores, ids = shard.scores(leaf, query), shard.ids[shard.leaves[leaf]]
        fits = (scores >= (max(kth, best[-1][0]) if full else kth)) & (ids != query_id)
        best += zip(scores[fits].tolist(), ids[fits].tolist())
        best.sort(key=lambda x: (-x[0], x[1]))
        del best[k:]
    return best


def _searched(rows: DataFrame, k: int, with_block: bool) -> DataFrame:
    """Search of packed rows of one ``grp`` and ``dim``: shards come before query blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, shards = None, []
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                vectors = np.frombuffer(row["vectors"], "<f8").reshape(len(ids), row["dim"])
                if (row["grp"], row["dim"]) != here:
                    here, shards = (row["grp"], row["dim"]), []
                if not row["asks"]:
                    shards.append(Shard(ids, vectors))
                    continue
                kths = np.frombuffer(row["kths"], "<i8")
                found = [search(shards, int(i), q, k, int(low)) for i, q, low in zip(ids, vectors, kths)]
                new = [max(int(low), x[-1][0]) if len(x) == k else int(low) for x, low in zip(found, kths)]
                counts = [len(x) for x in found]
                flat = [hit for x in found for hit in x]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]]),
                        pa.array([row["grp"]], pa.int32()),
                        pa.array([row["dim"]], pa.int32()),
                        pa.array([row["ids"]], pa.binary()),
                        pa.array([row["vectors"] if with_block else b""], pa.binary()),
                        pa.array([np.array(new, "<i8").tobytes()], pa.binary()),
                        pa.array([np.repeat(np.arange(len(ids)), counts).tolist()], pa.list_(pa.int32())),
                        pa.array([np.repeat(ids, counts).tolist()], pa.list_(pa.int64())),
                        pa.array([[v for _, v in flat]], pa.list_(pa.int64())),
                        pa.array([[s for s, _ in flat]], pa.list_(pa.int64())),
                    ],
                    ["part", "grp", "dim", "ids", "vectors", "kths", "place", "query_id", "vec_id", "score"],
                )

    ordered = rows.repartition("grp", "dim").sortWithinPartitions("grp", "dim", "asks")
    return ordered.mapInArrow(
        run,
        "part long, grp int, dim int, ids binary, vectors binary, kths binary, "
        "place array<int>, query_id array<long>, vec_id array<long>, score array<long>",
    )


def top_inner_products(
    vectors: DataFrame,
    queries: Column,
    *,
    k: int = 10,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of each query, all if there are fewer.

    ``queries`` picks the query rows; a query's candidates are all rows with another id,
    ties go to the smaller id. Defined results: a null, empty or non-finite vector, or one with a
    null id, takes no part; vectors are compared with those of their own length; rows that
    share an id are candidates of their own, but not of queries with their id; scores beyond a
    long are cut to its range.
    """
    shards = pin(pack_vectors(vectors, vec_id, embedding, SHARD_ROWS))
    blocks = pack_vectors(vectors.where(queries), vec_id, embedding, BLOCK_ROWS)
    blocks = pin(blocks.withColumn("part", F.monotonically_increasing_id()))
    groups = 1 + shards.count() // GROUP_SHARDS
    group_of = F.pmod(F.xxhash64("part", "ids"), F.lit(groups)).cast("int")
    shown = ["grp", "dim", "asks", "part", "ids", "vectors", "kths"]
    held = shards.withColumns({"grp": group_of, "asks": F.lit(False), "kths": F.lit(b"").cast("binary")}).select(shown)

    lowest = F.expr(f"unhex(repeat('{np.array([LOWEST], '<i8').tobytes().hex()}', rows))")
    asked = blocks.withColumns({"grp": group_of, "asks": F.lit(True), "kths": lowest}).select(shown)
    first = pin(_searched(held.unionByName(asked), k, True))
    others = first.withColumns(
        {"home": F.col("grp"), "grp": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))}
    ).where(F.col("grp") != F.col("home"))
    others = others.withColumn("asks", F.lit(True)).select(shown)
    second = _searched(held.unionByName(others), k, False)

    hits = ["part", "dim", F.explode(F.arrays_zip("place", "query_id", "vec_id", "score")).alias("hit")]
    found = first.select(hits).unionByName(second.select(hits)).select("part", "dim", "hit.*")
    order = W.partitionBy("part", "dim", "place").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
