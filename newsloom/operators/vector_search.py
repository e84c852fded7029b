"""Exact best items per user by the dot product of dense vectors.

Users and items are cut into blocks of bounded size; a pair of blocks is a cell, one task's
matrix product, which keeps ``n`` items per user. What is shuffled is blocks of
vectors and at most n rows per user and cell, never user-item scores.

Where the items make several blocks, blocks hold what is near each other: vectors are sorted by the
nearest of some pivots and their distance from it. A block lies in a ball (centre c, radius r), and by
Cauchy-Schwarz no item in it scores over u.c + |u| r for a user, nor over a like sum for a ball of
users. First each block of users meets the block of items with the highest bound. That gives every user an
n-th score, and only cells whose bound reaches the lowest of them are made; in a cell, users whose own
bound stays below their n-th score are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import RANK_DIGITS
from newsloom.operators.ranking import prefix_sums, top_n
from newsloom.operators.similarity import best_per_row
from newsloom.session import pin

# Vectors, and stored numbers, in one chunk at most; the users of a chunk, who bring their exclusions along;
# and the scores a task holds at a time.
CHUNK_VECTORS = 65_536
CHUNK_NUMBERS = 8_000_000
CHUNK_USERS = 8_192
SCORE_BLOCK = 500_000
# Below this a chunk of users is not split further for the sake of parallel tasks.
SMALLEST_CHUNK = 256

# Pivots that vectors are sorted by; they are sent to the tasks, so they are few and fixed in number.
PIVOTS = 256
# Room for rounding: of scores, and of sums relative to the lengths of their vectors.
MARGIN = 2 * 10.0**-RANK_DIGITS
SLACK = 1e-12

FOUND = "user_id long, article_id long, score double"


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(rows, -1)


def _cell_search(n: int):
    """The task of one cell: vectors and exclusions in, best items out."""

    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        left, right = table.filter(pa.array(kind == 0)), table.filter(pa.array(kind == 1))
        users, items = left["user_id"].to_numpy(), right["article_id"].to_numpy()
        if not len(users) or not len(items):
            return pa.table({"user_id": users[:0], "article_id": items[:0], "score": np.zeros(0)})
        by_user, by_item = np.argsort(users, kind="stable"), np.argsort(items, kind="stable")
        users, items, least = users[by_user], items[by_item], left["least"].to_numpy()[by_user]
        user_rows = _matrix(left["vec"], len(users))[by_user]
        item_rows = _matrix(right["vec"], len(items))[by_item]
        # Users who can't reach their score with any item here ask for nothing.
        centre = item_rows.mean(axis=0)
        radius = np.sqrt(((item_rows - centre) ** 2).sum(axis=1).max())
        lengths = np.sqrt((user_rows * user_rows).sum(axis=1))
        slack = SLACK * lengths * (np.sqrt((centre * centre).sum()) + radius) + MARGIN
        asks = user_rows @ centre + lengths * radius + slack >= least
        users, user_rows, least = users[asks], user_rows[asks], least[asks]
        if not len(users):
            return pa.table({"user_id": users, "article_id": items[:0], "score": np.zeros(0)})
        seen = table.filter(pa.array(kind == 2))
        seen_users, seen_items = seen["user_id"].to_numpy(), seen["article_id"].to_numpy()
        # An exclusion of a user or item outside this cell has nothing to exclude.
        su, si = np.searchsorted(users, seen_users), np.searchsorted(items, seen_items)
        known = (su < len(users)) & (si < len(items))
        known[known] = (users[su[known]] == seen_users[known]) & (items[si[known]] == seen_items[known])
        su, si = su[known], si[known]
        step = max(1, SCORE_BLOCK // len(items))
        found = []
        for begin in range(0, len(users), step):
            scores = user_rows[begin : begin + step] @ item_rows.T
            allowed = np.ones(scores.shape, dtype=bool)
            here = (su >= begin) & (su < begin + step)
            allowed[su[here] - begin, si[here]] = False
            allowed &= scores >= least[begin : begin + step, None] - MARGIN
            r, c = best_per_row(scores, n, allowed)
            found.append((users[begin + r], items[c], scores[r, c]))
        user, item, score = (np.concatenate(part) for part in zip(*found))
        return pa.table({"user_id": user, "article_id": item, "score": score})

    return run


def best_by_dot(
    users: DataFrame,
    items: DataFrame,
    n: int,
    exclude: DataFrame | None = None,
    chunk_vectors: int = CHUNK_VECTORS,
) -> DataFrame:
    """(user_id, article_id, score, rank): the ``n`` items with the largest dot product per user.

    ``users(user_id, vec)`` and ``items(article_id, vec)`` hold arrays of one length.
    Pairs in ``exclude(user_id, article_id)`` are left out inside the tasks, so a user
    with many of them still gets ``n`` items and no list of them is collected.
    """
    spark = users.sparkSession
    n_users, n_items = users.count(), items.count()
    if not n_users or not n_items:
        empty = spark.createDataFrame([], FOUND)
        return empty.withColumn("rank", F.lit(1))
    width = items.select(F.size("vec").alias("width")).first()["width"]
    chunk_vectors = max(1, min(chunk_vectors, CHUNK_NUMBERS // max(width, 1)))
    spread = -(-n_users // spark.sparkContext.defaultParallelism)
    per_chunk = min(chunk_vectors, CHUNK_USERS, max(spread, SMALLEST_CHUNK))
    user_chunks, item_chunks = -(-n_users // per_chunk), -(-n_items // chunk_vectors)
    wide = F.col("vec").cast("array<double>").alias("vec")
    users = users.select(F.col("user_id").cast("long").alias("user_id"), wide)
    items = items.select(F.col("article_id").cast("long").alias("article_id"), wide)
    if item_chunks > 1:
        return _pruned(users, items, n, exclude, per_chunk, chunk_vectors, n_items)

    user_chunk = F.pmod(F.xxhash64(F.col("user_id").cast("long")), F.lit(user_chunks)).cast("long").alias("ub")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(user_chunks - 1).cast("long"))).alias("ub")
    cells = _user_rows(users.select(user_chunk, F.lit(0).cast("long").alias("ib"), "*"))
    cells = cells.unionByName(_item_rows(items.select(every, F.lit(0).cast("long").alias("ib"), "*")))
    if exclude is not None:
        cells = cells.unionByName(_seen_rows(exclude.select(user_chunk, F.lit(0).cast("long").alias("ib"), "*")))
    found = cells.groupBy("ub", "ib").applyInArrow(_cell_search(n), FOUND)
    return top_n(found, "user_id", "score", "article_id", n)


def _user_rows(rows: DataFrame, least=None) -> DataFrame:
    """Cell rows (ub, ib, kind, user_id, article_id, vec, least) of users; ``least`` is the score to reach."""
    least = F.lit(float("-inf")) if least is None else least
    return rows.select(
        "ub", "ib", F.lit(0).alias("kind"), "user_id", F.lit(None).cast("long").alias("article_id"), "vec", least.alias("least")
    )


def _item_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "ub", "ib", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("user_id"), "article_id", "vec", F.lit(0.0).alias("least")
    )


def _seen_rows(rows: DataFrame) -> DataFrame:
    ids = [F.col(c).cast("long").alias(c) for c in ("user_id", "article_id")]
    none = F.lit(None).cast("array<double>").alias("vec")
    return rows.select("ub", "ib", F.lit(2).alias("kind"), *ids, none, F.lit(0.0).alias("least"))


def _blocks(vectors: DataFrame, name: str, pivots: np.ndarray, block_vectors: int) -> DataFrame:
    """(name, vec, block): blocks of at most ``block_vectors``, of one nearest pivot and a like distance from it."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = (pivots * pivots).sum(axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(pa.chunked_array([batch.column("vec")]), batch.num_rows)
            squares = (rows * rows).sum(axis=1)[:, None] - 2 * rows @ pivots.T + lengths
            pivot = squares.argmin(axis=1)
            far = np.sqrt(np.maximum(squares[np.arange(len(rows)), pivot], 0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pivot.astype(np.int64)), pa.array(far)], [*batch.schema.names, "pivot", "far"]
            )

    near = vectors.mapInArrow(nearest, f"{name} long, vec array<double>, pivot long, far double")
    counted = prefix_sums(near.withColumn("one", F.lit(1)), [F.col("far").asc(), F.col(name).asc()], "one", "nth", "pivot")
    # A pivot's blocks are numbered within its own range.
    block = F.shiftleft("pivot", 40) + F.floor((F.col("nth") - 1) / block_vectors).cast("long")
    return pin(counted.select(name, "vec", block.alias("block")))


def _balls(blocks: DataFrame) -> DataFrame:
    """(block, centre, radius) of each block."""

    def ball(table: pa.Table) -> pa.Table:
        rows = _matrix(table["vec"], table.num_rows)
        centre = rows.mean(axis=0)
        radius = np.sqrt(((rows - centre) ** 2).sum(axis=1).max())
        return pa.table({"block": table["block"][:1], "centre": pa.array([centre]), "radius": [float(radius)]})

    return blocks.select("block", "vec").groupBy("block").applyInArrow(ball, "block long, centre array<double>, radius double")


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def cell_bounds(user_balls: DataFrame, item_balls: DataFrame) -> DataFrame:
    """(ub, ib, bound): what a user of one block can score with an item of the other at most; a row for each pair of blocks."""
    u = user_balls.select(F.col("block").alias("ub"), F.col("centre").alias("uc"), F.col("radius").alias("ur"))
    v = item_balls.select(F.col("block").alias("ib"), F.col("centre").alias("ic"), F.col("radius").alias("ir"))
    numbers = item_balls.agg(F.collect_list("block")).scalar()
    pairs = u.withColumn("ib", F.explode(numbers)).join(v, "ib")
    # (uc + a)(ic + b) with |a| up to ur and |b| up to ir.
    u_length, i_length = F.sqrt(_dot("uc", "uc")), F.sqrt(_dot("ic", "ic"))
    reach = u_length * F.col("ir") + F.col("ur") * i_length + F.col("ur") * F.col("ir")
    slack = (u_length + F.col("ur")) * (i_length + F.col("ir")) * SLACK + MARGIN
    return pairs.select("ub", "ib", (_dot("uc", "ic") + reach + slack).alias("bound"))


def needed_cells(bounds: DataFrame, least: DataFrame) -> DataFrame:
    """(ub, ib) of the cells that may hold a score of ``least`` (ub, least), without the first one of each block of users."""
    return bounds.where("nth > 1").join(least, "ub").where(F.col("bound") >= F.col("least")).select("ub", "ib")


def _pruned(
    users: DataFrame, items: DataFrame, n: int, exclude: DataFrame | None, user_chunk: int, item_chunk: int, n_items: int
) -> DataFrame:
    """``best_by_dot`` over several blocks of items."""
    # About a pivot for each block; more would part what a block could hold.
    n_pivots = min(PIVOTS, -(-n_items // item_chunk))
    sample = items.orderBy(F.xxhash64("article_id"), "article_id").limit(n_pivots).select("vec").collect()
    pivots = np.array([r["vec"] for r in sample], np.float64)
    users, items = _blocks(users, "user_id", pivots, user_chunk), _blocks(items, "article_id", pivots, item_chunk)
    bounds = cell_bounds(_balls(users), pin(_balls(items)))
    nth = F.row_number().over(W.partitionBy("ub").orderBy(F.col("bound").desc(), "ib"))
    bounds = pin(bounds.withColumn("nth", nth))
    placed = users.select("user_id", F.col("block").alias("ub"), "vec")
    offered = items.select("article_id", F.col("block").alias("ib"), "vec")
    seen = None
    if exclude is not None:
        ids = exclude.select(F.col("user_id").cast("long").alias("user_id"), F.col("article_id").cast("long").alias("article_id"))
        seen = pin(ids.join(placed.select("user_id", "ub"), "user_id").join(offered.select("article_id", "ib"), "article_id"))

    def searched(cells: DataFrame, asking: DataFrame) -> DataFrame:
        rows = _user_rows(asking.join(cells, "ub"), F.col("least")).unionByName(_item_rows(offered.join(cells, "ib")))
        if seen is not None:
            rows = rows.unionByName(_seen_rows(seen.join(cells, ["ub", "ib"], "left_semi")))
        return rows.groupBy("ub", "ib").applyInArrow(_cell_search(n), FOUND)

    lowest = F.lit(float("-inf"))
    first = searched(bounds.where("nth = 1").select("ub", "ib"), placed.withColumn("least", lowest))
    first = pin(top_n(first, "user_id", "score", "article_id", n))
    floors = first.where(F.col("rank") == n).select("user_id", F.col("score").alias("least"))
    asking = pin(placed.join(floors, "user_id", "left").withColumn("least", F.coalesce("least", lowest)))
    cells = pin(needed_cells(bounds, asking.groupBy("ub").agg(F.min("least").alias("least"))))
    found = searched(cells, asking).unionByName(first.drop("rank"))
    return top_n(found, "user_id", "score", "article_id", n)
