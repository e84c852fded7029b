"""Exact top-K cosine neighbours of sparse rows.

Rows are (entity, key, weight): users by article, articles by user, or articles by
topic. A key held by d entities links d * d pairs, so pairs are never rows of a table:

* copies: entities with the same normalised row are searched once (``collapse``);
* entities are sorted by their heaviest key and cut into blocks of bounded size, so that like ones
  are near each other. A block's lists, the holders of each key, are packed into one value. A cell is a pair of
  blocks: one task multiplies each pair of its entities once, for both of them, and keeps K rows per entity;
* first each block meets itself, above the diagonal only. That gives every entity a K-th score.
  Then the pairs of blocks with a range of keys in common follow in rounds, as a Cartesian product of the packed blocks: a
  task reads its two, merges their ascending keys, and no list is written once more for each block it meets. A round begins
  with the scores of the one before: from a key's largest weight in the other block and
  from partial norms comes a bound for each entity, and one whose bound is below its K-th score asks for
  nothing there. Only pairs of which one side asks are multiplied, and of these only sums that
  reach one of the two scores are kept; the scores rise as a task goes on;
* an entity with so many keys that its own row does not fit a task is a block of its own. A cell
  holds only those of its keys that the other block has, which are bounded by that block's size.

Nothing is left out: every pair that shares a key is weighed, or excluded by its bound.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import RANK_DIGITS
from newsloom.operators.ranking import contenders, global_rank, prefix_sums, top_n
from newsloom.session import pin, store

# Bounds of one block: entities and stored weights. A task reads two blocks.
CHUNK_ENTITIES = 131_072
CHUNK_WEIGHTS = 4_000_000
TASK_HOLDERS = 4_000_000
LIST_HOLDERS = 131_072
# With more products than this for each pair of entities, a block has half as many of them.
DENSE_PRODUCTS = 0.05
# There are as many blocks as tasks at a time, if they don't get smaller than this.
TASK_WEIGHTS = 250_000
# The most blocks in a partition. A task of the Cartesian product reads two partitions, for all pairs of their blocks;
# with fewer than so many partitions, each has one block.
PART_BLOCKS = 4
LEAST_PARTS = 24
# Entities with more keys than this are blocks of their own.
HEAVY_KEYS = 1_000_000
# Below this a block is not split further for the sake of parallel tasks.
SMALLEST_CHUNK = 64
# Up to so many blocks all meet heavy rows; beyond, those that share a key.
FEW_BLOCKS = 4
# Ranges of keys, in words of 64: blocks without a range in common don't meet.
RANGE_WORDS = 64
# A round meets blocks up to so many times as far away as the round before.
ROUND_GROWTH = 3
# Rows of a batch that leave a task.
UNPACKED_ROWS = 100_000

# Inside a task: products expanded at a time, cells of a result that cost as much as
# sorting one product, multiply-adds of a dense column that cost as much as one expanded
# product, cells of a slice of the result, and cells of the dense columns.
PRODUCT_BATCH = 1_000_000
SPARSE_GAIN = 16
# Buckets of a hash of pairs, two to this power: what a bucket sums up to bounds the sum of each pair in it.
BUCKET_BITS = 22
DENSE_GAIN = 100
SLICE_CELLS = 500_000
DENSE_CELLS = 8_000_000
# Sums for the right side that wait before its best ones are sorted again.
PENDING_SUMS = 100_000


NEIGHBOURS = "entity long, neighbor long, sim double"


def unit_rows(rows: DataFrame, entity: str, key: str, weight: str) -> DataFrame:
    """(e, f, x, main): non-zero weights scaled so that each entity's row has length one; ``main`` marks its largest ones."""
    base = rows.select(
        F.col(entity).cast("long").alias("e"), F.col(key).alias("f"), F.col(weight).cast("double").alias("w")
    ).where("w IS NOT NULL AND w <> 0 AND e IS NOT NULL AND f IS NOT NULL")
    whole = W.partitionBy("e")
    unit = base.withColumns({"norm": F.sqrt(F.sum(F.col("w") * F.col("w")).over(whole)), "top": F.max(F.abs("w")).over(whole)})
    x = F.try_divide("w", "norm").alias("x")
    return unit.select("e", "f", x, (F.abs("w") == F.col("top")).alias("main")).where("x IS NOT NULL")


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with whole numbers as keys: other kinds of keys are numbered in their order."""
    if dict(rows.dtypes)[key] in ("tinyint", "smallint", "int", "bigint"):
        return rows.withColumn(key, F.col(key).cast("long"))
    places = global_rank(rows.select(key).where(F.col(key).isNotNull()).distinct(), [F.col(key)], "_number")
    return rows.join(places, key).drop(key).withColumnRenamed("_number", key)


def require_unique_pairs(rows: DataFrame, entity: str, key: str) -> None:
    """Raise ``ValueError`` when an (entity, key) pair has more than one row."""
    repeated = rows.groupBy(entity, key).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"({entity}, {key}) is not unique, e.g. {repeated[0].asDict()}")


def _in_rank_order(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> np.ndarray:
    """Order by row, falling rounded value and column."""
    if not len(rows) or not (np.abs(vals).max() < 2 and 0 <= rows.min() and rows.max() < 2**31):
        return np.lexsort((cols, -np.round(vals, RANK_DIGITS), rows))
    # Row and rounded value fit one number; only what is equal in both is sorted by column.
    one = (rows.astype(np.int64) << 32) - np.rint(vals * 10.0**RANK_DIGITS).astype(np.int64)
    order = np.argsort(one)
    one = one[order]
    same = one[1:] == one[:-1]
    if same.any():
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        order[tied] = order[tied][np.lexsort((cols[order[tied]], one[tied]))]
    return order


def _best_entries(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, k: int, ascending: bool = True):
    """The ``k`` best entries of each row; equal values by column. ``rows`` may come in any order if they aren't ``ascending``."""
    if ascending:
        keep = contenders(rows, vals, k)
        rows, cols, vals = rows[keep], cols[keep], vals[keep]
    order = _in_rank_order(rows, cols, vals)
    rows, cols, vals = rows[order], cols[order], vals[order]
    # The entry k places before is of another row.
    keep = np.ones(len(rows), bool)
    keep[k:] = rows[k:] != rows[:-k]
    return rows[keep], cols[keep], vals[keep]


def best_per_row(scores: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best scores of each row of a matrix; equal scores by column."""
    if allowed is not None:
        scores = np.where(allowed, scores, -np.inf)
    width = scores.shape[1] // k
    keep = scores > -np.inf
    if width >= 2:
        # The same bound as in contenders, on runs of equal width.
        runs = scores[:, : width * k].reshape(len(scores), k, width).max(axis=2)
        keep &= scores >= (runs.min(axis=1) - 2 * 10.0**-RANK_DIGITS)[:, None]
    rows, cols = np.nonzero(keep)
    rows, cols, _ = _best_entries(rows, cols, scores[rows, cols], k)
    return rows, cols


# Values equal after rounding must stay together.
MARGIN = 2 * 10.0**-RANK_DIGITS


class _Entries:
    """One block's weights in a cell, by key and place: key number, place of the entity in ``ids``, weight."""

    def __init__(self, ids: np.ndarray, key: np.ndarray, at: np.ndarray, x: np.ndarray):
        self.ids, self.key, self.at, self.x = ids, key, at, x

    def take(self, chosen: np.ndarray) -> _Entries:
        return _Entries(self.ids, self.key[chosen], self.at[chosen], self.x[chosen])

    def largest(self, n_keys: int) -> np.ndarray:
        """The largest absolute weight of each key."""
        out = np.zeros(n_keys)
        if len(self.key):
            starts = np.flatnonzero(np.append(True, self.key[1:] != self.key[:-1]))
            out[self.key[starts]] = np.maximum.reduceat(np.abs(self.x), starts)
        return out

    def norms(self) -> np.ndarray:
        return np.sqrt(np.bincount(self.at, self.x * self.x, minlength=len(self.ids)))

    def bounds(self, other: _Entries, n_keys: int) -> np.ndarray:
        """What an entity's similarity to any of the other block can be at most."""
        sums = np.bincount(self.at, np.abs(self.x) * other.largest(n_keys)[self.key], minlength=len(self.ids))
        return np.minimum(sums, self.norms() * other.norms().max(initial=0.0)) * (1 + 1e-12)


def _summed(row: np.ndarray, col: np.ndarray, product: np.ndarray, shape: tuple, low: np.ndarray, high: np.ndarray):
    """(row, column, sum) of the pairs that reach the floor of one side, from the products of a slice of a sparse result.

    Few pairs reach a floor once there are floors. A pair's sum is at most what its bucket has of positive
    products, so most products go before the others are sorted.
    """
    rows, width = shape
    if rows * width <= SPARSE_GAIN * len(product):
        sums = np.bincount(row.astype(np.int64) * width + col, weights=product, minlength=rows * width)
        cell = np.flatnonzero(sums > 0)
        row, col, sums = cell // width, cell % width, sums[cell]
    else:
        floor = np.minimum(low[row], high[col])
        if (floor > 0).any():
            mixed = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + col.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            bucket = (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            keep = np.bincount(bucket, np.fmax(product, 0), minlength=1 << BUCKET_BITS)[bucket] >= floor - MARGIN
            row, col, product = row[keep], col[keep], product[keep]
        cell = row.astype(np.int64) * width + col
        order = np.argsort(cell)
        cell = cell[order]
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else order
        sums = np.add.reduceat(product[order], starts) if len(cell) else product
        row, col = cell[starts] // max(width, 1), cell[starts] % max(width, 1)
    ok = (sums > 0) & (sums >= np.minimum(low[row], high[col]) - MARGIN)
    return row[ok], col[ok], sums[ok]


def _multiplied(left: _Entries, right: _Entries, n_keys: int, floors: tuple, triangle: bool, tally: list | None):
    """(place left, place right, similarity) of pairs that reach the floor of one side, slice by slice of the left.

    Entities are worked off in slices. Keys that many of both sides hold are multiplied as dense
    columns; the others product by product. In a ``triangle`` both sides are the same block and
    each pair is made once.
    """
    height, width = len(left.ids), len(right.ids)
    b, b_x = right.at, right.x
    n_right, n_left = np.bincount(right.key, minlength=n_keys), np.bincount(left.key, minlength=n_keys)
    begin = np.append(0, np.cumsum(n_right))

    # The keys with the most products become dense columns, as far as those fit.
    products = n_left * n_right
    hot = np.flatnonzero((products * DENSE_GAIN >= height * width) & (products > 0))
    hot = np.sort(hot[np.argsort(-products[hot], kind="stable")[: DENSE_CELLS // max(width, 1)]])
    n_dense = len(hot)

    first_of, end_of = begin[left.key], begin[left.key + 1]
    if triangle:
        # Holders behind the entity itself: the pairs before it were made from the other side.
        first_of = np.arange(1, len(b) + 1)
        twice = (right.key[1:] == right.key[:-1]) & (b[1:] == b[:-1])
        if twice.any():
            ends = np.append(np.flatnonzero(~twice), len(b) - 1) + 1
            first_of = ends[np.searchsorted(ends, np.arange(len(b)), side="right")]
    if not n_dense:
        fan = end_of - first_of
        if tally is not None:
            tally.append(int(fan.sum()))
        yield from _sparse(left, right, first_of, fan, floors)
        return

    dense = np.zeros(n_keys, dtype=bool)
    dense[hot] = True
    column = np.cumsum(dense) - 1
    slab = np.zeros((n_dense, width))
    in_slab = dense[right.key]
    slab[column[right.key[in_slab]], b[in_slab]] = b_x[in_slab]
    order = np.argsort(left.at, kind="stable")
    a, a_key, a_x, first_of, end_of = left.at[order], left.key[order], left.x[order], first_of[order], end_of[order]
    is_dense = dense[a_key]
    fan = np.where(is_dense, 0, end_of - first_of)
    if tally is not None:
        tally.append(int(fan.sum()) + int(products[dense].sum()))
    ends = np.cumsum(np.bincount(a, weights=fan, minlength=height).astype(np.int64))
    low, high = floors
    first = 0
    while first < height:
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + PRODUCT_BATCH, side="right")))
        last = min(last, first + max(1, SLICE_CELLS // width))
        lo, hi = np.searchsorted(a, [first, last])
        rows_here = last - first
        f, here = fan[lo:hi], is_dense[lo:hi]
        offset = np.arange(int(f.sum())) - np.repeat(np.cumsum(f) - f, f)
        at = np.repeat(first_of[lo:hi], f) + offset
        cell = np.repeat((a[lo:hi] - first).astype(np.int64) * width, f) + b[at]
        sums = np.zeros(rows_here * width)
        if len(cell):
            sums = np.bincount(cell, weights=np.repeat(a_x[lo:hi], f) * b_x[at], minlength=len(sums))
        rows = np.zeros((rows_here, n_dense))
        rows[a[lo:hi][here] - first, column[a_key[lo:hi][here]]] = a_x[lo:hi][here]
        whole = rows @ slab
        if triangle:
            whole *= np.arange(width) > np.arange(first, last)[:, None]
        sums += whole.ravel()
        # Compared as a matrix: few sums pass, and only those get coordinates.
        sums = sums.reshape(rows_here, width)
        ok = sums >= np.minimum(low[first:last, None], high[None, :]) - MARGIN
        ok &= sums > 0
        rows, cols = np.nonzero(ok)
        yield rows + first, cols, sums[rows, cols]
        first = last


def _sparse(left: _Entries, right: _Entries, first_of: np.ndarray, fan: np.ndarray, floors: tuple):
    """``_multiplied`` without dense columns: entries stay in the order of the keys, and a slice takes those of its entities."""
    height, width = len(left.ids), len(right.ids)
    low, high = floors
    some = fan > 0
    a, a_x, first_of, fan = left.at[some], left.x[some], first_of[some], fan[some]
    ends = np.cumsum(np.bincount(a, weights=fan, minlength=height).astype(np.int64))
    first = 0
    while first < height and len(a):
        done = ends[first - 1] if first else 0
        last = min(height, max(first + 1, int(np.searchsorted(ends, done + PRODUCT_BATCH, side="right"))))
        mine = slice(None) if last - first == height else np.flatnonzero((a >= first) & (a < last))
        f = fan[mine]
        n = int(f.sum())
        if n:
            at = np.arange(n) + np.repeat(first_of[mine] - (np.cumsum(f) - f), f)
            row = np.repeat(a[mine] - first, f)
            product = np.repeat(a_x[mine], f) * right.x[at]
            rows, cols, sums = _summed(row, right.at[at], product, (last - first, width), low[first:last], high)
            yield rows + first, cols, sums
        first = last


def _cell_best(k: int, tally: list | None = None):
    """``best(left, right, n_keys, floors)``: (entity, neighbor, sim) that a cell of two blocks adds for either of them.

    Without ``right`` the block meets itself. ``floors`` are the K-th scores so far, by place; all floors may rise on the way.
    """

    def best(left: _Entries, right: _Entries | None, n_keys: int, floors: tuple) -> tuple:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        triangle = right is None

        def multiply(left: _Entries, right: _Entries, low: np.ndarray, high: np.ndarray) -> None:
            best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            waiting, n_waiting = [], 0

            def settle() -> None:
                nonlocal best, waiting, n_waiting
                new = [np.concatenate(x) for x in zip(best, *waiting)]
                waiting, n_waiting = [], 0
                best = list(_best_entries(*new, k, ascending=False))
                # A column with k sums has a floor of its own from here on.
                full = np.flatnonzero(np.append(best[0][1:] != best[0][:-1], True)) if len(best[0]) else np.zeros(0, np.int64)
                counts = np.bincount(best[0], minlength=len(high))
                full = full[counts[best[0][full]] >= k]
                high[best[0][full]] = np.maximum(high[best[0][full]], best[2][full])

            for rows, cols, sums in _multiplied(left, right, n_keys, (low, high), triangle, tally):
                mine = sums >= low[rows] - MARGIN
                r, c, v = _best_entries(rows[mine], cols[mine], sums[mine], k)
                found.append((left.ids[r], right.ids[c], v))
                theirs = sums >= high[cols] - MARGIN
                waiting.append((cols[theirs], rows[theirs], sums[theirs]))
                n_waiting += int(theirs.sum())
                if n_waiting >= max(PENDING_SUMS, len(best[0])):
                    settle()
            settle()
            found.append((right.ids[best[0]], left.ids[best[1]], best[2]))

        if triangle:
            # One array for both sides: what an entity has from the rows before its own is a floor for its row.
            multiply(left, left, floors[0], floors[0])
        else:
            asks = [x.bounds(y, n_keys) >= z - MARGIN for x, y, z in ((left, right, floors[0]), (right, left, floors[1]))]
            asking = asks[0][left.at]
            if asking.all():
                multiply(left, right, floors[0], floors[1].copy())
            else:
                if asking.any():
                    multiply(left.take(asking), right, floors[0], floors[1].copy())
                theirs = asks[1][right.at]
                if theirs.any():
                    multiply(left.take(~asking), right.take(theirs), floors[0], floors[1].copy())
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)

    return best


def _floors_at(ids: np.ndarray, known: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The scores of the entities ``known`` at their places in ``ids``, 0 elsewhere."""
    out = np.zeros(len(ids))
    if len(known) and len(ids):
        at = np.minimum(np.searchsorted(ids, known), len(ids) - 1)
        here = ids[at] == known
        out[at[here]] = score[here]
    return out


def _cell_neighbours(k: int, tally: list | None = None):
    """The task of one pair of blocks whose lists come as rows.

    An input row is a key with its holders in the block of its ``side``, as a list ``l`` of pairs or as
    two lists ``es`` and ``xs``; rows without a key hold the K-th scores that the block's entities have so far.
    """
    cell = _cell_best(k, tally)

    def held(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length of each list; entities and numbers of all of them."""
        if "l" in table.column_names:
            lists = table["l"].combine_chunks()
            flat = lists.flatten()
            return lists.value_lengths().to_numpy(), flat.field("e").to_numpy(), flat.field("x").to_numpy()
        es, xs = table["es"].combine_chunks(), table["xs"].combine_chunks()
        return es.value_lengths().to_numpy(), es.flatten().to_numpy(), xs.flatten().to_numpy()

    def entries(table: pa.Table, keys: np.ndarray) -> _Entries:
        n, e, x = held(table)
        ids, at = np.unique(e, return_inverse=True)
        key = np.repeat(keys, n)
        order = np.lexsort((at, key))
        return _Entries(ids, key[order], at[order], x[order])

    def floors_of(table: pa.Table, ids: np.ndarray) -> np.ndarray:
        return _floors_at(ids, *held(table)[1:])

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        keys = table["f"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        n_keys = int(keys.max(initial=-1)) + 1
        part = lambda chosen: table.filter(pa.array(chosen))
        if table["lo"][0] == table["hi"][0]:
            whole = entries(table, keys)
            found = cell(whole, None, n_keys, (np.zeros(len(whole.ids)),))
        else:
            shared = np.zeros(n_keys + 1, np.int64)
            for s in (0, 1):
                shared[np.unique(keys[(side == s) & (keys >= 0)])] += 1
            on = (keys >= 0) & (shared[keys] == 2)
            both = [entries(part(on & (side == s)), keys[on & (side == s)]) for s in (0, 1)]
            floors = tuple(floors_of(part((keys < 0) & (side == s)), x.ids) for s, x in enumerate(both))
            found = cell(*both, n_keys, floors)
        return pa.table(dict(zip(("entity", "neighbor", "sim"), found)))

    return run


def _placed(held: DataFrame, n: int, weights: int, n_blocks: int) -> tuple[DataFrame, int]:
    """(e, block) of the entities of ``held`` (e, held, main), and the number of blocks.

    Entities with the same heaviest key follow each other. A block's entities and weights together use up two
    shares, so it may hold twice its share of either, and no more.
    """
    if n_blocks == 1:
        return held.select("e", F.lit(0).cast("long").alias("block")), 1
    cost = F.col("held") * F.lit(n_blocks / weights) + F.lit(n_blocks / n)
    costed = held.withColumn("cost", cost)
    reached = prefix_sums(costed, [F.col("main"), F.col("e")], "cost", "reached")
    block = F.floor((F.col("reached") - F.col("cost") / 2) / 2).cast("long")
    return reached.select("e", F.least(block, F.lit(n_blocks - 1)).alias("block")), n_blocks


def _as_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_bytes(held: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(held.as_buffer()).read_all()


def _best_of(found: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entity, neighbor, sim) of the ``k`` best rows of each entity."""
    entity, neighbor, sim = (found[c].to_numpy() for c in ("entity", "neighbor", "sim"))
    ids, place = np.unique(entity, return_inverse=True)
    place, neighbor, sim = _best_entries(place, neighbor, sim, k, ascending=False)
    return ids[place], neighbor, sim


def _small(numbers: np.ndarray) -> np.ndarray:
    """Non-negative numbers in as few bytes as the largest needs."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def _in_bytes(arrays: list[np.ndarray]) -> bytes:
    out = io.BytesIO()
    for array in arrays:
        np.save(out, array)
    return out.getvalue()


class _Block:
    """A block's lists: ascending keys, how many hold each, places of the holders in the ascending ``ids``, and weights."""

    def __init__(self, held: bytes):
        source = io.BytesIO(held)
        steps, counts, at, self.x, self.ids = (np.load(source) for _ in range(5))
        # Differences wrap around like the keys.
        self.keys, self.counts = np.cumsum(steps.astype(np.int64)), counts.astype(np.int64)
        self.at = at.astype(np.int64)

    @staticmethod
    def packed(keys: np.ndarray, counts: np.ndarray, at: np.ndarray, x: np.ndarray, ids: np.ndarray) -> bytes:
        steps = np.append(keys[:1], np.diff(keys))
        steps = _small(steps) if steps.min(initial=0) >= 0 else steps
        return _in_bytes([steps, _small(counts), _small(at), x, ids])

    def on(self, chosen: np.ndarray, numbers: np.ndarray) -> _Entries:
        """The entries of the keys at the places ``chosen``, which get the given ``numbers``."""
        number = np.full(len(self.keys), -1, np.int64)
        number[chosen] = numbers
        key = np.repeat(number, self.counts)
        keep = key >= 0
        return _Entries(self.ids, key[keep], self.at[keep], self.x[keep])


def _cell_of(best, lo: bytes, hi: bytes, floors: list[tuple]) -> tuple:
    """What ``best`` finds for two packed blocks, given (entities, scores) of both."""
    left, right = _Block(lo), _Block(hi)
    few, many = (left, right) if len(left.keys) <= len(right.keys) else (right, left)
    if not len(few.keys):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    place = np.minimum(np.searchsorted(many.keys, few.keys), len(many.keys) - 1)
    same = np.flatnonzero(many.keys[place] == few.keys)
    numbers = np.arange(len(same))
    both = {id(few): few.on(same, numbers), id(many): many.on(place[same], numbers)}
    sides = [both[id(left)], both[id(right)]]
    del left, right, few, many
    scores = tuple(_floors_at(x.ids, *known) for x, known in zip(sides, floors))
    return best(*sides, len(same), scores)


def _key_ranges(keys: np.ndarray, first: int, last: int) -> list[int]:
    """Which of the equal ranges from the first to the last key of all blocks have a key here, as words of 64 bits."""
    n = RANGE_WORDS * 64
    share = (keys.astype(np.float64) - float(first)) / max(float(last) - float(first), 1.0)
    there = np.zeros(n, bool)
    there[np.clip((share * n).astype(np.int64), 0, n - 1)] = True
    return np.packbits(there, bitorder="little").view(np.int64).tolist()


def _packed_block(k: int, alone: bool, first: int, last: int):
    """The task of one block: its lists as one value, and the neighbours that its entities have among themselves."""
    cell = _cell_best(k)

    def pack(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        f, e, x = (table[c].to_numpy() for c in ("f", "e", "x"))
        del table
        ids, at = np.unique(e, return_inverse=True)
        order = np.lexsort((at, f))
        f, at, x = f[order], at[order], x[order]
        starts = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
        counts = np.diff(np.append(starts, len(f)))
        keys = f[starts]
        del e, f, order
        held = None if alone else _Block.packed(keys, counts, at, x, ids)
        whole = _Entries(ids, np.repeat(np.arange(len(keys)), counts), at, x)
        found = pa.table(dict(zip(("entity", "neighbor", "sim"), cell(whole, None, len(keys), (np.zeros(len(ids)),)))))
        near = pa.table(dict(zip(("entity", "neighbor", "sim"), _best_of(found, k))))
        ranges = pa.array([_key_ranges(keys, first, last)], pa.list_(pa.int64()))
        return pa.table({"block": [block], "held": pa.array([held], pa.binary()), "near": pa.array([_as_bytes(near)], pa.binary()), "ranges": ranges})

    return pack


def _unpacked(column: str, schema: str, rows):
    """The rows ``rows(table, block)`` of each value of ``column``, a block's at a time."""

    def unpack(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                yield from rows(_from_bytes(batch.column(column)[at]), batch.column("block")[at].as_py()).to_batches(UNPACKED_ROWS)

    return lambda df: df.select("block", column).mapInArrow(unpack, schema)


def _cells(k: int):
    """The tasks of pairs of blocks, each row with the lists and K-th scores of both."""
    best = _cell_best(k)
    none = (np.zeros(0, np.int64), np.zeros(0))

    def cells(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                floors = []
                for side in ("lo", "hi"):
                    e, x = (batch.column(f"{side}_{c}")[at] for c in ("es", "xs"))
                    floors.append((e.values.to_numpy(), x.values.to_numpy()) if e.is_valid else none)
                found = _cell_of(best, *(batch.column(f"{side}_held")[at].as_buffer() for side in ("lo", "hi")), floors)
                found = pa.table(dict(zip(("entity", "neighbor", "sim"), found)))
                yield from pa.table(dict(zip(("entity", "neighbor", "sim"), _best_of(found, k)))).to_batches(UNPACKED_ROWS)

    return cells


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return top_n(found, "entity", "sim", "neighbor", k)


def _neighbours(
    unit: DataFrame, held: DataFrame, k: int, chunk_entities: int, task_holders: int, list_holders: int, heavy_keys: int
) -> DataFrame:
    """Ranked neighbours (entity, neighbor, sim, rank) of those entities of the stored unit rows that ``held`` lists.

    A block's lists are one value. Pairs of blocks are a Cartesian product, whose tasks read the values where
    they are, so that no copy of a list is ever written. Blocks near each other meet first; from round to
    round the K-th scores rise, and about as many rows pass them in a round as there are neighbours.
    """
    spark = unit.sparkSession
    is_heavy = F.col("held") > heavy_keys
    size = held.agg(
        F.count_if(~is_heavy).alias("n"),
        F.coalesce(F.sum(F.when(~is_heavy, F.col("held"))), F.lit(0)).alias("weights"),
        F.count_if(is_heavy).alias("heavy"),
    ).first()
    if not size["n"] + size["heavy"]:
        return spark.createDataFrame([], NEIGHBOURS + ", rank int")
    cells = spark.sparkContext.defaultParallelism
    first, last, keys = unit.agg(F.min("f"), F.max("f"), F.approx_count_distinct("f")).first()
    most = min(chunk_entities, list_holders)
    if size["weights"] ** 2 > DENSE_PRODUCTS * keys * size["n"] ** 2:
        most = min(most, CHUNK_ENTITIES // 2)
    n_blocks = max(
        1,
        # A block may be larger than its share by one entity, and have half its share of the one in the other.
        -(-2 * size["n"] // most) if size["n"] > most else 1,
        -(-2 * size["weights"] // min(CHUNK_WEIGHTS, task_holders)) if size["weights"] > min(CHUNK_WEIGHTS, task_holders) else 1,
        min(math.isqrt(2 * cells), -(-size["n"] // SMALLEST_CHUNK)),
        min(cells, size["weights"] // TASK_WEIGHTS),
    )
    placed, n_blocks = _placed(held.where(~is_heavy), max(size["n"], 1), max(size["weights"], 1), n_blocks)
    n_all = n_blocks + size["heavy"]
    if size["heavy"]:
        ranked = global_rank(held.where(is_heavy).select("e"), [F.col("e")], "place")
        placed = pin(placed.unionByName(ranked.select("e", (F.col("place") + n_blocks - 1).alias("block"))))

    entries = unit.join(placed, "e")
    own = entries.where(F.col("block") < n_blocks).select("block", "f", "e", "x")
    packed = own.repartitionById(n_blocks, F.col("block").cast("int")).groupBy("block")
    packed = packed.applyInArrow(_packed_block(k, n_all == 1, first, last), "block long, held binary, near binary, ranges array<long>")
    blocks = pin(packed)
    best = _ranked(_unpacked("near", NEIGHBOURS, lambda near, _: near)(blocks), k)
    if n_all == 1:
        return best

    def scores(best: DataFrame) -> DataFrame:
        """(block, es, xs): the K-th scores of a block's entities."""
        kth = best.where(F.col("rank") == k).join(placed, F.col("entity") == F.col("e"))
        lists = kth.groupBy("block").agg(F.collect_list(F.struct("e", F.col("sim").alias("x"))).alias("l"))
        return lists.select("block", F.col("l")["e"].alias("es"), F.col("l")["x"].alias("xs"))

    if n_blocks > 1:
        near, far = 1, n_blocks // 2
        own_blocks = min(PART_BLOCKS, max(1, n_blocks // LEAST_PARTS))
        while near <= far:
            # What little would be left for one more round is met now.
            until = near * ROUND_GROWTH - 1
            until = far if 2 * far <= 3 * until else until
            known = blocks.select("block", "held", "ranges").unionByName(scores(best), allowMissingColumns=True)
            known = known.repartitionById(-(-n_blocks // own_blocks), F.floor(F.col("block") / own_blocks).cast("int")).groupBy("block")
            known = known.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("held", "ranges", "es", "xs")])
            lo, hi = (known.select(*[F.col(c).alias(f"{side}_{c}") for c in known.columns]) for side in ("lo", "hi"))
            away = F.col("hi_block") - F.col("lo_block")
            away = F.least(away, n_blocks - away)
            meet = (F.col("lo_block") < F.col("hi_block")) & away.between(near, until)
            common = F.zip_with("lo_ranges", "hi_ranges", lambda a, b: a.bitwiseAND(b))
            meet &= F.exists(common, lambda word: word != 0)
            pairs = lo.hint("shuffle_replicate_nl").join(hi, meet)
            pairs = pairs.select(*[f"{side}_{c}" for side in ("lo", "hi") for c in ("held", "es", "xs")])
            found = pairs.mapInArrow(_cells(k), NEIGHBOURS)
            best = store(_ranked(found.unionByName(best.drop("rank")), k))
            near = until + 1
    if not size["heavy"]:
        return best

    # Two lists of numbers take half the bytes of a list of pairs.
    two_lists = [F.col("l")["e"].alias("es"), F.col("l")["x"].alias("xs")]
    lists = entries.groupBy("f", "block").agg(F.collect_list(F.struct("e", "x")).alias("l")).select("f", "block", *two_lists)
    floors = scores(best).select(F.lit(None).cast("long").alias("f"), "block", "es", "xs")
    every = F.sequence(F.lit(0).cast("long"), F.lit(n_all - 1).cast("long"))
    if n_all <= FEW_BLOCKS:
        sent = lists.unionByName(floors).withColumn("others", every)
    else:
        # Only blocks with a key in common meet: lists go to the blocks that hold their key, scores to the heavy ones.
        lists = pin(lists)
        holders = lists.groupBy("f").agg(F.collect_set("block").alias("others")).where(F.size("others") > 1)
        sent = lists.join(holders, "f").unionByName(floors.withColumn("others", every))
    sent = sent.select("f", "block", "es", "xs", F.explode("others").alias("other")).where(F.col("block") != F.col("other"))
    sent = sent.select(
        F.least("block", "other").alias("lo"),
        F.greatest("block", "other").alias("hi"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
        "f",
        "es",
        "xs",
    ).where((F.col("lo") < n_blocks) & (F.col("hi") >= n_blocks))
    found = sent.groupBy("lo", "hi").applyInArrow(_cell_neighbours(k), NEIGHBOURS).unionByName(best.drop("rank"))
    if size["heavy"] > 1:
        # Two heavy rows may share more keys than fit a task: few pairs, summed on the map side first.
        heavy = entries.where(F.col("block") >= n_blocks)
        one = heavy.select("f", F.col("e").alias("entity"), F.col("x").alias("own"))
        both = one.join(heavy, "f").where(F.col("entity") != F.col("e")).groupBy("entity", F.col("e").alias("neighbor"))
        found = found.unionByName(both.agg(F.sum(F.col("own") * F.col("x")).alias("sim")).where("sim > 0"))
    return _ranked(found, k)


def _entities(unit: DataFrame) -> DataFrame:
    """(e, held, main, h1, h2): the number of keys, the heaviest one, and two fingerprints of the row."""
    return unit.groupBy("e").agg(
        F.count("*").alias("held"),
        F.max(F.when(F.col("main"), F.col("f"))).alias("main"),
        F.bit_xor(F.xxhash64("f", "x")).alias("h1"),
        F.bit_xor(F.xxhash64("f", "x", F.lit(1))).alias("h2"),
    )


def _collapsed(held: DataFrame, k: int) -> tuple[DataFrame, DataFrame] | None:
    """(members, groups) of entities whose unit rows are equal; None if no two are.

    ``members(e, rep)`` names each entity's representative, the smallest id of its
    group; ``groups(rep, ids)`` holds the k + 1 smallest ids, which is all that a top-k
    with ties by id can use. Rows are told apart by two 64-bit fingerprints and a count.
    """
    same = ["held", "h1", "h2"]
    reps = pin(held.groupBy(*same).agg(F.min("e").alias("rep"), F.count("*").alias("copies")))
    if reps.where("copies > 1").isEmpty():
        return None
    # WindowGroupLimit trims each group in the map tasks, so a hot group stays small.
    order = W.partitionBy(*same).orderBy("e")
    firsts = held.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    groups = firsts.groupBy(*same).agg(F.min("e").alias("rep"), F.sort_array(F.collect_list("e")).alias("ids"))
    return held.join(reps, same).select("e", "rep"), pin(groups.select("rep", "ids"))


def _expand(members: DataFrame, groups: DataFrame, between: DataFrame, k: int) -> DataFrame:
    """Neighbours of every member from those of its representative.

    A group contributes at most its k + 1 smallest ids, and k neighbouring groups
    suffice, as each holds at least one entity. The list per representative is cut to
    the best k + 1, so a member still has k after its own id is left out.
    """
    own = groups.select(F.col("rep").alias("entity"), "ids", F.lit(1.0).alias("sim"))
    near = between.join(groups, F.col("neighbor") == F.col("rep")).select("entity", "ids", "sim")
    options = own.unionByName(near).select("entity", "sim", F.explode("ids").alias("neighbor"))
    lists = (
        top_n(options, "entity", "sim", "neighbor", k + 1)
        .groupBy(F.col("entity").alias("rep"))
        .agg(F.sort_array(F.collect_list(F.struct("rank", "neighbor", "sim"))).alias("near"))
    )
    others = F.slice(F.filter("near", lambda n: n["neighbor"] != F.col("e")), 1, k)
    return (
        members.join(lists, "rep")
        .select(F.col("e").alias("entity"), F.posexplode(others).alias("at", "n"))
        .select("entity", "n.neighbor", "n.sim", (F.col("at") + 1).alias("rank"))
    )


def top_k_cosine(
    rows: DataFrame,
    entity: str,
    key: str,
    weight: str,
    k: int = 10,
    collapse: bool = True,
    chunk_entities: int = CHUNK_ENTITIES,
    task_holders: int = TASK_HOLDERS,
    list_holders: int = LIST_HOLDERS,
    heavy_keys: int = HEAVY_KEYS,
) -> DataFrame:
    """(entity, neighbor, sim, rank): the ``k`` most similar other entities, sim > 0.

    Exact, ties by the smaller id. Pairs of ``rows`` must be unique.
    """
    unit = store(unit_rows(_numbered(rows, key), entity, key, weight))
    limits = (chunk_entities, task_holders, list_holders, heavy_keys)
    held = pin(_entities(unit))
    copies = _collapsed(held, k) if collapse else None
    if copies is None:
        return _neighbours(unit, held, k, *limits)
    members, groups = copies
    distinct = held.join(groups, F.col("e") == F.col("rep"), "left_semi")
    return _expand(members, groups, _neighbours(unit, pin(distinct), k, *limits), k)
