"""Ranks and order statistics that never put a whole table, or a hot group, into one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from newsloom.functions import RANK_DIGITS, best_first, epoch_micros
from newsloom.session import pin, store

# A group larger than this is ranked across tasks instead of inside one window.
HOT_GROUP_ROWS = 1_000_000
# Size of the sketch of times, more than the share of rows its quantiles are off by, and the rows that one task may sort.
SKETCH_SIZE = 4096
SKETCH_ERROR = 0.002
SEARCH_TAIL_ROWS = 100_000
# Two days.
CLOCK_MICROS = 2 * 86_400_000_000
# Rows of a common ranking that are broadcast.
HEAD_ROWS = 10_000
# Offers that are always worked off in one pass, those of one task, about, and those that wait in it to be summed up.
PASS_OFFERS = 20_000_000
TASK_OFFERS = 2_000_000
WAITING_OFFERS = 4_000_000
# An entry of a packed list.
ENTRY = np.dtype([("item", "<i8"), ("value", "<f8")])


def top_n(df: DataFrame, group: str, score: str, item: str, n: int, rank: str = "rank") -> DataFrame:
    """The best ``n`` rows of each group, ranked from 1.

    The filter on row_number becomes a WindowGroupLimit, so each map task sends at most
    ``n`` rows of a group to the shuffle however large the group is.
    """
    order = W.partitionBy(group).orderBy(*best_first(score, item))
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)


def global_rank(df: DataFrame, order: list[Column], rank: str = "position") -> DataFrame:
    """Rank of each row in the order of the whole table, from 1, without a one-task window.

    A range-partitioned sort gives each row its place in its partition; the offsets of
    the partitions are a prefix sum over one row per partition. The sorted rows are
    pinned, so both reads see the same partitions.
    """
    placed = pin(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    # monotonically_increasing_id keeps the partition above bit 33, the row below it.
    partition = F.shiftright("_place", 33)
    row = F.col("_place").bitwiseAND(F.lit(2**33 - 1))
    sizes = placed.groupBy(partition.alias("_part")).agg(F.count("*").alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    # One row per shuffle partition: bounded by the partition count, not by the data.
    ranked = placed.withColumns({"_part": partition, "_row": row}).join(F.broadcast(offsets), "_part")
    return ranked.withColumn(rank, F.col("_before") + F.col("_row") + F.lit(1)).drop(
        "_part", "_row", "_place", "_before"
    )


def large_groups(df: DataFrame, group: str, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame | None:
    """(_named) of the groups with more than ``hot_rows`` rows; None if there are none."""
    counts = df.groupBy(F.col(group).alias("_named")).agg(F.count("*").alias("_rows"))
    large = pin(counts.where(F.col("_rows") > hot_rows).select("_named"))
    return None if large.isEmpty() else large


def rank_within(
    df: DataFrame,
    group: str,
    order: list[str | Column],
    rank: str = "position",
    size: str = "group_rows",
    hot_rows: int = HOT_GROUP_ROWS,
    any_large: bool | None = None,
) -> DataFrame:
    """Position and group size of each row, in ``order`` inside ``group``.

    Groups up to ``hot_rows`` go through a window. Rows of larger groups are sorted
    across tasks by (group, order); their position is the global one less the first of
    the group. Rows without a group are a group of their own on both ways, which return
    the same columns. ``any_large`` tells whether there are larger groups, if that is known.
    """
    counts = df.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias(size))
    window = W.partitionBy(group).orderBy(*order)
    if any_large is None:
        any_large = not counts.where(F.col(size) > hot_rows).isEmpty()
    if not any_large:
        whole = W.partitionBy(group)
        return df.withColumns({rank: F.row_number().over(window), size: F.count("*").over(whole)})
    sized = df.join(counts, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    cool = sized.where(F.col(size) <= hot_rows).withColumn(rank, F.row_number().over(window))
    placed = global_rank(
        sized.where(F.col(size) > hot_rows), [F.col(group).asc(), *order], "_overall"
    )
    firsts = placed.groupBy(F.col(group).alias("_group")).agg(F.min("_overall").alias("_first"))
    hot = placed.join(firsts, F.col(group).eqNullSafe(F.col("_group")))
    hot = hot.withColumn(rank, (F.col("_overall") - F.col("_first") + 1).cast("int"))
    shown = [*df.columns, rank, size]
    return cool.select(shown).unionByName(hot.select(shown))


def _restarting_sums(values: np.ndarray, starts: np.ndarray, carried: float | int) -> np.ndarray:
    """Running sums that begin again at each start; what comes before the first start goes on from ``carried``."""
    sums = np.cumsum(values)
    before = np.zeros(len(values), values.dtype)
    if len(starts):
        before[starts] = np.diff(np.append(0, (sums - values)[starts]))
        before = np.cumsum(before)
    out = sums - before
    out[: starts[0] if len(starts) else len(out)] += carried
    return out


def prefix_sums(df: DataFrame, order: list[Column], value: str, total: str, group: str | None = None) -> DataFrame:
    """``df`` with ``total``, the sum of ``value`` over the rows of the same group up to this one in ``order``.

    Rows are sorted across tasks by (group, order); each task sums up its stretch of the sorted rows as
    they stream by, starting anew with each group. What a stretch lacks is what its first group has at the
    end of the stretches before it, which follows from one row for each partition. No task sees more than its
    partition, however many rows a group has. A null value counts 0; rows without a group are a group.
    """
    whole = dict(df.dtypes)[value] in ("tinyint", "smallint", "int", "bigint")
    kind = LongType() if whole else DoubleType()
    by = F.lit(0) if group is None else F.col(group)
    added = df.select("*", F.coalesce(F.col(value), F.lit(0)).cast(kind).alias("_value"), by.alias("_group"))
    placed = added.orderBy(F.col("_group").asc(), *order).withColumn("_part", F.spark_partition_id())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried, rows, leading = None, 0, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column("_group")
            codes = groups.dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.flatnonzero(codes[1:] != codes[:-1]) + 1
            if last is not None and last != (groups[0].as_py(),):
                starts = np.append(0, starts)
            found = _restarting_sums(batch.column("_value").to_numpy(), starts, carried)
            last, carried = (groups[len(groups) - 1].as_py(),), found[-1]
            at = rows + np.arange(len(found))
            first = np.full(len(found), leading)
            if len(starts):
                first[starts[0] :] = leading = False
            rows += len(found)
            more = [pa.array(found), pa.array(at), pa.array(first)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_sum", "_at", "_first"])

    new = [StructField("_sum", kind), StructField("_at", LongType()), StructField("_first", BooleanType())]
    summed = pin(placed.mapInArrow(sums, StructType([*placed.schema.fields, *new])))
    ends = summed.groupBy("_part").agg(
        F.min_by("_group", "_at").alias("lead"), F.max_by("_group", "_at").alias("trail"), F.max_by("_sum", "_at").alias("own")
    )
    # A group's stretches follow each other: before a leading group come those that the group is the last of.
    asks = F.struct(F.col("lead").alias("g"), F.lit(0).alias("kind"), F.lit(0).cast(kind).alias("own"))
    gives = F.struct(F.col("trail").alias("g"), F.lit(1).alias("kind"), "own")
    edges = ends.select(F.col("_part").alias("_of"), F.explode(F.array(asks, gives)).alias("x")).select("_of", "x.*")
    before = W.partitionBy("g").orderBy("_of", "kind").rowsBetween(W.unboundedPreceding, -1)
    offsets = edges.withColumn("_before", F.sum("own").over(before)).where("kind = 0 AND _before IS NOT NULL")
    # One row per shuffle partition: bounded by the partition count, not by the data.
    found = summed.join(F.broadcast(offsets.select("_of", "_before")), F.col("_part") == F.col("_of"), "left")
    carried = F.when(F.col("_first"), F.coalesce("_before", F.lit(0))).otherwise(F.lit(0)).cast(kind)
    return found.withColumn(total, F.col("_sum") + carried).select(*df.columns, total)


def running_total(
    df: DataFrame, group: str, order: list[Column], value: str, total: str, large: DataFrame | None
) -> DataFrame:
    """``prefix_sums`` for the groups in ``large`` (see ``large_groups``), a window for the others."""
    window = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    in_window = F.sum(F.coalesce(F.col(value), F.lit(0))).over(window)
    if large is None:
        return df.withColumn(total, in_window)
    same = F.col(group).eqNullSafe(F.col("_named"))
    cool = df.join(large, same, "left_anti").withColumn(total, in_window)
    hot = prefix_sums(df.join(large, same, "left_semi"), order, value, total, group)
    return cool.unionByName(hot)


def time_stats(time: Column) -> list[Column]:
    """Aggregates of one scan that ``nth_smallest`` needs: rows, extremes and a mergeable quantile sketch of the times."""
    micros = epoch_micros(time)
    return [
        F.count(micros).alias("timed"),
        F.min(micros).alias("low"),
        F.max(micros).alias("high"),
        F.kll_sketch_agg_bigint(micros, F.lit(SKETCH_SIZE)).alias("sketch"),
    ]


def rows_between(df: DataFrame, time: str, low: int, high: int) -> DataFrame:
    """The rows whose time is from ``low`` to ``high`` microseconds.

    The scan gets a filter on the raw column, to skip what is far off. It is wider by more than any shift of
    a clock, since a time without zone is read in the session's.
    """
    kind = dict(df.dtypes)[time]
    first, last = (F.timestamp_micros(F.lit(x)).cast(kind) for x in (low - CLOCK_MICROS, high + CLOCK_MICROS))
    return df.where(F.col(time).between(first, last) & epoch_micros(F.col(time)).between(low, high))


def nth_smallest(
    df: DataFrame, time: str, item: str, target: int, tail_rows: int = SEARCH_TAIL_ROWS, stats: Row | None = None
) -> tuple[object, int]:
    """(time, id) of the ``target``-th row in ascending (time, id) order, in three scans whatever the data.

    The first makes a quantile sketch (``stats`` if the caller has it), which brackets the row's time. The
    second counts the rows before and inside the bracket, the third keeps those inside, and the scan
    skips what lies beyond. They are sorted across tasks, if they are more than ``tail_rows``. A sketch
    errs with a small chance; the counts tell, and then the bracket is the whole range.
    """
    stats = df.agg(*time_stats(F.col(time))).first() if stats is None else stats
    low, high = stats["low"], stats["high"]
    micros = epoch_micros(F.col(time))
    if low < high:
        share = [min(max(target / stats["timed"] + x, 0.0), 1.0) for x in (-SKETCH_ERROR, SKETCH_ERROR)]
        at = F.kll_sketch_get_quantile_bigint(F.lit(bytes(stats["sketch"])), F.array(*map(F.lit, share)))
        low, high = df.sparkSession.range(1).select(at).first()[0]
    early = rows_between(df, time, stats["low"], high)
    before, inside = early.agg(F.count_if(micros < low), F.count_if(micros >= low)).first()
    if not before < target <= before + inside:
        low, high, before, inside = stats["low"], stats["high"], 0, stats["timed"]
    tail = pin(rows_between(df, time, low, high).select(time, item))
    if inside > tail_rows:
        row = global_rank(tail, [F.col(time), F.col(item)], "_nth").where(F.col("_nth") == target - before).first()
        return row[time], row[item]
    last = tail.orderBy(time, item).limit(target - before).orderBy(F.col(time).desc(), F.col(item).desc()).first()
    return last[0], last[1]


def best_unseen(
    users: DataFrame, ranked_items: DataFrame, seen: DataFrame, n: int, head_rows: int = HEAD_ROWS
) -> DataFrame:
    """For each user the first ``n`` items of one common ranking that the user has not seen.

    ``users(user_id)``, ``ranked_items(article_id, position, ...)`` with positions
    1, 2, 3..., ``seen(user_id, article_id)`` without duplicates. All users share the
    ranking, so the answer depends only on the positions a user has seen: if j seen
    positions come before p, then p - 1 - j unseen ones do. Counting seen positions by
    the unseen ones before them gives the place of each of the first n unseen ones,
    and the rows produced are ``n`` per user, not users x items.
    """
    places = seen.join(ranked_items.select("article_id", "position"), "article_id").select("user_id", "position")
    gaps = (
        rank_within(places, "user_id", ["position"], "_nth", "_seen")
        .withColumn("gap", F.col("position") - F.col("_nth"))
        .where(F.col("gap") < n)
        .groupBy("user_id", "gap")
        .agg(F.count("*").alias("blocked"))
        .groupBy("user_id")
        .agg(F.collect_list(F.struct("gap", "blocked")).alias("blocked"))
    )
    # At most n (gap, count) pairs per user.
    skipped = F.aggregate(
        F.filter(F.coalesce("blocked", F.expr("array()")), lambda b: b["gap"] < F.col("turn")),
        F.lit(0).cast("long"),
        lambda total, b: total + b["blocked"],
    )
    turns = (
        users.join(gaps, "user_id", "left")
        .withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .select("user_id", F.col("turn").alias("rank"), (F.col("turn") + skipped).alias("position"))
    )
    # Nearly all places wanted are at the head of the ranking, where every user asks for the
    # same few: that head has a fixed size and is broadcast, so no hot place is shuffled.
    head = ranked_items.where(F.col("position") <= head_rows)
    if ranked_items.where(F.col("position") > head_rows).isEmpty():
        return turns.join(F.broadcast(head), "position").drop("position")
    # Two joins read the turns, which are n rows per user: they are made once.
    turns = pin(turns)
    near = turns.where(F.col("position") <= head_rows).join(F.broadcast(head), "position")
    far = turns.where(F.col("position") > head_rows).join(ranked_items, "position")
    return near.unionByName(far).drop("position")


def contenders(rows: np.ndarray, vals: np.ndarray, k: int) -> np.ndarray:
    """Entries that can be among the ``k`` best of their row; ``rows`` is ascending.

    A row's entries are cut into k runs: the least of the runs' maxima is reached by at
    least k entries, so what lies below it is out.
    """
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[starts, len(rows)])
    bound = np.full(len(starts), -np.inf)
    long = sizes >= 2 * k
    if long.any():
        cuts = starts[:, None] + np.arange(k)[None, :] * sizes[:, None] // k
        maxima = np.maximum.reduceat(vals, cuts.ravel()).reshape(-1, k)
        # Values equal after rounding must stay together.
        bound[long] = maxima[long].min(axis=1) - 2 * 10.0**-RANK_DIGITS
    return ~(vals < np.repeat(bound, sizes))


def lists_of(df: DataFrame, owner: str, item: str, value: str) -> DataFrame:
    """(owner, held): each owner's items and their values, packed. An owner with many has several lists."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners = batch.column(owner).to_numpy()
            if not len(owners):
                continue
            starts = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
            entries = np.empty(len(owners), ENTRY)
            entries["item"], entries["value"] = batch.column(item).to_numpy(), batch.column(value).to_numpy()
            ends = (np.append(starts, len(owners)) * ENTRY.itemsize).astype(np.int32)
            held = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(entries.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(owners[starts]), held], [owner, "held"])

    rows = df.select(*[F.col(c).cast(kind).alias(c) for c, kind in ((owner, "long"), (item, "long"), (value, "double"))]).dropna()
    return rows.repartition(owner).sortWithinPartitions(owner).mapInArrow(pack, f"{owner} long, held binary")


def list_entries(held: str = "held") -> Column:
    """The number of entries of a packed list."""
    return (F.octet_length(held) / ENTRY.itemsize).cast("long")


def _numbers(ids: np.ndarray) -> tuple[np.ndarray, Callable]:
    """Numbers below 2 ** 31 in the order of the ids, and the way back."""
    low, high = (int(ids.min()), int(ids.max())) if len(ids) else (0, 0)
    if high - low < 2**30:
        return ids - low, lambda n: n + low
    listed, at = np.unique(ids, return_inverse=True)
    return at, lambda n: listed[n]


def _best_of_offers(n: int) -> Callable:
    """The task of some users' offers and read articles: those articles of a user that can be among its ``n`` best.

    A row is a user with a read article, a packed list of offers, or both. What waits is summed up now and then, so a task holds
    the different pairs of its users, not their offers.
    """

    def summed(waiting: list[tuple]) -> tuple:
        user, no_user, article, value, read = (np.concatenate(x) for x in zip(*waiting))
        (u, users), (a, articles) = _numbers(user), _numbers(article)
        u = np.where(no_user, 0, u + 1)
        n_articles = int(a.max(initial=0)) + 1
        pair = u * n_articles + a
        order = np.argsort(pair)
        pair = pair[order]
        same = pair[1:] == pair[:-1]
        if same.any():
            # The order of arrival decides no sum.
            tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
            order[tied] = order[tied][np.lexsort((value[order[tied]], pair[tied]))]
        starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else order
        if len(pair):
            value, read = np.add.reduceat(value[order], starts), np.logical_or.reduceat(read[order], starts)
        pair = pair[starts]
        u, a = np.divmod(pair, n_articles)
        return users(np.maximum(u - 1, 0)), u == 0, articles(a), value, read

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows, most = [], 0, WAITING_OFFERS
        for batch in batches:
            user, no_user = batch.column("user_id").fill_null(0).to_numpy(), batch.column("user_id").is_null().to_numpy(zero_copy_only=False)
            seen = batch.column("read").is_valid().to_numpy(zero_copy_only=False)
            articles = batch.column("read").fill_null(0).to_numpy()[seen]
            waiting.append((user[seen], no_user[seen], articles, np.zeros(len(articles)), np.ones(len(articles), bool)))
            held = batch.column("held")
            ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
            if ends[-1] > ends[0]:
                offers = np.frombuffer(held.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(ENTRY)
                sizes = np.diff(ends) // ENTRY.itemsize
                whose = np.repeat(user, sizes), np.repeat(no_user, sizes)
                waiting.append((*whose, offers["item"].copy(), offers["value"].copy(), np.zeros(len(offers), bool)))
            rows += len(articles) + int(ends[-1] - ends[0]) // ENTRY.itemsize
            if rows >= most:
                waiting = [summed(waiting)]
                rows = len(waiting[0][0])
                most = max(WAITING_OFFERS, 2 * rows)
        if not rows:
            return
        user, no_user, article, value, read = summed(waiting)
        del waiting
        user, no_user, article, value = (x[~read] for x in (user, no_user, article, value))
        number = np.cumsum(np.append(False, (user[1:] != user[:-1]) | (no_user[1:] != no_user[:-1]))) if len(user) else user
        keep = contenders(number, value, n)
        number, user, no_user, article, value = (x[keep] for x in (number, user, no_user, article, value))
        # Of equal values, the n smallest ids.
        order = np.lexsort((article, value, number))
        place = np.arange(len(order))
        new = np.append(True, (np.diff(number[order]) != 0) | (np.diff(value[order]) != 0)) if len(order) else place
        keep = order[place - np.maximum.accumulate(np.where(new, place, 0)) < n] if len(order) else order
        columns = [pa.array(user[keep], mask=no_user[keep]), pa.array(article[keep]), pa.array(value[keep])]
        yield from pa.table(dict(zip(("user_id", "article_id", "score"), columns))).to_batches(100_000)

    return best


def best_unread(
    users: DataFrame, offers_of: Callable[[DataFrame], DataFrame], read: DataFrame | None, n: int, offers: int, rows: int
) -> DataFrame:
    """The ``n`` best articles of each user by the sum of what the user's offers are worth, without pairs in ``read``.

    ``users`` are the rows with a user_id that ``offers_of`` makes into packed lists of offers, ``held``, beside which
    ``read`` may name an article that the user has read. Lists go to the task of their user, which sums them up; no offer is a row of its
    own. They are several times the interactions, so users are dealt to passes, each with at most about as many ``offers``
    as twice the interactions' ``rows``: what a pass shuffles is gone before the next begins.
    """
    passes = max(1, -(-offers // max(PASS_OFFERS, 2 * rows)))
    cores = users.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-(offers // passes) // TASK_OFFERS), min(cores, offers // 100_000))
    # Whole rounds of the cores.
    tasks = tasks if tasks < cores else -(-tasks // cores) * cores
    found = None
    for nth in range(passes):
        mine = lambda df: df if passes == 1 else df.where(F.pmod(F.xxhash64("user_id"), F.lit(passes)) == nth)  # noqa: B023, E731
        lists = offers_of(mine(users)).select("user_id", "read", "held")
        if read is not None:
            lists = lists.unionByName(mine(read).select("user_id", F.col("article_id").alias("read"), F.lit(None).cast("binary").alias("held")))
        some = lists.repartition(tasks, "user_id").mapInArrow(_best_of_offers(n), "user_id long, article_id long, score double")
        best = top_n(some, "user_id", "score", "article_id", n)
        if passes == 1:
            return best
        best = store(best)
        found = best if found is None else found.unionByName(best)
    return found
