"""Exact Jaccard join of shingle sets as a metric-space join.

The distance 1 - |x & y| / |x | y| is a metric. Texts link at a distance of at most 0.2.

1. Equal sets (distance 0) are one point, named by a fingerprint.
2. Almost all points lie about as far as can be from all others. Nearest to such a
   point are the one-element sets of its own shingles, so those are the outer pivots. A
   point's window holds the pivots that a linked point can't all be missing: of any
   order of its n shingles, the first n - ceil(0.8 n) + 1. A first pass (``survivors``)
   takes the window a little wider in the order of the hashes, where a linked point must
   share several pivots, and drops the points that don't. A second pass (``regions``)
   orders the rest's shingles by the number of points that have them, so that a point
   is replicated to its emptiest regions only.
3. The region's best-connected point becomes its pivot: distances from the pivot to the
   region are computed, once for each (point, pivot). Points within 0.2 are linked.
4. All points met by one pivot are its cell; each possible link lies in a cell. Where
   the cell isn't one component yet, the points outside its main component are compared
   with those of the cell whose distance from the pivot differs by at most 0.2, in
   blocks of bounded size (``leftovers``). That is enough for components.
5. For the number of links of each document all points of a cell are compared with those
   in their window, block by block (``link_counts``). A pair that lies in several cells is
   counted in the first of them.

What differs from the plain method: step 2 is prefix filtering. Around document pivots the outer regions
would be the whole corpus, since the triangle inequality parts nothing where all distances are near 1, so no
point is assigned to its nearest pivot there and regions are not split again. Documents are pivots, and
windows on distances hold, inside the regions.

Nothing is capped or sampled, and no pair is made a row unless one side is a pivot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from newsloom.llm.components import connected_components
from newsloom.llm.shingles import mixed, shingle_sets
from newsloom.llm.texts import spread
from newsloom.llm.workers import slices
from newsloom.session import pin

# Similarity that links, in percent.
PERCENT = 80
# The first window is wider than it must be by this share of the set; a linked point shares as much.
EXTRA = 10
SLICE_BYTES = 4 << 20
# Shingles that one task sorts at once, and that one block of a cell holds.
BUCKET_KEYS = 1_000_000
BLOCK_SHINGLES = 100_000
# Points that meet one copy of their pivot's set, and parts that a component's rows are named in.
PIVOT_ROWS = 512
COMPONENT_PARTS = 32
# Ids that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
# Numbers in one matrix of a block's sets.
MATRIX_CELLS = 1 << 21
# A shingle of so many points in one slice is ordered behind all others, without counting.
HOT_IN_SLICE = 32
HOT = 2**31 - 1
RADIUS = 1 - PERCENT / 100


def _kept_least(n: np.ndarray) -> np.ndarray:
    """Shingles that a point of n shares at least with any point linked to it."""
    return -(-n * PERCENT // 100)


def _extra(n: np.ndarray) -> np.ndarray:
    return 1 + n * EXTRA // 100


def fingerprints(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for an empty one."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        sums = np.add.reduceat(mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), offsets[:-1][full])
        out[full] = mixed(sums + n[full].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def _chosen(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def point_names(docs: DataFrame) -> DataFrame:
    """(doc_id, n, point) of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            hashes, offsets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(fingerprints(hashes, offsets))],
                ["doc_id", "n", "point"],
            )

    return docs.mapInArrow(rows, "doc_id long, n long, point long")


# Rows that carry keys of many points to the task of their bucket, packed. ``low`` are the lower halves of
# the keys, ``points`` whose they are, the first ``n_counted`` to be counted and the others only
# as witnesses. ``own_*`` travel along: what the sending task knows of its points already. They ride on one of
# the slice's rows, drawn by its points, so that no bucket gets those of all slices.
PACKED = "bucket int, n_counted int, low binary, points binary, own_points binary, own_n binary, own_counts binary, own_keys binary"


def _packed(bucket, n_counted, low, points, own) -> pa.RecordBatch:
    carrier = int(mixed(own[0][:1].astype(np.uint64))[0] % np.uint64(len(bucket))) if len(own[0]) else 0
    columns = [pa.array(bucket, pa.int32()), pa.array(n_counted, pa.int32())]
    columns += [pa.array(x, pa.binary()) for x in (low, points)]
    columns += [pa.array([x.tobytes() if i == carrier else b"" for i in range(len(bucket))], pa.binary()) for x in own]
    names = [x.split()[0] for x in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays(columns, names)


def _by_bucket(keys: np.ndarray, points: np.ndarray, counted: np.ndarray, buckets: int, own: list) -> pa.RecordBatch:
    """One packed row for each bucket that gets something, and one at least."""
    bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((~counted, bucket))
    bucket, keys, points, counted = bucket[order], keys[order], points[order], counted[order]
    names = np.unique(bucket) if len(bucket) else np.zeros(1, np.int64)
    cuts = np.append(np.searchsorted(bucket, names), len(bucket))
    low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    return _packed(
        names,
        [int(counted[a:b].sum()) for a, b in spans],
        [low[a:b].tobytes() for a, b in spans],
        [points[a:b].astype("<i8").tobytes() for a, b in spans],
        own,
    )


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list]]:
    """(bucket, low keys, points, counted, own rows) of each bucket of a sorted partition."""

    def joined(bucket: int, rows: list[dict]) -> tuple:
        low = np.concatenate([np.frombuffer(r["low"], "<u4") for r in rows])
        points = np.concatenate([np.frombuffer(r["points"], "<i8") for r in rows])
        counted = np.concatenate([np.arange(len(r["low"]) // 4) < r["n_counted"] for r in rows])
        return bucket, low, points, counted, [r for r in rows if r["own_points"]]

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield joined(held[0]["bucket"], held)
                held = []
            held.append(row)
    if held:
        yield joined(held[0]["bucket"], held)


def _runs(low: np.ndarray, points: np.ndarray, counted: np.ndarray) -> tuple:
    """Distinct (key, point) rows in order, with the number of points of each row's key."""
    order = np.lexsort((~counted, points, low))
    low, points, counted = low[order], points[order], counted[order]
    new = np.append(True, (low[1:] != low[:-1]) | (points[1:] != points[:-1])) if len(low) else np.zeros(0, bool)
    low, points, counted = low[new], points[new], counted[new]
    firsts = np.flatnonzero(np.append(True, low[1:] != low[:-1])) if len(low) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(firsts, len(low)))
    return low, points, counted, np.repeat(sizes, sizes)


def survivors(docs: DataFrame, buckets: int) -> DataFrame:
    """(point, n) of the points that share enough of their first window with others."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            hashes, offsets = shingle_sets(batch.column("text"))
            n = np.diff(offsets)
            names, first = np.unique(fingerprints(hashes, offsets), return_index=True)
            full = n[first] > 0
            names, first = names[full], first[full]
            if not len(first):
                continue
            n = n[first]
            window = np.minimum(n, n - _kept_least(n) + _extra(n))
            keys = hashes[spread(offsets[first], window)]
            owner = np.repeat(np.arange(len(first)), window)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sizes = np.diff(np.append(start, len(keys)))
            size = np.repeat(sizes, sizes)
            # What is shared inside the slice is known here; two witnesses tell the other slices.
            known = np.bincount(owner[size > 1], minlength=len(first))
            place = np.arange(len(keys)) - np.repeat(start, sizes)
            sent = place < 2
            own = [names.astype("<i8"), n.astype("<i8"), known.astype("<i8"), np.zeros(0, "<u8")]
            yield _by_bucket(keys[sent], names[owner[sent]], size[sent] == 1, buckets, own)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, low, points, counted, own in _buckets(batches):
            _, points, counted, sizes = _runs(low, points, counted)
            shared, found = np.unique(points[counted & (sizes > 1)], return_counts=True)
            parts = [np.frombuffer(r[c], "<i8") for c in ("own_points", "own_n", "own_counts") for r in own]
            third = len(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([shared, *parts[:third]])),
                    pa.array(np.concatenate([np.zeros(len(shared), np.int64), *parts[third : 2 * third]])),
                    pa.array(np.concatenate([found.astype(np.int64), *parts[2 * third :]])),
                ],
                ["point", "n", "shared"],
            )

    packed = docs.mapInArrow(send, PACKED).repartition("bucket").sortWithinPartitions("bucket")
    counted = packed.mapInArrow(count, "point long, n long, shared long").groupBy("point")
    counted = counted.agg(F.max("n").alias("n"), F.sum("shared").alias("shared"))
    # Linked points share as many as the smaller one's window is too wide, and it may be smaller by a fifth.
    least = F.expr(f"1 + ((n * {PERCENT} + 99) DIV 100) * {EXTRA} DIV 100")
    return counted.where(F.col("shared") >= least).select("point", "n")


def full_sets(docs: DataFrame) -> DataFrame:
    """(point, n, shingles) of rows, the shingles as packed ascending hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            hashes, offsets = shingle_sets(batch.column("text"))
            ends = offsets.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(fingerprints(hashes, offsets)),
                    pa.array(np.diff(offsets)),
                    pa.array([hashes[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
                ],
                ["point", "n", "shingles"],
            )

    return docs.mapInArrow(rows, "point long, n long, shingles binary")


def regions(sets: DataFrame, buckets: int) -> DataFrame:
    """(key, point, shared_share): the emptiest regions each point must be in."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "shingles", 2 * SLICE_BYTES):
            names, first = np.unique(batch.column("point").to_numpy(), return_index=True)
            each = [np.frombuffer(x, np.uint64) for x in batch.column("shingles").take(pa.array(first)).to_pylist()]
            n = np.array([len(x) for x in each], np.int64)
            keys, owner = np.concatenate(each), np.repeat(np.arange(len(each)), n)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(start, len(keys)))
            hot = np.repeat(sizes, sizes) >= HOT_IN_SLICE
            witness = hot & np.append(True, keys[1:] != keys[:-1])[: len(keys)]
            # A point's hot keys go along with it: their places in the order don't depend on a count.
            by_owner = np.argsort(owner[hot], kind="stable")
            bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
            whole = (bucket << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
            n_hot = np.bincount(owner[hot], minlength=len(each))
            own = [names.astype("<i8"), n.astype("<i8"), n_hot.astype("<i8"), whole[hot][by_owner].astype("<u8")]
            sent = ~hot | witness
            yield _by_bucket(keys[sent], names[owner[sent]], ~hot[sent], buckets, own)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, low, points, counted, own in _buckets(batches):
            hot_low = np.unique(low[~counted])
            low, points, _, sizes = _runs(low[counted], points[counted], np.ones(int(counted.sum()), bool))
            sizes = np.where(np.isin(low, hot_low), HOT, sizes)
            on = sizes > 1
            low, points, sizes = low[on], points[on], sizes[on]
            order = np.argsort(points, kind="stable")
            whole = ((np.int64(bucket) << 32) | low.astype(np.int64))[order]
            sizes = sizes[order].astype(np.int32)
            names, counts = np.unique(points, return_counts=True)
            parts = [(names, np.zeros(len(names), np.int64), counts, whole, sizes)]
            for r in own:
                hot = np.frombuffer(r["own_keys"], "<i8")
                row = [np.frombuffer(r[c], "<i8") for c in ("own_points", "own_n", "own_counts")]
                parts.append((*row, hot, np.full(len(hot), HOT, np.int32)))
            for names, n, counts, keys, points_of in parts:
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names),
                        pa.array(n),
                        pa.ListArray.from_arrays(offsets, pa.array(keys)),
                        pa.ListArray.from_arrays(offsets, pa.array(points_of)),
                    ],
                    ["point", "n", "keys", "sizes"],
                )

    def emptiest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c) for c in ("point", "n", "keys", "sizes"))):
                point, n, keys, sizes = row[0].as_py(), row[1].as_py(), row[2].values, row[3].values
                keys, sizes = keys.to_numpy(), sizes.to_numpy()
                least = int(_kept_least(np.int64(n)))
                if n and len(keys) >= least:
                    chosen = keys[np.lexsort((keys, sizes))][: len(keys) - least + 1]
                    out.append((chosen, point, len(keys) / n))
            if out:
                counts = [len(x) for x, _, _ in out]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([x for x, _, _ in out])),
                        pa.array(np.repeat([x for _, x, _ in out], counts)),
                        pa.array(np.repeat([x for _, _, x in out], counts)),
                    ],
                    ["key", "point", "shared_share"],
                )

    packed = sets.mapInArrow(send, PACKED).repartition("bucket").sortWithinPartitions("bucket")
    counted = packed.mapInArrow(count, "point long, n long, keys array<long>, sizes array<int>")
    gathered = counted.groupBy("point").agg(
        F.max("n").alias("n"),
        F.flatten(F.collect_list("keys")).alias("keys"),
        F.flatten(F.collect_list("sizes")).alias("sizes"),
    )
    return gathered.mapInArrow(emptiest, "key long, point long, shared_share double")


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(point, pivot, distance, linked) of each (point, pivot)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "shingles", 4 * SLICE_BYTES):
            common, either = [], []
            for a, b in zip(batch.column("shingles").to_pylist(), batch.column("pivot_shingles").to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common.append(int((y[at] == x).sum()))
                either.append(len(x) + len(y) - common[-1])
            shared, whole = np.array(common, np.int64), np.array(either, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("point"),
                    batch.column("pivot"),
                    pa.array(1 - shared / whole),
                    pa.array(100 * shared >= PERCENT * whole),
                ],
                ["point", "pivot", "distance", "linked"],
            )

    # A pivot's points meet it in parts of some PIVOT_ROWS, so that no task has all of a large region.
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(PIVOT_ROWS)).cast("int").alias("parts"))
    pivot_sets = sets.select(F.col("point").alias("pivot"), F.col("shingles").alias("pivot_shingles")).join(parts, "pivot")
    pivot_sets = pivot_sets.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = pairs.join(parts, "pivot").select(
        "point", "pivot", F.pmod(F.xxhash64("point"), F.col("parts")).cast("int").alias("part")
    )
    both = dealt.join(sets.select("point", "shingles"), "point").join(pivot_sets, ["pivot", "part"])
    return both.mapInArrow(rows, "point long, pivot long, distance double, linked boolean")


def leftovers(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): components that a link inside a cell joins.

    ``cells`` (pivot, point, distance, component). The points outside a cell's main
    component are compared with the points of the cell in their window, block by block.
    """
    sizes = cells.groupBy("pivot", "component").agg(F.count("*").alias("rows"))
    mains = sizes.groupBy("pivot").agg(
        F.max_by("component", F.struct("rows", "component")).alias("main"), F.count("*").alias("components")
    )
    open_cells = mains.where(F.col("components") > 1)
    members = cells.join(open_cells, "pivot").join(sets.select("point", "n", "shingles"), "point")
    members = members.withColumns(
        {"bin": F.floor(F.col("distance") * 10).cast("int"), "open": F.col("component") != F.col("main")}
    )
    pieces = lambda n: F.ceil(F.sum(n) / F.lit(BLOCK_SHINGLES)).cast("int")
    bins = members.groupBy("pivot", "bin").agg(pieces("n").alias("slices"))
    queries = members.where("open").groupBy("pivot").agg(pieces("n").alias("query_slices"))
    here = ["pivot", "bin", "slice", "query_slice"]
    shown = [*here, "query", "component", "distance", "shingles"]
    slice_of = F.pmod(F.xxhash64("point"), F.col("slices")).cast("int")
    query_slice_of = F.pmod(F.xxhash64("point"), F.col("query_slices")).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = (
        members.join(bins, ["pivot", "bin"])
        .join(queries, "pivot")
        .withColumns({"slice": slice_of, "query": F.lit(False)})
        .withColumn("query_slice", numbers("query_slices"))
        .select(shown)
    )
    near = (F.col("other_bin") >= F.floor((F.col("distance") - RADIUS) * 10 - 1e-6)) & (
        F.col("other_bin") <= F.floor((F.col("distance") + RADIUS) * 10 + 1e-6)
    )
    asked = (
        members.where("open")
        .drop("bin")
        .join(bins.withColumnRenamed("bin", "other_bin"), "pivot")
        .where(near)
        .withColumnRenamed("other_bin", "bin")
        .join(queries, "pivot")
        .withColumns({"query_slice": query_slice_of, "query": F.lit(True)})
        .withColumn("slice", numbers("slices"))
        .select(shown)
    )

    def compare(group: pa.Table) -> pa.Table:
        asks = np.array(group.column("query").to_pylist(), bool)
        component = group.column("component").to_numpy()
        each = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        n = np.array([len(x) for x in each], np.int64)
        rows, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
        found = np.zeros((0, 2), np.int64)
        if len(rows) and len(asking):
            keys, owner = np.concatenate([each[i] for i in rows]), np.repeat(rows, n[rows])
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            parts = []
            for i in asking.tolist():
                low, high = np.searchsorted(keys, each[i], "left"), np.searchsorted(keys, each[i], "right")
                common = np.bincount(owner[spread(low, high - low)], minlength=len(each))
                links = (100 * common >= PERCENT * (n + n[i] - common)) & ~asks & (component != component[i])
                for c in np.unique(component[links]).tolist():
                    parts.append((component[i], c))
            if parts:
                found = np.unique(np.array(parts, np.int64).reshape(-1, 2), axis=0)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    return held.unionByName(asked).groupBy(*here).applyInArrow(compare, "a long, b long").distinct()


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, common elements of each left set from there on with each right set), a band of left sets at a time."""
    names = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def matrix(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), len(columns)), np.float32)
        row, keys = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(columns, keys), len(columns) - 1)
        on = columns[at] == keys
        out[row[on], at[on]] = 1
        return out

    rows = max(1, min(len(left), MATRIX_CELLS // (2 * max(1, len(right)))))
    width = max(1, MATRIX_CELLS // max(rows, len(right)))
    for at in range(0, len(left), rows):
        band = left[at : at + rows]
        # Sums of ones stay exact in 32 bits up to 2**24 of them; a strip holds fewer.
        common = np.zeros((len(band), len(right)), np.int64)
        for start in range(0, len(names), width):
            strip = names[start : start + width]
            common += (matrix(band, strip) @ matrix(right, strip).T).astype(np.int64)
        yield at, common


def link_counts(cells: DataFrame, sets: DataFrame, copies: DataFrame) -> DataFrame:
    """(point, links): the rows of other points that each point links to.

    ``cells`` (pivot, point, distance), ``copies`` (point, copies). All points of a cell are
    compared with those whose distance from the pivot differs by at most 0.2, in pairs of
    blocks. A pair counts in the cell with the smallest pivot that both points have met.
    """
    met = cells.select("pivot", "point", "distance")
    # Both points of a pair carry the pivots they have met, to tell whether another cell has the pair first.
    homes = met.groupBy("point").agg(F.collect_list("pivot").alias("pivots"))
    # The windows are as wide as two bins; a third takes up what rounding does at their edges.
    members = met.withColumn("bin", F.floor(F.col("distance") * 10).cast("int"))
    members = members.join(sets.select("point", "n", "shingles"), "point")
    bins = members.groupBy("pivot", "bin").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias("slices"))
    slice_of = F.pmod(F.xxhash64("point"), F.col("slices")).cast("int")
    members = members.join(bins, ["pivot", "bin"]).withColumn("slice", slice_of)
    others = bins.select("pivot", F.col("bin").alias("other_bin"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    mine, its = F.struct(F.col("bin"), F.col("slice")), F.struct(F.col("other_bin").alias("bin"), F.col("other").alias("slice"))
    sent = members.join(others, "pivot").where(F.abs(F.col("bin") - F.col("other_bin")) <= 3)
    sent = sent.select("pivot", F.least(mine, its).alias("low"), F.greatest(mine, its).alias("high"), "point", (mine <= its).alias("is_low"))
    sent = sent.join(sets.select("point", "n", "shingles"), "point").join(copies, "point").join(homes, "point")

    def compare(group: pa.Table) -> pa.Table:
        low = np.array(group.column("is_low").to_pylist(), bool)
        points, copies = (group.column(c).to_numpy() for c in ("point", "copies"))
        pivot = group.column("pivot")[0].as_py()
        each = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        n = np.array([len(x) for x in each], np.int64)
        earlier = [np.array(sorted(y for y in x if y < pivot), np.int64) for x in group.column("pivots").to_pylist()]
        same = group.column("low")[0] == group.column("high")[0]
        a = np.flatnonzero(low)
        b = a if same else np.flatnonzero(~low)
        links = np.zeros(len(points), np.int64)
        if len(a) and len(b):
            pick = lambda of, at: [of[i] for i in at]
            right, right_earlier = pick(each, b), pick(earlier, b)
            for at, common in _common(pick(each, a), right):
                rows = a[at : at + len(common)]
                linked = 100 * common >= PERCENT * (n[rows][:, None] + n[b] - common)
                linked &= points[rows][:, None] != points[b]
                if linked.any():
                    for start, shared in _common(pick(earlier, rows), right_earlier):
                        linked[start : start + len(shared)] &= shared == 0
                links[rows] += linked @ copies[b]
                if not same:
                    links[b] += copies[rows] @ linked
        return pa.table({"point": pa.array(points), "links": pa.array(links)})

    counted = sent.groupBy("pivot", "low", "high").applyInArrow(compare, "point long, links long")
    return counted.groupBy("point").agg(F.sum("links").alias("links"))


@dataclass(frozen=True)
class Joined:
    """``names`` (doc_id, n, point) of each row; ``sets`` and ``cells`` of the points that may link, one row for each
    set; ``components`` (point, component, component_id) of all points; ``many`` (doc_id), the ids of several rows, or
    None if there are none."""

    names: DataFrame
    sets: DataFrame
    cells: DataFrame
    components: DataFrame
    many: DataFrame | None


def _one_set_each(chosen: DataFrame, left: DataFrame, points: DataFrame, many: DataFrame | None) -> DataFrame:
    """The sets of the points of ``left`` (point, n), one row for each."""
    if many is None:
        # An id is one row's, so the ids of one row of each point give that point and no other.
        ids = left.join(points.groupBy("point").agg(F.min("doc_id").alias("doc_id")), "point").select("doc_id")
        return full_sets(chosen.join(ids, "doc_id", "left_semi"))
    # A row whose id is its own is taken if the point has one; else those of one id are told apart by their points.
    shared = points.join(many.withColumn("shared", F.lit(True)), "doc_id", "left")
    shared = shared.select("point", F.struct(F.coalesce("shared", F.lit(False)).alias("shared"), "doc_id").alias("row"))
    picked = pin(left.join(shared.groupBy("point").agg(F.min("row").alias("row")), "point").select("point", "row.*"))
    alone = full_sets(chosen.join(picked.where(~F.col("shared")).select("doc_id"), "doc_id", "left_semi"))
    held = picked.where("shared")
    others = full_sets(chosen.join(held.select("doc_id").distinct(), "doc_id", "left_semi"))
    return alone.unionByName(others.join(held.select("point"), "point", "left_semi").dropDuplicates(["point"]))


def _join(docs: DataFrame, doc_id: str, text: str) -> Joined:
    chosen = _chosen(docs, doc_id, text)
    names = pin(point_names(chosen))
    points = names.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    window = F.expr(f"n - ((n * {PERCENT} + 99) DIV 100) + 1 + n * {EXTRA} DIV 100")
    keys = names.agg(F.sum(window)).first()[0] or 0
    buckets = 1 + int(keys) // BUCKET_KEYS
    many = names.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("rows"))
    many = pin(many.where(F.col("rows") > 1).select("doc_id"))
    many = None if many.isEmpty() else many

    left = pin(survivors(chosen.where(F.col("doc_id").isNotNull()), buckets))
    size = left.agg(F.sum("n")).first()[0] or 0
    # The survivors' texts are read once more; the other side of the join is ids.
    sets = pin(_one_set_each(chosen, left.select("point"), points, many))
    homes = pin(regions(sets, 1 + int(size) // BUCKET_KEYS))

    best = homes.groupBy("key").agg(
        F.min(F.struct(-F.col("shared_share"), F.xxhash64("point"), "point")).alias("best"), F.count("*").alias("rows")
    )
    pivots = best.where(F.col("rows") > 1).select("key", F.col("best.point").alias("pivot"))
    pairs = homes.join(pivots, "key").where(F.col("point") != F.col("pivot")).select("point", "pivot").distinct()
    met = pin(distances(pin(pairs), sets))

    first = pin(connected_components(met.where("linked").select(F.col("point").alias("a"), F.col("pivot").alias("b"))))
    centres = met.select("pivot").distinct().select("pivot", F.col("pivot").alias("point"), F.lit(0.0).alias("distance"))
    cells = met.select("pivot", "point", "distance").unionByName(centres)
    cells = cells.join(first.withColumnRenamed("node", "point"), "point", "left")
    cells = pin(cells.withColumn("component", F.coalesce("component", "point")))
    more = pin(connected_components(leftovers(cells, sets)))

    # Components of points, then of the components of the first round.
    again = more.select(F.col("node").alias("component"), F.col("component").alias("last"))
    once = first.join(again, "component", "left").select(
        F.col("node").alias("point"), F.coalesce("last", "component").alias("component")
    )
    alone = more.join(first, "node", "left_anti").select(F.col("node").alias("point"), "component")
    labels = pin(once.unionByName(alone))

    # Only points with a label share a component; its smallest id comes back to them in parts.
    least = points.groupBy("point").agg(F.min("doc_id").alias("least"))
    labelled = pin(labels.join(least, "point"))
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = ids.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(COMPONENT_PARTS - 1))))
    part = F.pmod(F.xxhash64("point"), F.lit(COMPONENT_PARTS)).cast("int")
    named = labelled.withColumn("part", part).join(ids, ["component", "part"]).select("point", "component", "component_id")
    components = least.join(named, "point", "left").select(
        "point", F.coalesce("component", "point").alias("component"), F.coalesce("component_id", "least").alias("component_id")
    )
    return Joined(names, sets, cells, pin(components), many)


def _own_rows(joined: Joined) -> DataFrame:
    """``names`` of the rows that can link, with their component."""
    own = joined.names.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    return own.join(joined.components, "point")


def _of_rows(joined: Joined) -> DataFrame:
    found = joined.names.join(joined.components.select("point", "component_id"), "point", "left")
    own = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    component = F.when(own, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "point")


def near_duplicate_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row.

    ``component_id`` is the smallest doc_id that links reach. Defined results: a text
    without words, or null, has 0 shingles and is its own component; a row with a null
    doc_id gets its number of shingles, links with nothing and has a null component;
    rows that share a doc_id are points of their own texts; other columns are not read.
    """
    return _of_rows(_join(docs, doc_id, text)).drop("point")


def near_duplicate_links(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of each row.

    The first three as in ``near_duplicate_components``; ``n_links`` is the number of other
    rows at a similarity of 0.8 or more, exact copies and rows of the same id among them. A text
    without words and a row with a null doc_id have none and count for none.
    """
    joined = _join(docs, doc_id, text)
    points = joined.names.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    copies = points.groupBy("point").agg(F.count("*").alias("copies"))
    links = link_counts(joined.cells, joined.sets, copies)
    of_point = copies.join(links, "point", "left").select(
        "point", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    own = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    n_links = F.when(own, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return _of_rows(joined).join(of_point, "point", "left").select(
        "doc_id", "n_shingles", "component_id", n_links.alias("n_links")
    )


def _free_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names that a table doesn't have, whatever the case of its own."""
    low = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in low:
            name = "_" + name
        low.add(name.lower())
        out.append(name)
    return out


def _small(ids: DataFrame) -> DataFrame:
    """Pinned ``ids``, to be broadcast if their number allows it."""
    ids = pin(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def keep_one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all columns: of its smallest doc_id.

    It is decided for each row, not for an id: of rows that share the id that names a component,
    one stays, with the smallest point and then the smallest hash of its columns. Rows
    without words or without an id stay. Other columns may have any name.
    """
    joined = _join(docs, doc_id, text)
    own = _own_rows(joined)
    id_name, point_name, n_name, row_name, hash_name = _free_names(docs.columns, "id", "point", "n", "row", "hash")
    id_of = F.col(doc_id).cast("long")

    # An id that is a single row's decides by itself, without a look at its text.
    goes = own.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_name))
    many = joined.many
    if many is None:
        return docs.join(_small(goes), id_of == F.col(id_name), "left_anti")
    many = many.select(F.col("doc_id").alias(id_name))
    left = docs.join(_small(goes.unionByName(many).distinct()), id_of == F.col(id_name), "left_anti")

    # The texts of the others are looked at again.
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE_BYTES):
            hashes, offsets = shingle_sets(batch.column(text))
            columns = [*batch.columns, pa.array(fingerprints(hashes, offsets)), pa.array(np.diff(offsets))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, point_name, n_name])

    schema = StructType([*docs.schema.fields, StructField(point_name, LongType()), StructField(n_name, LongType())])
    again = docs.join(_small(many), id_of == F.col(id_name), "left_semi").mapInArrow(rows, schema)
    named = own.where(F.col("doc_id") == F.col("component_id")).join(joined.many, "doc_id", "left_semi")
    stays = named.groupBy("component", "doc_id").agg(F.min("point").alias("point"))
    # Only a map can't be hashed.
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row_name)
    full = again.where(F.col(n_name) > 0).select(
        id_of.alias("doc_id"), F.col(point_name).alias("point"), whole, F.xxhash64(*[F.col(f"`{c}`") for c in hashed]).alias(hash_name)
    )
    full = full.join(stays.select("doc_id", "point"), ["doc_id", "point"], "left_semi")
    one = full.groupBy("doc_id", "point").agg(F.min_by(row_name, hash_name).alias(row_name)).select(f"{row_name}.*")
    blank = again.where(F.col(n_name) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    return left.unionByName(blank).unionByName(one)
