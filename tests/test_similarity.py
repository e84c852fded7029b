"""Neighbour search against a dense product, under every size bound."""

import numpy as np
import pyarrow as pa
import pytest

from newsloom.operators import similarity
from newsloom.operators.similarity import _cell_neighbours, require_unique_pairs, top_k_cosine


def brute_force(rows, k):
    entities = sorted({e for e, _, w in rows if w})
    keys = sorted({f for _, f, _ in rows})
    m = np.zeros((len(entities), len(keys)))
    for e, f, w in rows:
        if w:
            m[entities.index(e), keys.index(f)] = w
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sims = m @ m.T
    out = {}
    for i, e in enumerate(entities):
        ranked = sorted(
            ((-round(sims[i, j], 9), o) for j, o in enumerate(entities) if j != i and sims[i, j] > 1e-12)
        )[:k]
        out[e] = [(o, round(-s, 6)) for s, o in ranked]
    return {e: near for e, near in out.items() if near}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["entity"], r["rank"])):
        out.setdefault(r["entity"], []).append((r["neighbor"], round(r["sim"], 6)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "entity long, key long, weight double")


@pytest.fixture(scope="module")
def skewed_rows():
    """Key 0 is held by everyone, a third of the entities are copies, one entity holds most keys."""
    rng = np.random.default_rng(7)
    rows = {}
    for e in range(90):
        rows[(e, 0)] = 1.0 if e % 3 == 0 else float(rng.integers(1, 9))
        if e % 3:
            for f in rng.choice(np.arange(1, 40), size=rng.integers(1, 6), replace=False):
                rows[(e, int(f))] = float(rng.integers(1, 9))
    for f in range(1, 40):
        rows[(1, f)] = 2.0
    rows[(500, 3)] = 0.0
    return [(e, f, w) for (e, f), w in rows.items()]


@pytest.mark.parametrize(
    "bounds",
    [
        {},
        {"collapse": False},
        {"chunk_entities": 7},
        {"task_holders": 5},
        {"list_holders": 4},
        {"heavy_keys": 10},
        {"collapse": False, "chunk_entities": 7, "task_holders": 5, "list_holders": 4, "heavy_keys": 10},
    ],
)
def test_equals_dense_product(spark, skewed_rows, bounds):
    got = found(top_k_cosine(frame(spark, skewed_rows), "entity", "key", "weight", 5, **bounds))
    assert got == brute_force(skewed_rows, 5)


@pytest.mark.parametrize("few", [1, 64])
@pytest.mark.parametrize("heavy", [5, 10**6])
def test_lists_go_to_all_blocks_or_to_the_holders(spark, skewed_rows, few, heavy, monkeypatch):
    monkeypatch.setattr(similarity, "FEW_BLOCKS", few)
    bounds = {"collapse": False, "chunk_entities": 12, "heavy_keys": heavy}
    got = found(top_k_cosine(frame(spark, skewed_rows), "entity", "key", "weight", 5, **bounds))
    assert got == brute_force(skewed_rows, 5)


def cell_table(parts):
    """A cell's input from (side, rows, floors) with (entity, key, weight) rows."""
    out = []
    for side, rows, floors in parts:
        for key in sorted({f for _, f, _ in rows}):
            out.append((side, key, [{"e": e, "x": x} for e, f, x in rows if f == key]))
        if floors:
            out.append((side, None, [{"e": e, "x": x} for e, x in floors]))
    side, key, held = zip(*out)
    ends = [int(len(parts) > 1)] * len(out)
    kind = pa.list_(pa.struct([("e", pa.int64()), ("x", pa.float64())]))
    return pa.table({"lo": [0] * len(out), "hi": ends, "side": side, "f": pa.array(key, pa.int64()), "l": pa.array(held, kind)})


def unit(rows):
    norms = {}
    for e, _, w in rows:
        norms[e] = norms.get(e, 0.0) + w * w
    return [(e, f, w / norms[e] ** 0.5) for e, f, w in rows]


def test_pairs_are_multiplied_once_and_only_if_one_side_asks(monkeypatch):
    monkeypatch.setattr(similarity, "DENSE_GAIN", 0)
    rng = np.random.default_rng(3)
    # Two groups with their own keys, and one key that all hold with a small weight.
    rows = []
    for e in range(80):
        group = e // 40
        rows += [(e, 100 * group + int(f), float(rng.integers(3, 9))) for f in rng.choice(20, 8, replace=False)] + [(e, 999, 0.5)]
    rows = unit(rows)
    blocks = [[r for r in rows if r[0] // 40 == g] for g in (0, 1)]
    made, floors = [], []
    for block in blocks:
        tally = []
        out = _cell_neighbours(5, tally)(cell_table([(0, block, [])]))
        degrees = np.unique([f for _, f, _ in block], return_counts=True)[1]
        made.append((sum(tally), int((degrees * (degrees - 1) // 2).sum())))
        best = {}
        for e, s in zip(out["entity"].to_pylist(), out["sim"].to_pylist()):
            best.setdefault(e, []).append(s)
        floors.append([(e, sorted(s)[-5]) for e, s in best.items() if len(s) >= 5])
    assert all(a == b for a, b in made)
    tally = []
    out = _cell_neighbours(5, tally)(cell_table([(0, blocks[0], floors[0]), (1, blocks[1], floors[1])]))
    # The one common key can't reach what the groups have inside.
    assert sum(tally) == 0 and out.num_rows == 0
    # An entity without a score yet asks, and nobody else is multiplied with the other block.
    lazy = [x for x in floors[0] if x[0] != 7]
    out = _cell_neighbours(5, tally)(cell_table([(0, blocks[0], lazy), (1, blocks[1], floors[1])]))
    assert 0 < sum(tally) <= 40 and set(out["entity"].to_pylist()) == {7}


@pytest.mark.parametrize("dense_gain", [0, 100])
def test_cells_against_a_dense_product(dense_gain, monkeypatch):
    monkeypatch.setattr(similarity, "DENSE_GAIN", dense_gain)
    monkeypatch.setattr(similarity, "PRODUCT_BATCH", 500)
    rng = np.random.default_rng(9)
    rows = unit([(e, int(f), float(rng.integers(-2, 9) or 1)) for e in range(60) for f in rng.choice(30, rng.integers(1, 12), replace=False)])
    m = np.zeros((60, 30))
    for e, f, x in rows:
        m[e, f] = x
    sims = m @ m.T
    np.fill_diagonal(sims, 0)
    left, right = [r for r in rows if r[0] < 25], [r for r in rows if r[0] >= 25]
    for parts, inside in (([(0, rows, [])], sims), ([(0, left, []), (1, right, [])], sims * (np.arange(60)[:, None] < 25) * (np.arange(60) >= 25))):
        inside = np.maximum(inside, inside.T)
        out = _cell_neighbours(4)(cell_table(parts))
        got = {}
        for e, o, s in zip(*(out[c].to_pylist() for c in ("entity", "neighbor", "sim"))):
            assert abs(inside[e, o] - s) < 1e-12
            got.setdefault(e, set()).add(round(s, 9))
        for e in range(60):
            best = [round(x, 9) for x in sorted(inside[e], reverse=True)[:4] if x > 1e-12]
            assert set(best) <= got.get(e, set())


def test_a_cell_takes_few_sums_at_a_time(monkeypatch):
    """Once entities have k sums, only better ones leave a slice, in a triangle for the rows too."""
    monkeypatch.setattr(similarity, "PENDING_SUMS", 100, raising=False)
    monkeypatch.setattr(similarity, "SLICE_CELLS", 2_000)
    rng = np.random.default_rng(4)
    rows = unit([(e, f, float(rng.integers(1, 99))) for e in range(400) for f in range(6)])
    passed, whole = [], similarity._multiplied

    def counted(*args):
        for part in whole(*args):
            passed.append(len(part[0]))
            yield part

    monkeypatch.setattr(similarity, "_multiplied", counted)
    out = _cell_neighbours(3)(cell_table([(0, rows, [])]))
    assert sum(passed) < 400 * 399 / 2 / 3
    best = {}
    for e, n, s in zip(*(out[c].to_pylist() for c in ("entity", "neighbor", "sim"))):
        best.setdefault(e, []).append((-round(s, 9), n))
    sims = brute_force(rows, 3)
    assert {e: [n for _, n in sorted(x)[:3]] for e, x in best.items()} == {e: [n for n, _ in x] for e, x in sims.items()}


def test_lists_go_only_to_blocks_that_share_a_key(spark, monkeypatch):
    """Ten separate groups in a dozen blocks: hardly a cell of two blocks has anything to multiply."""
    whole = similarity._cell_neighbours
    seen = spark.sparkContext.accumulator(0)

    def watched(k):
        run = whole(k)

        def count(table):
            seen.add(int(table["lo"][0] != table["hi"][0]))
            return run(table)

        return count

    monkeypatch.setattr(similarity, "_cell_neighbours", watched)
    rng = np.random.default_rng(6)
    rows = [(e, 100 * (e // 12) + int(f), float(rng.integers(1, 9))) for e in range(120) for f in rng.choice(9, 4, replace=False)]
    got = found(top_k_cosine(frame(spark, rows), "entity", "key", "weight", 4, collapse=False, chunk_entities=24))
    assert {e: [n for n, _ in x] for e, x in got.items()} == {e: [n for n, _ in x] for e, x in brute_force(rows, 4).items()}
    assert seen.value <= 30


def test_twins_and_zero_rows(spark):
    rows = [(1, 10, 2.0), (1, 11, 1.0), (2, 10, 4.0), (2, 11, 2.0), (3, 10, 0.0), (4, 12, 1.0)]
    got = found(top_k_cosine(frame(spark, rows), "entity", "key", "weight", 10))
    # Self never, the twin yes; the all-zero row and the lone row have no neighbours.
    assert got == {1: [(2, 1.0)], 2: [(1, 1.0)]}


def test_many_copies_keep_the_smallest_ids(spark):
    rows = [(e, 1, 1.0) for e in range(40)]
    got = found(top_k_cosine(frame(spark, rows), "entity", "key", "weight", 3))
    assert got[0] == [(1, 1.0), (2, 1.0), (3, 1.0)]
    assert got[2] == [(0, 1.0), (1, 1.0), (3, 1.0)]
    assert got[39] == [(0, 1.0), (1, 1.0), (2, 1.0)]


def test_symmetric(spark, skewed_rows):
    rows = top_k_cosine(frame(spark, skewed_rows), "entity", "key", "weight", 1000).collect()
    sims = {(r["entity"], r["neighbor"]): r["sim"] for r in rows}
    assert all(abs(sims[(b, a)] - s) < 1e-9 for (a, b), s in sims.items())


def test_negative_weights(spark):
    rows = [(1, 1, 1.0), (1, 2, -1.0), (2, 1, 1.0), (2, 2, 3.0), (3, 1, 2.0), (3, 2, -1.0)]
    got = found(top_k_cosine(frame(spark, rows), "entity", "key", "weight", 10))
    assert [n for n, _ in got[1]] == [3]
    assert 2 not in got


def test_no_rows(spark):
    assert top_k_cosine(frame(spark, []), "entity", "key", "weight", 3).count() == 0


def test_unique_pairs_are_checked(spark):
    with pytest.raises(ValueError):
        require_unique_pairs(frame(spark, [(1, 1, 1.0), (1, 1, 2.0)]), "entity", "key")
    require_unique_pairs(frame(spark, [(1, 1, 1.0), (1, 2, 2.0)]), "entity", "key")


def test_pairs_of_blocks_are_read_and_not_shuffled(spark, monkeypatch):
    """Twelve blocks that all share keys: cells come from a Cartesian product in rounds, whose scores rise."""
    plans, stored = [], similarity.store

    def watched(df):
        plans.append(df._jdf.queryExecution().toString())
        return stored(df)

    monkeypatch.setattr(similarity, "store", watched)
    rng = np.random.default_rng(8)
    rows = [(e, int(f), float(rng.integers(1, 9))) for e in range(120) for f in rng.choice(30, 5, replace=False)]
    got = found(top_k_cosine(frame(spark, rows), "entity", "key", "weight", 4, collapse=False, chunk_entities=20))
    assert got == brute_force(rows, 4)
    rounds = [p for p in plans if "CartesianProduct" in p]
    assert len(rounds) == 2 and not any("FlatMapGroupsInArrow" in p for p in rounds)


def test_a_task_meets_several_blocks(spark, monkeypatch):
    """Twelve blocks in three partitions: a round has nine tasks, not one for each of 144 pairs of blocks."""
    monkeypatch.setattr(similarity, "LEAST_PARTS", 2, raising=False)
    tasks, whole = spark.sparkContext.accumulator(0), similarity._cells

    def watched(k):
        run = whole(k)

        def cells(batches):
            tasks.add(1)
            yield from run(batches)

        return cells

    monkeypatch.setattr(similarity, "_cells", watched)
    rng = np.random.default_rng(8)
    rows = [(e, int(f), float(rng.integers(1, 9))) for e in range(120) for f in rng.choice(30, 5, replace=False)]
    got = found(top_k_cosine(frame(spark, rows), "entity", "key", "weight", 4, collapse=False, chunk_entities=20))
    assert got == brute_force(rows, 4)
    assert 0 < tasks.value <= 2 * 9


@pytest.mark.parametrize("first", [0, -(2**62), 2**62])
def test_packed_blocks_meet_like_a_dense_product(first, monkeypatch):
    monkeypatch.setattr(similarity, "DENSE_GAIN", 0)
    monkeypatch.setattr(similarity, "SPARSE_GAIN", 0)
    monkeypatch.setattr(similarity, "PRODUCT_BATCH", 40)
    rng = np.random.default_rng(5)
    m = np.where(rng.random((40, 25)) < 0.2, rng.integers(1, 9, (40, 25)), 0) + np.eye(40, 25)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids, keys, k = np.arange(40) * 7 + 3, first + np.arange(25) * 3, 3
    packed, sims = [], m @ m.T
    for part in (range(18), range(18, 40)):
        at, f = np.nonzero(m[list(part)])
        rows = pa.table({"block": np.zeros(len(at), np.int64), "f": keys[f], "e": ids[list(part)][at], "x": m[list(part)][at, f]})
        packed.append(similarity._packed_block(k, False, int(keys[0]), int(keys[-1]))(rows)["held"][0].as_py())
    for floors in ((np.zeros(0, np.int64), np.zeros(0)), (ids, np.full(40, 0.3))):
        got = {}
        for e, o, s in zip(*similarity._cell_of(similarity._cell_best(k), *packed, [floors] * 2)):
            got.setdefault(e, {})[o] = s
        for i, e in enumerate(ids):
            others = range(18, 40) if i < 18 else range(18)
            best = sorted(((-round(sims[i, j], 9), ids[j]) for j in others if sims[i, j] > max(1e-12, floors[1].max(initial=0))))[:k]
            assert {o: -s for s, o in best}.items() <= {o: round(s, 9) for o, s in got.get(e, {}).items()}.items()


def test_blocks_that_share_a_key_share_a_range():
    rng = np.random.default_rng(2)
    low, high = -(2**63), 2**63 - 1
    keys = np.append(rng.integers(low, high, 300), [low, high])
    for key in keys:
        one = similarity._key_ranges(np.array([key]), low, high)
        assert any(a & b for a, b in zip(one, similarity._key_ranges(np.sort(keys), low, high)))
    assert similarity._key_ranges(np.array([5]), 5, 5)[0] == 1


def test_keys_of_any_kind(spark):
    rng = np.random.default_rng(1)
    rows = [(e, int(f), float(rng.integers(1, 9))) for e in range(30) for f in rng.choice(20, 4, replace=False)]
    named = spark.createDataFrame([(e, f"key {f:02d}", w) for e, f, w in rows], "entity long, key string, weight double")
    assert found(top_k_cosine(named, "entity", "key", "weight", 3)) == brute_force(rows, 3)
