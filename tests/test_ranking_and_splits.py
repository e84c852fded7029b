import random
from datetime import datetime

import numpy as np
import pytest
from conftest import at
from pyspark.sql import functions as F

from newsloom.operators import ranking, splits
from newsloom.operators.ranking import (
    best_unseen,
    global_rank,
    large_groups,
    nth_smallest,
    prefix_sums,
    rank_within,
    rows_between,
    running_total,
    top_n,
)


def test_global_rank_equals_sort(spark):
    df = spark.range(0, 5000, numPartitions=7).select(
        F.col("id"), (F.col("id") * 7919 % 13).cast("double").alias("score")
    )
    rows = global_rank(df, [F.col("score").desc(), F.col("id").asc()]).collect()
    expected = sorted(((-r["score"], r["id"]) for r in rows))
    got = [(-r["score"], r["id"]) for r in sorted(rows, key=lambda r: r["position"])]
    assert got == expected
    assert sorted(r["position"] for r in rows) == list(range(1, 5001))


@pytest.mark.parametrize("hot_rows", [1_000_000, 50])
def test_rank_within_hot_groups(spark, hot_rows):
    df = spark.range(600).select(
        F.when(F.col("id") < 300, 1).otherwise(F.col("id") % 7 + 2).alias("g"),
        (F.col("id") * 31 % 17).alias("t"),
        F.col("id"),
    )
    rows = rank_within(df, "g", ["t", "id"], hot_rows=hot_rows).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["g"], []).append(r)
    for members in groups.values():
        ordered = sorted(members, key=lambda r: (r["t"], r["id"]))
        assert [r["position"] for r in ordered] == list(range(1, len(members) + 1))
        assert {r["group_rows"] for r in members} == {len(members)}
    assert len(rows) == 600


def test_top_n_breaks_ties_by_id_and_puts_missing_last(spark):
    df = spark.createDataFrame(
        [(1, 5, 0.5), (1, 4, 0.5 + 1e-13), (1, 3, None), (1, 9, 0.9)], "user_id long, article_id long, score double"
    )
    rows = top_n(df, "user_id", "score", "article_id", 3).orderBy("rank").collect()
    assert [r["article_id"] for r in rows] == [9, 4, 5]


@pytest.mark.parametrize("tail", [1, 3, 100_000])
def test_nth_smallest_with_one_hot_instant(spark, tail):
    rows = [(at(1), 50 + i) for i in range(40)] + [(at(0), 3), (at(9), 1), (at(9), 2)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, i long")
    ordered = sorted(rows)
    for target in (1, 2, 20, 41, 43):
        assert nth_smallest(df, "t", "i", target, tail) == ordered[target - 1]


@pytest.mark.parametrize("size, error", [(8, 0.0), (8, 0.002), (4096, 0.002)])
def test_nth_smallest_when_the_sketch_is_off(spark, size, error, monkeypatch):
    monkeypatch.setattr(ranking, "SKETCH_SIZE", size)
    monkeypatch.setattr(ranking, "SKETCH_ERROR", error)
    pick = random.Random(4)
    rows = [(at(pick.randint(0, 3000)), i) for i in range(4000)] + [(at(1500), 10_000 + i) for i in range(900)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, i long").repartition(5)
    ordered = sorted(rows)
    for target, tail in ((1, 5), (1234, 5), (2500, 100_000), (4900, 5)):
        assert nth_smallest(df, "t", "i", target, tail) == ordered[target - 1]


def test_time_search_filters_the_scan(spark, sf_dir):
    for name, time in (("events", "ts"), ("orders", "o_orderdate")):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        plan = rows_between(df, time, 10**15, 10**15 + 10**6)._jdf.queryExecution().toString()
        pushed = plan[plan.index("PushedFilters") :]
        assert f"GreaterThanOrEqual({time}" in pushed and "LessThanOrEqual(" in pushed


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_prefix_sums(spark, partitions):
    pick = random.Random(partitions)
    rows = [(pick.choice([None, 1, 1, 1, 1, 2, 5]), i, pick.choice([None, 1, 2, 7]), "x") for i in range(500)]
    rows += [(9, i, 3, "y") for i in range(3)] + [(1, 1000 + i, 1, "z") for i in range(700)]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, o long, v int, other string").repartition(partitions)
    expected = {}
    for whole in (False, True):
        total = {}
        for g, o, v, x in sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0) if not whole else 0, r[1], r[3])):
            total[whole or g] = total.get(whole or g, 0) + (v or 0)
            expected[(whole, g, o, x)] = total[whole or g]
    got = prefix_sums(df, [F.col("o").asc(), F.col("other").asc()], "v", "sum", "g")
    assert got.columns == ["g", "o", "v", "other", "sum"]
    assert {(False, r["g"], r["o"], r["other"]): r["sum"] for r in got.collect()} == {k: v for k, v in expected.items() if not k[0]}
    got = prefix_sums(df, [F.col("o").asc(), F.col("other").asc()], "v", "sum")
    assert {(True, r["g"], r["o"], r["other"]): r["sum"] for r in got.collect()} == {k: v for k, v in expected.items() if k[0]}
    large = large_groups(df, "g", 400)
    assert {r[0] for r in large.collect()} == {1} and large_groups(df, "g", 10_000) is None
    both = running_total(df, "g", [F.col("o").asc(), F.col("other").asc()], "v", "sum", large)
    assert {(False, r["g"], r["o"], r["other"]): r["sum"] for r in both.collect()} == {k: v for k, v in expected.items() if not k[0]}
    assert prefix_sums(df.limit(0), [F.col("o")], "v", "sum", "g").count() == 0


def test_prefix_sums_of_doubles(spark):
    df = spark.range(1, 1001).select("id", (F.col("id") / 4).alias("v")).repartition(6)
    rows = {r["id"]: r["t"] for r in prefix_sums(df, [F.col("id")], "v", "t").collect()}
    assert rows == {i: i * (i + 1) / 8 for i in range(1, 1001)}


def test_time_split(spark, make_log):
    rows = [(i, 1, i, s, 1.0, 1.0) for i, s in enumerate([9, 8, 7, 3, 3, 5, 4, 6, 2, 1])]
    train, test = splits.time_split(make_log(rows), test_ratio=0.3)
    # The three oldest: times 1, 2, and the smaller id of the two at time 3.
    assert {r["impression_id"] for r in test.collect()} == {9, 8, 3}
    assert train.count() == 7


def test_time_split_of_nothing(spark, make_log):
    train, test = splits.time_split(make_log([(1, 1, 1, 1, 1.0, 1.0)]), test_ratio=0.3)
    assert (train.count(), test.count()) == (1, 0)


@pytest.mark.parametrize("hot_rows", [1_000_000, 4])
@pytest.mark.parametrize("ratio, cuts", [(0.8, {1: 1, 2: 1, 5: 4, 10: 8}), (1.0, {1: 1, 2: 1, 5: 4, 10: 9})])
def test_user_time_split(spark, make_log, ratio, cuts, hot_rows):
    rows, n = [], 0
    for user in cuts:
        for i in range(user):
            rows.append((n, user, i, 59 - i, 1.0, 1.0))
            n += 1
    train, test = splits.user_time_split(make_log(rows), ratio, hot_rows=hot_rows)
    got = {r["user_id"]: r["count"] for r in train.groupBy("user_id").count().collect()}
    assert got == cuts
    assert train.count() + test.count() == len(rows)
    last = train.groupBy("user_id").agg(F.max("impression_time").alias("t")).join(
        test.groupBy("user_id").agg(F.min("impression_time").alias("u")), "user_id"
    )
    assert last.where("t >= u").isEmpty()


def test_random_split_is_disjoint_complete_and_stable(spark):
    df = spark.range(10_000).select(F.col("id").alias("impression_id"))
    train, test = splits.random_split(df, 0.3)
    again = splits.random_split(df.repartition(5), 0.3)[1]
    assert train.union(test).distinct().count() == train.count() + test.count() == 10_000
    assert abs(test.count() - 3000) < 150
    assert test.exceptAll(again).isEmpty()


def test_sample_users(spark):
    users = spark.range(100).select(F.col("id").alias("user_id"))
    picked = splits.sample_users(users.union(users), 12, seed=1)
    assert picked.count() == picked.distinct().count() == 12
    assert splits.sample_users(users, None).count() == 100
    assert splits.sample_users(users, 500).count() == 100


@pytest.mark.parametrize("head_rows", [10_000, 2, 0])
def test_best_unseen_equals_cross_join(spark, head_rows):
    users = [(u,) for u in range(6)]
    items = [(100 + p, p) for p in range(1, 21)]
    seen = [(1, 101), (1, 102), (1, 104), (2, 120), (3, 103)] + [(4, 100 + p) for p in range(1, 18)]
    seen += [(5, 100 + p) for p in range(1, 21)]
    got = best_unseen(
        spark.createDataFrame(users, "user_id long"),
        spark.createDataFrame(items, "article_id long, position long"),
        spark.createDataFrame(seen, "user_id long, article_id long"),
        4,
        head_rows,
    ).collect()
    for (u,) in users:
        free = [a for a, _ in items if (u, a) not in seen][:4]
        mine = sorted((r for r in got if r["user_id"] == u), key=lambda r: r["rank"])
        assert [r["article_id"] for r in mine] == free
        assert [r["rank"] for r in mine] == list(range(1, len(free) + 1))


@pytest.fixture(scope="module")
def gaps(spark):
    """Fifty rows, some without a time, an id or a user; some keys are negative."""
    rows = []
    for i in range(50):
        time = None if i % 9 == 0 else at(i * 7 % 20)
        rows.append((i, None if i % 6 == 5 else i - 25, time, None if i % 4 == 0 else i % 3))
    return spark.createDataFrame(rows, "row long, impression_id long, impression_time timestamp_ntz, user_id long").repartition(3)


def rows_of(df):
    return sorted(r["row"] for r in df.collect())


def test_random_split_is_complete(gaps):
    train, test = splits.random_split(gaps, 0.4)
    assert sorted(rows_of(train) + rows_of(test)) == list(range(50))
    keyless = set(rows_of(gaps.where("impression_id IS NULL")))
    assert keyless <= set(rows_of(train))
    negative = set(rows_of(gaps.where("impression_id < 0")))
    assert negative & set(rows_of(train)) and negative & set(rows_of(test))


@pytest.mark.parametrize("ratio", [0.04, 0.1, 0.3, 0.5, 0.9, 1.0])
def test_time_split_is_complete(gaps, ratio):
    train, test = splits.time_split(gaps, test_ratio=ratio)
    assert sorted(rows_of(train) + rows_of(test)) == list(range(50))
    oldest = sorted(
        gaps.collect(),
        key=lambda r: (
            r["impression_time"] is not None,
            r["impression_time"] or datetime.min,
            r["impression_id"] is not None,
            r["impression_id"] or 0,
        ),
    )
    n = int(50 * ratio)
    cut = oldest[n - 1]
    same = {r["row"] for r in oldest if (r["impression_time"], r["impression_id"]) == (cut["impression_time"], cut["impression_id"])}
    # Rows without either can't be told apart; they fall together.
    assert set(rows_of(test)) == {r["row"] for r in oldest[:n]} | same


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_user_time_split_is_complete(gaps, hot_rows):
    train, test = splits.user_time_split(gaps, 0.5, id_column="row", hot_rows=hot_rows)
    assert train.columns == test.columns == gaps.columns
    assert sorted(rows_of(train) + rows_of(test)) == list(range(50))
    nobody = rows_of(gaps.where("user_id IS NULL"))
    assert len(set(nobody) & set(rows_of(train))) == len(nobody) // 2


@pytest.mark.parametrize("waiting", [4_000_000, 50])
@pytest.mark.parametrize("pass_offers", [20_000_000, 300])
@pytest.mark.parametrize("wide", [1, 2**40])
def test_offers_travel_as_packed_lists(spark, monkeypatch, waiting, pass_offers, wide):
    """Sums of offers by user, without read pairs; users may be null, ids far apart, and no offer is a row of its own."""
    monkeypatch.setattr(ranking, "WAITING_OFFERS", waiting, raising=False)
    monkeypatch.setattr(ranking, "PASS_OFFERS", pass_offers)
    rng = np.random.default_rng(3)
    reads = [(u if u else None, int(a) * wide) for u in range(20) for a in rng.choice(30, 6, replace=False)]
    near = [(a * wide, int(b) * wide, float(rng.integers(1, 5)) / 4) for a in range(25) for b in rng.choice(30, 5, replace=False)]
    mine = spark.createDataFrame(reads, "user_id long, article_id long")
    lists = ranking.lists_of(spark.createDataFrame(near, "article_id long, item long, sim double"), "article_id", "item", "sim")
    shown = []

    def offers_of(some):
        rows = some.join(lists, "article_id", "left").selectExpr("user_id", "article_id AS read", "held")
        shown.append(rows.count())
        return rows

    got = ranking.best_unread(mine, offers_of, None, 3, len(reads) * 5, 30)
    sums = {}
    for u, a in reads:
        for x, b, s in near:
            if x == a and (u, b) not in reads:
                sums.setdefault(u, {}).setdefault(b, []).append(s)
    want = {u: [b for _, b in sorted((-sum(s), b) for b, s in x.items())[:3]] for u, x in sums.items()}
    found = {}
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        found.setdefault(r["user_id"], []).append(r["article_id"])
        assert r["score"] == sum(sums[r["user_id"]][r["article_id"]])
    assert found == want
    assert sum(shown) <= len(reads) * 2 and len(shown) == (1 if pass_offers > 1000 else 2)
