import math

import pytest
from conftest import at
from pyspark.sql import functions as F

from newsloom.operators import clean, explore, interactions, reshape
from newsloom.functions import cosine, dot, l2_norm, l2_normalise


def test_roll_up_of_a_repeated_pair(make_log):
    log = make_log([(1, 1, 9, 1, 2.0, None), (2, 1, 9, 2, 3.0, 10.0), (3, 1, 9, 3, 5.0, 40.0)])
    product = interactions.roll_up(log).first()
    assert (product["total_readtime"], product["max_scroll"]) == (30.0, 40.0)
    assert interactions.roll_up(log, "sum").first()["total_readtime"] == 10.0
    times = interactions.roll_up_times(log).first()
    assert (times["read_time"], times["scroll_percentage"], times["impression_time"]) == (10.0, 40.0, at(3))
    with pytest.raises(ValueError):
        interactions.roll_up(log, "median")


def test_roll_up_of_missing_read_times(make_log):
    log = make_log([(1, 1, 9, 1, None, None), (2, 1, 9, 2, None, None)])
    row = interactions.roll_up(log).first()
    assert (row["total_readtime"], row["max_scroll"]) == (1.0, None)
    assert interactions.roll_up_times(log).first()["read_time"] == 0.0


def articles(spark, rows):
    return spark.createDataFrame(rows, "article_id long, published_time timestamp_ntz")


def test_interaction_scores(spark, make_log):
    log = make_log(
        [
            (1, 1, 10, 1, 1.0, 50.0),
            (2, 2, 10, 2, 3.0, 100.0),
            (3, 3, 11, 3, 1.0, None),
            (4, 4, 99, 4, 1.0, 50.0),
            (5, 5, None, 5, 1.0, 50.0),
        ]
    )
    got = {
        r["user_id"]: r["score"]
        for r in interactions.interaction_scores(log, articles(spark, [(10, at(0)), (11, at(10))])).collect()
    }
    low, high = math.log(2) * 50, math.log(4) * 100
    assert got[1] == pytest.approx(0.0)
    assert got[2] == pytest.approx(0.8 * (high - low) / (high - low))
    # Unknown scroll, unknown article: no score. Home-page rows are gone.
    assert got[3] is None and got[4] is None and 5 not in got


def test_interaction_scores_without_a_range(spark, make_log):
    log = make_log([(1, 1, 10, 1, 1.0, 50.0), (2, 2, 10, 1, 1.0, 50.0)])
    rows = interactions.interaction_scores(log, articles(spark, [(10, at(0)), (11, at(0))])).collect()
    assert [r["score"] for r in rows] == [None, None]


def test_binary_matrix_and_its_counts(spark, make_log):
    log = make_log([(1, 1, 10, 1, 1.0, 1.0), (2, 1, 10, 2, 1.0, 1.0), (3, 2, 11, 3, 1.0, 1.0), (4, 9, 10, 4, 1.0, 1.0), (5, 2, None, 4, 1.0, 1.0)])
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    items = spark.createDataFrame([(10,), (11,), (12,)], "article_id long")
    rows = interactions.binary_matrix(log, users, items).collect()
    got = sorted((r["user_id"], r["article_id"], r["clicked"]) for r in rows)
    expected = [(u, a, 0) for u in (1, 2, 3) for a in (10, 11, 12) if (u, a) not in {(1, 10), (2, 11)}]
    assert got == sorted(expected + [(1, 10, 1), (1, 10, 1), (2, 11, 1)])
    counts = {r["article_id"]: (r["positives"], r["negatives"]) for r in interactions.click_counts(log, users, items).collect()}
    assert counts == {10: (2, 2), 11: (1, 2), 12: (0, 3)}
    sampled = interactions.binary_matrix(log, users, items, negatives_per_user=1)
    assert sampled.where("clicked = 1").count() == 3
    assert {r["n"] for r in sampled.where("clicked = 0").groupBy("user_id").agg(F.count("*").alias("n")).collect()} == {1}


def test_grid_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(interactions, "GRID_BLOCK_IDS", 3)
    users = spark.range(4).select(F.col("id").alias("user_id"))
    items = spark.range(10).select(F.col("id").alias("article_id"))
    pairs = interactions.user_article_pairs(users, items)
    assert pairs.count() == pairs.distinct().count() == 40


def test_grid_is_unrolled_in_many_tasks_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(interactions, "GRID_BLOCK_IDS", 3)
    monkeypatch.setattr(interactions, "TASK_PAIRS", 20, raising=False)
    users = spark.createDataFrame([(u,) for u in [*range(12), None]], "user_id long")
    items = spark.range(10).select(F.col("id").alias("article_id"))
    log = spark.createDataFrame([(1, 2), (1, 2), (3, 9)], "user_id long, article_id long")
    pairs = interactions.user_article_pairs(users, items)
    matrix = interactions.binary_matrix(log, users, items)
    assert pairs.distinct().count() == 130 and matrix.count() == 131
    assert sorted(map(tuple, matrix.where("clicked = 1").drop("clicked").collect())) == [(1, 2), (1, 2), (3, 9)]
    for df in (pairs, matrix):
        tasks = df.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(tasks) > 2 and max(r["count"] for r in tasks) < 100
    assert "BroadcastExchange" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_history(spark):
    rows = [(1, [5, 6, 5], [1.0, 2.0, 4.0]), (2, [], []), (3, [7], [3.0])]
    history = spark.createDataFrame(rows, "user_id long, article_id_fixed array<int>, read_time_fixed array<float>")
    got = {(r["user_id"], r["article_id"]): r["score"] for r in interactions.history_interactions(history).collect()}
    assert got == {(1, 5): 5.0, (1, 6): 2.0, (3, 7): 3.0}
    exploded = reshape.explode_parallel(history, ["article_id_fixed", "read_time_fixed"])
    assert exploded.count() == 5
    assert exploded.where("user_id = 2 AND article_id_fixed IS NULL").count() == 1


def test_topics(spark):
    rows = [(1, ["a", "b"], True), (2, [], False)]
    items = spark.createDataFrame(rows, "article_id long, topics array<string>, premium boolean")
    wide = interactions.topic_features(items)
    assert wide.columns == ["article_id", "premium", "topic_null", "topic_a", "topic_b"]
    assert sorted(tuple(r) for r in wide.collect()) == [(1, 1, 0, 1, 1), (2, 0, 1, 0, 0)]
    assert clean.columns_starting(wide, "topic_") == ["topic_null", "topic_a", "topic_b"]
    long = interactions.long_topics(wide.drop("topic_null"))
    assert sorted(tuple(r) for r in long.collect()) == [(1, "a"), (1, "b")]


def test_clean_table(spark):
    df = spark.createDataFrame([(1, None, 3.0), (2, "x", None), (3, "y", 1.0)], "a long, b string, c double")
    out = clean.clean_table(df, filter_null_columns=["b"], sort_by="c")
    assert [r["a"] for r in out.collect()] == [2, 3]
    with pytest.raises(ValueError):
        clean.clean_table(df, remove_columns=["nope"])
    with pytest.raises(ValueError):
        clean.clean_table(df, predict_columns=["c"], predict_strategy="median")
    filled = clean.clean_table(df, predict_columns=["c"], expand_columns={"b": ["x"]}).orderBy("a").collect()
    assert [(r["c"], r["b_x"]) for r in filled] == [(3.0, 0), (2.0, 1), (1.0, 0)]


def test_missing_keys(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 3), (2.0, None)], "article_id double, user_id long")
    assert clean.drop_missing_keys(df, ["article_id", "user_id"]).count() == 1


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(
        dot(F.col("a"), F.col("b")).alias("dot"),
        l2_norm(F.col("a")).alias("norm"),
        cosine(F.col("a"), F.col("b")).alias("cos"),
        l2_normalise(F.col("a")).alias("unit"),
    ).collect()
    assert (rows[0]["dot"], rows[0]["norm"], round(rows[0]["cos"], 9)) == (24.0, 5.0, 0.96)
    assert rows[0]["unit"] == pytest.approx([0.6, 0.8])
    assert rows[1]["cos"] is None and rows[1]["unit"] == [0.0, 0.0]


def test_exploration(spark, make_log):
    log = make_log([(1, 1, 10, 1, 1.0, None), (2, 1, 10, 2, 1.0, 1.0), (3, 2, None, 3, 1.0, 1.0)])
    report = explore.explore(log)
    assert {r["column"]: r["nulls"] for r in report["null_counts"].collect()} == {"article_id": 1, "scroll_percentage": 1}
    assert report["schema"].count() == 6 and report["head"].count() == 3
    assert {r["summary"] for r in report["describe"].collect()} >= {"count", "mean", "min", "max"}
    sparsity = explore.data_sparsity(log.where("article_id IS NOT NULL")).first()
    assert (sparsity["interactions"], sparsity["sparsity"]) == (1, 0.0)
    clicks = explore.article_clicks(log, spark.createDataFrame([(10,), (11,)], "article_id long"))
    assert [tuple(r) for r in clicks.collect()] == [(10, 2)]


def test_histogram(spark):
    clicks = spark.createDataFrame([(i, c) for i, c in enumerate([0, 1, 5, 10, 10])], "article_id long, clicks long")
    bins = explore.click_histogram(clicks, 10).orderBy("bin").collect()
    assert [r["articles"] for r in bins] == [1, 1, 0, 0, 0, 1, 0, 0, 0, 2]
    assert (bins[0]["low"], bins[-1]["high"]) == (0.0, 10.0)
    flat = explore.click_histogram(spark.createDataFrame([(1, 4), (2, 4)], "article_id long, clicks long"), 10)
    assert sum(r["articles"] for r in flat.collect()) == 2


def test_reader_bitmaps(spark):
    """More users than a block holds, a load twice, articles without readers."""
    from newsloom.operators.reader_bitmaps import ReaderBitmaps, number_users

    rows = [(u, u % 5) for u in range(0, 70_000, 7)] + [(u, 9) for u in range(32_760, 32_776)] + [(3, 1), (None, 1), (5, None)]
    log = spark.createDataFrame([(u, a) for u, a in rows], "user_id long, article_id long")
    users = spark.range(70_000).select(F.col("id").alias("user_id"))
    articles = spark.createDataFrame([(a,) for a in (0, 1, 2, 3, 4, 9, 77)], "article_id long")
    places = number_users(users)
    once = ReaderBitmaps.of(log, places)
    both = once.merged(ReaderBitmaps.of(log.where("article_id > 1"), places))
    assert once.click_counts(articles).exceptAll(interactions.click_counts(log, users, articles)).isEmpty()
    read = {a: {u for u, b in rows if b == a and u is not None} for a in range(10)}
    assert {r["article_id"]: r["readers"] for r in both.readers().collect()} == {a: len(x) for a, x in read.items() if x}
    pairs = spark.createDataFrame([(0, 1), (9, 0), (9, 9), (1, 77), (1, 9)], "first long, second long")
    assert {(r["first"], r["second"]): r["readers"] for r in both.common_readers(pairs).collect()} == {
        (a, b): len(read.get(a, set()) & read.get(b, set())) for a, b in ((0, 1), (9, 0), (9, 9), (1, 77), (1, 9))
    }
    named = spark.createDataFrame([(7,), (32_767,), (32_768,), (69_993,), (10**9,)], "user_id long")
    cells = {(r["user_id"], r["article_id"]): r["clicked"] for r in once.rows_of(named, articles).collect()}
    assert cells == {(u, a): int(u in read.get(a, set())) for u in (7, 32_767, 32_768, 69_993) for a in (0, 1, 2, 3, 4, 9, 77)}
    found = once.sparsity().first()
    pairs_read = sum(len(x) for x in read.values())
    n_users = len(set().union(*read.values()))
    assert (found["interactions"], found["users"], found["items"]) == (pairs_read, n_users, 6)


def test_thinly_read_articles_have_small_blocks(spark):
    from newsloom.operators.reader_bitmaps import ReaderBitmaps, number_users

    # Each article has three readers far from each other: what is stored follows the pairs.
    log = spark.range(300).select((F.col("id") * 331 % 9973).alias("user_id"), (F.col("id") % 100).alias("article_id"))
    found = ReaderBitmaps.of(log, number_users(spark.range(10_000).select(F.col("id").alias("user_id"))))
    stored = found.blocks.agg(F.sum(F.length(F.hex("bits")) / 2).alias("bytes")).first()["bytes"]
    assert stored <= 300 * 8
    assert found.sparsity().first()["interactions"] == 300
