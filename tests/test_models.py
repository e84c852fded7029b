import numpy as np
import pytest
from conftest import at, lists
from pyspark.sql import functions as F

from newsloom.models import (
    ClickModel,
    CosineProfiles,
    ItemCF,
    MostPopular,
    PopularityUserCF,
    Recommender,
    RingBuffer,
    TopicCF,
    UserCF,
    UserItemBias,
    WeightedProfiles,
)
from newsloom.models import users_frame as users_of
from newsloom.operators.interactions import binary_matrix, click_counts
from newsloom.operators import vector_search
from newsloom.operators.vector_search import best_by_dot
from newsloom.plans import model_queries
from newsloom.plans.given_tables import GivenTables


def pairs(spark, rows):
    return spark.createDataFrame(rows, "user_id long, article_id long, total_readtime double, max_scroll double")


def scored(spark, rows):
    return spark.createDataFrame(
        [(u, a, at(i), s) for i, (u, a, s) in enumerate(rows)],
        "user_id long, article_id long, impression_time timestamp_ntz, score double",
    )


def vectors(spark, rows):
    return spark.createDataFrame(rows, "article_id long, document_vector array<float>")


# --- popularity and recency ---------------------------------------------------------


def test_most_popular(spark, make_log):
    log = make_log([(i, 1 + i % 2, a, i, 1.0, 1.0) for i, a in enumerate([5, 5, 3, 4, 4, 9])])
    model = MostPopular(log).fit()
    assert isinstance(model, Recommender)
    # Read articles stay, ties go to the smaller id, unknown users get the same list.
    assert lists(model.recommend(users_of(spark, 1, 77), n=3)) == {1: [4, 5, 3], 77: [4, 5, 3]}
    with pytest.raises(ValueError):
        MostPopular(log).recommend(n=3)


def buffer_log(make_log):
    rows = [(i, 1, 100 + i, i, 1.0, 1.0) for i in range(11)]
    return make_log(rows + [(11, 2, 102, 30, 1.0, 1.0)])


def test_ring_buffer_holds_the_oldest(spark, make_log):
    model = RingBuffer(buffer_log(make_log), 10).fit()
    assert [r["article_id"] for r in model.contents().orderBy("slot").collect()] == list(range(100, 110))
    got = lists(model.recommend(users_of(spark, 1, 2, 50), n=4))
    assert got[1] == [100, 101, 102, 103]
    # User 2 is on 102 now; user 50 is unknown and gets the most frequent ones.
    assert got[2] == [100, 101, 103, 104]
    assert got[50] == [100, 101, 102, 103]


def test_ring_buffer_newest_and_reads(spark, make_log):
    model = RingBuffer(buffer_log(make_log), 10, keep="newest").fit()
    assert [r["article_id"] for r in model.most_recent(3).collect()] == [102, 110, 109]
    assert model.slot(2).first()["article_id"] == 110
    assert model.length().first()["length"] == 10
    assert model.most_popular(1).first()["article_id"] == 102
    later = make_log([(99, 3, 7, 59, 1.0, 1.0)])
    assert model.add_behaviors(later).most_recent(1).first()["article_id"] == 7
    assert model.cleared().length().first()["length"] == 0
    with pytest.raises(ValueError):
        RingBuffer(later, 10, keep="latest")


def test_ring_buffer_repeats(spark, make_log):
    log = make_log([(1, 1, 5, 1, 1.0, 1.0), (2, 2, 5, 2, 1.0, 1.0), (3, 1, 6, 3, 1.0, 1.0)])
    assert lists(RingBuffer(log, 10).fit().recommend(users_of(spark, 1, 2), n=5)) == {1: [5, 5], 2: [6]}


# --- bias ---------------------------------------------------------------------------


def test_bias_by_hand(spark):
    model = UserItemBias(scored(spark, [(1, 10, 4.0), (1, 11, 2.0), (2, 10, 3.0), (2, 12, 0.0), (3, 12, None)])).fit()
    assert model.global_mean == 3.0
    b_u = {r["user_id"]: r["user_bias"] for r in model.user_biases.collect()}
    b_i = {r["article_id"]: r["item_bias"] for r in model.item_biases.collect()}
    assert b_u == {1: 0.0, 2: 0.0, 3: 0.0}
    assert b_i == {10: 0.5, 11: -1.0, 12: 0.0}
    # Article 12 has only zero cells: user 2 is offered it again.
    assert lists(model.recommend(n=3)) == {1: [12], 2: [12, 11], 3: [10, 12, 11]}
    wanted = spark.createDataFrame([(1, 10), (9, 10)], "user_id long, article_id long")
    assert [r["score"] for r in model.predict(wanted).collect()] == [3.5]
    with pytest.raises(ValueError):
        model.predict(wanted, strict=True)
    dense = model.user_ratings(users_of(spark, 2), dense=True)
    assert sorted((r["article_id"], r["rating"]) for r in dense.collect()) == [(10, 3.0), (11, 0.0), (12, 0.0)]


def test_bias_equals_cross_join(spark, sf_dir):
    from newsloom.operators.interactions import interaction_scores

    t = GivenTables(spark, sf_dir)
    model = UserItemBias(interaction_scores(t.behaviors, t.articles)).fit()
    got = lists(model.recommend(n=5))
    cells = {(r["user_id"], r["article_id"]): r["rating"] for r in model.cells.collect()}
    items = {r["article_id"]: r["item_bias"] for r in model.item_biases.collect()}
    for user, mine in got.items():
        free = [a for a in items if not cells.get((user, a))]
        assert mine == sorted(free, key=lambda a: (-round(items[a], 9), a))[:5]


# --- collaborative ------------------------------------------------------------------


def test_user_cf(spark):
    rows = [(1, 10, 1.0, 0.0), (1, 11, 1.0, 0.0), (2, 10, 1.0, 0.0), (2, 12, 5.0, 0.0), (3, 11, 1.0, 0.0), (3, 13, 2.0, 0.0), (4, 99, 1.0, 0.0)]
    model = UserCF(pairs(spark, rows), check_keys=True).fit()
    assert lists(model.recommend(n=5)) == {1: [12, 13], 2: [11], 3: [10]}
    assert lists(model.recommend(users_of(spark, 1), n=5, allow_read_articles=True)) == {1: [12, 13, 10, 11]}
    binary = UserCF(pairs(spark, rows), binary_model=True).fit()
    assert {r["score"] for r in binary.recommend(n=5).collect()} == {1.0}
    with pytest.raises(ValueError):
        UserCF(pairs(spark, rows + rows[:1]), check_keys=True).fit()


def test_item_cf(spark):
    rows = [(1, 10, 1.0, 0.0), (1, 11, 1.0, 0.0), (2, 10, 1.0, 0.0), (2, 12, 1.0, 0.0), (3, 10, 1.0, 0.0)]
    model = ItemCF(pairs(spark, rows)).fit()
    assert lists(model.recommend(n=5)) == {1: [12], 2: [11], 3: [11, 12]}
    everything = lists(model.recommend(users_of(spark, 3), n=5, allow_read_articles=True))
    assert everything == {3: [11, 12]}


def topic_walk(rows, neighbours, n, allow_read):
    """The user's articles from the best down, until n candidates are known."""
    out = {}
    for user in {r[0] for r in rows}:
        mine = sorted(((-round(s, 9), a, s) for u, a, s in rows if u == user))
        read, scores = {a for _, a, _ in mine}, {}
        for _, a, s in mine:
            for other, sim in neighbours.get(a, []):
                if allow_read or other not in read:
                    scores[other] = scores.get(other, 0.0) + s * sim
            if len(scores) >= n:
                break
        ranked = sorted(scores, key=lambda a: (-round(scores[a], 9), a))[:n]
        if ranked:
            out[user] = ranked
    return out


@pytest.mark.parametrize("n", [1, 3, 8])
@pytest.mark.parametrize("allow_read", [False, True])
def test_topic_cf_equals_the_walk(spark, n, allow_read):
    rng = np.random.default_rng(3)
    topics = [(a, int(t)) for a in range(30) for t in rng.choice(6, size=2, replace=False)]
    rows = [(u, int(a), float(rng.integers(1, 20))) for u in range(8) for a in rng.choice(30, size=4, replace=False)]
    table = pairs(spark, [(u, a, s, 0.0) for u, a, s in rows])
    model = TopicCF(table, spark.createDataFrame(topics, "article_id long, topic long")).fit(sim_size=4)
    near = {}
    for r in model.neighbors.orderBy("entity", "rank").collect():
        near.setdefault(r["entity"], []).append((r["neighbor"], r["sim"]))
    expected = topic_walk(rows, near, n, allow_read)
    assert lists(model.recommend(n=n, allow_read_articles=allow_read)) == expected
    # Users with many articles are ranked and summed across tasks; the walk is the same.
    assert lists(model.recommend(n=n, allow_read_articles=allow_read, hot_rows=3)) == expected


def test_topic_cf_stops_early(spark):
    topics = [(1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, "z"), (6, "z")]
    table = pairs(spark, [(1, 1, 9.0, 0.0), (1, 3, 8.0, 0.0), (1, 5, 7.0, 0.0)])
    model = TopicCF(table, spark.createDataFrame(topics, "article_id long, topic string")).fit()
    assert lists(model.recommend(n=2)) == {1: [2, 4]}
    assert lists(model.recommend(n=5)) == {1: [2, 4, 6]}


def test_topic_cf_with_missing_scores(spark):
    topics = [(1, "x"), (2, "x"), (3, "y"), (4, "y")]
    table = pairs(spark, [(1, 1, 9.0, None), (1, 3, 8.0, 0.0)])
    model = TopicCF(table, spark.createDataFrame(topics, "article_id long, topic string")).fit()
    assert lists(model.recommend(n=5)) == {1: [4, 2]}
    binary = TopicCF(table, spark.createDataFrame(topics, "article_id long, topic string"), binary_model=True).fit()
    assert lists(binary.recommend(n=5)) == {1: [2, 4]}


def test_hybrid_fills_with_popular(spark):
    rows = [(1, 10, 1.0, 0.0), (1, 11, 1.0, 0.0), (2, 10, 1.0, 0.0), (2, 12, 1.0, 0.0), (3, 30, 1.0, 0.0)]
    model = PopularityUserCF(pairs(spark, rows)).fit()
    got = lists(model.recommend(users_of(spark, 1, 3, 9), n=5))
    # One collaborative article, then popular ones, read or not, without repeats.
    assert got[1] == [12, 10, 11, 30]
    assert got[3] == got[9] == [10, 11, 12, 30]


# --- content ------------------------------------------------------------------------


def dense_top(users, items, n, seen=()):
    out = {}
    for u, v in users:
        ranked = sorted((-round(float(np.dot(v, w)), 9), a) for a, w in items if (u, a) not in seen)
        out[u] = [a for _, a in ranked[:n]]
    return out


@pytest.mark.parametrize("chunk", [65_536, 7])
def test_vector_search_equals_dense_product(spark, chunk):
    rng = np.random.default_rng(5)
    users = [(u, rng.normal(size=4).tolist()) for u in range(25)]
    items = [(100 + a, rng.normal(size=4).tolist()) for a in range(40)] + [(200, [0.0] * 4), (201, [0.0] * 4)]
    seen = {(0, 100 + a) for a in range(38)} | {(1, 103), (1, 104), (77, 100), (2, 999)}
    got = best_by_dot(
        spark.createDataFrame(users, "user_id long, vec array<double>"),
        spark.createDataFrame(items, "article_id long, vec array<double>"),
        6,
        exclude=spark.createDataFrame(sorted(seen), "user_id long, article_id long"),
        chunk_vectors=chunk,
    )
    assert lists(got) == dense_top(users, items, 6, seen)


@pytest.mark.parametrize("equal_lengths", [True, False])
def test_vector_search_makes_few_cells_of_clustered_vectors(spark, equal_lengths, monkeypatch):
    rng = np.random.default_rng(8)
    centres = 3 * rng.normal(size=(12, 6))

    def near(n):
        rows = centres[rng.integers(0, 12, n)] + 0.05 * rng.normal(size=(n, 6))
        return rows / np.linalg.norm(rows, axis=1, keepdims=True) if equal_lengths else rows

    users = [(u, v.tolist()) for u, v in enumerate(near(600))]
    items = [(1000 + a, v.tolist()) for a, v in enumerate(near(480))]
    seen = {(u, 1000 + int(a)) for u in range(0, 600, 50) for a in rng.integers(0, 480, 30)}
    counted = []
    whole = vector_search.needed_cells
    monkeypatch.setattr(vector_search, "SMALLEST_CHUNK", 25)
    monkeypatch.setattr(
        vector_search, "needed_cells", lambda b, x: counted.append((whole(b, x).count(), b.count())) or whole(b, x)
    )
    got = best_by_dot(
        spark.createDataFrame(users, "user_id long, vec array<double>"),
        spark.createDataFrame(items, "article_id long, vec array<double>"),
        5,
        exclude=spark.createDataFrame(sorted(seen), "user_id long, article_id long"),
        chunk_vectors=20,
    )
    assert lists(got) == dense_top(users, items, 5, seen)
    cells, pairs = counted[0]
    assert pairs >= 24 * 24 and cells < pairs / 2


def test_vector_search_on_vectors_without_any_order(spark):
    # Equal lengths, spread all around: the bounds exclude nothing, and must not.
    rng = np.random.default_rng(2)
    round_about = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 12)))
    users = [(u, v.tolist()) for u, v in enumerate(round_about(60))]
    items = [(1000 + a, v.tolist()) for a, v in enumerate(round_about(90))] + [(2000 + a, [0.0] * 12) for a in range(9)]
    got = best_by_dot(
        spark.createDataFrame(users, "user_id long, vec array<double>"),
        spark.createDataFrame(items, "article_id long, vec array<double>"),
        95,
        chunk_vectors=11,
    )
    assert lists(got) == dense_top(users, items, 95)


def test_vector_search_bounds_the_users_of_a_cell(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)
    whole = vector_search._cell_search

    def watched(n):
        run = whole(n)

        def checked(table):
            sizes.add(int(table["kind"].to_numpy().tolist().count(0) > 60))
            return run(table)

        return checked

    monkeypatch.setattr(vector_search, "_cell_search", watched)
    monkeypatch.setattr(vector_search, "CHUNK_USERS", 30, raising=False)
    monkeypatch.setattr(vector_search, "SMALLEST_CHUNK", 1000)
    rng = np.random.default_rng(1)
    users = [(u, rng.normal(size=4).tolist()) for u in range(400)]
    items = [(1000 + a, rng.normal(size=4).tolist()) for a in range(20)]
    got = best_by_dot(
        spark.createDataFrame(users, "user_id long, vec array<double>"),
        spark.createDataFrame(items, "article_id long, vec array<double>"),
        3,
    )
    assert lists(got) == dense_top(users, items, 3)
    assert sizes.value == 0


def test_vector_search_without_items(spark):
    users = spark.createDataFrame([(1, [1.0])], "user_id long, vec array<double>")
    none = spark.createDataFrame([], "article_id long, vec array<double>")
    assert best_by_dot(users, none, 3).count() == 0


def test_weighted_profiles(spark):
    rows = [(1, 10, 1.0), (1, 11, 3.0), (1, 12, 1.0), (2, 10, 0.0), (2, 11, 0.0), (3, 11, None), (3, 10, 2.0), (3, 12, 1.0)]
    items = [(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [1.0, 1.0]), (13, [-1.0, 0.0])]
    model = WeightedProfiles(scored(spark, rows), vectors(spark, items), train_ratio=0.7).fit()
    profile = {r["user_id"]: r["vec"] for r in model.profiles.collect()}
    assert profile[1] == pytest.approx([0.25, 0.75])
    assert [r["user_id"] for r in model.errors.collect()] == [2]
    got = lists(model.recommend(n=5))
    assert got[1] == [12, 13] and 2 not in got
    # A user without train rows gets the mean of all vectors; one of zero scores none.
    strangers = lists(model.recommend(users_of(spark, 2, 50), n=2))
    assert strangers == {50: [12, 11]}
    asked = spark.createDataFrame([(1, 12), (1, 999)], "user_id long, article_id long")
    assert [round(r["score"], 6) for r in model.score(asked).collect()] == [round(1 / (0.625**0.5 * 2**0.5), 6)]
    with pytest.raises(ValueError):
        model.score(asked, strict=True)


def test_cosine_profiles(spark, make_log):
    log = make_log([(1, 1, 10, 1, 1.0, 1.0), (2, 1, 10, 2, 1.0, 1.0), (3, 1, 11, 3, 1.0, 1.0)])
    items = vectors(spark, [(10, [2.0, 0.0]), (11, [0.0, 5.0]), (12, [1.0, 1.0]), (13, [0.0, 0.0])])
    listed = spark.createDataFrame([(a, 1) for a in (10, 11, 12, 13)], "article_id long, category int")
    model = CosineProfiles(log, listed, items).fit(top_k=3)
    assert lists(model.recommend(n=3)) == {1: [12, 10, 11]}
    # The zero profile scores everything 0.
    assert lists(model.recommend(users_of(spark, 1, 5), n=3)) == {1: [12, 10, 11], 5: [10, 11, 12]}
    wide = spark.createDataFrame([(10, 2.0, 0.0), (11, 0.0, 5.0), (12, 1.0, 1.0)], "article_id long, d0 float, d1 float")
    assert lists(CosineProfiles(log, listed, wide).fit().recommend(n=2)) == {1: [12, 10]}


def test_click_model_equals_fit_on_all_pairs(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from newsloom.models.click import PENALTY

    rng = np.random.default_rng(11)
    items = [(a, rng.normal(size=5).tolist()) for a in range(25)]
    log = [(u, int(a)) for u in range(20) for a in rng.choice(25, size=4, p=np.arange(1, 26) / 325)]
    behaviors = spark.createDataFrame(log, "user_id long, article_id long")
    users, listed = users_of(spark, *range(20)), spark.createDataFrame([(a,) for a, _ in items], "article_id long")
    vecs = vectors(spark, items)
    model = ClickModel(behaviors, users, listed, vecs, n_components=3).fit()
    # An independent fit on every pair: components of the expanded rows, then the regression.
    literal = binary_matrix(behaviors, users, listed).join(vecs, "article_id").toPandas()
    x = np.array(literal["document_vector"].tolist(), float)
    _, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    axes = axes[:, ::-1][:, :3]
    assert model.components @ model.components.T == pytest.approx(axes @ axes.T, abs=1e-6)
    reduced = spark.createDataFrame(
        [(float(c), v.tolist(), int(a)) for c, v, a in zip(literal["clicked"], (x - x.mean(axis=0)) @ axes, literal["article_id"])],
        "label double, v array<double>, article_id long",
    ).withColumn("r", array_to_vector("v"))
    expected = LogisticRegression(featuresCol="r", labelCol="label", regParam=PENALTY, standardization=False).fit(reduced)
    wanted = {r["article_id"]: r["probability"][1] for r in expected.transform(reduced).collect()}
    for row in model.ranked.collect():
        assert row["prediction"] == pytest.approx(wanted[row["article_id"]], abs=1e-4)
    got = model.recommend(n=5)
    clicked = {(u, a) for u, a in log}
    assert not [r for r in got.collect() if (r["user_id"], r["article_id"]) in clicked]
    assert got.groupBy("user_id").count().where("count <> 5").isEmpty()
    again = ClickModel(behaviors, users, listed, vecs, n_components=3).fit(counts=click_counts(behaviors, users, listed))
    assert lists(again.recommend(n=5)) == lists(got)


# --- the protocol ---------------------------------------------------------------------


def test_all_models_keep_the_protocol(spark, sf_dir):
    """Each of the ten: fit returns the model, lists have the same columns, at most n rows a user, ranks from 1; an unknown user doesn't fail."""
    t = GivenTables(spark, sf_dir)
    log = model_queries.known(t)
    rows, scores = model_queries.inter(t), model_queries.scored(t)
    models = [
        MostPopular(log),
        RingBuffer(log, 10),
        UserItemBias(scores),
        UserCF(rows),
        ItemCF(rows),
        TopicCF(rows, t.topics),
        PopularityUserCF(rows),
        WeightedProfiles(scores, t.vectors),
        CosineProfiles(log, t.articles, t.vectors),
        ClickModel(t.behaviors, t.users, t.articles, t.vectors),
    ]
    one = log.select("user_id").first()[0]
    for model in models:
        assert isinstance(model, Recommender)
        with pytest.raises(ValueError):
            model.recommend(n=3)
        assert model.fit() is model
        found = model.recommend(n=3)
        assert set(found.columns) == {"user_id", "article_id", "score", "rank"}, type(model)
        for user, ranks in ranks_of(found).items():
            assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) <= 3 and user is not None
        few = ranks_of(model.recommend(users_of(spark, one, 10**9), n=3))
        assert set(few) <= {one, 10**9} and one in few


def ranks_of(found):
    out = {}
    for r in found.collect():
        out.setdefault(r["user_id"], []).append(r["rank"])
    return {user: sorted(ranks) for user, ranks in out.items()}


@pytest.mark.parametrize("model", [UserCF, ItemCF])
def test_offers_are_worked_off_in_passes(spark, model, monkeypatch):
    from newsloom.operators import ranking

    rows = [(u, a, float(1 + (u * 7 + a * 3) % 5)) for u in range(30) for a in range(25) if (u * 5 + a * 11) % 4]
    fitted = model(spark.createDataFrame(rows, "user_id long, article_id long, interaction_score double")).fit()
    whole = fitted.recommend(n=3).collect()
    passes, stored = [], ranking.store
    monkeypatch.setattr(ranking, "PASS_OFFERS", 10)
    monkeypatch.setattr(ranking, "store", lambda df: passes.append(1) or stored(df))
    key = lambda r: (r["user_id"], r["rank"])
    assert sorted(fitted.recommend(n=3).collect(), key=key) == sorted(whole, key=key)
    assert len(passes) > 1
