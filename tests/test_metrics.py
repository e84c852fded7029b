import math

import pytest
from pyspark.sql import functions as F

from newsloom.models import ItemCF, MostPopular
from newsloom.operators import metrics
from newsloom.plans import experiments
from newsloom.plans.given_tables import GivenTables


def recs(spark, rows):
    return spark.createDataFrame(rows, "user_id long, article_id long, rank int")


def test_ranking_by_hand(spark):
    found = recs(spark, [(1, a, i + 1) for i, a in enumerate("abcde".encode())])
    test = spark.createDataFrame([(1, ord(c)) for c in "bbez"] + [(2, ord("a"))], "user_id long, article_id long")
    r = {x["user_id"]: x for x in metrics.user_metrics(found, test, 5).collect()}
    log2 = math.log2
    assert r[1]["precision"] == pytest.approx(2 / 5)
    assert r[1]["recall"] == pytest.approx(2 / 3)
    # Candidates a, b, e, z; one of them is not relevant, three recommendations miss.
    assert r[1]["fpr"] == pytest.approx(3 / 1)
    assert r[1]["ndcg"] == pytest.approx((1 / log2(3) + 1 / log2(6)) / (1 + 1 / log2(3) + 1 / 2))
    assert r[1]["ap"] == pytest.approx((1 / 2 + 2 / 5) / 3)
    # User 2 got nothing: counted as 0.
    assert (r[2]["precision"], r[2]["ndcg"], r[2]["ap"], r[2]["fpr"]) == (0.0, 0.0, 0.0, 0.0)
    macro = metrics.evaluate(found, test, 5).first()
    assert (macro["precision"], macro["users"]) == (pytest.approx(0.2), 2)
    ranking = metrics.evaluate_ranking(found, test, 5, skip_empty=True).first()
    assert (ranking["precision_at_k"], ranking["users"]) == (pytest.approx(0.4), 1)
    one = metrics.evaluate_ranking(found, test, 5, user_sample=1).first()
    assert one["users"] == 1
    among = metrics.evaluate(found, test, 5, users=spark.createDataFrame([(2,)], "user_id long")).first()
    assert (among["precision"], among["users"]) == (0.0, 1)
    overlap = metrics.prediction_overlap(found, test)
    assert sorted(x["article_id"] for x in overlap.collect()) == [ord("b"), ord("e")]


def test_nothing_to_evaluate(spark):
    none = recs(spark, [])
    assert tuple(metrics.evaluate(none, none.drop("rank"), 5).first()) == (0.0, 0.0, 0.0, 0)


def test_repeated_recommendations_count_again(spark):
    found = recs(spark, [(1, 5, 1), (1, 5, 2)])
    test = spark.createDataFrame([(1, 5)], "user_id long, article_id long")
    assert metrics.user_metrics(found, test, 5).first()["precision"] == pytest.approx(2 / 5)


@pytest.mark.parametrize(
    "counts, expected", [([0, 0, 0, 4], 0.75), ([1, 1, 1, 1], 0.0), ([0, 0], 0.0), ([1, 2, 3], 2 / 9), ([5, 0, 1, 1, 5, 9], None)]
)
def test_gini(spark, counts, expected):
    catalogue = spark.createDataFrame([(i,) for i in range(len(counts))], "article_id long")
    rows = [(u, i, 1) for i, c in enumerate(counts) for u in range(c)]
    rows += [(0, 999, 1)]  # not in the catalogue, so not counted
    n, ordered = len(counts), sorted(counts)
    direct = sum((2 * (i + 1) - n - 1) * c for i, c in enumerate(ordered)) / (n * sum(counts)) if sum(counts) else 0.0
    got = metrics.gini(recs(spark, rows), catalogue).first()["gini"]
    assert got == pytest.approx(direct)
    if expected is not None:
        assert got == pytest.approx(expected)


def test_diversity(spark):
    catalogue = spark.createDataFrame([(i,) for i in range(4)], "article_id long")
    found = recs(spark, [(1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 3, 6)])
    assert metrics.aggregate_diversity(found, catalogue, 5).first()["diversity"] == 0.5
    only = spark.createDataFrame([(2,)], "user_id long")
    assert metrics.aggregate_diversity(found, catalogue, 5, users=only).first()["diversity"] == 0.25


def test_bounds_on_given_tables(spark, sf_dir):
    t = GivenTables(spark, sf_dir)
    log = t.behaviors.where("article_id IS NOT NULL")
    compared = experiments.compare_splits(log, lambda train: MostPopular(train).fit()).collect()
    assert {r["split"] for r in compared} == {"random", "time"}
    for r in compared:
        assert all(0.0 <= r[c] <= 1.0 for c in ("precision", "recall", "fpr"))


def test_same_result_for_one_and_many_partitions(spark, sf_dir):
    t = GivenTables(spark, sf_dir)
    from newsloom.operators.interactions import collaborative_interactions

    rows = collaborative_interactions(t.train, t.validation)
    one = ItemCF(rows.coalesce(1)).fit().recommend(n=5)
    many = ItemCF(rows.repartition(8)).fit().recommend(n=5)
    columns = ["user_id", "article_id", "rank", F.round("score", 6).alias("score")]
    assert one.select(columns).exceptAll(many.select(columns)).isEmpty()
    given = one.groupBy("user_id").agg(F.max("rank").alias("last"), F.count("*").alias("n"))
    assert given.where("last <> n OR n > 5").isEmpty()
    assert one.join(rows, ["user_id", "article_id"], "left_semi").isEmpty()
