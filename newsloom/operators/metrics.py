"""Ranking metrics of recommendation tables (user_id, article_id, rank)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import rank_discount
from newsloom.operators.clean import known_pairs
from newsloom.operators.splits import sample_users


def _ideal_gain(relevant: Column, k: int) -> Column:
    """Best possible discounted gain for a number of relevant items: a k-entry prefix sum."""
    sums, total = [], 0.0
    for rank in range(1, k + 1):
        total += 1.0 / math.log2(rank + 1)
        sums.append(F.lit(total))
    return F.element_at(F.array(*sums), F.least(relevant, F.lit(k)).cast("int"))


def user_metrics(recommendations: DataFrame, test: DataFrame, k: int = 5, users: DataFrame | None = None) -> DataFrame:
    """One row per user with test articles: precision, recall, fpr, ndcg and ap at ``k``.

    The candidates for false positives are the distinct test articles. A user without
    recommendations counts 0 throughout; ``returned`` tells how many were given. A
    repeated recommendation counts again. ``users`` restricts the population.
    """
    relevant = known_pairs(test)
    candidates = relevant.agg(F.countDistinct("article_id")).scalar()
    counted = relevant.groupBy("user_id").agg(F.count("*").alias("relevant"))
    if users is not None:
        counted = counted.join(users.select("user_id").distinct(), "user_id", "left_semi")
    hits = (
        recommendations.where(F.col("rank") <= k)
        .select(F.col("user_id").cast("long").alias("user_id"), F.col("article_id").cast("long").alias("article_id"), "rank")
        .join(relevant.withColumn("hit", F.lit(True)), ["user_id", "article_id"], "left")
        .groupBy("user_id")
        .agg(
            F.count("*").alias("returned"),
            F.count("hit").alias("hits"),
            F.sum(F.when(F.col("hit"), rank_discount(F.col("rank")))).alias("gain"),
            # At most k ranks per user.
            F.sort_array(F.collect_list(F.when(F.col("hit"), F.col("rank")))).alias("hit_ranks"),
        )
    )
    rows = counted.join(hits, "user_id", "left").na.fill(0, ["returned", "hits"]).na.fill(0.0, ["gain"])
    at_hit = F.transform("hit_ranks", lambda rank, i: (i + 1).cast("double") / rank.cast("double"))
    precision_sum = F.coalesce(F.aggregate(at_hit, F.lit(0.0), lambda total, p: total + p), F.lit(0.0))
    share = lambda part, whole: part.cast("double") / whole.cast("double")
    negatives = candidates - F.col("relevant")
    return rows.select(
        "user_id",
        "relevant",
        "returned",
        "hits",
        share(F.col("hits"), F.lit(k)).alias("precision"),
        share(F.col("hits"), F.col("relevant")).alias("recall"),
        F.when(negatives > 0, (F.col("returned") - F.col("hits")) / F.nullif(negatives, F.lit(0)))
        .otherwise(F.lit(0.0))
        .alias("fpr"),
        (F.col("gain") / _ideal_gain(F.col("relevant"), k)).alias("ndcg"),
        (precision_sum / F.least("relevant", F.lit(k)).cast("double")).alias("ap"),
    )


def _average(name: str) -> Column:
    return F.coalesce(F.avg(name), F.lit(0.0))


def evaluate(recommendations: DataFrame, test: DataFrame, k: int = 5, users: DataFrame | None = None) -> DataFrame:
    """One row (precision, recall, fpr, users): averages over the users with test articles."""
    return user_metrics(recommendations, test, k, users).agg(
        _average("precision").alias("precision"),
        _average("recall").alias("recall"),
        _average("fpr").alias("fpr"),
        F.count("*").alias("users"),
    )


def evaluate_ranking(
    recommendations: DataFrame,
    test: DataFrame,
    k: int = 5,
    users: DataFrame | None = None,
    user_sample: int | None = None,
    seed: int = 42,
    skip_empty: bool = False,
) -> DataFrame:
    """One row (precision_at_k, map_at_k, ndcg_at_k, users).

    The mean of precision@k and the mean of average precision both go under their own
    names. ``users`` is the population, e.g. train users; ``skip_empty`` leaves out
    users without recommendations instead of counting 0.
    """
    population = users
    if user_sample is not None:
        pool = known_pairs(test)
        if users is not None:
            pool = pool.join(users.select("user_id").distinct(), "user_id", "left_semi")
        population = sample_users(pool, user_sample, seed)
    rows = user_metrics(recommendations, test, k, population)
    if skip_empty:
        rows = rows.where("returned > 0")
    return rows.agg(
        _average("precision").alias("precision_at_k"),
        _average("ap").alias("map_at_k"),
        _average("ndcg").alias("ndcg_at_k"),
        F.count("*").alias("users"),
    )


def aggregate_diversity(
    recommendations: DataFrame, catalogue: DataFrame, k: int = 5, users: DataFrame | None = None
) -> DataFrame:
    """One row (recommended, catalogue, diversity): distinct recommended over distinct listed.

    The numerator counts every recommended article, listed or not.
    """
    given = recommendations.where(F.col("rank") <= k)
    if users is not None:
        given = given.join(users.select("user_id").distinct(), "user_id", "left_semi")
    listed = catalogue.agg(F.countDistinct("article_id")).scalar()
    return given.agg(F.countDistinct("article_id").alias("recommended")).select(
        "recommended",
        listed.alias("catalogue"),
        F.coalesce(F.try_divide(F.col("recommended").cast("double"), listed.cast("double")), F.lit(0.0)).alias("diversity"),
    )


def gini(recommendations: DataFrame, catalogue: DataFrame, k: int = 5, users: DataFrame | None = None) -> DataFrame:
    """One row (items, recommendations, gini) over the whole catalogue.

    Articles with equal counts share one row (count, multiplicity), so the ranks are
    a prefix sum over the distinct counts: fewer than the square root of twice the
    number of recommendations. A block of m equal counts after ``before`` smaller ones
    holds the ranks before + 1 ... before + m.
    """
    given = recommendations.where(F.col("rank") <= k)
    if users is not None:
        given = given.join(users.select("user_id").distinct(), "user_id", "left_semi")
    counts = given.groupBy("article_id").agg(F.count("*").alias("count"))
    blocks = (
        catalogue.select("article_id")
        .join(counts, "article_id", "left")
        .na.fill(0, ["count"])
        .groupBy("count")
        .agg(F.count("*").alias("m"))
    )
    before = F.coalesce(F.sum("m").over(W.orderBy("count").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = blocks.withColumn("before", before)
    c, m, b = (F.col(x).cast("double") for x in ("count", "m", "before"))
    rank_sum = m * (F.lit(2.0) * b + m + F.lit(1.0)) / F.lit(2.0)
    total = ranked.agg(F.sum(m).alias("n"), F.sum(c * m).alias("s"), F.sum(c * rank_sum).alias("w"))
    n, s, w = F.col("n"), F.col("s"), F.col("w")
    value = F.try_divide(F.lit(2.0) * w - (n + F.lit(1.0)) * s, n * s)
    return total.select(
        F.coalesce(n, F.lit(0.0)).cast("long").alias("items"),
        F.coalesce(s, F.lit(0.0)).cast("long").alias("recommendations"),
        F.coalesce(value, F.lit(0.0)).alias("gini"),
    )


def prediction_overlap(recommendations: DataFrame, test: DataFrame) -> DataFrame:
    """Recommendations that the user did read in the test part."""
    return recommendations.join(known_pairs(test), ["user_id", "article_id"], "left_semi")
