"""Most popular: the same best-read articles for everyone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.models.base import check_fitted, distinct_users, ordered_list, unroll


def popularity(behaviors: DataFrame) -> DataFrame:
    """(article_id, count): rows per article; a partial count per map task, so no hot key."""
    return behaviors.where("article_id IS NOT NULL").groupBy("article_id").agg(F.count("*").alias("count"))


def most_read(counts: DataFrame, n: int) -> DataFrame:
    """(article_id, count, position) of the ``n`` largest counts, ties by id.

    The limit runs as a bounded top-k in every task; the window sees its n rows only.
    """
    top = counts.orderBy(F.col("count").desc(), F.col("article_id").asc()).limit(n)
    order = W.orderBy(F.col("count").desc(), F.col("article_id").asc())
    return top.withColumn("position", F.row_number().over(order))


class MostPopular:
    """``counts`` (article_id, count) stand in for the log if they are kept elsewhere (``PopularityState``)."""

    def __init__(self, behaviors: DataFrame, counts: DataFrame | None = None):
        self.behaviors = behaviors
        self.kept_counts = counts
        self.counts: DataFrame | None = None

    def fit(self) -> "MostPopular":
        """Nothing is run: a recommendation reads the counts once, as one partial aggregate."""
        self.counts = popularity(self.behaviors) if self.kept_counts is None else self.kept_counts
        return self

    def recommend(self, users: DataFrame | None = None, n: int = 5) -> DataFrame:
        """Articles already read are not left out."""
        check_fitted(self, "counts")
        top = most_read(self.counts, n).withColumn("score", F.col("count").cast("double"))
        listed = ordered_list(top, "position", "article_id", "score")
        who = distinct_users(self.behaviors if users is None else users)
        return unroll(who, "user_id", listed, n)
