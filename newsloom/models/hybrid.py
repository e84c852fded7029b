"""User-based collaborative filtering, filled up with popular articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.models.base import distinct_users, ordered_list, unroll
from newsloom.models.popularity import most_read, popularity
from newsloom.models.user_cf import UserCF

# Length of the list that fills up short recommendations, if the caller names no other.
POPULAR_LIST = 100


class PopularityUserCF(UserCF):
    def __init__(
        self,
        interactions: DataFrame,
        binary_model: bool = False,
        check_keys: bool = False,
        counts: DataFrame | None = None,
    ):
        """``counts`` (article_id, count) stand in for the interactions' own (``PopularityState``)."""
        super().__init__(interactions, binary_model, check_keys)
        self.counts = counts

    def recommend(
        self,
        users: DataFrame | None = None,
        n: int = 5,
        allow_read_articles: bool = False,
        top_n: int | None = None,
    ) -> DataFrame:
        """The user-CF list; where it has fewer than ``n`` articles, popular ones follow.

        Only articles already in the list are left out of the fill, not those the user
        has read. A user without neighbours gets popular articles alone. Popular
        articles have rank-ordered scores at or below 0, under every collaborative one.
        ``top_n`` is the length of the popular list: POPULAR_LIST, or twice ``n`` if that is
        more, so that the list never ends before the recommendations do.
        """
        top_n = max(POPULAR_LIST, 2 * n) if top_n is None else top_n
        own = super().recommend(users, n, allow_read_articles)
        lists = own.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "article_id", "score"))).alias("own"))
        counts = popularity(self.scored) if self.counts is None else self.counts
        popular = most_read(counts, top_n).select(
            "position", F.col("article_id").cast("long").alias("article_id"), (-F.col("position")).cast("double").alias("score")
        )
        fill = ordered_list(popular, "position", "article_id", "score")
        # The pinned scores have the rows of the interactions.
        who = distinct_users(self.scored if users is None else users)
        listed = who.join(lists, "user_id", "left").withColumn("popular", fill)
        pair = lambda x: F.struct(x["article_id"].alias("article_id"), x["score"].alias("score"))
        # Both arrays are short: n entries and top_n entries.
        mine = F.coalesce(F.transform("own", pair), F.expr("array()").cast("array<struct<article_id:bigint,score:double>>"))
        taken = F.coalesce(F.transform("own", lambda x: x["article_id"]), F.expr("array()").cast("array<bigint>"))
        rest = F.transform(F.filter("popular", lambda p: ~F.array_contains(F.col("taken"), p["article_id"])), pair)
        listed = listed.withColumns({"mine": mine, "taken": taken})
        return unroll(listed, "user_id", F.concat("mine", rest), n)
