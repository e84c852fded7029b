"""User and item bias around the global mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import best_first
from newsloom.models.base import check_fitted, distinct_users
from newsloom.operators.ranking import best_unseen, global_rank
from newsloom.session import pin


class UserItemBias:
    """A cell of the user-item matrix is the mean score of its pair, 0 where there is none.

    A cell of exactly 0 counts as not rated, as it does in a matrix filled with zeros.
    """

    def __init__(self, scored: DataFrame):
        self.scored = scored
        self.cells: DataFrame | None = None

    def fit(self) -> "UserItemBias":
        self.cells = pin(
            self.scored.where("user_id IS NOT NULL AND article_id IS NOT NULL")
            .groupBy("user_id", "article_id")
            .agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("rating"))
        )
        rated = self.cells.where(F.col("rating") != 0.0)
        self.global_mean = rated.agg(F.coalesce(F.avg("rating"), F.lit(0.0)).alias("mean")).first()["mean"]
        mean = F.lit(self.global_mean)
        # Users and items come from all cells; one without a rating has bias 0.
        is_rated = F.col("rating") != 0.0
        self.user_biases = pin(
            self.cells.groupBy("user_id").agg(
                F.coalesce(F.avg(F.when(is_rated, F.col("rating") - mean)), F.lit(0.0)).alias("user_bias")
            )
        )
        residual = self.cells.join(self.user_biases, "user_id")
        item_biases = residual.groupBy("article_id").agg(
            F.coalesce(F.avg(F.when(is_rated, F.col("rating") - mean - F.col("user_bias"))), F.lit(0.0)).alias("item_bias")
        )
        # The order of the items is the same for every user, so it is made once.
        self.item_biases = global_rank(item_biases, best_first("item_bias", "article_id"))
        return self

    def scorable(self, users: DataFrame) -> DataFrame:
        """Those of the users that have a bias."""
        return users.join(self.user_biases, "user_id", "left_semi")

    def recommend(self, users: DataFrame | None = None, n: int = 5) -> DataFrame:
        """Unrated items by predicted score; a user unknown to the model gets no rows."""
        check_fitted(self, "cells")
        who = self.user_biases if users is None else self.user_biases.join(distinct_users(users), "user_id", "left_semi")
        rated = self.cells.where(F.col("rating") != 0.0).select("user_id", "article_id")
        if users is not None:
            rated = rated.join(distinct_users(users), "user_id", "left_semi")
        found = best_unseen(who.select("user_id"), self.item_biases, rated, n)
        return found.join(who, "user_id").select(
            "user_id",
            "article_id",
            (F.lit(self.global_mean) + F.col("user_bias") + F.col("item_bias")).alias("score"),
            F.col("rank").cast("int").alias("rank"),
        )

    def user_ratings(self, users: DataFrame, dense: bool = False) -> DataFrame:
        """(user_id, article_id, rating) of the users; ``dense`` adds the zero cells."""
        check_fitted(self, "cells")
        who = distinct_users(users)
        own = self.cells.join(who, "user_id", "left_semi")
        if not dense:
            return own
        from newsloom.operators.interactions import user_article_pairs

        known = who.join(self.user_biases, "user_id", "left_semi")
        pairs = user_article_pairs(known, self.item_biases.select("article_id"))
        return pairs.join(own, ["user_id", "article_id"], "left").na.fill(0.0, ["rating"])

    def predict(self, pairs: DataFrame, strict: bool = False) -> DataFrame:
        """``pairs`` with their predicted score; unknown ids are dropped, or raise if ``strict``."""
        check_fitted(self, "cells")
        if strict:
            for key, known in (("user_id", self.user_biases), ("article_id", self.item_biases)):
                unknown = pairs.join(known, key, "left_anti").select(key).first()
                if unknown is not None:
                    raise ValueError(f"{key} {unknown[0]} is not in the model")
        scored = pairs.join(self.user_biases, "user_id").join(self.item_biases.drop("position"), "article_id")
        prediction = F.lit(self.global_mean) + F.col("user_bias") + F.col("item_bias")
        return scored.withColumn("score", prediction).drop("user_bias", "item_bias")
