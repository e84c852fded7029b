"""User-based collaborative filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.models.base import check_fitted, distinct_users
from newsloom.operators.interactions import weighted_interactions
from newsloom.operators.ranking import best_unread, list_entries, lists_of
from newsloom.operators.similarity import require_unique_pairs, top_k_cosine
from newsloom.session import pin, store


def scored_interactions(
    interactions: DataFrame, binary: bool, scroll_weight: float, readtime_weight: float
) -> DataFrame:
    """(user_id, article_id, interaction_score): the weighted score, or 1 in a binary model."""
    if binary:
        scored = interactions.withColumn("interaction_score", F.lit(1.0))
    elif "interaction_score" in interactions.columns:
        scored = interactions
    else:
        scored = weighted_interactions(interactions, scroll_weight, readtime_weight)
    return scored.select(
        F.col("user_id").cast("long").alias("user_id"),
        F.col("article_id").cast("long").alias("article_id"),
        F.col("interaction_score").cast("double").alias("interaction_score"),
    )


class UserCF:
    """Articles of the most similar users; the similarity chooses the users and does not weigh them."""

    def __init__(self, interactions: DataFrame, binary_model: bool = False, check_keys: bool = False):
        self.interactions = interactions
        self.binary_model = binary_model
        self.check_keys = check_keys
        self.neighbors: DataFrame | None = None

    def fit(
        self, scroll_weight: float = 1.0, readtime_weight: float = 1.0, sim_size: int = 10, **limits: int
    ) -> "UserCF":
        """``limits`` are the size bounds of ``top_k_cosine``."""
        if self.check_keys:
            require_unique_pairs(self.interactions, "user_id", "article_id")
        self.scored = store(scored_interactions(self.interactions, self.binary_model, scroll_weight, readtime_weight))
        self.neighbors = pin(
            top_k_cosine(
                self.scored, "user_id", "article_id", "interaction_score", sim_size, **limits
            )
        )
        return self

    def recommend(
        self, users: DataFrame | None = None, n: int = 5, allow_read_articles: bool = False
    ) -> DataFrame:
        """Sum of the neighbours' scores per article, or their number in a binary model.

        A user without neighbours gets no rows.
        """
        check_fitted(self, "neighbors")
        near = self.neighbors.select(F.col("entity").alias("user_id"), "neighbor")
        if users is not None:
            near = near.join(distinct_users(users), "user_id", "left_semi")
        theirs = self.scored.select(
            F.col("user_id").alias("neighbor"),
            "article_id",
            (F.lit(1.0) if self.binary_model else F.coalesce("interaction_score", F.lit(0.0))).alias("value"),
        )
        lists = store(lists_of(theirs, "neighbor", "article_id", "value"))
        read = None if allow_read_articles else self.scored.select("user_id", "article_id")
        held = lists.groupBy("neighbor").agg(F.sum(list_entries()).alias("count"))
        offers = near.join(held, "neighbor").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        unread = F.lit(None).cast("long").alias("read")
        offers_of = lambda some: some.join(lists, "neighbor").select("user_id", unread, "held")
        return best_unread(near, offers_of, read, n, offers, self.scored.count())
