"""Item similarity by topics, walked from a user's best-liked article down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import best_first
from newsloom.models.base import check_fitted, distinct_users
from newsloom.models.user_cf import scored_interactions
from newsloom.operators.ranking import HOT_GROUP_ROWS, large_groups, rank_within, running_total, top_n
from newsloom.operators.similarity import top_k_cosine
from newsloom.session import pin


class TopicCF:
    """``topics`` is the long form (article_id, topic): a 0/1 topic column per row."""

    def __init__(self, interactions: DataFrame, topics: DataFrame, binary_model: bool = False):
        self.interactions = interactions
        self.topics = topics
        self.binary_model = binary_model
        self.neighbors: DataFrame | None = None

    def fit(self, sim_size: int = 10, **limits: int) -> "TopicCF":
        self.scored = pin(scored_interactions(self.interactions, self.binary_model, 1.0, 1.0))
        flags = self.topics.select("article_id", "topic").dropna().distinct().withColumn("flag", F.lit(1.0))
        # Few topic sets cover many articles, so equal ones are searched once.
        self.neighbors = pin(top_k_cosine(flags, "article_id", "topic", "flag", sim_size, **limits))
        return self

    def recommend(
        self,
        users: DataFrame | None = None,
        n: int = 5,
        allow_read_articles: bool = False,
        hot_rows: int = HOT_GROUP_ROWS,
    ) -> DataFrame:
        """Score-weighted similarity to the user's articles, taken in order of score.

        The walk stops after the article that brings the number of candidates to ``n``,
        so later articles add nothing: each candidate has the step at which
        it first appears; the running number of candidates gives the last step. An
        article without a score counts 0 and comes last. Users with more than ``hot_rows``
        articles are ranked and summed across tasks.
        """
        check_fitted(self, "neighbors")
        read = self.scored
        mine = read if users is None else read.join(distinct_users(users), "user_id", "left_semi")
        mine = mine.withColumn("liking", F.coalesce("interaction_score", F.lit(0.0)))
        large = large_groups(mine, "user_id", hot_rows)
        order = best_first("liking", "article_id")
        steps = rank_within(mine, "user_id", order, "step", "_read", hot_rows, any_large=large is not None)
        near = self.neighbors.select(F.col("entity").alias("article_id"), F.col("neighbor").alias("candidate"), "sim")
        offers = steps.join(near, "article_id").select(
            "user_id", F.col("candidate").alias("article_id"), "step", (F.col("liking") * F.col("sim")).alias("part")
        )
        if not allow_read_articles:
            offers = offers.join(read.select("user_id", "article_id"), ["user_id", "article_id"], "left_anti")
        # The stops and the scores both read the offers.
        offers = pin(offers)
        new_by_step = (
            offers.groupBy("user_id", "article_id")
            .agg(F.min("step").alias("step"))
            .groupBy("user_id", "step")
            .agg(F.count("*").alias("new"))
        )
        so_far = running_total(new_by_step, "user_id", [F.col("step").asc()], "new", "known", large)
        stops = so_far.where(F.col("known") >= n).groupBy("user_id").agg(F.min("step").alias("stop"))
        walked = offers.join(stops, "user_id", "left").where("stop IS NULL OR step <= stop")
        scores = walked.groupBy("user_id", "article_id").agg(F.sum("part").alias("score"))
        return top_n(scores, "user_id", "score", "article_id", n)
