"""Per-article click statistics of a stream, from which the click model is refitted.

The model needs, per article, how often it was clicked and by how many different users.
Each micro-batch adds its rows per (user, article) to a store of few merged runs; the
statistics are one aggregation over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.interactions import clicked_pairs
from newsloom.streaming.manifest import MergedRuns


class ClickCounts:
    """``path`` belongs to one stream: its batch numbers tell what has been added."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4):
        self.spark = spark
        self.runs = MergedRuns(spark, path, {"user_id": "long", "article_id": "long"}, ["rows"], fanout)

    def add_batch(self, behaviors: DataFrame, batch_id: int) -> None:
        """Fold one micro-batch in; a retried batch counts once."""
        self.runs.add(clicked_pairs(behaviors).select("user_id", "article_id", F.lit(1).alias("rows")), batch_id)

    def follow(self, behaviors: DataFrame, checkpoint: str):
        """Start the stream over what is available now; returns the query."""
        return (
            behaviors.writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(self.add_batch)
            .start()
        )

    def compact(self, path: str) -> "ClickCounts":
        """All batches folded into one under a new path."""
        found = ClickCounts(self.spark, path, self.runs.fanout)
        found.runs.add(self.runs.rows(), 0)
        return found

    def _pairs(self) -> DataFrame:
        return self.runs.rows()

    def counts(self, users: DataFrame, articles: DataFrame) -> DataFrame:
        """(article_id, positives, negatives), as ``click_counts`` gives for the whole log."""
        listed = users.select("user_id").distinct()
        known = (
            self._pairs()
            .join(listed, "user_id", "left_semi")
            .groupBy("article_id")
            .agg(F.sum("rows").alias("positives"), F.count("*").alias("readers"))
        )
        n_users = listed.agg(F.count("*")).scalar()
        return (
            articles.select("article_id")
            .join(known, "article_id", "left")
            .na.fill(0, ["positives", "readers"])
            .select("article_id", "positives", (n_users - F.col("readers")).alias("negatives"))
        )
