"""Popularity counts kept up to date by loads and corrections, so that no reader scans the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.models.popularity import popularity
from newsloom.streaming.manifest import MergedRuns


class PopularityState:
    """Rows per article over all loads; the models take ``counts()`` in place of the log.

    Every load adds its own counts as a run, a correction the difference between the rows that should have come and those that
    did. Loads are numbered upwards; a repeated number changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4):
        self.runs = MergedRuns(spark, path, {"article_id": "long"}, ["count"], fanout)

    def add(self, behaviors: DataFrame, load: int) -> None:
        self.runs.add(popularity(behaviors), load)

    def correct(self, wrong: DataFrame, right: DataFrame, load: int) -> None:
        """Take the rows of ``wrong`` back and add those of ``right``."""
        back = popularity(wrong).withColumn("count", -F.col("count"))
        self.runs.add(popularity(right).unionByName(back), load)

    def counts(self) -> DataFrame:
        """(article_id, count), as ``popularity`` gives for the whole log."""
        return self.runs.rows()
