"""Ring buffer: the rows that a fixed-size buffer holds at the end of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.models.base import check_fitted, distinct_users, ordered_list, unroll

BUFFER_COLUMNS = ["impression_id", "impression_time", "user_id", "article_id"]


def by_value(rows: DataFrame) -> DataFrame:
    """A buffer's few rows kept apart from the log, so that reading them does not scan it again."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


class RingBuffer:
    """``keep='oldest'`` holds the n oldest rows, ``'newest'`` the n newest.

    The buffer is filled from the newest row to the oldest by default, so that the last
    ones appended, which remain, are the oldest.
    """

    def __init__(self, behaviors: DataFrame, size: int = 10, keep: str = "oldest"):
        if keep not in ("oldest", "newest"):
            raise ValueError("keep is 'oldest' or 'newest'")
        self.behaviors = behaviors
        self.size = size
        self.keep = keep
        self.buffer: DataFrame | None = None

    def fit(self) -> "RingBuffer":
        """Slots are numbered from the last append (1) back."""
        keys = ["impression_time", "impression_id"]
        order = [F.col(c).asc() if self.keep == "oldest" else F.col(c).desc() for c in keys]
        rows = self.behaviors.select(BUFFER_COLUMNS).orderBy(*order).limit(self.size)
        self.buffer = by_value(rows.withColumn("slot", F.row_number().over(W.orderBy(*order))))
        return self

    def add_behaviors(self, rows: DataFrame) -> "RingBuffer":
        """The model after appending new rows, oldest first: each evicts the slot appended first.

        Only the buffer and the new rows are read; the log gets the rows when it is next used.
        """
        check_fitted(self, "buffer")
        times = ["impression_time", "impression_id"]
        new = rows.select(BUFFER_COLUMNS).orderBy(*[F.col(c).desc() for c in times]).limit(self.size)
        new = new.withColumn("slot", F.row_number().over(W.orderBy(*[F.col(c).desc() for c in times])))
        moved = new.withColumn("_old", F.lit(0)).unionByName(self.buffer.withColumn("_old", F.lit(1)))
        # At most two buffers of rows go through this window.
        moved = moved.withColumn("slot", F.row_number().over(W.orderBy("_old", "slot"))).drop("_old")
        model = RingBuffer(self.behaviors.unionByName(rows.select(self.behaviors.columns)), self.size, self.keep)
        model.buffer = by_value(moved.where(F.col("slot") <= self.size))
        return model

    def contents(self) -> DataFrame:
        check_fitted(self, "buffer")
        return self.buffer

    def slot(self, index: int) -> DataFrame:
        return self.contents().where(F.col("slot") == index)

    def most_recent(self, n: int) -> DataFrame:
        """The ``n`` latest rows of the buffer, in time order."""
        return self.contents().orderBy(F.col("impression_time").desc(), F.col("impression_id").desc()).limit(n)

    def most_popular(self, n: int) -> DataFrame:
        """(article_id, count, position): the most frequent articles in the buffer."""
        counts = self.contents().where("article_id IS NOT NULL").groupBy("article_id").agg(F.count("*").alias("count"))
        order = [F.col("count").desc(), F.col("article_id").asc()]
        return counts.orderBy(*order).limit(n).withColumn("position", F.row_number().over(W.orderBy(*order)))

    def length(self) -> DataFrame:
        return self.contents().agg(F.count("*").alias("length"))

    def cleared(self) -> "RingBuffer":
        """The model with an empty buffer and the same log."""
        model = RingBuffer(self.behaviors, self.size, self.keep)
        model.buffer = self.contents().where(F.lit(False))
        return model

    def current_articles(self) -> DataFrame:
        """(user_id, current): each user's latest article."""
        return self.behaviors.groupBy("user_id").agg(
            F.max_by("article_id", F.struct("impression_time", "impression_id")).alias("current")
        )

    def recommend(self, users: DataFrame | None = None, n: int = 5) -> DataFrame:
        """Buffer articles from the last append back, without the user's current one.

        An article held twice is recommended twice. A user without behavior gets the
        most frequent articles of the buffer. The buffer is ``size`` rows and reaches
        the users as a scalar array; score is minus the slot, or the frequency.
        """
        held = self.contents().withColumn("score", -F.col("slot").cast("double"))
        buffer = ordered_list(held, "slot", "article_id", "score")
        common = ordered_list(self.most_popular(n).withColumn("score", F.col("count").cast("double")), "position", "article_id", "score")
        seen = self.current_articles().withColumn("known", F.lit(True))
        who = distinct_users(self.behaviors if users is None else users)
        listed = who.join(seen, "user_id", "left").withColumns({"buffer": buffer, "common": common})
        # A user's current article may itself be unknown; then only unknown entries match it.
        walk = F.filter("buffer", lambda b: ~b["article_id"].eqNullSafe(F.col("current")))
        as_pairs = lambda items: F.transform(items, lambda b: F.struct(b["article_id"].alias("article_id"), b["score"].alias("score")))
        items = F.when(F.col("known"), as_pairs(walk)).otherwise(as_pairs(F.col("common")))
        return unroll(listed, "user_id", items, n)
