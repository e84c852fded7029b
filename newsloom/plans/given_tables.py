"""The given tables read as a news data set.

Events are impressions, embeddings are articles with their vectors, order lines are a
second, wider impression log. Every view is lazy and reads only the columns it names.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources.parquet import read_parquet


class GivenTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return read_parquet(self.spark, f"{self.root}/{name}.parquet")

    @staticmethod
    def as_behaviors(events: DataFrame) -> DataFrame:
        """Signups play the home page, errors lack the scroll depth; also valid on a stream."""
        kind = F.col("event_type")
        article = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
        return events.select(
            F.col("event_id").alias("impression_id"),
            "user_id",
            F.when(kind == "signup", F.lit(None)).otherwise(article).alias("article_id"),
            F.col("ts").alias("impression_time"),
            F.col("value").alias("read_time"),
            F.when(kind == "error", F.lit(None)).otherwise((F.col("event_id") * 37 % 101).cast("double")).alias("scroll_percentage"),
            F.lit(None).cast("long").alias("age"),
            kind.alias("device_type"),
        )

    @cached_property
    def behaviors(self) -> DataFrame:
        return self.as_behaviors(self.table("events"))

    @cached_property
    def train(self) -> DataFrame:
        return self.behaviors.where("impression_id % 5 <> 0")

    @cached_property
    def validation(self) -> DataFrame:
        return self.behaviors.where("impression_id % 5 = 0")

    @cached_property
    def articles(self) -> DataFrame:
        items, dates = self.table("embeddings"), self.table("orders")
        return items.join(dates, F.col("o_orderkey") == F.col("vec_id") + 1).select(
            F.col("vec_id").alias("article_id"),
            F.col("label").cast("long").alias("category"),
            F.col("o_orderdate").alias("published_time"),
            ((F.col("vec_id") % 2) == 0).alias("premium"),
        )

    @cached_property
    def topics(self) -> DataFrame:
        """Long form of a two-entry topics list."""
        listed = F.array(F.col("label").cast("long"), F.lit(10) + F.col("vec_id") % 7)
        return self.table("embeddings").select(F.col("vec_id").alias("article_id"), F.explode(listed).alias("topic"))

    @cached_property
    def topic_lists(self) -> DataFrame:
        """Articles with their topics as a list column; every tenth list is empty."""
        listed = F.array(F.col("label").cast("long"), F.lit(10) + F.col("vec_id") % 7)
        empty = F.expr("cast(array() as array<bigint>)")
        return self.table("embeddings").select(
            F.col("vec_id").alias("article_id"),
            ((F.col("vec_id") % 2) == 0).alias("premium"),
            F.when(F.col("vec_id") % 10 == 0, empty).otherwise(listed).alias("topics"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("document_vector"))

    @cached_property
    def users(self) -> DataFrame:
        return self.table("events").select("user_id").distinct()

    @cached_property
    def history(self) -> DataFrame:
        """Two parallel lists per user and span of 1024 impressions, in time order.

        The span bounds a list whatever one user reads; a user has several rows.
        """
        entry = F.struct("impression_time", "impression_id", "article_id", "read_time")
        lists = (
            self.behaviors.where("article_id IS NOT NULL")
            .groupBy("user_id", F.expr("impression_id DIV 1024").alias("span"))
            .agg(F.array_sort(F.collect_list(entry)).alias("a"))
        )
        return lists.select(
            "user_id",
            F.transform("a", lambda x: x["article_id"]).alias("article_id_fixed"),
            F.transform("a", lambda x: x["read_time"]).alias("read_time_fixed"),
        )

    @cached_property
    def big_behaviors(self) -> DataFrame:
        """Order lines as impressions: a wide catalogue, sparse, with ties in time."""
        lines, orders = self.table("lineitem"), self.table("orders")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("impression_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("article_id"),
            F.col("o_orderdate").alias("impression_time"),
            F.col("l_quantity").alias("read_time"),
            (F.col("l_discount") * 1000).alias("scroll_percentage"),
        )

    @cached_property
    def big_train(self) -> DataFrame:
        return self.big_behaviors.where("impression_id % 5 <> 0")

    @cached_property
    def big_validation(self) -> DataFrame:
        return self.big_behaviors.where("impression_id % 5 = 0")
