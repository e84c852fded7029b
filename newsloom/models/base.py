"""What every recommender offers."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@runtime_checkable
class Recommender(Protocol):
    """``recommend`` returns (user_id, article_id, score, rank), rank from 1 within a user."""

    def fit(self, *args, **kwargs) -> "Recommender": ...

    def recommend(self, users: DataFrame | None = None, n: int = 5) -> DataFrame: ...


def check_fitted(model: object, attribute: str) -> None:
    if getattr(model, attribute, None) is None:
        raise ValueError("fit the model before asking it for scores")


def users_frame(spark: SparkSession, *ids: int) -> DataFrame:
    """A ``users`` argument for a few users by id."""
    return spark.createDataFrame([(int(i),) for i in ids], "user_id long")


def distinct_users(users: DataFrame) -> DataFrame:
    return users.select(F.col("user_id").cast("long").alias("user_id")).where("user_id IS NOT NULL").distinct()


def ordered_list(ranked: DataFrame, *columns: str) -> Column:
    """The rows of a short ranked table as one array, in the order of ``columns[0]``.

    A scalar subquery: Spark runs it once and hands the value to the outer plan. Only
    for tables cut to a fixed number of rows.
    """
    return ranked.agg(F.sort_array(F.collect_list(F.struct(*columns)))).scalar()


def unroll(df: DataFrame, user: str, items: Column, n: int, score: str = "score") -> DataFrame:
    """(user_id, article_id, score, rank) of the first ``n`` entries of an array per row."""
    rows = df.select(user, F.posexplode(F.slice(items, 1, n)).alias("at", "item"))
    return rows.select(
        user,
        F.col("item.article_id").alias("article_id"),
        F.col(f"item.{score}").cast("double").alias("score"),
        (F.col("at") + 1).cast("int").alias("rank"),
    )
